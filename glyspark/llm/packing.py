"""Packing documents into as few fixed-size sequences as possible.

Every document becomes ids plus an end id; longer ones are cut into full pieces after a first, maybe
shorter one. The instance is then a histogram of piece lengths (at most `capacity` counts), on which

1. Martello-Toth dominance fixes sets that some optimal packing contains: a piece that nothing fits
   beside, a pair that fills a sequence exactly, the largest fitting piece where no two others fit,
   and a pair of others that matches every alternative pair; then
2. best fit, longest first, places the rest, each into the fullest sequence that takes it.

Both steps handle whole runs of equal lengths, so the plan is short and independent of the number of
rows. Each piece finds its place from its rank among the pieces of its length; ranks come from salted
groups of a length and their cumulated counts. The salt comes from a row number of the written pieces, so that rows
which repeat an id or a text spread like others.

Null text counts as empty (one piece, the end id). Repeated rows and null ids are packed like others.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from ._io import Workspace, byte_chunks, text_buffers
from ._tokens import byte_encoder, default_path

CAPACITY = 1024
END_ID = 2
#: Least rows aimed at per group of the rank computation; a length of many has groups of about the root of its rows.
GROUP = 200


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids' bytes) of every piece."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode = byte_encoder(path)
        for batch in batches:
            ids_in = batch.column(0)
            raw, offsets = text_buffers(batch.column(1))
            for lo, hi in byte_chunks(offsets):
                row, piece, start, length, crc, data = [], [], [], [], [], []
                for i in range(lo, hi):
                    ids = encode(raw[offsets[i] : offsets[i + 1]].tobytes().decode()) + end
                    n = len(ids) // 4
                    cut = n % capacity or capacity
                    at, k = 0, 0
                    while at < n:
                        to = at + cut if not k else at + capacity
                        part = ids[4 * at : 4 * to]
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            data.append(part)
                        at, k = to, k + 1
                out = [ids_in.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(data, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class _Plan:
    """Rows (length, lo, hi, sequence, each, offset): the pieces of that length with ranks lo to hi - 1
    go to sequences from `sequence` on, `each` to a sequence, the first of them at `offset`."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {k: v for k, v in counts.items() if v > 0}
        self.used = dict.fromkeys(counts, 0)
        self.sizes = sorted(self.left)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def take(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        lo = self.used[length]
        self.rows.append((length, lo, lo + n, sequence, each, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.sizes.remove(length)

    def close(self, group: list[int], times: int) -> None:
        """Fix a set of pieces, that many times over."""
        at = 0
        for length in dict.fromkeys(group):
            each = group.count(length)
            self.take(length, each * times, self.sequences, each, at)
            at += each * length
        self.sequences += times

    def largest(self, most: int, without: list[int]) -> int:
        """The largest remaining length up to `most`, when the pieces in `without` are spoken for; 0 if none."""
        for k in range(bisect_right(self.sizes, most) - 1, -1, -1):
            s = self.sizes[k]
            if self.left[s] > without.count(s):
                return s
        return 0

    def smallest(self, n: int, without: list[int]) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - without.count(s))
            if len(out) >= n:
                break
        return out

    def dominating(self, j: int) -> list[int] | None:
        """A set with j that dominates every other set with j, of three pieces at most; None if not shown."""
        room = self.capacity - j
        first = self.largest(room, [j])
        if not first:
            return [j]
        low = self.smallest(3, [j])
        if first == room or len(low) < 2 or low[0] + low[1] > room:
            return [j, first]
        if len(low) == 3 and sum(low) <= room:
            return None
        # Two others fit at most. A pair (x, y), x >= y, is matched by (first, second) if y never exceeds second.
        second = self.largest(room - first, [j, first])
        if second and second >= self.largest(room // 2, [j]):
            return [j, first, second]
        return None

    def reduce(self) -> None:
        """One pass from the longest piece down; a fixed set counts as often as its pieces allow."""
        k = len(self.sizes) - 1
        while k >= 0:
            j = self.sizes[min(k, len(self.sizes) - 1)]
            while j in self.left and (group := self.dominating(j)):
                self.close(group, min(self.left[s] // group.count(s) for s in set(group)))
            k = bisect_left(self.sizes, j) - 1

    def best_fit(self) -> None:
        rooms: list[int] = []
        open_: dict[int, list[list[int]]] = {}

        def opened(room: int, sequence: int, n: int) -> None:
            if room and n:
                if room not in open_:
                    open_[room] = []
                    insort(rooms, room)
                open_[room].append([sequence, n])

        for length in reversed(list(self.sizes)):
            while length in self.left:
                at = bisect_left(rooms, length)
                if at == len(rooms):
                    each = self.capacity // length
                    n = self.left[length]
                    full, rest = divmod(n, each)
                    if full:
                        self.take(length, full * each, self.sequences, each, 0)
                        opened(self.capacity - each * length, self.sequences, full)
                        self.sequences += full
                    if rest:
                        self.take(length, rest, self.sequences, each, 0)
                        opened(self.capacity - rest * length, self.sequences, 1)
                        self.sequences += 1
                    continue
                room = rooms[at]
                sequence, n = open_[room].pop()
                each = min(room // length, self.left[length])
                use = min(n, self.left[length] // each)
                self.take(length, use * each, sequence, each, self.capacity - room)
                if use < n:
                    open_[room].append([sequence + use, n - use])
                if not open_[room]:
                    del open_[room]
                    rooms.remove(room)
                opened(room - each * length, sequence, use)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Plan rows and the number of sequences for a histogram of lengths."""
    p = _Plan(counts, capacity)
    p.reduce()
    p.best_fit()
    return p.rows, p.sequences


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its place there; with_ids adds the ids as bytes."""
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    cut = pieces(docs, path or default_path("byte_bpe_50k.json"), capacity, end_id, with_ids)
    # Written with the rows, the number stays theirs.
    cut = work.save(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    # At most `capacity` rows come to the driver.
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    salts = spark.createDataFrame([(n, -(-c // max(GROUP, isqrt(c)))) for n, c in counts.items()], "length long, salts long")
    keyed = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts"))).drop("salts")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = keyed.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = keyed.withColumn("rank", rank).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("rank") - 1)
    table = spark.createDataFrame(rows, "plan_length long, lo long, hi long, seq0 long, each long, offset0 long")
    # The plan's size depends on the capacity alone: runs of equal lengths, not rows.
    if len(rows) <= 200_000:
        table = F.broadcast(table)
    placed = ranked.join(table, (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", F.expr("seq0 + (rank - lo) div each").alias("sequence_id"), (F.col("offset0") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset")]
    return placed.select(*out, *(["ids"] if with_ids else []))

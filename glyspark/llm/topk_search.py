"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's code has one bit per component (component > 0). Codes are cut into segments of SEGMENT bits and
indexed by each. A query looks up its segments at radius 0, 1, 2, ...; once segment a is done at radius r, each
code within distance m * r + a has been met (else it differed in more bits than that), so a query ends when
that many distinct ids at least are verified within the covered distance.

Equal codes are one entry with their k + 1 smallest ids, which is all that a top k can use; equal queries are
answered once. Entries are dealt to shards of a bounded size, each of which is indexed once; the queries stream
through it, batch by batch, and the shards' answers are merged. Only where there are fewer shards than cores is a
shard copied, so that blocks of the queries run side by side.

Ties go to the smaller id. A query is not its own answer. Vectors that are null, empty, of another length than
most, or hold null or NaN have no code: they neither ask nor answer. Rows that repeat an id and its code
count once; an id with several codes answers with its nearest. Fewer than k others give fewer rows; an empty
table gives none. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from ._io import Workspace

K = 10
EVERY = 20
SEGMENT = 16
#: Most entries aimed at per shard; queries that are searched at once.
SHARD, AT_ONCE = 1_000_000, 64
#: About the most entries verified at once.
STEP = 1 << 21
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def codes(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, code) with the bits as binary, most significant first, padded with zeros to whole segments."""
    size = vectors.filter(F.size(column) > 0).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    bits = size[0]["d"] if size else 0

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            flat = col.flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, bits) if bits else np.zeros((0, 1))
            ok = ~np.isnan(x).any(axis=1)
            packed = np.packbits(x[ok] > 0, axis=1)
            pad = -packed.shape[1] % (SEGMENT // 8)
            packed = np.pad(packed, ((0, 0), (0, pad)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "code"])

    good = vectors.filter(F.col(id_col).isNotNull() & (F.size(column) == bits) & (F.size(column) > 0) & ~F.exists(column, lambda v: v.isNull()))
    return good.select(F.col(id_col).cast("long").alias("id"), column).mapInArrow(run, "id long, code binary")


class MultiIndex:
    """Segment tables over distinct codes; ids: how many ids (capped at need) each code stands for."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.seg = rows.view(">u2").astype(np.uint16) if len(rows) else np.zeros((0, max(rows.shape[1] // 2, 1)), np.uint16)
        self.ids, self.m = ids, self.seg.shape[1]
        self.order = [np.argsort(self.seg[:, s], kind="stable") for s in range(self.m)]
        self.start = [np.searchsorted(self.seg[o, s], np.arange((1 << SEGMENT) + 1)) for s, o in enumerate(self.order)]

    def search(self, queries: np.ndarray, need: int, members: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, distance) triples, sorted so, that hold each query's `need` nearest ids at least.

        Without members, no id may stand for two codes. With them (offsets by entry, ids), any may: the triples
        are then (query, id, distance), each query's `need` nearest distinct ids by distance and id.
        """
        q = queries.view(">u2").astype(np.uint16)
        n, far = len(q), SEGMENT * self.m
        hist = np.zeros((n, far + 1), np.int64)
        active = np.arange(n)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        best = (np.zeros(0, np.int64),) * 3
        for r in range(SEGMENT + 1):
            masks = _masks(r)
            for a in range(self.m):
                if not len(active):
                    break
                probe = (q[active, a][:, None] ^ masks[None, :]).astype(np.int64)
                lo, hi = self.start[a][probe], self.start[a][probe + 1]
                many = (hi - lo).ravel()
                total = int(many.sum())
                each = many.reshape(len(active), -1)
                for part in np.array_split(np.arange(len(active)), min(len(active), 1 + total // STEP)) if total else []:
                    many, low = each[part].ravel(), lo[part].ravel()
                    ask = np.repeat(np.repeat(active[part], len(masks)), many)
                    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                    entry = self.order[a][at]
                    apart = _ONES[self.seg[entry] ^ q[ask]]
                    # Met here first: no earlier segment lies within r, no later one within r - 1.
                    new = (apart[:, :a] > r).all(axis=1) & (apart[:, a + 1 :] >= r).all(axis=1)
                    ask, entry, dist = ask[new], entry[new], apart[new].sum(axis=1, dtype=np.int64)
                    if members is None:
                        np.add.at(hist, (ask, dist), self.ids[entry])
                        got.append((ask, entry, dist))
                    else:
                        best = _nearest_ids(best, _members(ask, entry, dist, members), need)
                if members is not None and total:
                    hist[:] = 0
                    np.add.at(hist, (best[0], best[2]), 1)
                covered = min(self.m * r + a, far)
                active = active[hist[active, : covered + 1].sum(axis=1) < need]
        if members is not None:
            return best
        if not got:
            z = np.zeros(0, np.int64)
            return z, z, z
        ask, entry, dist = (np.concatenate(x) for x in zip(*got, strict=True))
        # Nothing beyond the distance at which enough ids are known can be among the nearest.
        limit = np.argmax(np.cumsum(hist, axis=1) >= need, axis=1)
        limit[hist.sum(axis=1) < need] = far
        keep = dist <= limit[ask]
        ask, entry, dist = ask[keep], entry[keep], dist[keep]
        order = np.lexsort((entry, dist, ask))
        return ask[order], entry[order], dist[order]


def _members(ask: np.ndarray, entry: np.ndarray, dist: np.ndarray, members: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of all ids of the entries."""
    offsets, flat = members
    many = np.diff(offsets)[entry]
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(offsets[entry], many)
    return np.repeat(ask, many), flat[at], np.repeat(dist, many)


def _nearest_ids(held: tuple, more: tuple, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's `need` nearest ids of both, an id at its least distance.

    An id that is cut has `need` others before it, which only come nearer; should it, it is met anew.
    """
    ask, ids, dist = (np.concatenate(x) for x in zip(held, more, strict=True))
    order = np.lexsort((dist, ids, ask))
    ask, ids, dist = ask[order], ids[order], dist[order]
    first = np.ones(len(ask), bool)
    first[1:] = (ask[1:] != ask[:-1]) | (ids[1:] != ids[:-1])
    ask, ids, dist = ask[first], ids[first], dist[first]
    order = np.lexsort((ids, dist, ask))
    ask, ids, dist = ask[order], ids[order], dist[order]
    keep = np.arange(len(ask)) - np.searchsorted(ask, ask) < need
    return ask[keep], ids[keep], dist[keep]


_mask_tables: dict[int, np.ndarray] = {}


def _masks(r: int) -> np.ndarray:
    """All SEGMENT-bit numbers with r ones."""
    if r not in _mask_tables:
        _mask_tables[r] = np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), r)], np.uint16)
    return _mask_tables[r]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, 2), np.uint8)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and distance of the k nearest others of each id divisible by `every`."""
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    need = k + 1
    rows = work.save(codes(vectors, id_col, column).distinct(), "codes")
    # The k + 1 smallest ids of a code: Spark cuts each group to that before the shuffle.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("n") <= need)
    entries = work.save(first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0)
    questions = work.save(asked.select("code").distinct(), "questions")
    n, q = entries.count(), questions.count()
    shards = max(1, -(-n // SHARD))
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, min(2 * cores // shards, -(-q // 64)))
    deal = F.pmod(F.xxhash64("code"), F.lit(1 << 30))
    none = F.lit(None).cast("array<long>")
    base = entries.select((deal % shards).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("role"), "code", "ids")
    ask = questions.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("code", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("role"), "code", none.alias("ids"))
    schema = pa.schema([("code", pa.binary()), ("id", pa.int64()), ("distance", pa.int32())])

    def search(batches):
        """A group's entries come first, then its queries; one index is held at a time."""
        group, parts, index, members, repeated = None, [], None, None, False
        for batch in batches:
            key = batch.column(0).to_numpy() * blocks + batch.column(1).to_numpy()
            role = batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (role[1:] != role[:-1]))) if len(key) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(key)], strict=True):
                some = batch.slice(lo, hi - lo)
                if key[lo] != group:
                    group, parts, index = key[lo], [], None
                if role[lo] == 0:
                    parts.append(some)
                    continue
                if not parts and index is None:
                    continue  # a shard without entries
                if index is None:
                    left = pa.Table.from_batches(parts).combine_chunks()
                    ids = left.column("ids").combine_chunks()
                    members = ids.offsets.to_numpy(), ids.values.to_numpy()
                    index, parts = MultiIndex(_matrix(left.column("code")), np.diff(members[0])), []
                    repeated = len(np.unique(members[1])) < len(members[1])
                questions = _matrix(some.column(3))
                for at in range(0, len(questions), AT_ONCE):
                    q = questions[at : at + AT_ONCE]
                    if repeated:
                        a, found, dist = index.search(q, need, members)
                    else:
                        a, found, dist = _nearest_ids((np.zeros(0, np.int64),) * 3, _members(*index.search(q, need), members), need)
                    yield pa.RecordBatch.from_arrays([pa.array([q[i].tobytes() for i in a], pa.binary()), pa.array(found), pa.array(dist.astype(np.int32))], schema=schema)

    dealt = base.unionByName(ask).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "role")
    met = dealt.mapInArrow(search, "code binary, id long, distance int")
    if shards > 1:
        w = Window.partitionBy("code").orderBy("distance", "id")
        met = met.groupBy("code", "id").agg(F.min("distance").alias("distance")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= need).drop("n")
    met = work.save(met, "met")
    pairs = asked.select(F.col("id").alias("query_id"), "code").join(met, "code").filter("query_id <> id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "distance")

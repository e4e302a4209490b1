"""Near-duplicate vectors by an inverted multi-index.

Each half of the normalised vectors has its own codebook (k-means in numpy on a bounded sample); the product
of the codebooks is a grid of cells, which grows with the number of vectors. A vector's nearest cells in
multi-sequence order, by the sum of the two halves' squared distances, are visited until the target recall, which is
calibrated on pairs of the sample and on pairs made to lie exactly at the threshold. Vectors met are verified by
cosine in double precision. A pair counts when either of the two visits the other's cell, and counts once.

Equal vectors are one entry with a weight. Tasks hold a block of a cell group and a block of its visitors,
both bounded, and return counts and a spanning forest of the links they find, never the pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
lengths do not link, and each length has a grid of its own. Components of any finite size count: vectors are scaled
before they are normalised. Rows that repeat an id count as vectors of their own in n_links and share a component. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._io import Workspace
from ._words import mix
from .components import components

COSINE = 0.9
#: Target recall: of pairs at the threshold itself, and of those found in the sample.
RECALL, RECALL_SEEN = 0.97, 0.999
#: Bounds: sampled vectors for the codebooks, vectors aimed at per cell, rows of a block.
SAMPLE, CELL, BLOCK = 16_384, 40, 4096
#: Most words of a codebook: one for each 16 vectors of the sample. With more than CELL * WORDS ** 2 vectors (40 million)
#: cells hold more of them, in more blocks.
WORDS = SAMPLE // 16


def multi_sequence(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first cells (i, j) of each row in order of a[i] + b[j], and these sums; a and b sorted along their rows.

    All rows go on by one cell at a time: each place i of the first half waits with the next place of the second that
    was not taken with it, and the least of those sums is the next cell. The first `steps` cells need so many places only.
    """
    a, b = a[:, :steps], np.pad(b[:, :steps], ((0, 0), (0, 1)), constant_values=np.inf)
    rows = np.arange(len(a))
    after, front = np.zeros(a.shape, np.int64), a + b[:, :1]
    out_i, out_j, out_s = np.zeros((3, len(a), steps))
    out_i, out_j = out_i.astype(np.int64), out_j.astype(np.int64)
    for k in range(steps):
        i = front.argmin(axis=1)
        out_i[:, k], out_j[:, k], out_s[:, k] = i, after[rows, i], front[rows, i]
        after[rows, i] += 1
        front[rows, i] = a[rows, i] + b[rows, np.minimum(after[rows, i], b.shape[1] - 1)]
    return out_i, out_j, out_s


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _squares(x, c).argmin(axis=1)
        many = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], c)
        c[many == 0] = x[rng.integers(len(x), size=int((many == 0).sum()))]
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


class Grid:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float = COSINE):
        self.half, self.visits = sample.shape[1] // 2, 1
        k = int(np.clip(2 ** round(np.log2(max(np.sqrt(n / CELL), 1))), 1, WORDS))
        self.a, self.b = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)
        self.visits = self._calibrate(sample, threshold)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(x[:, : self.half], self.a), _squares(x[:, self.half :], self.b)

    def reach(self, x: np.ndarray) -> np.ndarray:
        """Each vector's distance of the last cell that it visits; cells at that very distance count as visited."""
        a, b = (np.sort(d, axis=1) for d in self.distances(x))
        steps = min(self.visits, a.shape[1] * b.shape[1])
        out = np.empty(len(x))
        for lo in range(0, len(x), 1024):
            out[lo : lo + 1024] = multi_sequence(a[lo : lo + 1024], b[lo : lo + 1024], steps)[2][:, -1]
        return out * (1 + 1e-9)

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The place of y's cell in x's sequence."""
        (a, b), (c, d) = self.distances(x), self.distances(y)
        rows = np.arange(len(x))
        target = a[rows, c.argmin(1)] + b[rows, d.argmin(1)]
        return np.array([((a[i][:, None] + b[i][None]) <= target[i]).sum() for i in rows])

    def _calibrate(self, sample: np.ndarray, threshold: float) -> int:
        rng = np.random.default_rng(9)
        x = sample[rng.permutation(len(sample))[:512]]
        u = rng.normal(size=x.shape)
        u -= (u * x).sum(1)[:, None] * x
        u /= np.maximum(np.linalg.norm(u, axis=1), 1e-12)[:, None]
        y = threshold * x + np.sqrt(1 - threshold**2) * u
        # Either end may find a pair.
        need = np.quantile(np.minimum(self._ranks(x, y), self._ranks(y, x)), RECALL, method="higher")
        q, p = np.nonzero(np.triu(x @ sample.T >= threshold) & (x @ sample.T < 1 - 1e-9))
        if len(q):
            some = rng.permutation(len(q))[:4096]
            x, y = x[q[some]], sample[p[some]]
            need = max(need, np.quantile(np.minimum(self._ranks(x, y), self._ranks(y, x)), RECALL_SEEN, method="higher"))
        return int(need)


def _unit(rows: pa.Array, size: int) -> np.ndarray:
    x = rows.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1)[:, None]


def forest(linked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Components (rows, columns) with links of a boolean matrix; each row and column is expanded once."""
    free_r, free_c = linked.any(axis=1), linked.any(axis=0)
    while free_r.any():
        rows, cols = np.array([int(free_r.argmax())]), np.zeros(0, np.int64)
        free_r[rows] = False
        all_r, all_c = [rows], []
        while len(rows):
            cols = np.flatnonzero(linked[rows].any(axis=0) & free_c)
            free_c[cols] = False
            all_c.append(cols)
            rows = np.flatnonzero(linked[:, cols].any(axis=1) & free_r) if len(cols) else cols
            free_r[rows] = False
            all_r.append(rows)
        yield np.concatenate(all_r), np.concatenate(all_c)


def _find(entries: DataFrame, dim: int, n: int, threshold: float, work: Workspace, name: str) -> DataFrame:
    """Links of entries (key, weight, v) of one length: rows (a, n) with links of an entry, (a, b) of a forest."""
    spark = entries.sparkSession
    # About SAMPLE vectors at most, picked by hash.
    share = min(1.0, SAMPLE / n)
    picked = entries.filter(F.pmod(F.xxhash64("digest"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("digest", "v").toArrow().sort_by("digest")
    grid = Grid(_unit(picked.column("v").combine_chunks(), dim), n, threshold)
    shared = spark.sparkContext.broadcast(grid)  # two codebooks of WORDS words at most

    words = len(grid.a)
    # Cells of a row of the grid are handled together as long as they hold about a block.
    together = int(np.clip(BLOCK * words * words // max(n, 1), 1, words))

    def homes(batches):
        g = shared.value
        for batch in batches:
            x = _unit(batch.column(2), dim)
            a, b = g.distances(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(a.argmin(1).astype(np.int32)), pa.array(b.argmin(1).astype(np.int32)), pa.array(g.reach(x))], names=["key", "weight", "v", "i", "j", "reach"])

    schema = "key long, weight long, v array<double>, i int, j int, reach double"
    placed = work.save(entries.select("key", "weight", "v").mapInArrow(homes, schema), f"placed_{name}")

    def groups_of(batch):
        """(row, cell group) of every visit."""
        g = shared.value
        a, b = g.distances(_unit(batch.column(2), dim))
        reach = batch.column(5).to_numpy()
        out = []
        step = max((1 << 24) // (words * words), 1)
        for lo in range(0, len(reach), step):
            seen = a[lo : lo + step, :, None] + b[lo : lo + step, None, :] <= reach[lo : lo + step, None, None]
            pad = -words % together
            seen = np.pad(seen, ((0, 0), (0, 0), (0, pad))).reshape(len(seen), words, -1, together).any(axis=3)
            r, i, jb = np.nonzero(seen)
            out.append((r + lo, i * (-(-words // together)) + jb))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2

    def tally(batches):
        total = np.zeros((2, words * -(-words // together)), np.int64)
        for batch in batches:
            _, group = groups_of(batch)
            total[1] += np.bincount(group, minlength=total.shape[1])
            home = batch.column(3).to_numpy() * -(-words // together) + batch.column(4).to_numpy() // together
            total[0] += np.bincount(home, minlength=total.shape[1])
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], names=["cells", "base", "visits"])

    # One row per cell group: WORDS * WORDS at most.
    counts = placed.mapInArrow(tally, "cells int, base long, visits long").groupBy("cells").agg(F.sum("base").alias("base"), F.sum("visits").alias("visits")).collect()
    blocks = np.zeros((2, words * -(-words // together)), np.int64)  # of a group's own vectors, and of its visitors
    for r in counts:
        if r["base"]:
            blocks[:, r["cells"]] = max(1, -(-r["base"] // BLOCK)), max(1, -(-r["visits"] // (2 * BLOCK)))
    shared_blocks = spark.sparkContext.broadcast(blocks)

    def deal(batches):
        nb, nq = shared_blocks.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                # Keys by hash, so that no order or step of them fills one block.
                h = mix(batch.column(0).to_numpy().view(np.uint64))
                home = batch.column(3).to_numpy() * -(-words // together) + batch.column(4).to_numpy() // together
                row, group = groups_of(batch)
                row, group = row[nb[group] > 0], group[nb[group] > 0]
                # A vector goes to its own block beside every block of visitors, and visits every block of a group.
                at = np.repeat(np.arange(len(home)), nq[home])
                nth = np.arange(len(at)) - np.repeat(np.cumsum(nq[home]) - nq[home], nq[home])
                own = at, home[at], (h[at] % nb[home[at]].astype(np.uint64)).astype(np.int64), nth
                k = np.repeat(np.arange(len(row)), nb[group])
                nth = np.arange(len(k)) - np.repeat(np.cumsum(nb[group]) - nb[group], nb[group])
                guest = row[k], group[k], nth, (h[row[k]] % nq[group[k]].astype(np.uint64)).astype(np.int64)
                at, cells, block, part = (np.concatenate(x) for x in zip(own, guest, strict=True))
                role = np.repeat(np.array([0, 1], np.int32), [len(own[0]), len(guest[0])])
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(role), *(batch.column(c).take(pa.array(at)) for c in range(6))], names=["cells", "block", "part", "role", "key", "weight", "v", "i", "j", "reach"])

    dealt = placed.mapInArrow(deal, "cells int, block int, part int, role int, " + schema)

    def verify(table: pa.Table) -> pa.Table:
        g = shared.value
        result = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        role = table.column("role").to_numpy()
        base, visit = (table.filter(pa.array(role == k)).combine_chunks() for k in (0, 1))
        if not base.num_rows or not visit.num_rows:
            return result.empty_table()
        col = lambda t, c: t.column(c).to_numpy()
        bx, vx = (_unit(t.column("v").combine_chunks(), dim) for t in (base, visit))
        va, vb = g.distances(vx)
        ba, bb = g.distances(bx)
        links_b, links_v = np.zeros(len(bx), np.int64), np.zeros(len(vx), np.int64)
        key_b, key_v, w_b, w_v = col(base, "key"), col(visit, "key"), col(base, "weight"), col(visit, "weight")
        home_i, home_j, reach_b, reach_v = col(visit, "i"), col(visit, "j"), col(base, "reach"), col(visit, "reach")
        edges: list[tuple[np.ndarray, int]] = []
        bi, bj = col(base, "i"), col(base, "j")
        for i, j in sorted(set(zip(bi.tolist(), bj.tolist(), strict=True))):
            at = np.flatnonzero((bi == i) & (bj == j))
            guests = np.flatnonzero(va[:, i] + vb[:, j] <= reach_v)
            for lo in range(0, len(at), 1024):
                own = at[lo : lo + 1024]
                for k in range(0, len(guests), 4096):
                    other = guests[k : k + 4096]
                    linked = bx[own] @ vx[other].T >= threshold
                    linked &= key_b[own][:, None] != key_v[other][None]
                    if not linked.any():
                        continue
                    links_v[other] += w_b[own] @ linked
                    # The base vector counts the pair here only if it does not visit the guest's own cell.
                    mutual = ba[own][:, home_i[other]] + bb[own][:, home_j[other]] <= reach_b[own][:, None]
                    links_b[own] += (linked & ~mutual) @ w_v[other]
                    for r, c in forest(linked):
                        ids = np.concatenate([key_b[own[r]], key_v[other[c]]])
                        edges.append((ids, int(ids.min())))
        out_a = [key_b[links_b > 0], key_v[links_v > 0], *(e for e, _ in edges)]
        out_b = [np.full(int((links_b > 0).sum()), -1), np.full(int((links_v > 0).sum()), -1), *(np.full(len(e), m) for e, m in edges)]
        out_n = [links_b[links_b > 0], links_v[links_v > 0], *(np.zeros(len(e), np.int64) for e, _ in edges)]
        edge = [np.zeros(len(x), bool) for x in out_a[:2]] + [np.ones(len(x), bool) for x in out_a[2:]]
        a, b, n_, e = (np.concatenate(x) for x in (out_a, out_b, out_n, edge))
        return pa.table([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64), mask=~e), pa.array(n_.astype(np.int64), mask=e)], schema=result)

    return work.save(dealt.groupBy("cells", "block", "part").applyInArrow(verify, "a long, b long, n long"), f"found_{name}")


def near_duplicates(vectors: DataFrame, threshold: float = COSINE, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    work = Workspace(vectors.sparkSession, "embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    # A digest of the components; -0.0 counts as 0.0.
    rows = work.save(rows.withColumn("digest", F.when(good, F.sha2(F.to_json(F.struct(F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))), 256))), "rows")
    entries = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    # Written with the rows, the key stays theirs: an id may stand for several vectors.
    entries = work.save(entries.withColumn("dim", F.size("v")).withColumn("key", F.monotonically_increasing_id()), "entries")
    found = None
    # One grid for each length that two different vectors have.
    for r in entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("dim").collect():
        links = _find(entries.filter(F.col("dim") == r["dim"]), r["dim"], r["n"], threshold, work, str(r["dim"]))
        found = links if found is None else found.unionByName(links)
    known = entries.select("digest", "key", "rep", "weight")
    # Sets of vectors that repeat an id hang together by it.
    mixed = rows.filter("digest IS NOT NULL").groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("id")
    edges = rows.join(mixed, "id", "left_semi").join(known, "digest").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    if found is not None:
        reps = known.select("key", "rep")
        edges = edges.unionByName(found.filter("b IS NOT NULL").join(reps.toDF("a", "u"), "a").join(reps.toDF("b", "v"), "b").select("u", "v"))
        counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("links"))
        known = known.join(counts, "key", "left")
    else:
        known = known.withColumn("links", F.lit(None).cast("long"))
    groups = components(edges, work)
    known = known.select("digest", "rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("id", "digest").join(known, "digest", "left")
    out = out.join(groups.toDF("id", "by_id"), "id", "left").join(groups.toDF("rep", "by_rep"), "rep", "left")
    component = F.coalesce("by_id", "by_rep", "rep", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))

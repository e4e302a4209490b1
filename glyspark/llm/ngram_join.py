"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of distinct five-word shingles. All shingles have one global order, the rarest first by
their exact number of sets. Two sets with Jaccard similarity of at least t share so many shingles that their
l-prefixes, the first n - ceil(t * n) + l shingles, share at least l. Each document picks its own l: a longer
prefix costs more postings but asks for more matches before a pair is verified. A pair is held to the smaller
l of the two, which both prefixes cover, and to the overlap that its two sizes need.

Steps:
1. equal sets collapse to one representative (the least doc_id);
2. a hash-sampled universe of shingles, a little more than a prefix's share of all, is counted over all sets.
   A set with more shingles of its own alone than a similar pair may miss has no partner and is done; most
   are, so that only the others' shingles need counting in full;
3. among these, shingles of two sets at least become postings with their places in the prefix; those of one
   set take places but make no postings;
4. a document is verified against the least document of its postings if it meets that often, which
   collapses large groups of near copies in linear work;
5. the multi-match join counts shared prefix shingles of pairs that are not yet in one component and
   verifies those with enough; pairs inside a component cannot change it;
6. components of all verified links.

No group is expanded into all its pairs and no posting is capped. Shingles with very many rows are dealt over
parts in every join. What is broadcast has a bounded size: a bit map, and at most MANY such shingles.

A null or empty text, or one without words, has no shingles, size 0, and links with nothing. Rows that
repeat a doc_id with other text are sets of their own with that id: each links for itself, and the id's component is
that of all of them. Null ids take part in no link and get a null component. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from ._io import Workspace, byte_chunks, text_buffers
from ._words import mix, shingle_sets
from .components import components

WIDTH = 5
#: The similarity as a ratio of whole numbers.
SHARE, WHOLE = 80, 100
#: The universe: shingles whose hash is below NEAR in its last GRAIN values.
GRAIN, NEAR = 1 << 16, round(0.27 * (1 << 16))
#: Bits of the map of documents whose sets are needed: LOAD for each distinct set, within these bounds.
LEAST_BITS, MOST_BITS, LOAD = 1 << 20, 1 << 28, 32
#: A shingle of this many rows, and of one in MANY of all rows, is dealt over SALTS parts.
HOT, MANY, SALTS = 512, 20_000, 32
#: In the self-join such a shingle has SIDE * SIDE parts: each row goes to SIDE of them on either side.
SIDE = 6
#: Longest extension of a prefix, and the cost of verifying a candidate in postings read.
MOST, VERIFY = 8, 4
#: Share of a document's prefix that its head must hold to be verified first.
HEAD = 0.25


def overlap(n):
    """The least number of shingles that a set of n shares with any similar set."""
    return -(-SHARE * n // WHOLE)


def adaptive_length(postings, l):
    """Cost of prefix extension l for a set whose l-prefix has that many postings of other sets.

    All are read; at most postings / l sets have l matches, and each of them costs a verification.
    """
    return postings * (1 + VERIFY / l)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _row(docs: DataFrame):
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def _texts(docs: DataFrame, carry: bool = False) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([_row(docs)] if carry else []))


def _sets_of(batch, width):
    """(row range, sets) of a batch, chunk by chunk."""
    raw, offsets = text_buffers(batch.column(1))
    for lo, hi in byte_chunks(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        yield lo, hi, shingle_sets(part, offsets[lo : hi + 1] - offsets[lo], width)


def _near(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(GRAIN - 1)) < np.uint64(NEAR)


def signatures(docs: DataFrame, width: int = WIDTH, carry: bool = False) -> DataFrame:
    """doc_id, n_shingles, how many of them lie in the universe, and a 128-bit digest of the set; carry adds the whole row as struct `row`."""

    def run(batches):
        for batch in batches:
            for lo, hi, sets in _sets_of(batch, width):
                cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([int(_near(s).sum()) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols, *(c.slice(lo, hi - lo) for c in batch.columns[2:])], names=names)

    names = ["doc_id", "n_shingles", "near", "digest"] + ["row"] * carry
    source = _texts(docs, carry)
    schema = "doc_id long, n_shingles long, near long, digest binary"
    return source.mapInArrow(run, f"{schema}, row {source.schema['row'].dataType.simpleString()}" if carry else schema)


def universe_shingles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, digest and the set's shingles in the universe (binary)."""

    def run(batches):
        for batch in batches:
            for lo, hi, sets in _sets_of(batch, width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s[_near(s)].tobytes() for s in sets], pa.binary())], names=["rep", "digest", "words"])

    return _texts(docs).filter("doc_id IS NOT NULL").mapInArrow(run, "rep long, digest binary, words binary")


def chosen_sets(docs: DataFrame, wanted: np.ndarray, width: int = WIDTH) -> DataFrame:
    """doc_id, digest and the whole set (binary) of documents that a bit map of ids lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        bits = shared.value
        for batch in batches:
            h = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)))
            for lo, hi, sets in _sets_of(batch, width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "digest", "words"])

    hashed = _texts(docs).filter("doc_id IS NOT NULL").select("*", F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(wanted))).alias("h"))
    return hashed.mapInArrow(run, "rep long, digest binary, words binary")


def _of_nodes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, words) of the sets that are nodes (rep, digest, node); rows that repeat an id and its text count once."""
    return sets.join(nodes.select("rep", "digest", "node"), ["rep", "digest"]).dropDuplicates(["rep", "digest"]).select("node", "words")


def _exploded(held: DataFrame) -> DataFrame:
    """One row (token, rep) per shingle of (node, words)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                parts = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
                if parts:
                    rep = np.repeat(b.column(0).to_numpy(), [len(p) for p in parts])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(rep)], names=["token", "rep"])

    return held.select("node", "words").mapInArrow(run, "token long, rep long")


def _miss(n="n"):
    """Shingles that a set of n may lack in any similar one."""
    return F.col(n) - F.ceil(F.col(n) * F.lit(SHARE) / F.lit(WHOLE))


def postings(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """(token, rep, n, l, pos) of the shingles in each document's l-prefix that another set has too.

    shared: (token, rep, f) with f >= 2 sets; sizes: (rep, n). A document's other shingles are its own
    alone and come first.
    """
    whole = Window.partitionBy("rep")
    rows = shared.join(sizes, "rep")
    pos = F.col("n") - F.count(F.lit(1)).over(whole) + F.row_number().over(whole.orderBy("f", "token")) - 1
    rows = rows.withColumn("pos", pos).withColumn("miss", _miss()).filter(F.col("pos") < F.col("miss") + MOST)
    # Most partners are of about the same size, so a pair's prefix is shorter than the longest that must be kept.
    usual = F.col("n") - F.ceil(2 * F.col("n") * F.lit(SHARE) / F.lit(SHARE + WHOLE))
    costs = []
    for l in range(1, MOST + 1):
        met = F.sum(F.when(F.col("pos") < usual + l, F.col("f") - 1).otherwise(0)).over(whole)
        # An extension beyond the overlap itself is impossible.
        costs.append(F.when(F.col("n") - F.col("miss") >= l, F.struct(adaptive_length(met, l).alias("cost"), F.lit(l).alias("l"))))
    rows = rows.withColumn("l", F.array_min(F.array(*costs))["l"])
    return rows.filter(F.col("pos") < F.col("miss") + F.col("l")).select("token", "rep", "n", "l", "pos")


def _bits(n: int) -> int:
    """Bits of the map for n distinct sets."""
    return min(max(1 << (max(n, 1) * LOAD - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """So many bits, set at the hashes of the ids."""
    h = ids.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("h"))
    words = h.selectExpr("h div 64 AS w", "shiftleft(1L, cast(h % 64 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint8)


def _hot(counts: DataFrame) -> DataFrame:
    """The tokens of counts (token, f) that are dealt; MANY at most, so that they may be broadcast."""
    total = counts.agg(F.sum("f")).first()[0] or 0
    return F.broadcast(counts.filter(F.col("f") > max(HOT, total // MANY)).select("token", F.lit(True).alias("hot")))


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with the part of their token that they fall into."""
    return rows.join(hot, "token", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(0)).drop("hot")


def _copied(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows once for each part of their token."""
    parts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return rows.join(hot, "token", "left").withColumn("salt", F.explode(parts)).drop("hot")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, bits: int, work: Workspace, name: str, width: int = WIDTH) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets are similar; sets are computed for their documents alone."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = _bitmap(nodes.join(classes, "node").select(F.col("rep").alias("id")), bits)
    sets = _of_nodes(chosen_sets(docs, wanted, width), classes)

    def hold(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                at = np.searchsorted(large, small)
                both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small)) if len(large) else 0
                keep.append(WHOLE * both >= SHARE * (len(a) + len(b) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    return work.save(both.select("a", "b", "x", "y").mapInArrow(hold, "a long, b long"), name)


def _prepared(docs: DataFrame, work: Workspace, width: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Steps 1 to 3: signatures, classes of equal sets, postings that several classes share, bits of the map of sets."""
    # Ids alone may repeat with other texts; a document is then known by its id and digest.
    sigs = work.save(signatures(docs, width), "signatures")
    classes = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("near").alias("near"))
    # A set's node is its representative; where an id stands for several texts, a number of their own for the others.
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("digest"))
    classes = work.save(classes.withColumn("node", F.when(nth == 1, F.col("rep")).otherwise(-F.pmod(F.xxhash64("digest"), F.lit(1 << 62)) - 2)), "classes")
    bits = _bits(classes.count())

    # 2. Sets with too many universe shingles of their own have no partner.
    held = work.save(_exploded(_of_nodes(universe_shingles(docs, width), classes)), "held")
    work.free()
    often = work.save(held.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "often2")
    work.free()
    hot = _hot(often)
    met = _dealt(held, hot).join(_copied(often.select("token"), hot), ["token", "salt"], "left_semi").groupBy(F.col("rep").alias("node")).agg(F.count(F.lit(1)).alias("met"))
    alive = classes.join(met, "node", "left").filter(F.col("near") - F.coalesce("met", F.lit(0)) <= _miss())
    alive = work.save(alive.select("node", "rep", "digest", "n"), "alive")
    work.drop("held", "often2")
    work.free()

    # 3. Exact counts over the others' whole sets.
    held = work.save(_exploded(_of_nodes(chosen_sets(docs, _bitmap(alive.select(F.col("rep").alias("id")), bits), width), alive)), "whole")
    work.free()
    often = work.save(held.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "often3")
    work.free()
    hot = _hot(often)
    shared = work.save(_dealt(held, hot).join(_copied(often, hot), ["token", "salt"]).drop("salt"), "often")
    work.drop("whole", "often3")
    work.free()
    sizes = alive.select(F.col("node").alias("rep"), "n")
    posted = work.save(postings(shared, sizes), "posted")
    work.drop("often")
    work.free()
    heads = work.save(posted.groupBy("token").agg(F.min("rep").alias("head"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("f")).filter("head < last").select("token", "head", "f"), "heads")
    hot = _hot(heads)
    shared = work.save(_dealt(posted, hot).join(_copied(heads.select("token", "head"), hot), ["token", "salt"]).drop("salt"), "shared")
    work.drop("posted", "heads")
    work.free()
    return sigs, classes, shared, bits


def _multi_match(rows: DataFrame, apart: bool) -> DataFrame:
    """Pairs (a, b) of nodes with enough shared prefix shingles; apart: only those of two components."""
    carried = ("rep", "n", "l", "pos") + ("component",) * apart
    hot = _hot(rows.groupBy("token").agg(F.count(F.lit(1)).alias("f")))
    marked = rows.join(hot, "token", "left").withColumn("own", F.pmod(F.xxhash64("rep"), F.lit(SIDE)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(SIDE - 1).cast("long"))

    def side(name: str, part: Callable[[Column, Column], Column]) -> DataFrame:
        # A row of a hot token meets each of the other side once, in the part of both their places.
        parts = F.when(F.col("hot"), F.transform(every, lambda other: part(F.col("own"), other))).otherwise(F.array(F.lit(0).cast("long")))
        return marked.select("token", *(F.col(c).alias(f"{c}_{name}") for c in carried), F.explode(parts).alias("salt"))

    a, b = side("a", lambda own, other: own * SIDE + other), side("b", lambda own, other: other * SIDE + own)
    l = F.least("l_a", "l_b")
    # The overlap that these two sizes need; a prefix leaves no more places than that allows to miss, and l.
    both = F.col("n_a") + F.col("n_b")
    least = F.ceil(both * F.lit(SHARE) / F.lit(SHARE + WHOLE))

    def inside(s: str):
        return F.col(f"pos_{s}") < F.col(f"n_{s}") - least + l

    on = (a["token"] == b["token"]) & (a["salt"] == b["salt"]) & (F.col("rep_a") < F.col("rep_b")) & (F.least("n_a", "n_b") * WHOLE >= F.greatest("n_a", "n_b") * SHARE) & inside("a") & inside("b")
    met = a.join(b, on & (F.col("component_a") != F.col("component_b")) if apart else on)
    return met.groupBy(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min(l).alias("l")).filter("shared >= l").select("a", "b")


def _by_id(classes: DataFrame, final: DataFrame, work: Workspace) -> DataFrame:
    """(rep, component) from (node, component): the sets of an id belong together, and a component is its least id."""
    others = classes.filter("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    if others.isEmpty():
        return final.withColumnRenamed("node", "rep")
    whole = work.save(components(final.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(others), work, "cc_id_"), "whole_ids")
    named = classes.select("node", "rep").join(whole, "node")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    return work.save(named.join(least, "component").select("rep", F.col("least").alias("component")).distinct(), "by_id")


def _labelled(sigs: DataFrame, classes: DataFrame, final: DataFrame) -> DataFrame:
    """The signatures' rows with component_id and rep; final: (rep, component)."""
    labels = classes.join(final, "rep", "left").select("digest", "rep", F.coalesce("component", "rep").alias("component"))
    lone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sigs.join(labels, "digest", "left").select("doc_id", "n_shingles", lone.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"), "digest")


def linked_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The whole join: as similar_documents(), and n_links, how many other documents each one is similar to.

    Every pair of class representatives is looked for and verified, inside components too; equal sets count by the
    size of their class. Documents are distinct (doc_id, set); those without an id or a shingle have no links.
    """
    work = Workspace(docs.sparkSession, "ngram_links")
    sigs, classes, shared, bits = _prepared(docs, work, width)
    pairs = work.save(_multi_match(shared, False), "pairs")
    links = verified(pairs, docs, classes, bits, work, "links", width)
    work.free()
    final = work.save(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), work, "cc_"), "components")
    members = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "digest").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("size"))
    sized = classes.select("node", "digest").join(members, "digest")
    ways = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ways.join(sized.select(F.col("node").alias("b"), "size"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("others"))
    counts = work.save(sized.join(others, "node", "left").select("digest", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links")), "counts")
    work.drop("shared", "pairs")
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    return _labelled(sigs, classes, _by_id(classes, final, work)).join(counts, "digest", "left").select("doc_id", "n_shingles", "component_id", "rep", n_links.alias("n_links"))


def _groups(docs: DataFrame, work: Workspace, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures, classes and (node, component), where a component is a group of sets."""
    sigs, classes, shared, bits = _prepared(docs, work, width)

    # 4. One verification per document: against the head it meets most often.
    votes = shared.filter("rep > head").groupBy("rep", "head").agg(F.count(F.lit(1)).alias("votes"), F.first("n").alias("n"), F.first("l").alias("l"))
    votes = votes.filter(F.col("votes") >= HEAD * (_miss() + F.col("l")))
    best = votes.groupBy("rep").agg(F.max_by("head", F.struct("votes", -F.col("head"))).alias("head"))
    links = verified(work.save(best.select(F.col("rep").alias("a"), F.col("head").alias("b")), "pairs1"), docs, classes, bits, work, "links1", width)
    first = work.save(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), work, "cc1_"), "first")

    work.free()
    # 5. The multi-match join over pairs that are not in one component yet.
    rows = work.save(shared.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "n", "l", "pos", F.coalesce("component", "rep").alias("component")), "placed")
    work.drop("shared")
    spread = work.save(rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("f")).filter("lo < hi").select("token", "f"), "spread")
    hot = _hot(spread)
    rows = work.save(_dealt(rows, hot).join(_copied(spread.select("token"), hot), ["token", "salt"], "left_semi").drop("salt"), "open")
    work.drop("placed", "spread")
    more = verified(work.save(_multi_match(rows, True), "pairs2"), docs, classes, bits, work, "links2", width)

    work.free()
    edges = first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    final = work.save(components(edges, work, "cc2_"), "components")
    work.drop("open", "first", "pairs1", "pairs2", "links1", "links2")
    return sigs, classes, final


def similar_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, rep (the least id with the same set)."""
    work = Workspace(docs.sparkSession, "ngram")
    sigs, classes, final = _groups(docs, work, width)
    return _labelled(sigs, classes, _by_id(classes, final, work)).drop("digest")


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of docs for each group of similar sets: that with the least doc_id, then the least digest.

    Sets of one id count by themselves, so that a text without a near copy stays whatever else its id holds. Of rows
    that repeat an id and its set one stays, the first by the text's hash; rows without an id all stay.
    """
    work = Workspace(docs.sparkSession, "ngram")
    sigs, classes, final = _groups(docs, work, width)
    grouped = classes.join(final, "node", "left").select("rep", "digest", F.coalesce("component", "node").alias("component"))
    first = grouped.groupBy("component").agg(F.min(F.struct("rep", "digest")).alias("x")).select(F.col("x.rep").alias("kept_id"), F.col("x.digest").alias("digest"))
    # Texts without a shingle are in no class and stay.
    bare = sigs.filter("n_shingles = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id"), "digest").distinct()
    sets = sigs.groupBy(F.col("doc_id").alias("kept_id")).agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).select("kept_id", (F.col("lo") != F.col("hi")).alias("several"))
    kept = work.save(first.unionByName(bare).join(sets, "kept_id"), "kept")
    whole = docs.select(F.col("doc_id").cast("long").alias("kept_id"), _row(docs))

    def first_of(found: DataFrame, *key: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row.text")))
        return found.withColumn("nth", nth).filter("nth = 1").select("row.*")

    out = first_of(whole.join(kept.filter("NOT several"), "kept_id", "left_semi"), "kept_id")
    again = kept.filter("several").select("kept_id", "digest")
    if not again.isEmpty():
        # Only these rows need their digests.
        some = whole.join(again, "kept_id", "left_semi").select("row.*")
        some = signatures(some, width, carry=True).withColumnRenamed("doc_id", "kept_id").join(again, ["kept_id", "digest"], "left_semi")
        out = out.unionByName(first_of(some, "kept_id", "digest"))
    return out.unionByName(docs.filter(F.col("doc_id").isNull()))

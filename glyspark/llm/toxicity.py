"""Toxicity scores from a counterfactual-regularised classifier.

A logistic model over the presence of lexical features: each word (a run of letters and digits, ASCII
lower-cased) gives itself, its starts and its ends of a few lengths, as 64-bit hashes. Features are chosen
by their association with the label: a fixed-size table of counts first, then exact counts of what stands
out there.

Counterfactual regularisation: in each training text the identity terms are swapped for others of their
group, and the squared change of the logit is added to the loss; a feature that tells groups apart but not
toxicity loses its weight, and neutral mentions of a group are not marked. The groups are given (IDENTITY) and learned
from the sample: words that texts of both labels mention often enough (MENTIONS each), those first that carry a
chosen feature and so move a score, are paired with the word of that sort whose neighbours are most alike. A word
most of whose texts are toxic (TOXIC_SHARE) is no neutral mention and never in a learned group.

The model is fitted on a bounded sample, about ROWS learnable rows picked by hash: Spark counts and chooses
at most FEATURES features, numpy on the driver fits their weights. Labels: a doc_id with several labels counts as toxic if one says
so; null labels are ignored. Without toxic or without clean learnable rows every score is the share of toxic
rows. Null and empty texts are scored by the intercept. Repeated rows are scored alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._io import Workspace, byte_chunks, text_buffers
from ._words import LETTERS, LOWER, distinct, mix, prefix_hash, range_hash, split
from .langid import is_learnable

#: Identity terms by group; in a counterfactual each is replaced by the next of its group.
IDENTITY = {
    "en": [["women", "men"], ["woman", "man"], ["girls", "boys"], ["gay", "lesbian", "straight", "bisexual", "transgender"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["black", "white", "asian", "latino"], ["african", "european", "american", "arab", "chinese", "mexican", "indian"], ["immigrants", "natives", "refugees"], ["old", "young"], ["deaf", "blind", "disabled"]],
    "de": [["frauen", "männer"], ["muslime", "christen", "juden"], ["schwul", "lesbisch"], ["schwarze", "weiße"], ["ausländer", "deutsche", "flüchtlinge"]],
    "fr": [["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["noirs", "blancs", "arabes"], ["étrangers", "français", "réfugiés"]],
    "es": [["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["negros", "blancos", "árabes"], ["extranjeros", "españoles", "refugiados"]],
}
#: Decision threshold on the score.
THRESHOLD = 0.3
#: Bounds: sampled rows, chosen features, buckets of the count table, and the chi-square a feature must reach.
ROWS, FEATURES, BUCKETS, LEAST = 20_000, 3000, 1 << 20, 18.0
STARTS, ENDS = (3, 4, 5, 6), (4, 5)
#: Learned identity terms: texts of each label that mention one, the toxic share of its texts at most, the number of
#: terms, buckets of their neighbours' counts, and the least cosine of two terms of a pair.
MENTIONS, TOXIC_SHARE, TERMS, NEIGHBOURS, ALIKE = 5, 0.6, 200, 512, 0.5


def _swap_table(groups=None, learned: list[list[bytes]] = ()) -> dict[bytes, bytes]:
    """Each term's replacement: the next of its group. Given groups (by language) come before learned ones."""
    out: dict[bytes, bytes] = {}
    given = [[w.encode() for w in g] for gs in (IDENTITY if groups is None else groups).values() for g in gs]
    for group in [*given, *learned]:
        for a, b in zip(group, group[1:] + group[:1], strict=True):
            out.setdefault(a, b)
    return out


def _hash_word(word: bytes) -> np.uint64:
    raw = np.frombuffer(word, np.uint8)
    return range_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0]


_WIDTH = 1 + len(STARTS) + len(ENDS)


def word_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Feature hashes of each word, _WIDTH columns; 0 where a word is too short for one."""
    sums = prefix_hash(raw) if sums is None else sums
    length = ends - starts
    out = np.zeros((len(starts), _WIDTH), np.uint64)
    out[:, 0] = range_hash(sums, starts, ends)
    col = 1
    for many, tail in ((STARTS, False), (ENDS, True)):
        for n in many:
            ok = length > n
            a = ends[ok] - n if tail else starts[ok]
            out[ok, col] = mix(range_hash(sums, a, a + n) + np.uint64(2 + tail))
            col += 1
    return out


class Swapper:
    """Counterfactual features of a text's distinct words."""

    def __init__(self, groups=None, learned: list[list[bytes]] = ()):
        table = _swap_table(groups, learned)
        self.keys = np.array(sorted(_hash_word(w) for w in table), np.uint64)
        by = {int(_hash_word(a)): b for a, b in table.items()}
        rows = []
        for k in self.keys:
            raw = np.frombuffer(by[int(k)], np.uint8)
            rows.append(word_features(raw, np.array([0]), np.array([len(raw)]))[0])
        self.rows = np.array(rows, np.uint64).reshape(-1, _WIDTH)

    def __call__(self, features: np.ndarray) -> tuple[np.ndarray, bool]:
        """The words' features after the swap, and whether any word was swapped."""
        if not len(self.keys):
            return features, False
        at = np.minimum(np.searchsorted(self.keys, features[:, 0]), len(self.keys) - 1)
        hit = self.keys[at] == features[:, 0]
        if not hit.any():
            return features, False
        out = features.copy()
        out[hit] = self.rows[at[hit]]
        return out, True


def _doc_words(batch, at: int, words: bool = False):
    """For each chunk: first and end row, per document the index of its words among the chunk's distinct words, and
    their features; words adds a function from index to the lower-cased word."""
    raw, offsets = text_buffers(batch.column(at))
    for lo, hi in byte_chunks(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        s, e, begin = split(part, offsets[lo : hi + 1] - offsets[lo], LETTERS)
        sums = prefix_hash(part)
        _, first, inverse = distinct(range_hash(sums, s, e))
        found = lo, hi, begin, inverse, word_features(part, s[first], e[first], sums)
        yield (*found, lambda k: LOWER[part[s[first[k]] : e[first[k]]]].tobytes()) if words else found  # noqa: B023


def _known(features: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Index in the sorted chosen features, or -1."""
    if not len(chosen):
        return np.full(features.shape, -1, np.int64)
    at = np.minimum(np.searchsorted(chosen, features), len(chosen) - 1)
    return np.where((chosen[at] == features) & (features != 0), at, -1)


def _association(n: np.ndarray, bad: np.ndarray, rows: int, toxic: int) -> np.ndarray:
    """Chi-square of a feature's presence with the label, from document counts."""
    n, bad = n.astype(float), bad.astype(float)
    a, b = bad, n - bad
    c, d = toxic - bad, rows - toxic - b
    under = n * (rows - n) * toxic * (rows - toxic)
    return np.where(under > 0, rows * (a * d - b * c) ** 2 / np.maximum(under, 1), 0)


def choose_features(rows: DataFrame, total: int, toxic: int) -> np.ndarray:
    """The sorted hashes of the features that are most associated with the label, over all rows (text, toxic)."""
    stripe = 1 << 12

    def count(batches):
        table = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            bad = batch.column(1).to_numpy()
            for lo, hi, begin, inverse, feats in _doc_words(batch, 0):
                bucket = (feats & np.uint64(BUCKETS - 1)).astype(np.int64)
                bucket[feats == 0] = -1
                for i in range(hi - lo):
                    own = np.unique(bucket[np.unique(inverse[begin[i] : begin[i + 1]])])
                    table[bad[lo + i], own[own >= 0]] += 1
        for c in range(2):
            grid = table[c].reshape(-1, stripe)
            at = np.flatnonzero(grid.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at + c * (BUCKETS // stripe), pa.int32()), pa.array([grid[i].astype("<i8").tobytes() for i in at], pa.binary())], names=["stripe", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = np.frombuffer(c.as_buffer(), "<i8")
                held[i] = held[i] + c if i in held else c
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([c.tobytes() for c in held.values()], pa.binary())], names=["stripe", "counts"])

    table = np.zeros(2 * BUCKETS, np.int64)
    for r in rows.mapInArrow(count, "stripe int, counts binary").repartition(16, "stripe").mapInArrow(add, "stripe int, counts binary").toLocalIterator():
        table[r["stripe"] * stripe : (r["stripe"] + 1) * stripe] = np.frombuffer(r["counts"], "<i8")
    clean, bad = table[:BUCKETS], table[BUCKETS:]
    score = _association(clean + bad, bad, total, toxic)
    score[bad * total <= (clean + bad) * toxic] = 0
    top = np.sort(np.argsort(-score, kind="stable")[: 2 * FEATURES])
    wanted = np.zeros(BUCKETS, bool)
    wanted[top[score[top] > 0]] = True
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def exact(batches):
        mask = shared.value
        for batch in batches:
            bad = batch.column(1).to_numpy()
            for lo, hi, begin, inverse, feats in _doc_words(batch, 0):
                hit = mask[(feats & np.uint64(BUCKETS - 1)).astype(np.int64)] & (feats != 0)
                some = np.flatnonzero(hit.any(axis=1))
                keep = np.zeros(len(feats), bool)
                keep[some] = True
                found, label = [], []
                for i in range(hi - lo):
                    own = np.unique(inverse[begin[i] : begin[i + 1]])
                    own = own[keep[own]]
                    x = np.unique(feats[own][hit[own]])
                    found.append(x)
                    label.append(np.full(len(x), bad[lo + i]))
                if found:
                    f, y = np.concatenate(found), np.concatenate(label)
                    u, inv = np.unique(f, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inv, minlength=len(u)).astype(np.int64)), pa.array(np.bincount(inv, weights=y, minlength=len(u)).astype(np.int64))], names=["feature", "n", "bad"])

    sums = rows.mapInArrow(exact, "feature long, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    a, b = F.col("bad").cast("double"), (F.col("n") - F.col("bad")).cast("double")
    under = F.col("n") * (total - F.col("n").cast("double")) * toxic * (total - toxic)
    chi = F.when(under > 0, total * F.pow(a * (total - toxic - b) - b * (toxic - a), 2) / under).otherwise(0.0)
    best = sums.withColumn("chi", chi).filter((F.col("chi") >= LEAST) & (F.col("bad") * total > F.col("n") * toxic) & (F.col("bad") >= 2)).orderBy(F.desc("chi"), "feature").limit(FEATURES)
    return np.sort(np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64))


def learned_groups(rows: DataFrame, chosen: np.ndarray) -> list[list[bytes]]:
    """Pairs of words of rows (text, toxic) that both labels mention and whose neighbours are alike, at most TERMS words.

    Words with a chosen feature come first, then the most frequent ones.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(chosen)  # FEATURES at most

    def mentions(batches):
        pick = shared.value
        for batch in batches:
            bad = batch.column(1).to_numpy()
            for lo, hi, begin, inverse, feats, word in _doc_words(batch, 0, words=True):
                able = (_known(feats, pick) >= 0).any(axis=1)
                n = np.zeros((2, len(feats)), np.int64)
                for i in range(hi - lo):
                    n[bad[lo + i], np.unique(inverse[begin[i] : begin[i + 1]])] += 1
                yield pa.RecordBatch.from_arrays([pa.array([word(k) for k in range(len(feats))], pa.binary()), pa.array(n[0]), pa.array(n[1]), pa.array(able)], names=["word", "clean", "toxic", "able"])

    often = rows.mapInArrow(mentions, "word binary, clean long, toxic long, able boolean").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.max("able").alias("able"))
    often = often.filter((F.col("clean") >= MENTIONS) & (F.col("toxic") >= MENTIONS) & (F.col("toxic") <= TOXIC_SHARE * (F.col("clean") + F.col("toxic"))))
    terms = sorted(bytes(r["word"]) for r in often.orderBy(F.desc("able"), F.desc(F.col("clean") + F.col("toxic")), "word").limit(TERMS).collect())
    if len(terms) < 2:
        return []
    keys = np.array([_hash_word(w) for w in terms], np.uint64)
    order = np.argsort(keys)

    def neighbours(batches):
        table = np.zeros((len(terms), 2 * NEIGHBOURS))
        for batch in batches:
            for _, _, begin, inverse, feats in _doc_words(batch, 0):
                at = np.minimum(np.searchsorted(keys[order], feats[:, 0]), len(keys) - 1)
                term = np.where(keys[order][at] == feats[:, 0], order[at], -1)[inverse]
                bucket = (feats[inverse, 0] >> np.uint64(20)).astype(np.int64) % NEIGHBOURS
                edge = np.zeros(len(inverse) + 1, bool)
                edge[begin] = True
                place = np.flatnonzero(term >= 0)
                left = place[~edge[place]]
                right = place[~edge[place + 1]]
                np.add.at(table, (term[left], bucket[left - 1]), 1)
                np.add.at(table, (term[right], NEIGHBOURS + bucket[right + 1]), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms)).astype(np.int32)), pa.array(list(table), pa.list_(pa.float64()))], names=["term", "counts"])

    # TERMS rows of fixed width from each task, added up before they come to the driver.
    parts = rows.mapInArrow(neighbours, "term int, counts array<double>").select("term", F.posexplode("counts")).filter("col > 0").groupBy("term", "pos").agg(F.sum("col").alias("n")).toArrow()
    table = np.zeros((len(terms), 2 * NEIGHBOURS))
    table[parts.column("term").to_numpy(), parts.column("pos").to_numpy()] = parts.column("n").to_numpy()
    # Common neighbours count for less.
    table = np.log1p(table)
    table -= table.mean(axis=0)
    table /= np.maximum(np.linalg.norm(table, axis=1), 1e-12)[:, None]
    alike = np.triu(table @ table.T, 1)
    out, used = [], set()
    for k in np.argsort(-alike, axis=None, kind="stable"):
        i, j = divmod(int(k), len(terms))
        if alike[i, j] < ALIKE:
            break
        if not {i, j} & used:
            used |= {i, j}
            out.append([terms[i], terms[j]])
    return out


def _rows_to_csr(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    arrays = [np.frombuffer(r, np.int32) for r in rows]
    many = np.array([len(a) for a in arrays], np.int64)
    return np.repeat(np.arange(len(rows)), many), np.concatenate(arrays) if len(arrays) else np.zeros(0, np.int32)


def fit_logistic(x: list[bytes], y: np.ndarray, swapped: list[tuple[int, bytes]], features: int, penalty: float = 2.0, l2: float = 0.5, steps: int = 300) -> np.ndarray:
    """Weights and, last, the intercept. x: chosen features present (int32) in each text; swapped: (text, features after the swap)."""
    doc, col = _rows_to_csr(x)
    n = len(y)
    origin = np.array([i for i, _ in swapped], np.int64)
    doc_c, col_c = _rows_to_csr([r for _, r in swapped])
    w = np.zeros(features + 1)
    w[-1] = np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(doc, weights=w[col], minlength=n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        err = p - y
        g = np.append(np.bincount(col, weights=err[doc], minlength=features), err.sum())
        g[:-1] += l2 * w[:-1]
        if len(swapped):
            gap = z[origin] - (np.bincount(doc_c, weights=w[col_c], minlength=len(swapped)) + w[-1])
            weight = np.zeros(n)
            np.add.at(weight, origin, gap)
            g[:-1] += 2 * penalty * (np.bincount(col, weights=weight[doc], minlength=features) - np.bincount(col_c, weights=gap[doc_c], minlength=features))
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


class Model:
    """Sorted feature hashes, their weights and, last, the intercept; of the fit, the learned groups, the training rows,
    those with a counterfactual, and those whose chosen features it changes."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, groups: list[list[bytes]] = (), rows: int = 0, swapped: int = 0, changed: int = 0):
        self.features, self.weights = features, weights
        self.groups, self.rows, self.swapped, self.changed = list(groups), rows, swapped, changed


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, penalty: float = 2.0, groups=None, learn_groups: bool = True) -> Model:
    """Fit on the learnable rows of docs (doc_id, text) that labels (doc_id, toxic) marks.

    groups: lists of identity terms by language, in place of IDENTITY; learn_groups adds those that the sample holds.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.least(F.greatest("toxic", F.lit(0)), F.lit(1))).alias("toxic"))
    marks = marks.filter(is_learnable(F.col("doc_id"))).withColumn("at", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)))
    # The same hash picks labels and texts, so that no text is shuffled; about `rows` labels are left to broadcast.
    share = int(1_000_000 * min(1.0, rows / max(marks.count(), 1))) + 1
    work = Workspace(docs.sparkSession, "toxicity")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share)
    known = work.save(texts.join(F.broadcast(marks.filter(F.col("at") < share).select("doc_id", "toxic")), "doc_id").select("text", F.col("toxic").cast("long").alias("toxic")), "known")
    total, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == total:
        p = min(max(toxic / total if total else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.uint64), np.array([np.log(p / (1 - p))]))
    chosen = choose_features(known, total, toxic)
    found = learned_groups(known, chosen) if learn_groups else []
    shared = docs.sparkSession.sparkContext.broadcast((chosen, found))

    def rows_of(batches):
        pick, swap = shared.value[0], Swapper(groups, shared.value[1])
        for batch in batches:
            out, out_c = [], []
            for lo, hi, begin, inverse, feats in _doc_words(batch, 0):
                at = _known(feats, pick)
                for i in range(hi - lo):
                    own = np.unique(inverse[begin[i] : begin[i + 1]])
                    x = np.unique(at[own])
                    out.append(x[x >= 0].astype(np.int32).tobytes())
                    other, changed = swap(feats[own]) if len(own) else (None, False)
                    if changed:
                        x = np.unique(_known(other, pick))
                        out_c.append(x[x >= 0].astype(np.int32).tobytes())
                    else:
                        out_c.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(out_c, pa.binary()), batch.column(1)], names=["x", "swapped", "toxic"])

    got = known.mapInArrow(rows_of, "x binary, swapped binary, toxic long").collect()
    work.drop("")
    # In one order whatever the order of tasks, so that the model is the same.
    got = sorted(((bytes(r["x"]), None if r["swapped"] is None else bytes(r["swapped"]), r["toxic"]) for r in got), key=lambda r: (r[0], r[1] or b"", r[2]))
    swapped = [(i, r[1]) for i, r in enumerate(got) if r[1] is not None]
    weights = fit_logistic([r[0] for r in got], np.array([r[2] for r in got], float), swapped, len(chosen), penalty)
    return Model(chosen, weights, found, len(got), len(swapped), sum(got[i][0] != x for i, x in swapped))


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; carry adds the whole row as struct `row`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        k = len(m.features)
        for batch in batches:
            score = np.full(batch.num_rows, m.weights[-1])
            for lo, hi, begin, inverse, feats in _doc_words(batch, 1):
                at = _known(feats, m.features)
                word, col = np.nonzero(at >= 0)
                if not len(word):
                    continue
                # Pairs (text, feature) of the few words with a chosen feature, each pair once.
                order = np.zeros(len(feats) + 1, np.int64)
                order[1:] = np.cumsum(np.bincount(word, minlength=len(feats)))
                doc = np.repeat(np.arange(hi - lo), np.diff(begin))
                many = (order[1:] - order[:-1])[inverse]
                some = np.flatnonzero(many)
                reps = many[some]
                nth = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                feature = at[word, col][np.repeat(order[inverse[some]], reps) + nth]
                pair = np.unique(np.repeat(doc[some], reps) * k + feature)
                score[lo:hi] += np.bincount(pair // k, weights=m.weights[pair % k], minlength=hi - lo)
            score = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
            out = [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out + batch.columns[3:], names=names)

    names = ["doc_id", "held_out", "score", "predicted"] + ["row"] * carry
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), (~is_learnable(F.col("doc_id"))).alias("held_out"), *([whole] if carry else []))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int"
    return source.mapInArrow(run, schema + f", row {source.schema['row'].dataType.simpleString()}" if carry else schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled rows that are not held out and score all rows."""
    return predict(docs, train(docs, labels), threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic."""
    return predict(docs, train(docs, labels), threshold, carry=True).filter("predicted = 0").select("row.*")

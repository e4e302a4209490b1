"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of the whole text, white space included, in both directions and labels every byte
with a language; a document's probabilities pool the labels of all its bytes (the mean of their
log-probabilities, normalised). ASCII letters are lower-cased.

A text is read in stretches of about CORE bytes, each with about CONTEXT bytes of its real neighbours on both
sides, which are read but not pooled: every byte is labelled once, with that much context or the text's end on
either side, and no stretch begins or ends inside a character. Stretches of all texts run side by side, so
that memory and steps are bounded whatever the length of a text.

Training runs in numpy on the driver by backpropagation through time with Adam, on a bounded sample: about ROWS
rows of each of the LANGS most frequent languages, of which SAMPLE windows of WINDOW bytes each, spread over the
whole text by hash.

Null texts and texts without a letter get `und` with score 0. Rows with a null lang or text are not
learned from; without any labelled row all predictions are `und`. Ties go to the first language in order. Repeated
rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ._io import Workspace, byte_chunks, text_buffers, trim
from ._words import LOWER, mix

UNKNOWN = "und"
#: Bytes of a stretch that are labelled in it, and bytes read before and after them.
CORE, CONTEXT = 224, 32
HIDDEN = 16
#: Bounds of the training sample: languages, rows per language, windows per row and their bytes; passes over it.
LANGS, ROWS, SAMPLE, WINDOW, EPOCHS = 256, 1000, 4, 48, 3
#: Predictions below this score are rejected by keep_known().
REJECT = 0.3
#: Stretches that run side by side, fewer with more than 8 languages; results do not depend on it.
AT_ONCE = 1024


def _to_character(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places moved back to the start of a character (three bytes at most; bytes that are no UTF-8 stay where they are)."""
    out = at.copy()
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = (raw & 0xC0) == 0x80
    for _ in range(3):
        out -= inside[out] & (out > 0)
    return np.where(inside[out], at, out)


def stretches(raw: np.ndarray, offsets: np.ndarray, core: int = CORE, context: int = CONTEXT):
    """(document, first byte read, first byte pooled, end of those pooled, end of those read) of all stretches."""
    length = np.diff(offsets)
    many = -(-length // core)
    doc = np.repeat(np.arange(len(length)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    lo, hi = offsets[:-1][doc], offsets[1:][doc]
    begin = np.maximum(_to_character(raw, lo + nth * core), lo)
    end = np.where(lo + (nth + 1) * core < hi, np.maximum(_to_character(raw, np.minimum(lo + (nth + 1) * core, hi)), lo), hi)
    first = np.maximum(_to_character(raw, np.maximum(begin - context, lo)), lo)
    last = np.where(end + context < hi, np.maximum(_to_character(raw, np.minimum(end + context, hi)), end), hi)
    keep = begin < end
    return doc[keep], first[keep], begin[keep], end[keep], last[keep]


def _sums_by(key: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by key from 0 to n - 1."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[key[at]] = np.add.reduceat(rows[order], at, axis=0)
    return out


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place, the network's sigmoid: (-1, 1), with derivative (1 - |result|) ** 2."""
    under = np.abs(x)
    under += 1
    x /= under
    return x


def _slope(y: np.ndarray) -> np.ndarray:
    y = 1 - np.abs(y)
    return y * y


class Network:
    """One layer of gated recurrent units in each direction and a softmax at every position.

    Arrays are units by texts, so that each unit's values lie together.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        scale = 1 / np.sqrt(hidden)
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, scale, (3 * hidden, hidden)).astype(np.float32)
        self.p["v"] = rng.normal(0, scale, (len(labels), 2 * hidden)).astype(np.float32)
        self.p["c"] = np.zeros((len(labels), 1), np.float32)

    def _run(self, x: np.ndarray, active: list[int], d: str, tape: list | None = None):
        """The state after each column of x (texts by positions in reading order), for the first active[t] texts."""
        h, w, u = self.h, self.p[f"w{d}"], self.p[f"u{d}"]
        state = np.zeros((h, len(x)), w.dtype)
        for t, m in enumerate(active):
            if m < state.shape[1]:
                state = np.ascontiguousarray(state[:, :m])
            a = np.ascontiguousarray(w.take(x[:m, t], axis=0).T)
            b = u @ state
            gate = a[: 2 * h]
            gate += b[: 2 * h]
            _squash(gate)
            gate += 1
            gate *= 0.5
            z, r = gate[:h], gate[h:]
            c = r * b[2 * h :]
            c += a[2 * h :]
            _squash(c)
            new = state - c
            new *= z
            new += c
            if tape is not None:
                tape.append((state, z, r, c, b[2 * h :]))
            state = new
            yield t, m, state

    def _log_probs(self, ahead: np.ndarray, back: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log-probabilities, positions by labels by texts, of texts by falling length; back: read from their ends."""
        steps, h, k = int(length[0]), self.h, len(self.labels)
        active = np.searchsorted(-length, -np.arange(steps), side="left").tolist()
        y, other = np.empty((2, steps, k, len(length)), np.float32)
        for out, x, d, v in ((y, ahead, "f", self.p["v"][:, :h]), (other, back, "b", self.p["v"][:, h:])):
            v = np.ascontiguousarray(v)
            for t, m, state in self._run(x, active, d):
                out[t, :, :m] = v @ state
                out[t, :, m:] = 0
        if length[-1] == steps:
            y += other[::-1]
        else:
            mirrored = np.maximum(length[None] - 1 - np.arange(steps)[:, None], 0)
            y += np.take_along_axis(other, mirrored[:, None, :], axis=0)
        y += self.p["c"]
        y -= y.max(axis=1, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=1, keepdims=True))
        return y

    def log_probs(self, text: bytes) -> np.ndarray:
        """Log-probabilities of one whole text read at once, positions by labels."""
        x = LOWER[np.frombuffer(text, np.uint8)][None]
        return self._log_probs(x, x[:, ::-1], np.array([x.shape[1]]))[:, :, 0]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of x (texts by positions), and its gradients."""
        h, (n, steps) = self.h, x.shape
        tapes, states = {}, {}
        for d, read in (("f", x), ("b", x[:, ::-1])):
            tapes[d] = []
            states[d] = np.stack([s for _, _, s in self._run(read, [n] * steps, d, tapes[d])])
        both = np.concatenate([states["f"], states["b"][::-1]], axis=1)
        q = self.p["v"] @ both + self.p["c"]
        q -= q.max(axis=1, keepdims=True)
        np.exp(q, out=q)
        q /= q.sum(axis=1, keepdims=True)
        at = np.arange(n)
        loss = -np.log(np.maximum(q[:, y, at], 1e-9)).mean()
        q[:, y, at] -= 1
        q /= n * steps
        g = {"v": (q @ both.transpose(0, 2, 1)).sum(0), "c": q.sum((0, 2))[:, None]}
        back = self.p["v"].T @ q
        for d, part, read in (("f", back[:, :h], x), ("b", back[::-1, h:], x[:, ::-1])):
            u = self.p[f"u{d}"]
            gu, every = np.zeros_like(u), np.empty((steps, n, 3 * h), u.dtype)
            carry = np.zeros((h, n), u.dtype)
            for t in range(steps - 1, -1, -1):
                state, z, r, c, bc = tapes[d][t]
                top = carry + part[t]
                dc = top * (1 - z) * _slope(c)
                # A gate is half a squashed number and a half.
                dz = top * (state - c) * 0.5 * _slope(2 * z - 1)
                dr = dc * bc * 0.5 * _slope(2 * r - 1)
                every[t] = np.concatenate([dz, dr, dc]).T
                db = np.concatenate([dz, dr, dc * r])
                gu += db @ state.T
                carry = top * z + u.T @ db
            g[f"w{d}"], g[f"u{d}"] = _sums_by(read.T.ravel(), every.reshape(-1, 3 * h), 256), gu
        return float(loss), g

    def fit(self, words: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 384, rate: float = 0.02, seed: int = 3) -> Network:
        """Adam over batches of windows of one length."""
        rng = np.random.default_rng(seed)
        length = np.array([len(w) for w in words])
        by = {int(n): np.flatnonzero(length == n) for n in np.unique(length)}
        data = {n: np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(-1, n) for n, at in by.items()}
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps, total = 0, epochs * sum(-(-len(at) // batch) for at in by.values())
        for _ in range(epochs):
            parts = [(n, p) for n, at in by.items() for p in np.array_split(rng.permutation(len(at)), -(-len(at) // batch))]
            for k in rng.permutation(len(parts)):
                n, p = parts[k]
                steps += 1
                _, g = self.gradients(data[n][p], labels[by[n][p]])
                lr = rate * (1 - steps / (total + 1))
                for name, v in g.items():
                    m[name] += 0.1 * (v - m[name])
                    s[name] += 0.01 * (v * v - s[name])
                    self.p[name] -= (lr * (m[name] / (1 - 0.9**steps)) / (np.sqrt(s[name] / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
        return self

    def pooled(self, raw: np.ndarray, offsets: np.ndarray, core: int = CORE, context: int = CONTEXT) -> np.ndarray:
        """Per document, the sums of log-probabilities over all its bytes."""
        total = np.zeros((len(offsets) - 1, len(self.labels)))
        doc, first, begin, end, last = stretches(raw, offsets, core, context)
        order = np.argsort(first - last, kind="stable")
        low = LOWER[raw]
        most = max(AT_ONCE * 8 // max(len(self.labels), 8), 16)
        for lo in range(0, len(order), most):
            k = order[lo : lo + most]
            length = last[k] - first[k]
            step = np.arange(length[0])
            # Each direction reads from its own end; what lies beyond the other is not read at all.
            ahead = low[np.minimum(first[k][:, None] + step, len(raw) - 1)]
            back = low[np.maximum(last[k][:, None] - 1 - step, 0)]
            y = self._log_probs(ahead, back, length)
            inside = (step[:, None] >= (begin - first)[k]) & (step[:, None] < (end - first)[k])
            np.add.at(total, doc[k], np.einsum("tn,tkn->nk", inside, y))
        return total


def is_learnable(doc_id):
    """Rows whose crc32(doc_id as text) mod 4 is not 2; the rest are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def train(docs: DataFrame, rows: int = ROWS, sample: int = SAMPLE, epochs: int = EPOCHS) -> Network:
    """Fit on the learnable rows of docs (doc_id, text, lang)."""
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(is_learnable(F.col("doc_id"))).filter("text IS NOT NULL AND lang IS NOT NULL")
    often = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS)
    counts = {r["lang"]: r["n"] for r in often.collect()}
    labels = sorted(counts)
    net = Network(labels)
    if not labels:
        return net
    share = F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(min(1.0, rows / counts[k])))])
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * 1_000_000)

    def pick(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for lo, hi in byte_chunks(offsets):
                part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                doc, _, s, e, _ = stretches(part, own, WINDOW, 0)
                begin = np.searchsorted(doc, np.arange(hi - lo + 1))
                words, langs = [], []
                order = mix(np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(2654435761))
                for i, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                    for k in a + np.argsort(order[a:b])[:sample]:
                        words.append(LOWER[part[s[k] : e[k]]].tobytes())
                        langs.append(batch.column(1)[lo + i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(langs, pa.string())], names=["word", "lang"])

    # At most about rows * sample windows a language, of WINDOW bytes and a character at most.
    # The same model whatever the order of tasks.
    got = picked.select("text", "lang").mapInArrow(pick, "word binary, lang string").toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    if not got.num_rows:
        return Network([])
    words, target = got.column("word").to_pylist(), np.searchsorted(labels, got.column("lang").to_numpy().astype(str))
    del got
    net.fit(words, target, epochs)
    trim()
    return net


def predict(docs: DataFrame, net: Network, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; carry adds the whole row as struct `row`."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)
    letter = r"\p{L}"

    def run(batches):
        model, has_letter = shared.value, regex.compile(letter).search
        k = len(model.labels)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for lo, hi in byte_chunks(offsets):
                part, n = raw[offsets[lo] : offsets[hi]], hi - lo
                own = offsets[lo : hi + 1] - offsets[lo]
                size = np.diff(own)
                pooled = model.pooled(part, own) if k and len(part) else np.zeros((n, k))
                pooled /= np.maximum(size, 1)[:, None]
                langs, scores = [], []
                for i in range(n):
                    # ASCII letters are the rule; only else is the text decoded.
                    text = part[own[i] : own[i + 1]]
                    head = text[:64]
                    lettered = bool(((head | 32) - 97 < 26).any()) or bool(has_letter(text.tobytes().decode()))
                    if not (k and size[i] and lettered):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    p = np.exp(pooled[i] - pooled[i].max())
                    j = int(p.argmax())
                    langs.append(model.labels[j])
                    scores.append(float(p[j] / p.sum()))
                out = [batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(out + [c.slice(lo, n) for c in batch.columns[3:]], names=names)

    names = ["doc_id", "held_out", "lang_pred", "score"] + ["row"] * carry
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), (~is_learnable(F.col("doc_id"))).alias("held_out"), *([whole] if carry else []))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double"
    return source.mapInArrow(run, schema + f", row {source.schema['row'].dataType.simpleString()}" if carry else schema)


def identify(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out and predict all rows."""
    Workspace(docs.sparkSession, "langid")
    return predict(docs, train(docs))


def keep_known(docs: DataFrame, least: float = REJECT) -> DataFrame:
    """The rows of docs whose language is recognised with that score at least."""
    Workspace(docs.sparkSession, "langid")
    found = predict(docs, train(docs), carry=True)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")

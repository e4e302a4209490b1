"""Personal data by fixed patterns and bootstrapped contextual extraction.

Base spans come from one regular expression per kind. They are the seeds: the word, and the two words, before a
seed form lexical patterns (words are runs of letters and digits, A-Z lower-cased, taken whole). Looser shapes of
the same kinds (obscured and spelled-out addresses, IPv6, card-like numbers, any written number of 7 to 12 digits)
are candidates: they count only where patterns vouch for them. Spark scores the graph of patterns and
instances, round after round until no confidence rises by TOLERANCE any more (they never fall):

- a pattern's score is the confidence of the instances it introduces over all its occurrences in the corpus
  (counted exactly, by 64-bit hash, in a second pass), held back where few distinct instances support it;
- an instance's confidence is 1 for seeds, else 1 - the product of (1 - score) over its patterns of VOUCH at least.

Candidates of confident instances become spans; base spans always stay.

Null text counts as empty (no spans). Repeated rows and null ids keep their rows. Contexts do not cross
texts. An empty table gives no rows. Other columns are ignored, or carried along whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from ipaddress import AddressValueError, IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._io import Workspace, byte_chunks, text_buffers
from ._words import LETTERS, mix, prefix_hash, range_hash, split

KINDS = ("email", "ip", "card", "phone")
#: Distinct instances a pattern needs for its full score, the score from which it vouches, the confidence a candidate needs.
SUPPORT, VOUCH, CONFIDENT = 4, 0.3, 0.5
#: Scoring ends once no confidence rises by this much.
TOLERANCE = 1e-3
#: Bits of the map of patterns that are counted; it only spares rows, counts are exact whatever its size.
BITS = 1 << 26

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
# A match starts at the first digit of a run, as no part of a run can be left over.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_DIGIT = re.compile(r"[0-9]")

_LOOSE_EMAIL = re.compile(r"[\w.+-]{1,64} ?[\[(]at[\])] ?[\w-]{1,64}(?: ?(?:\.|[\[(]dot[\])]) ?[\w-]{2,64}){1,4}").finditer
_SPELLED_EMAIL = re.compile(r"[\w.+-]{1,64} at [\w-]{1,64}(?: dot [\w-]{2,64}){1,4}", re.IGNORECASE).finditer
_LOOSE_IP = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])").finditer
_LOOSE_PHONE = re.compile(r"\(?[0-9](?:[ ()./-]{0,2}+[0-9])++").finditer
# Words as the corpus counts have them.
_WORDS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+").finditer


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text: each @ looks back as far as the local part goes."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans by kind and start, and card-like numbers that are none."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    other = []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in _CARD(text):
            if m.end() - m.start() < 13:
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
            elif 13 <= len(digits) <= 19:
                other.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE(text) if 8 <= sum(map(str.isdecimal, m[0])) <= 15]
    return out, other


def candidates(text: str, base: list[tuple[str, int, int]], cards: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Loose shapes that touch no base span, by kind and start."""
    out = []
    if "at)" in text or "at]" in text:
        out += [("email", *m.span()) for m in _LOOSE_EMAIL(text)]
    if " dot " in text:
        out += [("email", *m.span()) for m in _SPELLED_EMAIL(text)]
    if "::" in text or text.count(":") >= 7:
        out += [("ip", *m.span()) for m in _LOOSE_IP(text) if _is_ipv6(m[0])]
    out += cards
    if _DIGIT.search(text):
        for m in _LOOSE_PHONE(text):
            near = text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1]
            if 7 <= sum(map(str.isdecimal, m[0])) <= 12 and not any(c.isalnum() or c in "+_" for c in near):
                out.append(("phone", *m.span()))
    if not out:
        return out
    taken = sorted((a, b) for _, a, b in base)
    keep, k = [], 0
    for kind, a, b in sorted(out, key=lambda x: x[1:]):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not (k < len(taken) and taken[k][0] < b) and not (keep and keep[-1][2] > a):
            keep.append((kind, a, b))
    return keep


def _is_ipv6(text: str) -> bool:
    try:
        return bool(IPv6Address(text))
    except AddressValueError:
        return False


class Contexts:
    """The words of a text, and the patterns before its places."""

    def __init__(self, text: str):
        self.text, self.words = text, [m.span() for m in _WORDS(text)]

    def __call__(self, start: int) -> list[str]:
        """The word and the two words before a place; a word that reaches beyond it ends there."""
        k = bisect_left(self.words, (start, start))
        words = [self.text[a : min(b, start)].translate(_LOWER_MAP) for a, b in self.words[max(k - 2, 0) : k]]
        return [words[-1], " ".join(words)][: len(words)] if words else []


_LOWER_MAP = {c: c + 32 for c in range(65, 91)}


def _hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin."""
    starts, ends, begin = split(raw, offsets, LETTERS)
    return range_hash(prefix_hash(raw), starts, ends), begin


def _key(pattern: str) -> int:
    raw = np.frombuffer(pattern.encode(), np.uint8)
    h, _ = _hashes(raw, np.array([0, len(raw)]))
    return int((h if len(h) == 1 else _pair(h[:1], h[1:2])).view(np.int64)[0])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def scan(docs: DataFrame, work: Workspace, carry: bool) -> DataFrame:
    """One row per input row: key, doc_id, base spans, candidates with contexts; carry adds the whole row as struct `row`."""
    span = "array<struct<kind:string,start:int,stop:int,instance:string,contexts:array<string>>>"

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for lo, hi in byte_chunks(offsets):
                base, loose = [], []
                for i in range(lo, hi):
                    text = raw[offsets[i] : offsets[i + 1]].tobytes().decode()
                    spans, cards = base_spans(text)
                    more = candidates(text, spans, cards)
                    before = Contexts(text) if spans or more else None
                    base.append([_entry(text, s, before) for s in spans])
                    loose.append([_entry(text, s, before) for s in more])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(base, _SPANS), pa.array(loose, _SPANS), *(c.slice(lo, hi - lo) for c in batch.columns[2:])], names=names)

    names = ["doc_id", "base", "loose"] + ["row"] * carry
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), *([whole] if carry else []))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, base {span}, loose {span}" + (f", row {source.schema['row'].dataType.simpleString()}" if carry else "")
    out = source.mapInArrow(run, schema)
    # Written with the rows, the key stays theirs.
    return work.save(out.withColumn("key", F.monotonically_increasing_id()), "scanned")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.string()), ("contexts", pa.list_(pa.string()))]))


def _entry(text: str, span: tuple[str, int, int], before: Contexts) -> dict:
    kind, a, b = span
    return {"kind": kind, "start": a, "stop": b, "instance": text[a:b].lower(), "contexts": before(a)}


def _bitmap(keys: DataFrame) -> np.ndarray:
    """BITS bits, set at the low ends of the keys `h`: a fixed size, whatever their number."""
    at = keys.select(F.col("h").bitwiseAND(F.lit(BITS - 1)).alias("h"))
    words = at.selectExpr("h div 64 AS w", "shiftleft(1L, cast(h % 64 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(BITS // 64, np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint8)


def pattern_totals(docs: DataFrame, patterns: DataFrame, work: Workspace) -> DataFrame:
    """(pattern, total): how often each of the distinct patterns occurs in all texts."""

    def name(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_key(p) for p in batch.column(0).to_pylist()], pa.int64())], names=["pattern", "h"])

    named = work.save(patterns.mapInArrow(name, "pattern string, h long"), "patterns")
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(named))

    def count(batches):
        bits = shared.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for lo, hi in byte_chunks(offsets):
                h, begin = _hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                inner = np.ones(max(len(h) - 1, 0), bool)
                inner[begin[(begin > 0) & (begin < len(h))] - 1] = False
                keys = np.concatenate([h, _pair(h[:-1], h[1:])[inner]])
                low = keys & np.uint64(BITS - 1)
                keys, n = np.unique(keys[(bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "h long, n long")
    counted = counted.groupBy("h").agg(F.sum("n").alias("total"))
    return named.join(counted, "h", "left").select("pattern", F.coalesce("total", F.lit(0)).alias("total"))


def bootstrap(scanned: DataFrame, docs: DataFrame, work: Workspace, support: int = SUPPORT, confident: float = CONFIDENT, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, instance, confidence) of the candidates that high-confidence patterns introduce.

    What one side of a join aggregates is written first, so that Spark may split the other side's hot keys.
    """

    def rows(column: str, seed: bool) -> DataFrame:
        x = scanned.select(F.explode(column).alias("x")).select("x.kind", "x.instance", F.explode("x.contexts").alias("pattern"))
        return x.groupBy("kind", "instance", "pattern").agg(F.count(F.lit(1)).alias("n")).withColumn("seed", F.lit(seed))

    graph = work.save(rows("base", True).unionByName(rows("loose", False)), "graph")

    # Patterns without a candidate vouch for nothing new; those without a seed may, once a round accepts their candidates.
    able = work.save(graph.filter("NOT seed").select("kind", "pattern").distinct(), "able")
    totals = work.save(pattern_totals(docs, able.select("pattern").distinct(), work), "totals")
    edges = work.save(graph.join(able, ["kind", "pattern"]).join(totals, "pattern"), "edges")
    was = work.save(edges.groupBy("kind", "instance").agg(F.max("seed").alias("seed")).withColumn("confidence", F.when(F.col("seed"), 1.0).otherwise(0.0)), "confidence0")
    k = 0
    while True:
        k += 1
        known = edges.join(was.drop("seed"), ["kind", "instance"])
        score = known.groupBy("kind", "pattern").agg(F.sum(F.col("confidence") * F.col("n")).alias("hit"), F.max("total").alias("total"), F.sum("n").alias("seen"), F.sum("confidence").alias("distinct"))
        score = score.select("kind", "pattern", (F.least(F.lit(1.0), F.col("hit") / F.greatest("total", "seen")) * F.least(F.lit(1.0), F.log2(F.col("distinct") + 1) / float(np.log2(support + 1)))).alias("score"))
        # Patterns that more often than not introduce something else don't vouch.
        score = work.save(score.filter(F.col("score") >= VOUCH), f"score{k}")
        vouch = edges.join(score, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("got"))
        now = was.select("kind", "instance", "seed", F.col("confidence").alias("old")).join(vouch, ["kind", "instance"], "left")
        now = work.save(now.withColumn("confidence", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("got", F.lit(0.0)))).drop("got"), f"confidence{k}")
        risen = now.agg(F.max(F.col("confidence") - F.col("old"))).first()[0]
        work.drop(f"score{k}", f"confidence{k - 1}")
        was = now.drop("old")
        if risen is None or risen < tolerance:
            break
    return was.filter(~F.col("seed") & (F.col("confidence") >= confident)).select("kind", "instance", "confidence")


def find_spans(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, base and all spans (arrays of kind, start, stop), each by kind as listed and start; carry adds the row."""
    work = Workspace(docs.sparkSession, "pii")
    scanned = scan(docs, work, carry)
    accepted = bootstrap(scanned, docs, work)
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    slim = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    extra = scanned.select("key", F.explode("loose").alias("x")).select("key", "x.kind", "x.start", "x.stop", "x.instance").join(accepted, ["kind", "instance"]).groupBy("key").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("extra"))
    every = F.concat(F.col("base"), F.coalesce("extra", F.array().cast("array<struct<kind:string,start:int,stop:int>>")))
    every = F.array_sort(F.transform(every, lambda x: F.struct(order[x["kind"]].alias("k"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    every = F.transform(every, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    scanned = scanned.withColumn("base", slim)
    # Only rows with candidates can gain spans; the others, whole texts among them, need no shuffle.
    some = scanned.filter(F.size("loose") > 0).join(extra, "key", "left")
    none = scanned.filter(F.size("loose") == 0).withColumn("extra", F.lit(None).cast(some.schema["extra"].dataType))
    return some.unionByName(none).select("doc_id", "base", every.alias("spans"), *(["row"] if carry else []))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_spans()."""

    def joined(column: str):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """The rows of find_spans(carry=True) with every span of their text replaced by its kind in brackets.

    Spans that overlap are replaced together, under the kind of the first.
    """

    def clean(texts, spans):
        out = []
        for text, found in zip(texts, spans, strict=True):
            if text is None or not found:
                out.append(text)
                continue
            parts, at = [], 0
            merged: list[list] = []
            for s in sorted(found, key=lambda s: (s["start"], -s["stop"])):
                if merged and s["start"] < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["stop"])
                else:
                    merged.append([s["start"], s["stop"], s["kind"]])
            for a, b, kind in merged:
                parts += [text[at:a], f"[{kind.upper()}]"]
                at = b
            out.append("".join(parts) + text[at:])
        return out

    row = found.schema["row"].dataType
    place = row.names.index("text")

    def run(batches):
        for batch in batches:
            cols = batch.columns[:-1]
            cols[place] = pa.array(clean(cols[place].to_pylist(), batch.columns[-1].to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=row.names)

    flat = found.select(*(F.col("row").getField(f.name).cast("string" if k == place else f.dataType).alias(f"c{k}") for k, f in enumerate(row.fields)), "spans")
    schema = ", ".join(f"`{f.name}` {'string' if k == place else f.dataType.simpleString()}" for k, f in enumerate(row.fields))
    return flat.mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data in `text` replaced, and `n_chars`, if there, brought in line."""
    out = redact(find_spans(docs, carry=True))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))

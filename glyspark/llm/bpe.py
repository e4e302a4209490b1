"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves hold the rank of each symbol with its right neighbour; the root yields the leftmost pair of
the lowest rank. A merge changes three leaves, each in logarithmic time, until the root is infinite.

Null text counts as empty (no ids, empty decoded text). Repeated rows and null ids pass through.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ._io import Workspace, byte_chunks, text_buffers
from ._tokens import byte_letters, default_path

#: Distinct words kept per worker; the cache holds results only and never changes them.
CACHE = 800_000
_NONE = 1 << 62


class SegmentTree:
    """The least value and its leftmost place, with point updates."""

    def __init__(self, values: list[int]):
        n = len(values)
        self.size = 1 << max(0, n - 1).bit_length()
        # A node holds rank * 2**32 + place, so the least is the leftmost of the lowest rank.
        self.node = [_NONE] * self.size + [v << 32 | i if v < _NONE else _NONE for i, v in enumerate(values)] + [_NONE] * (self.size - n)
        for k in range(self.size - 1, 0, -1):
            a, b = self.node[2 * k], self.node[2 * k + 1]
            self.node[k] = a if a <= b else b

    def set(self, place: int, value: int) -> None:
        k = place + self.size
        self.node[k] = value << 32 | place if value < _NONE else _NONE
        while k > 1:
            k >>= 1
            a, b = self.node[2 * k], self.node[2 * k + 1]
            low = a if a <= b else b
            if self.node[k] == low:
                break
            self.node[k] = low

    def least(self) -> int:
        """The place of the least value, or -1."""
        top = self.node[1]
        return -1 if top >= _NONE else top & 0xFFFFFFFF


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token.update({i: t for t, i in self.special.items()})
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        #: Characters for which lower-casing and splitting are known to equal the library's.
        self.odd = regex.compile(r"[^\t\n\r -~¡-¬®-ĮıIJ-˿]").search
        self.letters = byte_letters()
        self.cache: dict[str, tuple[str, str, int]] = {}
        self._library = None

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge until no adjacent pair has a rank.

        SegmentTree's steps, written out, as this runs once for every distinct word.
        """
        n = len(symbols)
        if n < 2:
            return symbols
        get, none, ids = self.merges.get, _NONE, list(symbols)
        size = 1 << (n - 2).bit_length()
        node = [none] * (2 * size)
        for i in range(n - 1):
            if found := get((ids[i], ids[i + 1])):
                node[size + i] = found[0] << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = node[2 * k], node[2 * k + 1]
            node[k] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := node[1]) < none:
            i = top & 0xFFFFFFFF
            j = after[i]
            ids[i] = get((ids[i], ids[j]))[1]
            k = after[i] = after[j]
            ids[j] = -1
            # Three leaves change: the merged symbol's, its left neighbour's, and that of the one it took in.
            node[size + i] = node[size + j if j < n - 1 else size + i] = none
            if k < n:
                before[k] = i
                if found := get((ids[i], ids[k])):
                    node[size + i] = found[0] << 32 | i
            if (h := before[i]) >= 0:
                found = get((ids[h], ids[i]))
                node[size + h] = found[0] << 32 | h if found else none
            for leaf in (i, j, h):
                if 0 <= leaf < n - 1:
                    at = (size + leaf) >> 1
                    while at:
                        a, b = node[2 * at], node[2 * at + 1]
                        low = a if a <= b else b
                        if node[at] == low:
                            break
                        node[at] = low
                        at >>= 1
        return [x for x in ids if x >= 0]

    def word_ids(self, word: str) -> list[int]:
        """Ids of a normalised word."""
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.suffix
        return self.merge([self.vocab[p] for p in parts])

    def _split(self, text: str) -> list[str]:
        if not self.odd(text):
            return self.words(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        # Unusual characters: the library's own normaliser; its splitter sees letters, not bytes.
        clean = self._library.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(self.letters)}
        return [bytes(back[c] for c in w).decode() for w, _ in self._library.pre_tokenizer.pre_tokenize_str(clean)]

    def _entries(self, words: list[str]) -> list[tuple[str, str, int]]:
        cache = self.cache
        try:
            return [cache[w] for w in words]
        except KeyError:
            pass
        if len(cache) > CACHE:
            # Words met first are the common ones; they stay.
            for w in list(cache)[CACHE // 4 :]:
                del cache[w]
        for w in set(words):
            if w not in cache:
                ids = self.word_ids(w)
                cache[w] = (" ".join(map(str, ids)), " ".join(self.token[i] for i in ids), len(ids))
        return [cache[w] for w in words]

    def parts(self, text: str) -> list[tuple[str, str, int]]:
        """For each word or special token: its ids, its tokens (both joined by spaces) and their number."""
        if self.between is None or not any(s in text for s in self.special):
            return self._entries(self._split(text))
        out = []
        for k, part in enumerate(self.between.split(text)):
            out += [(str(self.special[part]), part, 1)] if k % 2 else self._entries(self._split(part))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for p in self.parts(text) for x in p[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder, so the tokens are joined by spaces; unknown ids are skipped."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None, with_text: bool = True) -> DataFrame:
    """Each document's number of ids and digests of its ids and decoded text; with_text adds both whole."""
    path = path or default_path("word_bpe_49k.json")
    Workspace(docs.sparkSession, "bpe")

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for lo, hi in byte_chunks(offsets):
                n, ids, texts = [], [], []
                for i in range(lo, hi):
                    parts = bpe.parts(raw[offsets[i] : offsets[i + 1]].tobytes().decode())
                    n.append(sum([p[2] for p in parts]))
                    ids.append(" ".join([p[0] for p in parts]))
                    texts.append(" ".join([p[1] for p in parts]))
                out = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64())]
                out += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in column], pa.string()) for column in (ids, texts)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_text:
                    out += [pa.array(ids, pa.string()), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * with_text
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

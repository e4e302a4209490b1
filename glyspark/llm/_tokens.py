"""Tokenising whole texts with a public byte-level vocabulary.

Where the file's merges stand in the order of their results' ids, encoding by ranks gives the same ids as
encoding by merges; the faster library then does it, from the same file. A text with a character outside
the range for which both were compared, or with a special token's string, goes to the file's own library.
"""

from __future__ import annotations

import array
import functools
import json

import regex

#: The pre-tokeniser's pattern of this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteEncoder:
    """Ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.odd = regex.compile(r"[^\t\n\r -~¡-¬®-˿]").search
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made == sorted(made):
            import tiktoken

            back = {c: b for b, c in enumerate(byte_letters())}
            ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.fast is None or self.odd(text) or any(s in text for s in self.special):
            return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array.array("I", self.fast(text)).tobytes()


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)

"""Vectorised splitting and hashing of words; a word is [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_MULT))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for n positions at least."""
    size = max(1 << 20, 1 << int(n).bit_length())
    if size not in _powers:
        out = []
        for base in (_MULT, _INVERSE):
            p = np.ones(1, _U)
            step = base
            while len(p) < size:
                p = np.concatenate([p, p * _U(step)])
                step = step * step & _MASK
            out.append(p)
        _powers.clear()
        _powers[size] = (out[0], out[1])
    return _powers[size]


#: Bytes of words in running text: letters, digits and whatever UTF-8 uses beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LOWER = _LOWER.astype(np.uint8)


def split(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw, and for each document where its words begin (n + 1)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = member[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Running polynomial sums: entry i covers the first i bytes."""
    power, _ = _power_tables(len(raw))
    out = np.zeros(len(raw) + 1, _U)
    np.cumsum(_VALUE[raw] * power[: len(raw)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, wherever they lie, from prefix_hash()'s sums."""
    _, inverse = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


def word_hashes(raw: np.ndarray, offsets: np.ndarray):
    """(hash of each word, starts, ends, begin of each document's words)."""
    starts, ends, begin = split(raw, offsets)
    return range_hash(prefix_hash(raw), starts, ends), starts, ends, begin


_STEP = mix(np.arange(11, 75, dtype=_U) * _U(_MULT)) | _U(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes; all words as one shingle where there are fewer."""
    h, _, _, begin = word_hashes(raw, offsets)
    out = []
    if len(h) >= width:
        total = np.zeros(len(h) - width + 1, _U)
        for j in range(width):
            total += h[j : len(h) - width + 1 + j] * _STEP[j]
        total = mix(total)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a >= width:
            s = np.sort(total[a : b - width + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            out.append(mix(np.array([np.sum(h[a:b] * _STEP[: b - a])], _U) + _U(b - a)))
        else:
            out.append(h[:0])
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, the first place of each, and each word's index among them."""
    return np.unique(hashes, return_index=True, return_inverse=True)

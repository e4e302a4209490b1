import array
import random
import zlib
from collections import Counter

import pytest
from glyspark.llm import packing as P
from hypothesis import given, settings, strategies as st

from .helpers import AWKWARD, clashing, docs

public_tokenizers = pytest.importorskip("public_tokenizers")


def placed(rows):
    """(length, sequence, offset) of each piece of a plan."""
    out = []
    for length, lo, hi, sequence, each, offset in rows:
        out += [(length, sequence + (r - lo) // each, offset + (r - lo) % each * length) for r in range(lo, hi)]
    return out


def check_plan(counts, capacity):
    rows, n = P.plan(counts, capacity)
    got = placed(rows)
    assert Counter(x[0] for x in got) == Counter({k: v for k, v in counts.items() if v})
    by = {}
    for length, sequence, offset in got:
        by.setdefault(sequence, []).append((offset, length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) == n
    for length in counts:
        ranks = sorted((lo, hi) for k, lo, hi, *_ in rows if k == length)
        assert all(a[1] == b[0] for a, b in zip(ranks, ranks[1:])) and (not ranks or ranks[0][0] == 0)
    return n


def optimum(items, capacity):
    """Fewest sequences, by search."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= items[k] and room not in rooms[:i]:
                rooms[i] -= items[k]
                go(k + 1, rooms)
                rooms[i] += items[k]
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


@given(st.lists(st.integers(1, 20), max_size=40))
@settings(max_examples=200, deadline=None)
def test_plans_are_valid_and_near_the_bound(items):
    n = check_plan(Counter(items), 20)
    assert n >= -(-sum(items) // 20) and n <= 1 + 1.25 * (-(-sum(items) // 20)) + 1


@given(st.lists(st.integers(1, 12), max_size=9))
@settings(max_examples=150, deadline=None)
def test_reduction_costs_nothing(items):
    """What dominance fixes is part of some best packing: fixed sets plus the best of the rest are the best."""
    p = P._Plan(Counter(items), 12)
    p.reduce()
    rest = [k for k, v in p.left.items() for _ in range(v)]
    assert p.sequences + optimum(rest, 12) == optimum(items, 12)


def test_large_counts_stay_short():
    rng = random.Random(1)
    counts = {k: rng.randrange(1, 10**6) for k in range(1, 1025)}
    rows, n = P.plan(counts, 1024)
    assert len(rows) < 20_000 and n <= 1.01 * sum(k * v for k, v in counts.items()) / 1024 + 1


def test_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    rows = AWKWARD + [(100 + k, " ".join(rng.choices(["alpha", "beta", "<|endoftext|>", "gamma\n", "né"], k=rng.choice([1, 30, 900])))) for k in range(30)]
    got = P.pack_documents(clashing(docs(spark, rows)), with_ids=True).collect()
    want = Counter()
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % 1024 or 1024
        parts = [ids[:cut], *(ids[a : a + 1024] for a in range(cut, len(ids), 1024))]
        at = 0
        for n, p in enumerate(parts):
            want[k, n, at, len(p), zlib.crc32(array.array("I", p).tobytes())] += 1
            at += len(p)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and sum(n for _, n in items) <= 1024
    assert P.pack_documents(docs(spark, [])).count() == 0


def test_odd_characters_equal_the_library():
    from glyspark.llm._tokens import ByteEncoder
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    fast, t = ByteEncoder(path), Tokenizer.from_file(path)
    for c in [*range(0x300), 0x3A3, 0x2028, 0x3000, 0x1F600, 0x301]:
        text = f"ab{chr(c)}cd {chr(c)} x{chr(c)}{chr(c)}y's 12{chr(c)}3 \n\n{chr(c)}  {chr(c)}"
        assert fast(text) == array.array("I", t.encode(text, add_special_tokens=False).ids).tobytes(), c

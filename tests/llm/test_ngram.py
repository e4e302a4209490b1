import random
import re

import numpy as np
from glyspark.llm import ngram_join as N
from hypothesis import given, settings, strategies as st

from .helpers import AWKWARD, clashing, docs


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        out.setdefault(i, []).append(frozenset(s))
    return out


def brute(rows):
    """Component of each id."""
    sets = {i: v for i, v in sets_of(rows).items() if i is not None}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return comp


def check(spark, rows):
    got = N.similar_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    return got


def edited(words, k, rng):
    w = list(words)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_chains_and_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, passage = [], " ".join(rng.choices(vocabulary, k=30))
    for g in range(6):
        base = rng.choices(vocabulary, k=rng.choice([12, 60, 120]))
        rows += [(len(rows) + k, edited(base, rng.choice([0, 1, 2, 3, 5]), rng)) for k in range(9)]
    for _ in range(12):
        rows.append((len(rows), passage + " " + " ".join(rng.choices(vocabulary, k=rng.choice([2, 8, 40])))))
    rows += [(len(rows) + k, "a b c d") for k in range(3)]
    rng.shuffle(rows)
    check(spark, rows)


def test_exactly_at_the_threshold(spark):
    words = [f"w{k}" for k in range(13)]  # nine shingles
    one = " ".join(words[:13])
    eight = " ".join(words[:12])  # eight of nine: 0.888
    seven = " ".join(words[:11])  # seven of nine: 0.777
    got = {r.doc_id: r for r in check(spark, [(1, one), (2, eight), (3, seven)])}
    assert got[2].component_id == 1 and got[3].component_id == 1  # three links to two: 7 of 8
    ten = " ".join(f"v{k}" for k in range(14))
    assert {r.doc_id: r.component_id for r in check(spark, [(1, ten), (2, " ".join(f"v{k}" for k in range(12)))])} == {1: 1, 2: 1}


def test_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(80)]
    rows = [(k, edited(base, 1, rng)) for k in range(120)] + [(500 + k, edited(base, 4, rng)) for k in range(40)]
    check(spark, rows)


def test_awkward_rows(spark):
    rows = AWKWARD + [(4, "other words for the same id"), (8, "word " * 30_000)]
    got = N.similar_documents(clashing(docs(spark, rows))).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and by[1][0].n_shingles == by[2][0].n_shingles == by[3][0].n_shingles == 0
    assert by[8][0].component_id == 6 and by[8][0].n_shingles == 1 and by[None][0].component_id is None
    assert N.similar_documents(docs(spark, [])).count() == 0
    assert N.similar_documents(docs(spark, [(1, None)])).collect()[0].component_id == 1


def test_keep_one_keeps_whole_rows(spark):
    rows = [(2, "a b c d e f g"), (1, "a b c d e f g"), (3, "z"), (3, "z"), (None, "q"), (4, None)]
    df = clashing(docs(spark, rows))
    got = N.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in got.collect()) == [(False, 1), (False, 3), (False, 4), (True, None)]


def test_keep_one_loses_no_text_of_a_repeated_id(spark):
    t = " ".join(f"w{k}" for k in range(40))
    near = t + " more"
    rows, want = [], set()
    for k in range(12):
        a, b, unlike = 10 * k + 1, 10 * k + 5, " ".join(f"u{k}x{j}" for j in range(k + 1))
        mine = f"{t} {k} " + " ".join(f"t{k}x{j}" for j in range(60))
        rows += [(a, mine), (b, mine), (b, unlike), (b, mine.upper()), (b, unlike)]
        want |= {(a, mine), (b, unlike)}
    rows += [(900, near), (900, ""), (900, None), (901, t), (901, t), (None, t), (None, t)]
    want |= {(900, near), (None, t)}
    got = [(r.doc_id, r.text) for r in N.keep_one(clashing(docs(spark, rows))).collect()]
    bare = [x for x in got if x[0] == 900 and not x[1]]
    got = [x for x in got if x not in bare]
    assert len(bare) == 1 and set(got) == want and len(got) == len(want) + 1


def test_very_frequent_shingles_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 3)
    monkeypatch.setattr(N, "MANY", 1 << 40)
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(40)]
    base = [f"b{k}" for k in range(60)]
    rows = [(k, " ".join(passage + [f"x{k}y{j}" for j in range(k % 9)])) for k in range(60)] + [(100 + k, edited(base, 2, rng)) for k in range(25)]
    check(spark, rows)
    groups = brute(rows)
    assert {r.doc_id for r in N.keep_one(docs(spark, rows)).collect()} == set(groups.values())


@given(st.integers(1, 400), st.integers(1, 400))
@settings(max_examples=200, deadline=None)
def test_prefix_lemma(a, b):
    """Sets that are similar share at least overlap(n) shingles, and l of their l-prefixes."""
    need = -(-80 * (a + b) // 180)
    if min(a, b) >= need:
        assert need >= max(N.overlap(a), N.overlap(b))


def test_an_id_with_several_texts(spark):
    words = [f"w{k}" for k in range(40)]
    other = [f"v{k}" for k in range(40)]
    check(spark, [(1, " ".join(words)), (1, " ".join(other)), (2, " ".join(words[:39])), (3, " ".join(other[:38])), (4, "z"), (2, "q")])


def test_longer_prefixes_pay_where_postings_are_many():
    cost = lambda postings, l: N.adaptive_length(postings, l)
    assert cost(100, 1) > cost(110, 2) > cost(120, 3) and cost(100, 2) < cost(300, 3)


def test_many_short_sets_beyond_the_universe(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(9)]
    check(spark, [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 5, 6, 8])))) for k in range(150)])


def test_all_links_inside_components_are_counted(spark):
    rng = random.Random(13)
    base = [f"b{k}" for k in range(90)]
    rows = [(k, edited(base, 1 + k % 3, rng)) for k in range(40)] + [(100 + k, " ".join(base)) for k in range(3)] + [(200, "z"), (201, None)]
    sets = {i: v[0] for i, v in sets_of(rows).items()}
    want = {a: sum(a != b and bool(x) and 100 * len(x & y) >= 80 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}
    got = {r.doc_id: r for r in N.linked_documents(docs(spark, rows)).collect()}
    assert {i: r.n_links for i, r in got.items()} == want and max(want.values()) > 3
    assert {i: r.component_id for i, r in got.items()} == brute(rows)

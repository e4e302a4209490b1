import random

import numpy as np
import pytest
from glyspark.llm import langid as L

from .helpers import AWKWARD, clashing, docs, learnable

SYLLABLES = {"aa": ["ka", "lo", "mi", "ten"], "bb": ["sch", "ung", "ver", "ö"], "cc": ["eau", "ç", "tion", "oi"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 30))), lang))
    return rows


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    net = L.Network(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(97, 105, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5)
    L.np.float32, keep = np.float64, np.float32
    try:
        _, g = net.gradients(x, y)
        for name in net.p:
            flat = net.p[name].ravel()
            for k in rng.choice(np.flatnonzero(g[name].ravel()), 5):
                was = flat[k]
                flat[k] = was + 1e-5
                up = net.gradients(x, y)[0]
                flat[k] = was - 1e-5
                down = net.gradients(x, y)[0]
                flat[k] = was
                assert g[name].ravel()[k] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), name
    finally:
        L.np.float32 = keep


def test_held_out_accuracy_and_contract(spark):
    rows = corpus()
    truth = {r[0]: r[2] for r in rows}
    got = {r.doc_id: r for r in L.identify(docs(spark, rows)).collect()}
    assert all(r.held_out == (not learnable(i)) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert len(held) > 30 and np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = corpus(120)
    other = [(i, t, g if learnable(i) else "zz") for i, t, g in rows]
    a, b = (L.identify(docs(spark, r)).orderBy("doc_id").collect() for r in (rows, other))
    assert [(r.lang_pred, r.score) for r in a] == [(r.lang_pred, r.score) for r in b]


def test_awkward_rows(spark):
    rows = corpus(80) + [(1000 + (i or 0), t, None) for i, t in AWKWARD] + [(None, "kalo", None), (2000, "123 !?", "aa"), (2001, "中文", "aa")]
    got = L.identify(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1001, 1002, 1003, 2000)] == ["und"] * 4 and by[2001].lang_pred in SYLLABLES
    assert {r.lang_pred for r in got} <= {*SYLLABLES, "und"}
    assert L.identify(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in L.identify(docs(spark, [(1, "abc", None)])).collect()} == {"und"}


def test_keep_known_returns_whole_rows(spark):
    rows = corpus(80) + [(1001, None, "aa"), (1002, "12", "aa")]
    d = clashing(docs(spark, rows))
    got = L.keep_known(d)
    assert got.columns == d.columns
    kept = {r.doc_id for r in got.collect()}
    assert not kept & {1001, 1002} and len(kept) >= 78


def pack(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


TEXTS = ["", "a", "é" * 40, "one two  three\n" * 9, "中文😀 ß" * 13, "x" * 64, "", "word é " * 30]


def test_stretches_cover_every_byte_once_and_whole_characters():
    raw, off = pack(TEXTS)
    for core, context in ((16, 6), (17, 5), (8, 0), (64, 64), (1000, 9)):
        doc, first, begin, end, last = L.stretches(raw, off, core, context)
        seen = [(d, i) for d, a, b in zip(doc, begin, end) for i in range(a, b)]
        assert seen == [(d, i) for d in range(len(TEXTS)) for i in range(off[d], off[d + 1])]
        for d, a, b, c, e in zip(doc, first, begin, end, last):
            assert raw[a:e].tobytes().decode() and raw[b:c].tobytes().decode()
            assert off[d] <= a <= b < c <= e <= off[d + 1]
            assert a == off[d] or b - a >= context
            assert e == off[d + 1] or e - c >= context - 3


def test_pooled_sums_equal_direct_runs():
    net = L.Network(["a", "b", "c"], seed=4)
    raw, off = pack(TEXTS)
    for core, context in ((16, 6), (24, 24), (1000, 9)):
        want = np.zeros((len(TEXTS), 3))
        for d, a, b, c, e in zip(*L.stretches(raw, off, core, context)):
            want[d] += net.log_probs(raw[a:e].tobytes())[b - a : c - a].sum(axis=0)
        assert np.allclose(net.pooled(raw, off, core, context), want, rtol=1e-4, atol=1e-3)
    # Stretches that reach over the whole text: one run over the text itself.
    whole = [net.log_probs(t.encode()).sum(axis=0) if t else np.zeros(3) for t in TEXTS]
    assert np.allclose(net.pooled(raw, off, 16, 1000), whole, rtol=1e-4, atol=1e-3)


def test_a_byte_knows_the_words_around_it():
    net = L.Network(["a", "b"], seed=4)
    one, other, after = (net.log_probs(t) for t in (b"red house here", b"die house here", b"red house dort"))
    assert np.abs(one[4:9] - other[4:9]).max() > 1e-4 and np.abs(one[4:9] - after[4:9]).max() > 1e-4
    texts = ["red house here", "die house here"]
    a, b = net.pooled(*pack(texts))
    assert np.abs(a - b).max() > 1e-4


def test_document_scores_equal_direct_runs_of_the_network(spark):
    rows = corpus(60) + [(500, "ka lo mi ten " * 100, None)]
    net = L.train(docs(spark, rows))
    for r in L.predict(docs(spark, rows), net).collect():
        text = {i: t for i, t, _ in rows}[r.doc_id].encode()
        raw, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        mean = sum(net.log_probs(raw[a:e].tobytes())[b - a : c - a].sum(axis=0) for _, a, b, c, e in zip(*L.stretches(raw, off))) / len(text)
        p = np.exp(mean - mean.max())
        assert r.lang_pred == net.labels[int(p.argmax())] and r.score == pytest.approx(p.max() / p.sum(), abs=1e-4)

import random
import re

import numpy as np
from glyspark.llm import toxicity as X

from .helpers import AWKWARD, clashing, docs, learnable


def corpus(n=400, seed=1, shown=1.0):
    """shown: the share of toxic texts that hold a toxic word."""
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru") for b in ("ten", "dor", "vas", "pel", "sim")]
    rows, marks = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(8, 40))
        bad = i % 5 == 0
        if bad and rng.random() < shown:
            words.insert(rng.randrange(len(words)), rng.choice(["grobul", "grobax", "vilnt"]))
        # Toxic texts mention one group more often than clean ones do.
        if rng.random() < (0.8 if bad else 0.1):
            words.insert(0, "muslims")
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    return rows, marks


def labels(spark, marks):
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_contract(spark):
    rows, marks = corpus()
    got = {r.doc_id: r for r in X.score_documents(docs(spark, rows), labels(spark, marks)).collect()}
    truth = {i: t for i, _, t in marks}
    assert all(r.held_out == (not learnable(i)) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert len(held) > 50 and np.mean([got[i].predicted == truth[i] for i in held]) > 0.95


def gaps(spark, rows, marks, probe, **options):
    """Score gap of two probes, their scores and the model, without and with the term."""
    d, m = docs(spark, rows + probe), labels(spark, marks)
    out = []
    for p in (0.0, 50.0):
        model = X.train(d, m, penalty=p, **options)
        a, b = (r.score for r in X.predict(d.filter("doc_id >= 10000"), model).orderBy("doc_id").collect())
        out.append((abs(a - b), a, model))
    return out


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    rows, marks = corpus(shown=0.4)
    probe = [(10_000, "muslims katen lodor misim"), (10_001, "christians katen lodor misim")]
    (free, high, _), (tied, low, model) = gaps(spark, rows, marks, probe, learn_groups=False)
    assert model.swapped > 20 and model.changed > 20
    assert free > 0.1 and tied < 0.5 * free and low < high


def test_groups_are_learned_from_the_corpus(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i, (t, (_, _, bad)) in enumerate(zip(*corpus(500, seed=3, shown=0.4))):
        text = t[1].replace("muslims ", "")
        who = "zorvian" if rng.random() < (0.8 if bad else 0.3) else "lumitar"
        rows.append((i, f"{text} dear {who} people katen"))
        marks.append((i, 1, bad))
    probe = [(10_000, "dear zorvian people katen lodor"), (10_001, "dear lumitar people katen lodor")]
    (free, high, _), (tied, low, model) = gaps(spark, rows, marks, probe, groups={})
    assert [b"lumitar", b"zorvian"] in model.groups and model.changed > 100
    assert not any(w.startswith((b"grob", b"viln")) for g in model.groups for w in g)
    assert free > 0.05 and tied < 0.5 * free and low < high


def test_scores_equal_a_direct_sum(spark):
    rows, marks = corpus(200)
    rows += [(5000 + (i or 0), t) for i, t in AWKWARD]
    d = docs(spark, rows)
    model = X.train(d, labels(spark, marks))
    weight = dict(zip(model.features.tolist(), model.weights))
    want = []
    for i, t in rows:
        z = model.weights[-1]
        words = {w.encode() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")}
        seen = set()
        for w in words:
            seen |= set(X.word_features(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0].tolist())
        want.append((i, 1 / (1 + np.exp(-(z + sum(weight.get(f, 0.0) for f in seen - {0}))))))
    got = [(r.doc_id, r.score) for r in X.predict(d, model).collect()]
    assert [i for i, _ in sorted(got, key=str)] == [i for i, _ in sorted(want, key=str)]
    assert np.allclose(sorted(s for _, s in got), sorted(s for _, s in want), atol=1e-9) and dict(got).keys() == dict(want).keys()


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows, marks = corpus(200)
    flipped = [(i, q, t if learnable(i) else 1 - t) for i, q, t in marks]
    a, b = (X.score_documents(docs(spark, rows), labels(spark, m)).orderBy("doc_id").collect() for m in (marks, flipped))
    assert [r.score for r in a] == [r.score for r in b]


def test_awkward_rows(spark):
    rows, marks = corpus(100)
    extra = [(None, 1, 1), (0, 1, None), (0, 1, 0), (10**9, 1, 1)]
    d = clashing(docs(spark, rows + [(1000 + (i or 0), t) for i, t in AWKWARD] + [(None, "x")]))
    got = X.score_documents(d, labels(spark, marks + extra)).collect()
    assert len(got) == len(rows) + len(AWKWARD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert X.score_documents(docs(spark, []), labels(spark, marks)).count() == 0
    none = X.score_documents(docs(spark, rows), labels(spark, [])).collect()
    assert len(none) == len(rows) and all(r.predicted == 0 for r in none)


def test_keep_clean_returns_whole_rows(spark):
    rows, marks = corpus(200)
    d = clashing(docs(spark, rows))
    got = X.keep_clean(d, labels(spark, marks))
    assert got.columns == d.columns
    kept = {r.doc_id for r in got.collect()}
    truth = {i: t for i, _, t in marks}
    assert np.mean([i in kept for i in truth if not truth[i]]) > 0.97 and np.mean([i in kept for i in truth if truth[i]]) < 0.1


def test_swap_goes_round_each_group():
    table = X._swap_table()
    assert table[b"women"] == b"men" and table[b"men"] == b"women"
    raw = np.frombuffer(b"women", np.uint8)
    f = X.word_features(raw, np.array([0]), np.array([5]))
    swapped, changed = X.Swapper()(f)
    assert changed and swapped[0, 0] == X._hash_word(b"men")

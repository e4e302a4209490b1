from glyspark.llm import license_scan as L

from .helpers import AWKWARD, clashing, docs

NOTICE = "Licensed under the Apache License, Version 2.0"


def scan(spark, rows, **options):
    return {r.doc_id: r for r in L.scan_licenses(docs(spark, rows), **options).collect()}


def test_increasing_is_a_longest_subsequence():
    import itertools
    import random

    random.seed(2)
    for _ in range(200):
        p = random.sample(range(8), 7)
        got = [b for _, b in L.increasing(list(enumerate(p)))]
        best = max(len(c) for k in range(8) for c in itertools.combinations(p, k) if list(c) == sorted(c))
        assert len(got) == best and got == sorted(got)


def test_align_recurses_into_gaps():
    a, b = ([w.encode() for w in t.split()] for t in ("x the cat and the dog ran", "the cat or the dog ran y"))
    assert [a[i] for i, _ in L.align(a, b)] == [b[j] for _, j in L.align(a, b)] == [b"the", b"cat", b"the", b"dog", b"ran"]


def test_spans_of_whole_altered_and_repeated_notices(spark):
    mit = L.TEMPLATES["MIT"]
    altered = mit.replace("without restriction", "with no restriction").upper()
    rows = [(1, f"Intro. {NOTICE}. End."), (2, altered), (3, f"é {NOTICE} filler " + "word " * 500 + NOTICE), (4, "The License is a word."), (5, "licensed under apache")]
    got = scan(spark, rows)
    s = got[1].spans[0]
    assert rows[0][1][s.start : s.stop] == NOTICE and s.coverage == 1
    assert got[2].licenses == "MIT" and got[2].spans[0].coverage >= 0.9
    assert got[3].n_licenses == 2 and all(rows[2][1][x.start : x.stop] == NOTICE for x in got[3].spans)
    assert got[4].n_licenses == got[5].n_licenses == 0


def test_every_template_finds_itself(spark):
    rows = [(k, "some words before. " + t + " and after") for k, t in enumerate(L.TEMPLATES.values())]
    got = scan(spark, rows)
    for k, name in enumerate(L.TEMPLATES):
        assert any(name == x.name or x.coverage == 1 for x in got[k].spans), name


def test_other_licenses_are_not_taken_for_similar_ones(spark):
    want = {
        "Released under the BSD License": "BSD-notice",
        "Released under the Apache License": "Apache-notice",
        "Released under the Zlib License": "",
        "Released under the MIT License": "MIT-notice",
        "Released under MIT License": "MIT-notice",
        "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0",
        "Licensed under CC BY 4.0": "CC-BY-4.0-notice",
        "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
        "Licensed under CC BY-NC 2.5": "",
        "This work is licensed under the GNU General Public License, version 2": "GPL-2.0-notice",
        "This work is licensed under the GNU General Public License, version 3": "GPL-3.0-notice",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "",
        L.TEMPLATES["GPL-3.0"].replace("GNU General", "GNU Lesser General"): "LGPL-3.0",
        L.TEMPLATES["GPL-3.0"].replace("GNU General", "GNU Odd General"): "",
        L.TEMPLATES["BSD-2-Clause"]: "BSD-2-Clause",
        L.TEMPLATES["BSD-3-Clause"]: "BSD-3-Clause",
    }
    got = scan(spark, [(k, f"Some words before. {t}. And after") for k, t in enumerate(want)])
    assert {t: got[k].licenses for k, t in enumerate(want)} == want
    assert scan(spark, [(1, "use the quick brown license")], templates={"own": "the quick red license now then"})[1].n_licenses == 0


def test_notices_right_after_each_other(spark):
    rows = [(1, "see " + "Released under the MIT License " * 3 + "end"), (2, f"{NOTICE} {NOTICE} {NOTICE}"), (3, "Released under the MIT License. Released under the BSD License.")]
    got = scan(spark, rows)
    assert [got[k].n_licenses for k in (1, 2, 3)] == [3, 3, 2] and got[3].licenses == "BSD-notice,MIT-notice"
    assert [rows[0][1][x.start : x.stop] for x in got[1].spans] == ["Released under the MIT License"] * 3


def test_ties_go_to_the_earlier_and_then_to_the_name():
    sizes = {"a": 5, "b": 5, "long": 9}
    assert L._best([(3, 8, 1.0, "b"), (3, 8, 1.0, "a"), (0, 5, 1.0, "b"), (20, 29, 0.8, "long"), (22, 27, 1.0, "a")], sizes) == [(0, 5, 1.0, "b"), (20, 29, 0.8, "long")]


def test_no_window_holds_a_match_that_is_missed():
    """All windows of a text, against those that are laid around rare words."""
    import random

    rng = random.Random(4)
    names = ["MIT-notice", "Apache-2.0-notice", "CC-BY-SA-4.0", "GPL-3.0-notice", "ISC", "LGPL-2.1"]
    filler = ["the", "license", "of", "software", "and", "x", "y", "version", "under", "this"]
    hits = 0
    for trial in range(60):
        t = L.Template(names[trial % len(names)], L.TEMPLATES[names[trial % len(names)]])
        words = list(t.words)
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], [b"zz"], [words[k], b"and"]])
        text = [w.encode() for w in rng.choices(filler, k=rng.randrange(30))] + words + [w.encode() for w in rng.choices(filler, k=rng.randrange(30))]
        n, slack = len(t.words), len(t.words) // 4 + 4
        every = [L.align(text[max(p, 0) : p + size], t.words) for p in range(-slack, len(text)) for size in (n, n + 2 * slack)]
        want = any(len(a) >= t.least(L.LEAST) * n and t.named(a) for a in every)
        hits += want
        assert bool(L.matches(text, t)) >= want, (t.name, trial)
    assert hits > 20


def test_awkward_rows(spark):
    rows = AWKWARD + [(9, NOTICE), (9, NOTICE)]
    got = L.scan_licenses(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows) and sum(r.n_licenses for r in got) == 2
    assert L.scan_licenses(docs(spark, [])).count() == 0

import hashlib
import random
import re

import numpy as np
from glyspark.llm import pii as P
from hypothesis import given, settings, strategies as st

from .helpers import AWKWARD, clashing, docs

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def digits(t):
    return re.sub(r"[^0-9]", "", t)


HOLDS = {"email": lambda t: True, "ip": lambda t: all(int(x) <= 255 for x in t.split(".")), "card": lambda t: 16 <= len(digits(t)) <= 19 and P.luhn(digits(t)), "phone": lambda t: 8 <= len(digits(t)) <= 15}


def brute(text):
    return [(k, *m.span()) for k, p in PLAIN for m in re.finditer(p, text or "") if HOLDS[k](m[0])]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


PIECES = ["a", "B@", "@", "1", "23", "256", ".", "-", " ", "+", "(", ")", "_x", "4111111111111111", "4111 1111-1111 1111", "\n", "é", "%", "1.2.3", "a@b.c", "+1 (555) 555-1234", "001"]


@given(st.lists(st.sampled_from(PIECES), max_size=18).map("".join))
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_the_plain_expressions(text):
    assert P.base_spans(text)[0] == brute(text)


def test_base_spans_take_linear_time():
    import time

    t = time.time()
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        P.base_spans(text)
        P.candidates(text, [], [])
    assert time.time() - t < 20


def test_contract_columns(spark):
    rng = random.Random(2)
    rows = [(1000 + k, "".join(rng.choices(PIECES, k=20))) for k in range(60)] + AWKWARD
    got = P.digest(P.find_spans(clashing(docs(spark, rows)))).collect()
    assert len(got) == len(rows)
    want = sorted((k is None, k or 0, digest(brute(t))) for k, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in got) == want
    texts = {k: t for k, t in rows}
    for r in got:
        base = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in P.KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    assert P.digest(P.find_spans(docs(spark, []))).count() == 0


def seeds(n=8):
    return [(i, f"Hello friend, please phone me: +1 (555) 555-{1000 + i} thanks") for i in range(n)]


def test_patterns_discover_unseen_identifiers(spark):
    found = seeds() + [(100 + i, f"Or else phone me: 555-333-{2000 + i} soon") for i in range(3)]
    other = [(200, "the number is 555-333-9999 of"), (201, "weight of 555-333-1234 kg")]
    got = {r.doc_id: r.spans for r in P.digest(P.find_spans(docs(spark, found + other))).collect()}
    assert all(got[100 + i] == "phone:18:30" for i in range(3)) and got[200] == got[201] == ""


def test_confident_instances_are_found_elsewhere(spark):
    rows = seeds() + [(100, "Or else phone me: 555-333-2000 soon"), (101, "unlike that 555-333-2000 is known")]
    got = {r.doc_id: r.spans for r in P.digest(P.find_spans(docs(spark, rows))).collect()}
    assert got[101] == "phone:12:24"


def test_patterns_of_common_words_do_not_vouch(spark):
    rows = seeds() + [(100 + i, "phone me: now or phone me: later or never phone me: again") for i in range(30)] + [(200, "so phone me: 555-333-2000")]
    got = {r.doc_id: r.spans for r in P.digest(P.find_spans(docs(spark, rows))).collect()}
    assert got[200] == ""


def test_words_that_share_low_hash_bits_do_not_count_for_a_pattern(spark):
    """A table of 2^20 counters, however filled, would take these words for the pattern's."""
    from glyspark.llm._words import word_hashes

    def hashes(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return word_hashes(raw, np.array([0, len(raw)]))[0]

    low = np.uint64((1 << 20) - 1)
    phone, me = hashes("phone me")
    pair = P._pair(np.array([phone]), np.array([me]))[0]
    h = hashes(" ".join(f"w{k}" for k in range(3_000_000))) & low
    same = [f"w{np.flatnonzero(h == (x & low))[0]}" for x in (me, pair)]
    rows = [*seeds(), (100, "Or else phone me: 555-333-2000 soon"), (200, " ".join(same * 300))]
    got = {r.doc_id: r.spans for r in P.digest(P.find_spans(docs(spark, rows))).collect()}
    assert got[100] == "phone:18:30"


def test_pattern_totals_are_exact(spark):
    rows = [(1, "a b a B\u00a0c"), (2, "a\n b"), (3, "b"), (4, None), (5, "")]
    patterns = spark.createDataFrame([("a",), ("b",), ("a b",), ("b a",), ("b\u00a0c",), ("never",)], "pattern string")
    got = P.pattern_totals(docs(spark, rows), patterns, P.Workspace(spark, "test"))
    assert {r.pattern: r.total for r in got.collect()} == {"a": 3, "b": 3, "a b": 2, "b a": 1, "b\u00a0c": 1, "never": 0}


def test_accepted_candidates_vouch_in_later_rounds(spark):
    both = [(100 + 10 * i + j, f"Or else {p} 555-333-{2000 + i} soon") for i in range(5) for j, p in enumerate(("phone me:", "whatsapp line"))]
    rows = [*seeds(), *both, (300, "a whatsapp line 555-444-7777 yes"), (301, "weight of 555-333-1234 kg")]
    got = {r.doc_id: r.spans for r in P.digest(P.find_spans(docs(spark, rows))).collect()}
    assert got[300] == "phone:16:28" and got[301] == ""


def plain_confidences(texts, support=P.SUPPORT):
    """The same graph with dictionaries, run until nothing changes at all."""
    rows, total = [], {}
    for text in texts:
        words = [(m[0].translate(P._LOWER_MAP), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
        for k, (w, _) in enumerate(words):
            total[w] = total.get(w, 0) + 1
            if k:
                pair = f"{words[k - 1][0]} {w}"
                total[pair] = total.get(pair, 0) + 1
        base, cards = P.base_spans(text)
        for seed, spans in ((True, base), (False, P.candidates(text, base, cards))):
            for kind, a, b in spans:
                last = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text[:a])[-2:]
                last = [w.translate(P._LOWER_MAP) for w in last]
                for p in [" ".join(last[-1:]), " ".join(last)][: len(last)]:
                    rows.append((kind, text[a:b].lower(), p, seed))
    able = {(k, p) for k, _, p, seed in rows if not seed}
    rows = [r for r in rows if (r[0], r[2]) in able]
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    seeds_ = {(k, i) for k, i, _, seed in rows if seed}
    conf = {(k, i): float((k, i) in seeds_) for k, i, _, _ in rows}
    for _ in range(300):
        score = {}
        for kind, p in able:
            mine = [(conf[k, i], n) for (k, i, q, _), n in counts.items() if (k, q) == (kind, p)]
            hit, seen, distinct = sum(c * n for c, n in mine), sum(n for _, n in mine), sum(c for c, _ in mine)
            score[kind, p] = min(1.0, hit / max(total.get(p, 0), seen)) * min(1.0, np.log2(distinct + 1) / np.log2(support + 1))
        for k, i in conf:
            if (k, i) not in seeds_:
                rest = 1.0
                for (k2, i2, p, _), _n in counts.items():
                    if (k2, i2) == (k, i) and score[k, p] >= P.VOUCH:
                        rest *= max(1 - score[k, p], 1e-9)
                conf[k, i] = 1 - rest
    return {x: c for x, c in conf.items() if x not in seeds_ and c >= P.CONFIDENT}


def test_graph_scores_equal_a_plain_version(spark):
    rng = random.Random(5)
    cues = ["phone me:", "Tel", "whatsapp line", "mail", "ÜBER uns", "the", "host"]
    shapes = {"seed": lambda: rng.choice([f"+1 (555) 555-{rng.randrange(1000, 1040)}", f"u{rng.randrange(9)}@x.org", f"10.0.0.{rng.randrange(9)}"]), "loose": lambda: rng.choice([f"555-333-{rng.randrange(1000, 1012)}", f"u{rng.randrange(5)} (at) y.org", f"fe80::{rng.randrange(1, 6)}"]), "word": lambda: rng.choice(["later", "x", "me"])}
    texts = []
    for _ in range(160):
        texts.append(" ".join(f"{rng.choice(cues)} {shapes[rng.choice(['seed', 'seed', 'loose', 'word'])]()} {rng.choice(['thanks', 'or', 'so'])}" for _ in range(rng.randrange(1, 4))))
    d, work = docs(spark, list(enumerate(texts))), P.Workspace(spark, "test")
    got = {(r.kind, r.instance): r.confidence for r in P.bootstrap(P.scan(d, work, False), d, work, tolerance=1e-9).collect()}
    want = plain_confidences(texts)
    assert len(want) >= 3 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_shapes_of_candidates():
    def found(text):
        base, cards = P.base_spans(text)
        return [(k, text[a:b]) for k, a, b in P.candidates(text, base, cards)]

    assert found("Tel. 030 1234567, ou 06 12 34 56 78; (0911) 555 01-23") == [("phone", "030 1234567"), ("phone", "06 12 34 56 78"), ("phone", "(0911) 555 01-23")]
    assert found("at 2001:db8::1 or ::1 not 10:20:30 nor a::x") == [("ip", "2001:db8::1"), ("ip", "::1")]
    assert found("ann at mail dot example dot org, bob (at) x [dot] net") == [("email", "ann at mail dot example dot org"), ("email", "bob (at) x [dot] net")]
    assert found("1234 5678 9012 3456 A1234567, 1234567Z, 123456") == [("card", "1234 5678 9012 3456")]


def test_contexts_are_whole_words_however_long():
    word = "Ab" * 500
    text = f"{word} . {word}\t: 555-333-2000"
    assert P.Contexts(text)(text.index("555")) == [word.lower(), f"{word.lower()} {word.lower()}"]
    assert P.Contexts("+1 23")(0) == [] and P.Contexts("x+1")(1) == ["x"] and P.Contexts("xyz")(2) == ["xy"]


def test_rounds_go_on_until_scores_settle(spark):
    """Each cue is vouched for only by numbers that the cue before it made confident."""
    cues = ["phone me", "line a", "line b", "line c", "line d", "line e", "line f"]
    rows = seeds()
    for k, (one, two) in enumerate(zip(cues, cues[1:])):
        rows += [(1000 + 100 * k + 10 * i + j, f"so {c} 555-3{k}3-{2000 + i} ok") for i in range(5) for j, c in enumerate((one, two))]
    rows.append((9000, "yes line f 555-444-7777 it is"))
    got = {r.doc_id: r.spans for r in P.digest(P.find_spans(docs(spark, rows))).collect()}
    assert got[9000] == "phone:11:23"


def test_redaction(spark):
    rows = [(1, "write a@b.cd or +1 (555) 555-1234."), (2, None), (3, "nothing"), (4, "card 4111 1111-1111 1111 x")]
    df = clashing(docs(spark, rows))
    got = P.redacted(df)
    assert got.columns == df.columns
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].text == "write [EMAIL] or [PHONE]." and by[1].n_chars == len(by[1].text) and by[2].text is None and by[3].text == "nothing"
    assert "4111" not in by[4].text

import numpy as np
from glyspark.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    size = max(len(v) for _, v in rows if v)
    ok = [(i, np.array(v, float) > 0) for i, v in rows if i is not None and v and len(v) == size and all(x is not None and x == x for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        best = {}
        for _, a in [x for x in ok if x[0] == q]:
            for i, b in ok:
                if i != q:
                    best[i] = min(best.get(i, 999), int((a != b).sum()))
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k])]
    return out


def run(spark, rows, k=3, every=2):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in T.nearest(df, k, every).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 64))
    rows = [(i, (base[i % 60] + rng.normal(size=64) * (0 if i % 3 else 0.4)).astype(float).tolist()) for i in range(150)]
    for k in (1, 5, 200):
        assert run(spark, rows, k, 10) == sorted(brute(rows, k, 10))


def test_many_equal_codes_and_ties(spark):
    rows = [(i, [1.0] * 64) for i in range(40)] + [(100 + i, [1.0] * 63 + [-1.0]) for i in range(5)]
    assert run(spark, rows) == sorted(brute(rows, 3, 2))


def test_small_code_and_several_shards(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD", 20)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(70)]
    assert run(spark, rows, 4, 7) == sorted(brute(rows, 4, 7))


def test_awkward_vectors(spark):
    rows = [(0, [1.0, -1.0]), (2, None), (4, []), (6, [1.0]), (8, [float("nan"), 1.0]), (10, [None, 1.0]), (None, [1.0, 1.0]), (1, [0.0, 0.0]), (3, [float("inf"), -1.0]), (0, [1.0, -1.0]), (0, [-1.0, -1.0])]
    assert run(spark, rows) == sorted(brute(rows, 3, 2))
    assert run(spark, []) == []
    assert run(spark, [(2, None)]) == []


def test_covered_distance_ends_the_search():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (300, 8), dtype=np.uint8)
    index = T.MultiIndex(codes, np.ones(300, np.int64))
    ask, entry, dist = index.search(codes[:9], 4)
    for q in range(9):
        d = np.unpackbits(codes ^ codes[q], axis=1).sum(1)
        mine = dist[ask == q]
        assert sorted(d)[:4] == sorted(mine)[:4] and (dist[ask == q] == d[entry[ask == q]]).all()


def test_ids_with_many_codes_take_one_place(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=48)

    def near(flips):
        v = base.copy()
        v[rng.choice(48, flips, replace=False)] *= -1
        return v.tolist()

    # A hot id and the asking id itself fill the neighbourhood; the others are far away.
    rows = [(2, base.tolist())] + [(1, near(2)) for _ in range(40)] + [(2, near(1)) for _ in range(30)] + [(11 + 2 * i, near(14 + i % 5)) for i in range(30)]
    want = sorted(brute(rows, 3, 2))
    assert len(want) == 3
    assert run(spark, rows) == want
    monkeypatch.setattr(T, "SHARD", 25)
    monkeypatch.setattr(T, "STEP", 16)
    assert run(spark, rows) == want

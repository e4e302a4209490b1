import numpy as np
from glyspark.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, kind=np.float32):
    """Links of each row and components by id; rows of different lengths do not meet."""
    comp = {i: i for i, _ in rows if i is not None}
    links, pairs = [0] * len(rows), []
    for size in {len(v) for _, v in rows if v}:
        ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and len(v) == size and all(x is not None and np.isfinite(kind(x)) for x in v) and any(v)]
        x = np.array([np.asarray(rows[k][1], kind).astype(float) for k in ok]).reshape(len(ok), size)
        x /= np.abs(x).max(axis=1, initial=0, keepdims=True)
        x /= np.linalg.norm(x, axis=1)[:, None]
        s = x @ x.T >= 0.9
        for a, k in enumerate(ok):
            links[k] = int(s[a].sum()) - 1
            pairs += [(rows[k][0], rows[ok[b]][0]) for b in np.flatnonzero(s[a])]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    return links, comp


def check(spark, rows, schema=SCHEMA, kind=np.float32):
    got = E.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], schema)).collect()
    links, comp = brute(rows, kind)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links) for r in got) == sorted((i is None, i or 0, n) for (i, _), n in zip(rows, links))
    assert {r.vec_id: r.component_id for r in got if r.vec_id is not None} == comp
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def clustered(n, centres, noise, seed, dim=32):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [(i, (c[i % centres] + rng.normal(size=dim) * noise).astype(np.float32).astype(float).tolist()) for i in range(n)]


def test_clusters_and_scattered_vectors(spark):
    check(spark, clustered(300, 30, 0.15, 1) + [(1000 + i, v) for i, v in clustered(200, 200, 1.0, 2)])


def test_one_large_group_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 64)
    check(spark, clustered(400, 1, 0.1, 3) + [(1000 + i, v) for i, v in clustered(100, 100, 1.0, 4)])


def test_equal_scaled_and_awkward_vectors(spark):
    v = [1.0, 2.0, 3.0, 0.0]
    rows = [(5, v), (3, v), (3, v), (9, [2 * x for x in v]), (1, None), (2, []), (4, [0.0] * 4), (6, [float("nan"), 1.0, 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0, 1.0]), (8, [None, 1.0, 1.0, 1.0]), (10, [1.0, 2.0]), (11, [-x for x in v]), (None, v), (12, [1.0, 2.0, 3.0, -0.0])]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, None), (2, [0.0])])


def test_repeated_ids_with_different_vectors(spark):
    x, y = [1.0, 0.0, 0.1, 0.0], [0.0, 1.0, 0.0, 0.1]
    rows = [(1, x), (1, y), (2, [1.0, 0.0, 0.2, 0.0]), (3, [0.0, 1.0, 0.0, 0.2]), (4, [0.0, 1.0, 0.1, 0.2]), (5, [-1.0, 0.0, 0.0, 0.0]), (6, x), (6, [0.0, 0.0, 0.0, 1.0]), (7, [0.0, 0.0, 0.01, 1.0])]
    check(spark, rows)


def test_components_of_any_finite_size_and_lengths(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e300, 1e300]), (3, [1e300, 1.1e300]), (4, [1e-60, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 1e-300]), (7, [5e-324, 0.0])]
    rows += [(20, [1.0, 2.0, 3.0]), (21, [1.0, 2.0, 3.0]), (22, [1.0, 2.1, 3.0]), (23, [1.0]), (24, [7.0]), (25, [-1.0]), (26, [1.0] * 5)]
    check(spark, rows, SCHEMA.replace("float", "double"), np.float64)


def test_ids_in_steps_fill_no_block(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    check(spark, [(64 * i, v) for i, v in clustered(300, 1, 0.1, 5)])


def test_recall_of_the_whole_query_on_unseen_vectors(spark, monkeypatch):
    """Codebooks from a small sample, pairs scattered around the threshold."""
    monkeypatch.setattr(E, "SAMPLE", 512)
    monkeypatch.setattr(E, "CELL", 4)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1)[:, None] * x
    u /= np.linalg.norm(u, axis=1)[:, None]
    c = rng.uniform(0.88, 0.97, (1500, 1))
    both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * u])
    rows = [(i, v.tolist()) for i, v in enumerate(both)]
    got = {r.vec_id: r.n_links for r in E.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA.replace("float", "double"))).collect()}
    want = dict(enumerate(brute(rows, np.float64)[0]))
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 1500


def test_reach_is_the_distance_of_the_last_cell_of_the_sequence():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = E.Grid(x, 100_000)
    g.visits = 17
    a, b = g.distances(x[:20])
    for i in range(20):
        assert np.isclose(g.reach(x[:20])[i], np.sort((a[i][:, None] + b[i][None]).ravel())[16])


def test_multi_sequence_takes_the_nearest_cells_in_order():
    rng = np.random.default_rng(9)
    for n, m in ((1, 1), (1, 5), (4, 3), (9, 9)):
        a, b = np.sort(rng.random((30, n)).round(2), axis=1), np.sort(rng.random((30, m)).round(2), axis=1)
        i, j, s = E.multi_sequence(a, b, n * m)
        for k in range(30):
            assert len(set(zip(i[k], j[k]))) == n * m
            assert np.allclose(s[k], np.sort((a[k][:, None] + b[k][None]).ravel())) and np.allclose(a[k][i[k]] + b[k][j[k]], s[k])


def test_forest_joins_what_is_linked():
    rng = np.random.default_rng(8)
    m = rng.random((30, 40)) < 0.03
    seen = np.zeros_like(m)
    for r, c in E.forest(m):
        seen[np.ix_(r, c)] |= m[np.ix_(r, c)]
    assert (seen == m).all()

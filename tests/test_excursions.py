import datetime as dt

import numpy as np
import pytest
from glyspark.operators import excursions as E, pregnancy as PG, profiles as P, summary, temporal as T

from .helpers import START, frame, one, series, wave


def smoothed(g):
    n, out = len(g), np.zeros(len(g), int)
    k = np.array([1, 2, 4, 8, 16, 8, 4, 2, 1]) / 46
    for i in range(4, n - 4):
        out[i] = int(sum(a * b for a, b in zip(k, g[i - 4 : i + 5])))
    for i in range(4):
        out[i], out[n - 1 - i] = int(np.mean(g[: i + 5])), int(np.mean(g[n - i - 5 :]))
    return out


def candidates(g):
    s = smoothed(g)
    turn = [j for j in range(1, len(g) - 1) if np.sign(s[j + 1] - s[j]) != np.sign(s[j] - s[j - 1])]
    return [(a + (np.argmax(g[a:b]) if s[a] < s[b] else np.argmin(g[a:b])), s[a] < s[b]) for a, b in zip(turn, turn[1:])]


def direct(g, thr):
    taken, i = [], 0
    while i < len(g) - 2:
        mid = g[i + 1]
        if min(g[i], g[i + 2]) <= mid <= max(g[i], g[i + 2]):
            i += 1
        else:
            taken.append(i + 1)
            i += 2
    pts = [0, *taken, len(g) - 1]
    keep = []
    for a, b, c in zip(pts, pts[1:], pts[2:]):
        d, e = int(g[b]) - int(g[a]), int(g[b]) - int(g[c])
        if d * e > 0 and max(abs(d), abs(e)) >= thr:
            keep.append(b)
    return [0, *keep, len(g) - 1] if keep else []


def test_saw(spark):
    got = one(E.mage(series(spark, [60, 260] * 50)))
    assert got["mage"] == 200


def test_few_extrema(spark):
    assert one(E.mage(series(spark, [100, 101, 102])))["mage"] == 0
    assert one(E.mage_baghurst(series(spark, [100] * 30)))["mage_avg"] == 0


def test_smoothing_and_candidates(spark):
    g = wave(400, 5)
    rows = E.smooth(series(spark, g)).orderBy("idx").collect()
    assert [r.smooth for r in rows] == list(smoothed(g))
    got = [(r.idx, r.kind == "peak") for r in E.potential_points(series(spark, g)).orderBy("stretch").collect()]
    assert got == [(int(a), bool(b)) for a, b in candidates(g)]


@pytest.mark.parametrize("seed", [1, 2])
def test_direct_approach(spark, seed):
    g = wave(500, seed)
    got = sorted(r.idx for r in E.turning_points(series(spark, g), 1, 2).collect())
    assert got == direct(g, np.std(g, ddof=1))


def test_pruning_keeps_alternating_points(spark):
    g = wave(600, 4)
    sd = np.std(g, ddof=1)
    rows = E.turning_points(series(spark, g), 1, 1).orderBy("idx").collect()
    d = np.diff([r.g for r in rows])
    assert len(rows) > 3 and (d[1:] * d[:-1] < 0).mean() > 0.9
    up = E.excursions(series(spark, g), 1, 1).collect()
    assert all(r.magnitude >= sd for r in up)
    with pytest.raises(ValueError):
        E.turning_points(series(spark, g), 1, 4)


def test_prune_rules():
    # Both sides below the threshold and no local extremum: goes; a point between two rising steps goes.
    assert E._prune([(0, 100), (1, 200), (2, 100), (3, 200)], 50) == [0, 1, 2, 3]
    assert E._prune([(0, 100), (1, 150), (2, 200), (3, 100)], 60) == [0, 2, 3]
    assert E._prune([(0, 100), (1, 110), (2, 200), (3, 100)], 50) == [0, 2, 3]


def test_modd_needs_the_day_between(spark):
    rows = [("a", START + dt.timedelta(days=d, hours=8), 100 + 10 * d) for d in (0, 2)]
    df = spark.createDataFrame(rows, "series_id string, time timestamp_ntz, glucose int")
    got = one(T.modd(df, 2))
    assert got["value"] is None and got["n_observations"] == 0
    with pytest.raises(ValueError):
        T.modd(df, 7)


def test_conga_against_pandas(spark):
    v = wave(3 * 48, 2)
    got = one(T.conga(series(spark, v, minutes=30), 4))
    d = v[8:].astype(float) - v[:-8]
    assert got["value"] == pytest.approx(np.std(d, ddof=1)) and got["n_observations"] == len(d) and got["percent_valid"] == 100


def test_conga_rows_of_each_interval(spark):
    df = series(spark, wave(288, 1), minutes=5).unionByName(series(spark, wave(96, 1), minutes=15, series_id="b"))
    got = {r.series_id: r for r in T.conga(df, 1).collect()}
    assert got["a"].total_comparisons == 288 - 12 and got["b"].total_comparisons == 96 - 4


def test_lability_merges_weeks_of_years(spark):
    a = series(spark, [100, 110, 130])
    df = a.unionByName(series(spark, [100, 150], start=dt.datetime(2024, 12, 30)))
    assert one(T.lability(df))["n_weeks"] == 1
    assert T.weekly_lability(df, by_year=True).count() == 2
    with pytest.raises(ValueError):
        T.lability(df, period="month")


def test_all_metrics_has_every_column(spark):
    got = one(summary.all_metrics(series(spark, wave(4 * 288))))
    assert len(got) == 1 + 17 + 13 + 5 + 6 + 2 + 6 + 6
    assert all(got[k] is not None for k in got)


P38 = PG.Pregnancy.of("2024-09-27", 38, 4)


def test_bounds_of_a_pregnancy():
    assert P38.conception == dt.datetime(2024, 1, 1) and P38.label() == "38+4"
    assert PG.weeks_and_days(38 + 4 / 7) == (38, 4)


def test_trimesters(spark):
    df = series(spark, [100 + k % 7 for k in range(272 * 4)], minutes=360)
    rows = PG.with_trimester(df, P38)
    n = {r.trimester: r["count"] for r in rows.groupBy("trimester").count().collect()}
    # A reading exactly at delivery belongs to no trimester.
    assert n == {"primer_trimestre": 364, "segundo_trimestre": 364, "tercer_trimestre": 88 * 4, None: 1}
    stats = {r.trimester: r.n for r in PG.trimester_statistics(df.filter("time < '2024-02-01'"), P38).collect()}
    assert stats == {"primer_trimestre": 124, "segundo_trimestre": 0, "tercer_trimestre": 0}
    days = {r.phase: r.n for r in PG.around_delivery(df, P38).collect()}
    assert days == {"preparto": 4, "postparto": 4 - 1} or days["postparto"] > 0
    weeks = PG.weekly_statistics(df, P38).collect()
    assert len(weeks) == 39 and sum(r.n for r in weeks) == 270 * 4 + 1
    assert PG.trimester_info(df, P38).count() == 3 and PG.all_metrics(df, P38).count() == 4
    assert PG.rollup_statistics(df, P38, ["n"]).count() == 4
    assert "38+4" in PG.describe(df, P38)[0]


def test_histogram_edges(spark):
    got = {r.bin_start: r["count"] for r in P.histogram(series(spark, [0, 9, 10, 490, 499, 500, 501])).collect()}
    assert got == {0: 2, 10: 1, 490: 3}


def test_rolling_profile(spark):
    v = wave(288, 6)
    got = P.agp(series(spark, v), 4).orderBy("time_decimal").toPandas()
    p = frame(v)
    p["t"] = (p.time.dt.hour + p.time.dt.minute / 60).round(2)
    want = p.groupby("t").glucose.median().rolling(4, center=True, min_periods=1).mean()
    assert np.allclose(got["p50_smooth"], want)


def test_boxplot_whiskers(spark):
    got = one(P.week_boxplots(series(spark, [100, 101, 102, 103, 104, 400])))
    assert got["whisker_high"] == 104 and got["fliers"] == 1 and got["weekday"] == "Lunes"


def test_conga_profile_in_one_pass(spark):
    df = series(spark, wave(3 * 48, 2), minutes=30)
    got = {r.hours: r.conga for r in P.conga_profile(df, 6).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[4] == pytest.approx(one(T.conga(df, 4))["value"])

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from glyspark.functions import expr as X
from glyspark.operators import basic as B, periods as PE, quality as Q, risk as R, sd as S, stability as ST, variance as V
from pyspark.sql import functions as F

from .helpers import START, frame, one, series, wave

EDGES = [53, 54, 55, 62, 63, 69, 70, 139, 140, 141, 179, 180, 181, 249, 250, 251]


def test_bounds(spark):
    got = one(B.compute(series(spark, EDGES), ["TIR", "TIR_tight", "TIR_pregnancy", "TAR250", "TAR180", "TAR140", "TBR70", "TBR63", "TBR55"]))
    v = np.array(EDGES)
    share = lambda c: 100 * c.mean()
    want = {"TIR": (v >= 70) & (v <= 180), "TIR_tight": (v >= 70) & (v <= 140), "TIR_pregnancy": (v >= 63) & (v <= 140), "TAR250": v > 250, "TAR180": (v >= 180) & (v <= 250), "TAR140": (v >= 140) & (v <= 250), "TBR70": (v >= 55) & (v <= 70), "TBR63": v < 63, "TBR55": v < 55}
    for k, c in want.items():
        assert got[k] == pytest.approx(share(c)), k


def test_against_pandas(spark):
    v = wave()
    got = one(B.time_statistics(series(spark, v)))
    s = pd.Series(v, dtype=float)
    want = {"mean": s.mean(), "median": s.median(), "sd": s.std(), "cv": s.std() / s.mean() * 100, "skewness": s.skew(), "kurtosis": s.kurtosis(), "p5": s.quantile(0.05), "p95": s.quantile(0.95), "gmi": round(3.31 + 0.02392 * s.mean(), 2)}
    for k, x in want.items():
        assert got[k] == pytest.approx(x, rel=1e-9), k
    assert got["data_percent"] == 100


def test_single_row_and_empty(spark):
    got = one(B.time_statistics(series(spark, [100])))
    assert got["sd"] is None and got["skewness"] is None and got["data_percent"] == 0 and got["mean"] == 100
    assert one(B.typical_interval(series(spark, [100])))["typical_interval"] == 5.0
    assert B.time_statistics(series(spark, [])).count() == 0


def test_constant(spark):
    df = series(spark, [100] * 576)
    assert one(S.sd_total(df))["sd"] == 0
    assert one(ST.mean_correlation(df))["avg_correlation_with_mean"] is None
    assert one(V.variance_components(df))["varianza_total"] == 0


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        B.metric("none")


def test_gaps(spark):
    times = [0, 5, 10, 25, 30, 46, 51]
    df = spark.createDataFrame([("a", START + dt.timedelta(minutes=m), 100) for m in times], "series_id string, time timestamp_ntz, glucose int")
    got = one(Q.disconnections(df))
    assert got["minutes"] == 16 and got["label"] == "00 horas y 16 minutos"
    info = one(Q.info(df))
    assert info["num_desconexiones"] == 1 and info["intervalo_tipico"] == 5.0 and info["datos_teoricos"] == 10
    assert "Disconnections: 1" in Q.describe(df)[0]


def test_segments(spark):
    df = series(spark, [100] * 288)
    assert Q.segment(df, "23:00", 2).count() == 24
    assert Q.segment(df, "08:00", 8).count() == 96
    assert Q.segment(df, "08:00", 24).count() == 0


def test_weeks_start_on_tuesday(spark):
    days = {"2024-01-01": "2023-12-26", "2024-01-02": "2024-01-02", "2024-12-30": "2024-12-24"}
    df = spark.createDataFrame([(dt.datetime.fromisoformat(d),) for d in days], "time timestamp_ntz")
    got = {str(r.time.date()): str(r.p) for r in df.select("time", X.period("W").alias("p")).collect()}
    assert got == days
    with pytest.raises(ValueError):
        X.period("Y")


def test_two_level_deviations_against_pandas(spark):
    v = wave(5 * 288, 3)
    df, p = series(spark, v), frame(v)
    p["day"], p["hm"] = p.time.dt.date, p.time.dt.strftime("%H:%M")
    daily = p.groupby("day").glucose.agg(["std", "mean"])
    assert one(S.sd_within_day(df))["sd"] == pytest.approx(daily["std"].mean())
    assert one(S.sd_daily_mean(df))["sd"] == pytest.approx(daily["mean"].std())
    cell = p.groupby(["day", "hm"]).glucose.mean().reset_index()
    points = cell.groupby("hm").glucose.agg(["mean", "std"])
    assert one(S.sd_between_timepoints(df))["sd"] == pytest.approx(points["mean"].std())
    assert one(S.sd_same_timepoint(df))["sd"] == pytest.approx(points["std"].mean())
    g, d, t = p.glucose.mean(), p.groupby("day").glucose.transform("mean"), p.groupby("hm").glucose.transform("mean")
    assert one(S.sd_interaction(df))["sd"] == pytest.approx((p.glucose - (g + (d - g) + (t - g))).std())
    adjusted = (p.glucose - d + g).groupby(p.hm).std().mean()
    assert one(S.sd_same_timepoint_adjusted(df))["sd"] == pytest.approx(adjusted)
    windows = [p[(p.time >= a) & (p.time < a + pd.Timedelta(hours=6))].glucose for a in p.time]
    assert one(S.sd_within_series(df, 6))["sd"] == pytest.approx(np.mean([w.std() for w in windows if len(w) > 2]))


def test_sparse_timepoint_is_left_out(spark):
    v = [100] * 288 * 4
    df = series(spark, v).unionByName(series(spark, [400], start=START + dt.timedelta(minutes=2)))
    assert one(S.sd_between_timepoints(df))["valid_timepoints"] == 288
    assert one(S.sd_between_timepoints(df, filter_outliers=False))["sd"] > 0


def test_all_deviations_for_several_series(spark):
    df = series(spark, wave(3 * 288, 1)).unionByName(series(spark, wave(3 * 288, 2), series_id="b"))
    got = {r.series_id: r for r in S.all_sd(df).collect()}
    alone = one(S.all_sd(series(spark, wave(3 * 288, 2), series_id="b")))
    assert len(got) == 2 and got["b"].SDws_1h == pytest.approx(alone["SDws_1h"]) and got["b"].SDI == pytest.approx(alone["SDI"])
    assert one(S.all_cv(df.filter("series_id = 'a'")))["CVT"] == pytest.approx(got["a"].SDT / one(S.sd_total(df.filter("series_id = 'a'")))["mean"] * 100)


def test_shift_changes_no_deviation(spark):
    a, b = (one(S.all_sd(series(spark, wave(3 * 288) + k))) for k in (0, 25))
    assert all(a[k] == pytest.approx(b[k]) for k in a if k != "series_id")


def test_variance_shares(spark):
    got = one(V.variance_components(series(spark, wave(6 * 288))))
    assert got["porcentaje_patron"] + got["porcentaje_interaccion"] + got["porcentaje_residual"] == pytest.approx(100)
    seg = V.variance_segments(series(spark, wave(6 * 288))).collect()
    assert sum(r.porcentaje for r in seg) == pytest.approx(100) and {r.segment for r in seg} == {0, 1, 2}


def test_stability_against_pandas(spark):
    v = wave(4 * 288, 7)
    p = frame(v)
    m = p.assign(day=p.time.dt.date, hm=p.time.dt.strftime("%H:%M")).pivot_table(index="hm", columns="day", values="glucose")
    prof = m.mean(axis=1)
    r = [np.corrcoef(m[d], prof)[0, 1] for d in m]
    got = one(ST.pattern_stability(series(spark, v)))
    assert got["avg_correlation_with_mean"] == pytest.approx(np.mean([np.sign(x) * x * x for x in r]))
    res, slopes = [], []
    for d in m:
        x = m.drop(columns=d).mean(axis=1)
        b = (x * m[d]).sum() / (x * x).sum()
        slopes.append(b)
        res += list(m[d] - b * x)
    assert got["bootstrap_rms"] == pytest.approx(np.sqrt(np.mean(np.square(res)))) and got["avg_bootstrap_slope"] == pytest.approx(np.mean(slopes))


def test_grade_and_risk(spark):
    got = series(spark, [36, 37, 630, 631]).select(X.grade(X.value()).alias("x")).collect()
    assert got[0].x == got[3].x == 50 and got[1].x != 50
    df = series(spark, wave())
    low, high = one(R.lbgi(df))["lbgi"], one(R.hbgi(df))["hbgi"]
    v = wave().astype(float)
    f = 1.509 * (np.log(v) ** 1.084 - 5.381)
    assert low == pytest.approx(np.where(f < 0, 10 * f * f, 0).mean()) and high == pytest.approx(np.where(f > 0, 10 * f * f, 0).mean())
    assert df.filter((X.low_risk(X.value()) > 0) & (X.high_risk(X.value()) > 0)).count() == 0
    with pytest.raises(ValueError):
        R.grade(df, unit="g")
    g = one(R.grade(df))
    assert g["hypo_percent"] + g["eu_percent"] + g["hyper_percent"] == pytest.approx(100)


def test_row_order_does_not_matter(spark):
    df = series(spark, wave())
    a, b = one(B.time_statistics(df)), one(B.time_statistics(df.orderBy(F.rand(3))))
    assert {k: v for k, v in a.items() if not isinstance(v, float)} == {k: v for k, v in b.items() if not isinstance(v, float)}
    assert all(a[k] == pytest.approx(b[k]) for k in a if isinstance(a[k], float))


def test_periods(spark):
    df = series(spark, wave(3 * 288)).filter(F.to_date("time") != "2024-01-02").unionByName(series(spark, [100] * 5, 60, dt.datetime(2024, 1, 2)))
    got = {str(r.period): r for r in PE.period_metrics(df, ["mean", "TIR"], "D", 70).collect()}
    assert set(got) == {"2024-01-01", "2024-01-03"} and got["2024-01-01"].n_points == 288

    def spread(x):
        return x.max() - x.min()

    def broken(x):
        raise RuntimeError

    rows = PE.period_function(df, [spread, broken], "D", 70).collect()
    assert len(rows) == 2 and all(r.spread > 0 and r.broken is None for r in rows)
    assert PE.period_apply(df, R.adrr, "D", 70).count() == 2


def test_day_correlation_over_several_blocks(spark, monkeypatch):
    from glyspark.operators import stability as ST

    df = series(spark, wave(9 * 288 + 100, 3)).unionByName(series(spark, [100] * 700, series_id="flat")).unionByName(series(spark, wave(150), series_id="short"))
    whole = {r.series_id: r for r in ST.day_correlation(df).collect()}
    monkeypatch.setattr(ST, "DAYS", 2)
    parts = {r.series_id: r for r in ST.day_correlation(df).collect()}
    assert set(whole) == set(parts) == {"a", "flat"} and whole["a"].pairs == parts["a"].pairs == 45
    assert abs(whole["a"][1] - parts["a"][1]) < 1e-12 and whole["flat"][1] is parts["flat"][1] is None

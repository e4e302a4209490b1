"""Single-pass statistics: one aggregation, whatever the number of metrics asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import expr as X
from ..schema import BY

G = X.value


def _cv() -> Column:
    return F.try_divide(F.stddev_samp(G()), F.avg(G())) * 100


def _percentile(p: float) -> Column:
    # Exact. The buffer counts distinct values, of which whole-number glucose has few hundreds.
    return F.percentile(G(), F.lit(p / 100))


#: Row-grain metrics by name; each makes an aggregate.
METRICS: dict[str, Callable[[], Column]] = {
    "n": lambda: F.count(F.lit(1)),
    "mean": lambda: F.avg(G()),
    "median": lambda: _percentile(50),
    "sd": lambda: F.stddev_samp(G()),
    "cv": _cv,
    "gmi": lambda: X.half_even(F.lit(3.31) + F.lit(0.02392) * F.avg(G())),
    "skewness": lambda: X.skewness(G()),
    "kurtosis": lambda: X.kurtosis(G()),
    "p5": lambda: _percentile(5),
    "p25": lambda: _percentile(25),
    "p75": lambda: _percentile(75),
    "p95": lambda: _percentile(95),
    "TIR": lambda: X.percent(X.between(70, 180)),
    "TIR_tight": lambda: X.percent(X.between(70, 140)),
    "TIR_pregnancy": lambda: X.percent(X.between(63, 140)),
    "TAR250": lambda: X.percent(G() > 250),
    "TAR180": lambda: X.percent(X.between(180, 250)),
    "TAR140": lambda: X.percent(X.between(140, 250)),
    "TBR70": lambda: X.percent(X.between(55, 70)),
    "TBR63": lambda: X.percent(G() < 63),
    "TBR55": lambda: X.percent(G() < 55),
    "j_index": lambda: F.lit(0.001) * F.pow(F.avg(G()) + F.stddev_samp(G()), 2),
    "m_value": lambda: X.half_even(F.avg(X.m_term(G()))),
    "lbgi": lambda: F.avg(X.low_risk(G())),
    "hbgi": lambda: F.avg(X.high_risk(G())),
    "grade_score": lambda: F.avg(X.grade(G())),
}


def metric(name: str) -> Column:
    """The aggregate of a registered metric."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}; known: {', '.join(METRICS)}")
    return METRICS[name]().alias(name)


def names() -> list[str]:
    return list(METRICS)


def compute(df: DataFrame, metrics: list[str], by=BY) -> DataFrame:
    """Any registered metrics in one aggregation."""
    return df.groupBy(*by).agg(*(metric(m) for m in metrics))


def time_in_range(df: DataFrame, low: float, high: float, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(X.percent(X.between(low, high)).alias("time_in_range"))


def time_above(df: DataFrame, threshold: float, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(X.percent(G() > float(threshold)).alias("time_above"))


def time_below(df: DataFrame, threshold: float, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(X.percent(G() < float(threshold)).alias("time_below"))


def percentiles(df: DataFrame, points: list[float], by=BY) -> DataFrame:
    """Exact percentiles, interpolated, as columns p<point>."""
    got = df.groupBy(*by).agg(F.percentile(G(), F.array(*(F.lit(p / 100) for p in points))).alias("_p"))
    return got.select(*by, *(F.col("_p")[k].alias(f"p{p:g}".replace(".", "_")) for k, p in enumerate(points)))


def with_gaps(df: DataFrame, by=BY) -> DataFrame:
    """t_us and gap_us, the microseconds since the series' previous reading (null at its first)."""
    t = X.micros()
    return df.withColumn("t_us", t).withColumn("gap_us", t - F.lag(t).over(X.by_time(by)))


#: Minutes; 5 for a series without a positive gap.
def typical_gap() -> Column:
    return F.coalesce(F.percentile(F.when(F.col("gap_us") > 0, F.col("gap_us").cast("double")), F.lit(0.5)) / float(X.MINUTE_US), F.lit(5.0))


def typical_interval(df: DataFrame, by=BY) -> DataFrame:
    return with_gaps(df, by).groupBy(*by).agg(typical_gap().alias("typical_interval"))


def _completeness(n: Column, lo: Column, hi: Column, interval: Column) -> tuple[Column, Column]:
    expected = F.floor((hi - lo) / float(X.MINUTE_US) / interval)
    return expected, F.when(expected > 0, n / expected * 100).otherwise(0.0)


def completeness(df: DataFrame, by=BY, interval: float | None = None) -> DataFrame:
    """Start, end, interval, expected and actual readings and their ratio in percent (0 if none are expected)."""
    if interval is None:
        rows, gap = with_gaps(df, by), typical_gap()
    else:
        rows, gap = df.withColumn("t_us", X.micros()), F.lit(float(interval))
    got = rows.groupBy(*by).agg(F.min("time").alias("start"), F.max("time").alias("end"), gap.alias("interval"), F.count(F.lit(1)).alias("actual"), F.min("t_us").alias("_lo"), F.max("t_us").alias("_hi"))
    expected, pct = _completeness(F.col("actual"), F.col("_lo"), F.col("_hi"), F.col("interval"))
    return got.select(*by, "start", "end", "interval", expected.alias("expected"), "actual", pct.alias("percent"))


STANDARD = ("TIR", "TIR_tight", "TBR70", "TBR55", "TAR250", "TAR180", "TAR140", "gmi", "cv", "mean", "median", "p5", "p25", "p75", "p95", "sd", "skewness", "kurtosis")
PREGNANCY = ("TIR_pregnancy", "TBR63", "TAR140", "TAR250", "gmi", "cv", "mean", "median", "p5", "p25", "p75", "p95", "sd", "skewness", "kurtosis")


def with_completeness(df: DataFrame, metrics, by=BY) -> DataFrame:
    """Registered metrics and data_percent: one window for the gaps and one aggregation for all."""
    got = with_gaps(df, by).groupBy(*by).agg(typical_gap().alias("_gap"), F.min("t_us").alias("_lo"), F.max("t_us").alias("_hi"), F.count(F.lit(1)).alias("_n"), *(metric(m) for m in metrics))
    _, pct = _completeness(F.col("_n"), F.col("_lo"), F.col("_hi"), F.col("_gap"))
    return got.select(*by, pct.cast("int").alias("data_percent"), *metrics)


def time_statistics(df: DataFrame, by=BY) -> DataFrame:
    return with_completeness(df, STANDARD, by)


def time_statistics_pregnancy(df: DataFrame, by=BY) -> DataFrame:
    return with_completeness(df, PREGNANCY, by)


def distribution_analysis(df: DataFrame, by=BY) -> DataFrame:
    got = with_completeness(df, ("mean", "median", "sd", "cv", "skewness", "kurtosis", "p25", "p75"), by)
    return got.withColumn("IQR", F.col("p75") - F.col("p25"))


def distinct_days(df: DataFrame, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(X.day()).alias("days"))

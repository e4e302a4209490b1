"""The standard-deviation family. Shared tables: day (series, day) and cell (series, day, minute)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import expr as X
from ..schema import BY

G = X.value
#: Segments of the day as start and hours.
SEGMENTS = {"noche": ("00:00", 8), "dia": ("08:00", 8), "tarde": ("16:00", 8)}
#: Most anchors of the sliding windows.
ANCHORS = 1000


def day_table(df: DataFrame, by=BY) -> DataFrame:
    return df.groupBy(*by, X.day().alias("day")).agg(F.stddev_samp(G()).alias("sd"), F.avg(G()).alias("mean"), F.count(F.lit(1)).alias("n"))


def cell_table(df: DataFrame, by=BY, bin_minutes: int = 1) -> DataFrame:
    """Mean of each day and minute of the day, or bin of minutes."""
    minute = X.minute_of_day()
    if bin_minutes > 1:
        minute = (F.floor(minute / bin_minutes) * bin_minutes).cast("int")
    return df.groupBy(*by, X.day().alias("day"), minute.alias("minute")).agg(F.avg(G()).alias("mean"), F.count(F.lit(1)).alias("n"))


def _enough(df: DataFrame, by, share: float, count: str = "n") -> DataFrame:
    """threshold (share of the series' median count) and valid (count reaches it)."""
    w = Window.partitionBy(*by)
    return df.withColumn("threshold", F.median(count).over(w) * share).withColumn("valid", F.col(count) >= F.col("threshold"))


def sd_total(df: DataFrame, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(F.stddev_samp(G()).alias("sd"), F.avg(G()).alias("mean"))


def days_with_validity(df: DataFrame, by=BY, min_count: float = 0.5) -> DataFrame:
    """The day table with the threshold of readings and whether a day reaches it."""
    return _enough(day_table(df, by), by, min_count)


def _when_valid(name: str) -> Column:
    return F.when(F.col("valid"), F.col(name))


def sd_within_day(df: DataFrame, by=BY, min_count: float = 0.5) -> DataFrame:
    """Mean of the valid days' deviations (days of one reading have none) and of their means."""
    return days_with_validity(df, by, min_count).groupBy(*by).agg(
        F.coalesce(F.avg(_when_valid("sd")), F.lit(0.0)).alias("sd"),
        F.coalesce(F.avg(_when_valid("mean")), F.lit(0.0)).alias("mean"),
        F.sum(F.col("valid").cast("long")).alias("valid_days"),
        F.count(F.lit(1)).alias("total_days"),
        F.first("threshold").alias("threshold"),
    )


def sd_daily_mean(df: DataFrame, by=BY, min_count: float = 0.5) -> DataFrame:
    """Deviation of the valid days' means."""
    return days_with_validity(df, by, min_count).groupBy(*by).agg(F.stddev_samp(_when_valid("mean")).alias("sd"), F.avg(_when_valid("mean")).alias("mean"), F.sum(F.col("valid").cast("long")).alias("valid_days"), F.count(F.lit(1)).alias("total_days"))


def sd_within_day_segment(df: DataFrame, start: str, hours: float, by=BY) -> DataFrame:
    days = day_table(df.filter(X.in_segment(start, hours)), by)
    return days.groupBy(*by).agg(F.coalesce(F.avg("sd"), F.lit(0.0)).alias("sd"), F.coalesce(F.avg("mean"), F.lit(0.0)).alias("mean"))


def timepoint_table(df: DataFrame, by=BY, bin_minutes: int = 1, min_count: float = 0.5) -> DataFrame:
    """Per minute of the day: mean and deviation of the days' means, number of days, validity."""
    points = cell_table(df, by, bin_minutes).groupBy(*by, "minute").agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd"), F.count(F.lit(1)).alias("n_days"))
    return _enough(points, by, min_count, "n_days")


def sd_between_timepoints(df: DataFrame, by=BY, min_count: float = 0.5, filter_outliers: bool = True, bin_minutes: int = 1) -> DataFrame:
    """Deviation of the time points' means."""
    points = timepoint_table(df, by, bin_minutes, min_count)
    if not filter_outliers:
        points = points.withColumn("valid", F.lit(True))
    return points.groupBy(*by).agg(
        F.stddev_samp(_when_valid("mean")).alias("sd"),
        F.avg(_when_valid("mean")).alias("mean"),
        F.sum(F.col("valid").cast("long")).alias("valid_timepoints"),
        F.count(F.lit(1)).alias("total_timepoints"),
        F.median("n_days").alias("median_count"),
        F.min("n_days").alias("min_count"),
        F.max("n_days").alias("max_count"),
    )


def sd_between_timepoints_segment(df: DataFrame, start: str, hours: float, by=BY) -> DataFrame:
    """Deviation of the raw means of the segment's minutes."""
    points = df.filter(X.in_segment(start, hours)).groupBy(*by, X.minute_of_day().alias("minute")).agg(F.avg(G()).alias("mean"))
    return points.groupBy(*by).agg(F.stddev_samp("mean").alias("sd"), F.avg("mean").alias("mean"))


def sd_within_series(df: DataFrame, hours: float = 1, by=BY) -> DataFrame:
    """Mean deviation of windows of some hours that start at every step-th reading, step = n // ANCHORS (at least 1),
    and hold three readings at least.

    Anchors are thinned before the windows are built: each reading goes to the time buckets it may belong
    to, so the join is by equality and a window's cost does not depend on its place.
    """
    width = int(hours * X.HOUR_US)
    rows = df.select(*by, "time", X.micros().alias("t"), G().alias("g"))
    w = Window.partitionBy(*by)
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / ANCHORS))
    anchors = rows.withColumn("at", F.row_number().over(X.by_time(by)) - 1).withColumn("step", step).filter(F.col("at") % F.col("step") == 0)
    # A window starting in bucket b ends in b + 1 at the latest.
    bucket = F.floor(F.col("t") / width)
    anchors = anchors.select(*by, F.col("t").alias("t0"), "at", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    met = anchors.join(rows.select(*by, "t", "g", bucket.alias("bucket")), [*by, "bucket"]).filter((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t0") + width))
    windows = met.groupBy(*by, "at", "t0").agg(F.stddev_samp("g").alias("sd"), F.avg("g").alias("mean"), F.count(F.lit(1)).alias("n")).filter("n > 2")
    return windows.groupBy(*by).agg(F.avg("sd").alias("sd"), F.avg("mean").alias("mean"), F.count(F.lit(1)).alias("windows_analyzed"))


def same_timepoint_table(df: DataFrame, by=BY, min_count: float = 0.5, filter_outliers: bool = True, bin_minutes: int = 1) -> DataFrame:
    points = timepoint_table(df, by, bin_minutes, min_count)
    return points.filter("valid") if filter_outliers else points


def sd_same_timepoint(df: DataFrame, by=BY, min_count: float = 0.5, filter_outliers: bool = True, bin_minutes: int = 1) -> DataFrame:
    """Deviations between days at the same time of day, weighted by days; a point of one day weighs in with 0."""
    points = same_timepoint_table(df, by, min_count, filter_outliers, bin_minutes)
    return points.groupBy(*by).agg(
        F.try_divide(F.sum(F.coalesce("sd", F.lit(0.0)) * F.col("n_days")), F.sum("n_days").cast("double")).alias("sd"),
        F.avg("mean").alias("mean"),
        F.first("threshold").alias("threshold"),
        F.count(F.lit(1)).alias("total_timepoints"),
    )


def sd_same_timepoint_adjusted(df: DataFrame, by=BY) -> DataFrame:
    """As above after the days' means are moved to the series' mean; raw rows, unweighted."""
    rows = df.select(*by, X.day().alias("day"), X.minute_of_day().alias("minute"), G().alias("g"))
    shifted = F.col("g") - F.avg("g").over(Window.partitionBy(*by, "day")) + F.avg("g").over(Window.partitionBy(*by))
    points = rows.withColumn("a", shifted).groupBy(*by, "minute").agg(F.stddev_samp("a").alias("sd"), F.avg("a").alias("mean"))
    return points.groupBy(*by).agg(F.avg("sd").alias("sd"), F.avg("mean").alias("mean"))


def sd_interaction(df: DataFrame, by=BY) -> DataFrame:
    """Deviation of what the day's and the minute's means leave unexplained."""
    rows = df.select(*by, X.day().alias("day"), X.minute_of_day().alias("minute"), G().alias("g"))
    grand, daily, point = (F.avg("g").over(Window.partitionBy(*by, *k)) for k in ([], ["day"], ["minute"]))
    return rows.withColumn("x", F.col("g") - (grand + (daily - grand) + (point - grand))).groupBy(*by).agg(F.stddev_samp("x").alias("sd"), F.avg("g").alias("mean"))


def sd_segment(df: DataFrame, start: str, hours: float, by=BY) -> DataFrame:
    """Pooled deviation and mean of a segment; 0 where it has no reading."""
    inside = F.when(X.in_segment(start, hours), G())
    return df.groupBy(*by).agg(F.when(F.count(inside) == 0, 0.0).otherwise(F.stddev_samp(inside)).alias("sd"), F.coalesce(F.avg(inside), F.lit(0.0)).alias("mean"))


def join_on(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """Left join on the keys; a global result has one row."""
    return left.join(right, list(by), "left") if by else left.crossJoin(F.broadcast(right))


FAMILY = ("SDT", "SDw", "SDhhmm", "noche", "dia", "tarde", "SDws_1h", "SDws_6h", "SDws_24h", "SDdm", "SDbhhmm", "SDbhhmm_dm", "SDI")


def family(df: DataFrame, by=BY) -> DataFrame:
    """All thirteen as <name>_sd and <name>_mean, from as few passes as their grains allow: one over the readings for
    the total and the segments, one day table, one time-point table, one set of windows each for the others."""
    rows = [F.stddev_samp(G()).alias("SDT_sd"), F.avg(G()).alias("SDT_mean")]
    for k, s in SEGMENTS.items():
        inside = F.when(X.in_segment(*s), G())
        rows += [F.when(F.count(inside) == 0, 0.0).otherwise(F.stddev_samp(inside)).alias(f"{k}_sd"), F.coalesce(F.avg(inside), F.lit(0.0)).alias(f"{k}_mean")]
    mean = F.avg(_when_valid("mean"))
    days = [F.coalesce(F.avg(_when_valid("sd")), F.lit(0.0)).alias("SDw_sd"), F.coalesce(mean, F.lit(0.0)).alias("SDw_mean"), F.stddev_samp(_when_valid("mean")).alias("SDdm_sd"), mean.alias("SDdm_mean")]
    weighted = F.try_divide(F.sum(F.when(F.col("valid"), F.coalesce("sd", F.lit(0.0)) * F.col("n_days"))), F.sum(_when_valid("n_days")).cast("double"))
    points = [F.stddev_samp(_when_valid("mean")).alias("SDhhmm_sd"), mean.alias("SDhhmm_mean"), weighted.alias("SDbhhmm_sd"), mean.alias("SDbhhmm_mean")]
    parts = [df.groupBy(*by).agg(*rows), days_with_validity(df, by).groupBy(*by).agg(*days), timepoint_table(df, by).groupBy(*by).agg(*points)]
    others = {"SDws_1h": sd_within_series(df, 1, by), "SDws_6h": sd_within_series(df, 6, by), "SDws_24h": sd_within_series(df, 24, by), "SDbhhmm_dm": sd_same_timepoint_adjusted(df, by), "SDI": sd_interaction(df, by)}
    parts += [p.select(*by, F.col("sd").alias(f"{k}_sd"), F.col("mean").alias(f"{k}_mean")) for k, p in others.items()]
    return reduce(lambda a, b: join_on(a, b, by), parts)


def all_sd(df: DataFrame, by=BY) -> DataFrame:
    """The thirteen deviations, one row per series."""
    return family(df, by).select(*by, *(F.col(f"{k}_sd").alias(k) for k in FAMILY))


def all_cv(df: DataFrame, by=BY) -> DataFrame:
    """The thirteen coefficients of variation in percent."""
    names = {k: k.replace("SD", "CV", 1) if k.startswith("SD") else f"CV{k}" for k in FAMILY}
    return family(df, by).select(*by, *((F.try_divide(F.col(f"{k}_sd"), F.nullif(F.col(f"{k}_mean"), F.lit(0.0))) * 100).alias(v) for k, v in names.items()))

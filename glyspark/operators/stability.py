"""Stability of the daily pattern."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import expr as X
from ..schema import BY
from ..shipping import ship
from . import sd as S

#: Days of a series that are multiplied with as many others at once.
DAYS = 256


def _signed_square(r):
    return F.signum(r) * r * r


def ratios(df: DataFrame, by=BY) -> DataFrame:
    """Squared ratio of the deviation between time points to that within days, whole day and segments."""

    def ratio(points: DataFrame, days: DataFrame, name: str) -> DataFrame:
        both = S.join_on(points.select(*by, F.col("sd").alias("a")), days.select(*by, F.col("sd").alias("b")), by)
        return both.select(*by, F.pow(F.try_divide(F.col("a"), F.nullif(F.col("b"), F.lit(0.0))), 2).alias(name))

    parts = [ratio(S.sd_between_timepoints(df, by), S.sd_within_day(df, by), "ratio")]
    parts += [ratio(S.sd_between_timepoints_segment(df, *s, by=by), S.sd_within_day_segment(df, *s, by=by), f"ratio_{k}") for k, s in S.SEGMENTS.items()]
    return reduce(lambda a, b: S.join_on(a, b, by), parts)


def day_correlation(df: DataFrame, by=BY) -> DataFrame:
    """Mean signed squared correlation over all pairs of days on their common minutes (undefined pairs are skipped).

    A day becomes one row, its cells as a list. Days are cut into blocks of DAYS, and each pair of blocks is one group
    that multiplies its days as matrices: shuffled are days times blocks, not the pairs of all their minutes.
    """
    keys = list(by)
    ship(df.sparkSession)
    cells = S.cell_table(df, by).groupBy(*by, "day").agg(F.collect_list(F.struct(F.col("minute").cast("int").alias("minute"), F.col("mean").cast("double").alias("mean"))).alias("cells"))
    block = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy("day")) - 1) / DAYS).cast("int")
    days = cells.withColumn("block", block)
    days = days.withColumn("last", F.max("block").over(Window.partitionBy(*by)))
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    met = days.withColumn("other", other).select(*by, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cells")

    def correlate(table: pa.Table) -> pa.Table:
        own = np.array(table.column("block").to_pylist())
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        lists = table.column("cells").combine_chunks()
        flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        day = np.repeat(np.arange(len(own)), np.diff(offsets))
        minute, mean = flat.field("minute").to_numpy(), flat.field("mean").to_numpy()
        x, has = np.zeros((len(own), 24 * 60)), np.zeros((len(own), 24 * 60))
        x[day, minute], has[day, minute] = mean, 1.0
        # Centred, so that sums of squares lose no digits.
        x -= has * (x.sum(axis=1) / np.maximum(has.sum(axis=1), 1))[:, None]
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        n = has[a] @ has[b].T
        sa, sb = x[a] @ has[b].T, has[a] @ x[b].T
        aa, bb = (x[a] ** 2) @ has[b].T, has[a] @ (x[b] ** 2).T
        va, vb = n * aa - sa**2, n * bb - sb**2
        # A side that is constant on the common minutes has no correlation.
        ok = (va > 1e-9 * n * aa) & (vb > 1e-9 * n * bb)
        pairs = n > 0
        if lo == hi:
            ok, pairs = np.triu(ok, 1), np.triu(pairs, 1)
        r = np.where(ok, (n * (x[a] @ x[b].T) - sa * sb) / np.sqrt(np.where(ok, va * vb, 1.0)), 0.0)
        out = {k: [table.column(k)[0].as_py()] for k in keys} | {"total": [float((np.sign(r) * r * r)[ok].sum())], "defined": [int(ok.sum())], "pairs": [int(pairs.sum())]}
        return pa.table(out, schema=pa.schema([*(table.schema.field(k) for k in keys), ("total", pa.float64()), ("defined", pa.int64()), ("pairs", pa.int64())]))

    schema = df.select(*by).schema.add("total", "double").add("defined", "long").add("pairs", "long")
    got = met.groupBy(*by, "lo", "hi").applyInArrow(correlate, schema).groupBy(*by).agg(F.sum("total").alias("total"), F.sum("defined").alias("defined"), F.sum("pairs").alias("pairs"))
    # A series without a pair of days that share a minute has no row.
    return got.filter("pairs > 0").select(*by, F.try_divide("total", "defined").alias("avg_correlation_between_days"), "pairs")


def _with_profile(df: DataFrame, by, leave_out: bool = False) -> DataFrame:
    """Cells (y) with the mean of their minute over all days, or over all other days (x)."""
    c = S.cell_table(df, by)
    w = Window.partitionBy(*by, "minute")
    if leave_out:
        n = F.count(F.lit(1)).over(w)
        x = F.when(n > 1, (F.sum("mean").over(w) - F.col("mean")) / (n - 1))
    else:
        x = F.avg("mean").over(w)
    return c.withColumn("x", x).filter("x IS NOT NULL").withColumnRenamed("mean", "y")


def mean_correlation(df: DataFrame, by=BY) -> DataFrame:
    """Mean signed squared correlation of the days with the mean profile."""
    days = _with_profile(df, by).groupBy(*by, "day").agg(X.pearson(F.col("x"), F.col("y")).alias("r"))
    return days.groupBy(*by).agg(F.avg(_signed_square(F.col("r"))).alias("avg_correlation_with_mean"))


def _regression(df: DataFrame, by, leave_out: bool, rms: str, slope: str) -> DataFrame:
    """Per day a line through the origin on the profile; pooled residuals and mean slope.

    The residual sum of squares of such a line is sum(y^2) - sum(xy)^2 / sum(x^2), so one pass suffices.
    """
    days = _with_profile(df, by, leave_out).groupBy(*by, "day").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    line = F.try_divide(F.col("xy"), F.nullif(F.col("xx"), F.lit(0.0)))
    rest = F.greatest(F.col("yy") - F.col("xy") * line, F.lit(0.0))
    return days.groupBy(*by).agg(F.sqrt(F.sum(rest) / F.sum("n")).alias(rms), F.avg(line).alias(slope))


def rms_error(df: DataFrame, by=BY) -> DataFrame:
    return _regression(df, by, False, "rms_error", "avg_slope")


def leave_one_out(df: DataFrame, by=BY) -> DataFrame:
    return _regression(df, by, True, "bootstrap_rms", "avg_bootstrap_slope")


def pattern_stability(df: DataFrame, by=BY) -> DataFrame:
    """All of the above, one row per series; 0 where nothing can be computed."""
    parts = [ratios(df, by), day_correlation(df, by).drop("pairs"), mean_correlation(df, by), rms_error(df, by), leave_one_out(df, by)]
    got = reduce(lambda a, b: S.join_on(a, b, by), parts)
    return got.fillna(0.0, subset=["rms_error", "avg_slope", "bootstrap_rms", "avg_bootstrap_slope", "avg_correlation_between_days", "avg_correlation_with_mean"])

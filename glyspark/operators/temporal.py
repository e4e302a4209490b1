"""Differences over time: MODD, CONGA, lability, and the combined variability row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import expr as X
from ..schema import BY
from . import basic as B, excursions as E
from .sd import join_on

G = X.value


def modd(df: DataFrame, days: int = 1, by=BY) -> DataFrame:
    """Mean absolute difference at the same time of day: each reading with the one `days` rows on, if that is `days` days on."""
    if not 1 <= days <= 6:
        raise ValueError("days must lie between 1 and 6")
    rows = df.select(*by, F.date_format("time", "HH:mm:ss").alias("clock"), X.day().alias("day"), G().alias("g"))
    w = Window.partitionBy(*by, "clock").orderBy("day", "g")
    pairs = rows.select(*by, "g", "day", F.lag("g", days).over(w).alias("before"), F.lag("day", days).over(w).alias("then"))
    apart = F.when(F.datediff("day", "then") == days, F.abs(F.col("g") - F.col("before")))
    both = F.col("then").isNotNull() & (F.datediff("day", "then") == days)
    return pairs.groupBy(*by).agg(F.avg(apart).alias("value"), F.count(apart).alias("n_observations"), F.stddev_pop(apart).alias("std"), X.pearson(F.when(both, F.col("before")), F.when(both, F.col("g"))).alias("correlation"))


def conga(df: DataFrame, hours: float | list[float] = 4, by=BY, max_gap_minutes: float | None = None) -> DataFrame:
    """Deviation of differences over some hours: each reading with the one n rows before, n = hours / interval,
    if their times are hours apart within max_gap_minutes (twice the interval by default).

    n differs by series, so readings meet by row number; several hours share the pass. One row per
    series and hours; no valid pair leaves the value null.
    """
    wanted = hours if isinstance(hours, list) else [hours]
    rows = B.with_gaps(df, by).withColumn("at", F.row_number().over(X.by_time(by)))
    typical = rows.groupBy(*by).agg(B.typical_gap().alias("interval"))
    rows = rows.select(*by, "at", "t_us", G().alias("g"))
    steps = typical.withColumn("hours", F.explode(F.array(*(F.lit(float(h)) for h in wanted)))).withColumn("n", F.floor(F.col("hours") * 60 / F.col("interval")))
    late = rows.join(steps, list(by)) if by else rows.crossJoin(F.broadcast(steps))
    late = late.filter("n > 0").withColumn("at0", F.col("at") - F.col("n"))
    early = rows.select(*by, F.col("at").alias("at0"), F.col("t_us").alias("t0"), F.col("g").alias("g0"))
    met = late.join(early, [*by, "at0"], "left")
    slack = F.lit(float(max_gap_minutes)) if max_gap_minutes is not None else 2 * F.col("interval")
    gap = (F.col("t_us") - F.col("t0")) / float(X.MINUTE_US)
    difference = F.col("g") - F.col("g0")
    met = met.select(*by, "hours", slack.alias("slack"), F.col("t0").isNotNull().cast("long").alias("pair"), F.when(gap.between(F.col("hours") * 60 - slack, F.col("hours") * 60 + slack), difference).alias("d"))
    return met.groupBy(*by, "hours").agg(
        F.stddev_samp("d").alias("value"),
        F.count("d").alias("n_observations"),
        F.avg("d").alias("mean_difference"),
        F.avg(F.abs("d")).alias("abs_mean_difference"),
        F.first("slack").alias("max_gap_minutes"),
        F.sum("pair").alias("total_comparisons"),
        F.count("d").alias("valid_comparisons"),
        (F.sum("pair") - F.count("d")).alias("invalid_comparisons"),
        (F.try_divide(F.count("d") * F.lit(100.0), F.sum("pair"))).alias("percent_valid"),
    )


def weekly_lability(df: DataFrame, interval: int = 1, by=BY, by_year: bool = False) -> DataFrame:
    """Sum of squared changes between readings `interval` rows apart, per ISO week."""
    keys = [F.weekofyear("time").alias("week"), *([F.year(F.date_add(X.period("W-ISO"), 3)).alias("year")] if by_year else [])]
    rows = df.select(*by, "time", G().alias("g"), *keys)
    part = [*by, "week", *(["year"] if by_year else [])]
    change = F.lead("g", interval).over(Window.partitionBy(*part).orderBy("time")) - F.col("g")
    return rows.withColumn("c", F.pow(change, 2) / interval).groupBy(*part).agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("lability"))


def lability(df: DataFrame, interval: int = 1, by=BY, period: str = "week", by_year: bool = False) -> DataFrame:
    if period != "week":
        raise ValueError("period must be 'week'")
    mean = F.avg("lability")
    return weekly_lability(df, interval, by, by_year).groupBy(*by).agg(mean.alias("mean_li"), (mean / 324.0).alias("mean_li_mmol"), F.stddev_pop("lability").alias("std_li"), F.count(F.lit(1)).alias("n_weeks"), F.sqrt(mean / 168.0).alias("cambio_tipico_por_hora"))


def variability(df: DataFrame, by=BY) -> DataFrame:
    """CONGA 1, 2, 4, 6 and 24, MODD, J, LBGI, HBGI, MAGE, M and weekly lability."""
    hours = [1, 2, 4, 6, 24]
    c = conga(df, hours, by).groupBy(*by).agg(*(F.max(F.when(F.col("hours") == h, F.col("value"))).alias(f"CONGA{h}") for h in hours))
    row = B.compute(df, ["j_index", "lbgi", "hbgi", "m_value"], by).withColumnsRenamed({"j_index": "J_index", "lbgi": "LBGI", "hbgi": "HBGI", "m_value": "M_value"})
    parts = [row, c, modd(df, 1, by).select(*by, F.col("value").alias("MODD")), E.mage(df, by).select(*by, F.col("mage").alias("MAGE")), lability(df, 1, by).select(*by, F.col("mean_li").alias("LI_week"))]
    return reduce(lambda a, b: join_on(a, b, by), parts)

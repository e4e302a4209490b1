"""Variance components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import expr as X
from ..schema import BY
from .sd import join_on

G = X.value
PARTS = ("patron", "interaccion", "residual")


def _segment():
    """0 for hours 0-8, 1 for 9-16, 2 for 17-23: right-closed bins, the first closed on both sides."""
    h = F.hour("time")
    return F.when(h <= 8, 0).when(h <= 16, 1).otherwise(2)


def _components(df: DataFrame, by) -> DataFrame:
    rows = df.select(*by, X.day().alias("day"), X.minute_of_day().alias("minute"), G().alias("g"))
    # Sums per cell feed every coarser mean, so the readings are shuffled once.
    cells = rows.groupBy(*by, "day", "minute").agg(F.sum("g").alias("s"), F.sum(F.col("g") * F.col("g")).alias("q"), F.count(F.lit(1)).alias("n"))
    days = cells.groupBy(*by, "day").agg((F.sum("s") / F.sum("n")).alias("m")).groupBy(*by).agg(F.var_samp("m").alias("interdia"))
    points = cells.groupBy(*by, "minute").agg((F.sum("s") / F.sum("n")).alias("m")).groupBy(*by).agg(F.var_samp("m").alias("patron"))
    total = rows.groupBy(*by).agg(F.var_samp("g").alias("total"))
    inner = cells.groupBy(*by).agg(F.var_samp(F.col("s") / F.col("n")).alias("cells"))
    return join_on(join_on(join_on(total, days, by), points, by), inner, by)


def variance_components(df: DataFrame, by=BY) -> DataFrame:
    """Total, between-day and within-day variance; the latter as pattern, interaction and residual; percentages and roots.

    A negative residual is 0 if it is below a hundredth of the total, else it is taken from the interaction; one
    that is only rounding is 0.
    """
    v = _components(df, by)
    c = F.col
    v = v.withColumn("intradia", c("total") - c("interdia")).withColumn("x", c("cells") - c("patron") - c("interdia")).withColumn("r", c("total") - (c("interdia") + c("patron") + c("x")))
    small = F.abs(c("r")) < 0.01 * c("total")
    v = v.withColumn("interaccion", F.when((c("r") < 0) & ~small, c("x") - F.abs(c("r"))).otherwise(c("x"))).withColumn("residual", F.when(c("r") < 1e-9 * c("total"), 0.0).otherwise(c("r")))
    for k in ("interdia", "intradia"):
        v = v.withColumn(f"porcentaje_{k}", F.coalesce(F.try_divide(c(k), F.nullif(c("total"), F.lit(0.0))) * 100, F.lit(0.0)))
    inner = {k: F.when(c("intradia") > 0, c(k) / c("intradia") * 100).otherwise(0.0) for k in PARTS}
    for k in PARTS:
        v = v.withColumn(f"_{k}", inner[k])
    whole = c("_patron") + c("_interaccion") + c("_residual")
    for k in PARTS:
        v = v.withColumn(f"porcentaje_{k}", F.when(whole > 0, c(f"_{k}") / whole * 100).otherwise(c(f"_{k}")))
    kinds = ("total", "interdia", "intradia", *PARTS)
    return v.select(*by, *(c(k).alias(f"varianza_{k}") for k in kinds), *(c(f"porcentaje_{k}") for k in ("interdia", "intradia", *PARTS)), *(F.when(c(k) > 0, F.sqrt(k)).otherwise(0.0).alias(f"sd_{k}") for k in kinds))


def variance_segments(df: DataFrame, by=BY) -> DataFrame:
    """Per segment of the day: variance, deviation, mean, readings, normalised share; and the variance between segments."""
    seg = df.groupBy(*by, _segment().alias("segment")).agg(F.var_samp(G()).alias("varianza"), F.avg(G()).alias("media"), F.count(F.lit(1)).alias("conteo"))
    w = Window.partitionBy(*by)
    n = F.sum("conteo").over(w)
    seg = seg.withColumn("n", n).withColumn("grand", F.sum(F.col("media") * F.col("conteo")).over(w) / n)
    between = F.sum(F.col("conteo") * F.pow(F.col("media") - F.col("grand"), 2)).over(w) / F.col("n")
    seg = seg.withColumn("varianza_entre_segmentos", F.when(F.count(F.lit(1)).over(w) > 1, between).otherwise(0.0))
    # The common factor (within-day variance) drops out when shares are brought to 100.
    share = F.col("varianza") * F.col("conteo")
    whole = F.sum(share).over(w)
    return seg.select(*by, "segment", "varianza", F.when(F.col("varianza") > 0, F.sqrt("varianza")).otherwise(0.0).alias("sd"), "media", "conteo", F.when(whole > 0, share / whole * 100).otherwise(0.0).alias("porcentaje"), "varianza_entre_segmentos")

"""Day statistics and gaps over a stream of readings (an extension; batch operators define the results)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import expr as X


def daily_statistics(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Readings, mean and deviation per series and day; state is dropped when the watermark passes the day."""
    rows = stream.withColumn("at", F.col("time").cast("timestamp")).withWatermark("at", late)
    got = rows.groupBy("series_id", F.window("at", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.avg(X.value()).alias("mean"), F.stddev_samp(X.value()).alias("sd"), X.percent(X.between(70, 180)).alias("TIR"))
    return got.select("series_id", F.to_date("window.start").alias("day"), "n", "mean", "sd", "TIR")


def sessions(stream: DataFrame, gap: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Stretches of readings without a longer gap."""
    rows = stream.withColumn("at", F.col("time").cast("timestamp")).withWatermark("at", late)
    got = rows.groupBy("series_id", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"))
    return got.select("series_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")

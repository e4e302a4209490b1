"""Gaps, data set information and periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import expr as X
from ..schema import BY
from . import basic as B

#: Minutes beyond the typical interval from which a gap is a disconnection.
TOLERANCE = 10


def _gaps(df: DataFrame, by) -> DataFrame:
    """Gaps with their series' typical interval. One row per series is joined back; Spark picks the join by size."""
    rows = B.with_gaps(df, by).withColumn("gap_start", F.lag("time").over(X.by_time(by)))
    typical = rows.groupBy(*by).agg(B.typical_gap().alias("interval"))
    joined = rows.join(typical, list(by)) if by else rows.crossJoin(F.broadcast(typical))
    return joined.withColumn("cut_off", F.coalesce(F.col("gap_us") > (F.col("interval") + TOLERANCE) * X.MINUTE_US, F.lit(False)))


def disconnections(df: DataFrame, by=BY) -> DataFrame:
    """Start, end, minutes and label of every gap longer than the typical interval and ten minutes."""
    minutes = F.floor(F.col("gap_us") / X.MINUTE_US)
    label = F.format_string("%02d horas y %02d minutos", F.floor(minutes / 60), minutes % 60)
    return _gaps(df, by).filter("cut_off").select(*by, "gap_start", F.col("time").alias("gap_end"), (F.col("gap_us") / float(X.MINUTE_US)).alias("minutes"), label.alias("label"))


def info(df: DataFrame, by=BY) -> DataFrame:
    """Readings, range, typical interval, theoretical readings, availability, disconnections and their hours."""
    got = _gaps(df, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_datos"),
        F.min("time").alias("fecha_inicio"),
        F.max("time").alias("fecha_fin"),
        F.first("interval").alias("intervalo_tipico"),
        F.sum(F.when(F.col("cut_off"), 1).otherwise(0)).alias("num_desconexiones"),
        (F.sum(F.when(F.col("cut_off"), F.col("gap_us")).otherwise(0)) / float(X.HOUR_US)).alias("tiempo_total_desconexion"),
    )
    expected = F.floor((X.micros("fecha_fin") - X.micros("fecha_inicio")) / float(X.MINUTE_US) / F.col("intervalo_tipico"))
    return got.withColumn("datos_teoricos", expected).withColumn("porcentaje_disponibilidad", F.try_divide(F.col("num_datos") * F.lit(100.0), F.nullif(F.col("datos_teoricos"), F.lit(0))))


def describe(df: DataFrame, by=BY) -> list[str]:
    """A text per series."""
    return [f"Readings: {r['num_datos']}\nFrom: {r['fecha_inicio']}\nTo: {r['fecha_fin']}\nInterval: {r['intervalo_tipico']:.1f} min\nExpected: {r['datos_teoricos']}\nAvailable: {(r['porcentaje_disponibilidad'] or 0):.1f} %\nDisconnections: {r['num_desconexiones']} ({r['tiempo_total_desconexion']:.1f} h)" for r in info(df, by).toLocalIterator()]


def segment(df: DataFrame, start: str, hours: float) -> DataFrame:
    """Readings whose time of day lies in [start, start + hours)."""
    return df.filter(X.in_segment(start, hours))


def with_period(df: DataFrame, frequency: str = "W") -> DataFrame:
    return df.withColumn("period", X.period(frequency))


def periods(df: DataFrame, frequency: str = "W", by=BY, interval: float | None = None) -> DataFrame:
    """Start, end, hours, completeness and readings of each period; the interval is the whole series'."""
    rows = with_period(df, frequency)
    got = rows.groupBy(*by, "period").agg(F.min("time").alias("start"), F.max("time").alias("end"), F.count(F.lit(1)).alias("n_points"))
    typical = B.typical_interval(df, by) if interval is None else df.select(*by).distinct().withColumn("typical_interval", F.lit(float(interval)))
    got = got.join(typical, list(by)) if by else got.crossJoin(F.broadcast(typical))
    hours = (X.micros("end") - X.micros("start")) / float(X.HOUR_US)
    got = got.withColumn("duration_hours", hours)
    expected = F.col("duration_hours") * 60 / F.col("typical_interval")
    return got.withColumn("completeness", F.when(expected > 0, F.col("n_points") / expected * 100).otherwise(0.0)).select(*by, "period", "start", "end", "duration_hours", "completeness", "n_points")

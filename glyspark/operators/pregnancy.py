"""Gestational reports: trimesters, weeks and the days around delivery."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import expr as X
from ..schema import BY
from . import basic as B, profiles as P, quality as Q, summary

TRIMESTERS = ("primer_trimestre", "segundo_trimestre", "tercer_trimestre")
WHOLE = "embarazo_completo"


@dataclass(frozen=True)
class Pregnancy:
    """A delivery date and the gestational age then, in weeks and days."""

    delivery: dt.datetime
    week: int
    day: int = 0

    @classmethod
    def of(cls, delivery: str | dt.date | dt.datetime, week: int, day: int = 0) -> Pregnancy:
        if isinstance(delivery, str):
            delivery = dt.datetime.fromisoformat(delivery)
        if not isinstance(delivery, dt.datetime):
            delivery = dt.datetime.combine(delivery, dt.time())
        return cls(delivery, week, day)

    @property
    def conception(self) -> dt.datetime:
        return self.delivery - dt.timedelta(days=self.week * 7 + self.day)

    def bounds(self) -> list[dt.datetime]:
        c = self.conception
        return [c, c + dt.timedelta(weeks=13), c + dt.timedelta(weeks=26), self.delivery]

    def label(self) -> str:
        """Readable age at delivery."""
        return f"{self.week}+{self.day}"


def weeks_and_days(weeks: float) -> tuple[int, int]:
    """Whole weeks and days of a decimal number of weeks."""
    return int(weeks), round((weeks - int(weeks)) * 7)


def _at(t: dt.datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def during(df: DataFrame, p: Pregnancy) -> DataFrame:
    """Readings from conception to delivery, both included."""
    return df.filter((F.col("time") >= _at(p.conception)) & (F.col("time") <= _at(p.delivery)))


def with_trimester(df: DataFrame, p: Pregnancy) -> DataFrame:
    """trimester, half-open; a reading exactly at delivery has none."""
    b = p.bounds()
    t, out = F.col("time"), F.lit(None).cast("string")
    for name, lo, hi in reversed(list(zip(TRIMESTERS, b, b[1:], strict=False))):
        out = F.when((t >= _at(lo)) & (t < _at(hi)), name).otherwise(out)
    return during(df, p).withColumn("trimester", out)


def _on_all(df: DataFrame, got: DataFrame, by, name: str, values) -> DataFrame:
    """got, with rows of nulls for labels that have no reading."""
    labels = F.explode(F.array(*(F.lit(v) for v in values))).alias(name)
    keys = df.select(*by).distinct().select(*by, labels) if by else df.sparkSession.range(1).select(labels)
    return keys.join(got, [*by, name], "left")


def trimester_statistics(df: DataFrame, p: Pregnancy, by=BY) -> DataFrame:
    """Readings and pregnancy statistics per trimester; nulls and n = 0 for empty ones."""
    rows = with_trimester(df, p).filter("trimester IS NOT NULL")
    got = B.with_completeness(rows, ("n", *B.PREGNANCY), (*by, "trimester"))
    return _on_all(df, got, by, "trimester", TRIMESTERS).fillna(0, subset=["n"])


def statistics(df: DataFrame, p: Pregnancy, by=BY) -> DataFrame:
    return B.time_statistics_pregnancy(during(df, p), by)


def trimester_info(df: DataFrame, p: Pregnancy, by=BY) -> DataFrame:
    """Data set information per trimester with expected readings for its whole days and their share."""
    got = Q.info(with_trimester(df, p).filter("trimester IS NOT NULL"), (*by, "trimester"))
    b = p.bounds()
    days = F.create_map(*[x for name, lo, hi in zip(TRIMESTERS, b, b[1:], strict=False) for x in (F.lit(name), F.lit((hi - lo).days))])
    expected = F.floor(F.lit(60.0) / F.col("intervalo_tipico") * 24 * days[F.col("trimester")])
    got = got.withColumn("datos_esperados", expected)
    return got.withColumn("porcentaje_datos", F.try_divide(F.col("num_datos") * F.lit(100.0), F.nullif(F.col("datos_esperados"), F.lit(0))))


def around_delivery(df: DataFrame, p: Pregnancy, by=BY) -> DataFrame:
    """Statistics of the 24 hours before and after delivery, from the series as it is, beyond delivery too."""
    day, t = dt.timedelta(days=1), F.col("time")
    label = F.when((t >= _at(p.delivery - day)) & (t < _at(p.delivery)), "preparto").when((t > _at(p.delivery)) & (t <= _at(p.delivery + day)), "postparto")
    rows = df.withColumn("phase", label).filter("phase IS NOT NULL")
    got = B.with_completeness(rows, ("n", *B.PREGNANCY), (*by, "phase")).withColumn("IQR", F.col("p75") - F.col("p25"))
    return _on_all(df, got, by, "phase", ("preparto", "postparto")).fillna(0, subset=["n"])


def weekly_statistics(df: DataFrame, p: Pregnancy, by=BY) -> DataFrame:
    """Readings and pregnancy statistics per week from conception; empty weeks have n = 0."""
    start = int((p.conception - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    week = (F.floor((X.micros() - F.lit(start)) / (7 * 24 * X.HOUR_US)) + 1).cast("int")
    got = B.with_completeness(during(df, p).withColumn("week", week), ("n", *B.PREGNANCY), (*by, "week"))
    days = p.week * 7 + p.day
    return _on_all(df, got, by, "week", range(1, -(-days // 7) + 1)).fillna(0, subset=["n"])


def all_metrics(df: DataFrame, p: Pregnancy, by=BY) -> DataFrame:
    """All metrics of the whole pregnancy and of each trimester."""
    rows = with_trimester(df, p)
    whole = rows.withColumn("trimester", F.lit(WHOLE))
    return summary.all_metrics(whole.unionByName(rows.filter("trimester IS NOT NULL")), (*by, "trimester"))


def rollup_statistics(df: DataFrame, p: Pregnancy, metrics: list[str], by=BY) -> DataFrame:
    """Registered metrics of the whole pregnancy and of each trimester in one pass over the readings."""
    rows = with_trimester(df, p).fillna("parto", subset=["trimester"])
    keys = [F.col(k) for k in by]
    got = rows.groupingSets([[*keys], [*keys, F.col("trimester")]], *keys, F.col("trimester")).agg(*(B.metric(m) for m in metrics))
    return got.withColumn("trimester", F.coalesce("trimester", F.lit(WHOLE))).filter("trimester <> 'parto'")


def distribution(df: DataFrame, p: Pregnancy, by=BY) -> DataFrame:
    return B.distribution_analysis(with_trimester(df, p).filter("trimester IS NOT NULL"), (*by, "trimester"))


def histogram(df: DataFrame, p: Pregnancy, bin_width: int = 10, by=BY) -> DataFrame:
    return P.histogram(with_trimester(df, p).filter("trimester IS NOT NULL"), bin_width, (*by, "trimester"))


def describe(df: DataFrame, p: Pregnancy, by=BY) -> list[str]:
    """A text per series."""
    head = f"Delivery: {p.delivery:%Y-%m-%d}\nGestational age: {p.label()}\nConception: {p.conception:%Y-%m-%d}"
    return [f"{head}\n{text}" for text in Q.describe(during(df, p), by)]

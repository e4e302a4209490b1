"""Risk and quality indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import expr as X
from ..schema import BY
from .sd import join_on

G = X.value


def m_value(df: DataFrame, reference: float = 90, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(X.half_even(F.avg(X.m_term(G(), reference))).alias("m_value"))


def j_index(df: DataFrame, by=BY) -> DataFrame:
    return df.groupBy(*by).agg((F.lit(0.001) * F.pow(F.avg(G()) + F.stddev_samp(G()), 2)).alias("j_index"))


def grade(df: DataFrame, by=BY, unit: str = "mg/dL") -> DataFrame:
    """Mean GRADE and its shares below 70, in [70, 140] and above 140."""
    if unit.lower() not in ("mg/dl", "mmol/l"):
        raise ValueError("unit must be 'mg/dL' or 'mmol/L'")
    g = G() * (18.0 if unit.lower() == "mmol/l" else 1.0)
    s = X.grade(g)
    total = F.nullif(F.sum(s), F.lit(0.0))

    def share(c):
        return F.try_divide(F.sum(F.when(c, s).otherwise(0.0)), total) * 100

    return df.groupBy(*by).agg(F.avg(s).alias("grade_score"), share(g < 70).alias("hypo_percent"), share(g.between(70.0, 140.0)).alias("eu_percent"), share(g > 140).alias("hyper_percent"))


def lbgi(df: DataFrame, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(X.low_risk(G())).alias("lbgi"))


def hbgi(df: DataFrame, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(X.high_risk(G())).alias("hbgi"))


def gri(df: DataFrame, by=BY, pregnancy: bool = False) -> DataFrame:
    """Glycaemia risk index and its parts, rounded to two digits."""
    low, high = (63, 140) if pregnancy else (70, 180)
    got = df.groupBy(*by).agg(X.percent(G() < 54).alias("VLow"), X.percent(X.between(54, low)).alias("Low"), X.percent(G() > 250).alias("VHigh"), X.percent(X.between(high, 250)).alias("High"))
    c, r = F.col, X.half_even
    return got.select(
        *by,
        r(3.0 * c("VLow") + 2.4 * c("Low") + 1.6 * c("VHigh") + 0.8 * c("High")).alias("GRI"),
        *(r(c(k)).alias(k) for k in ("VLow", "Low", "VHigh", "High")),
        r(c("VLow") + 0.8 * c("Low")).alias("hypo_component"),
        r(c("VHigh") + 0.5 * c("High")).alias("hyper_component"),
        r(100.0 - (c("VLow") + c("Low") + c("VHigh") + c("High"))).alias("TIR"),
    )


def daily_risk(df: DataFrame, by=BY) -> DataFrame:
    """The largest low and high risk of each day."""
    return df.groupBy(*by, X.day().alias("day")).agg(F.max(X.low_risk(G())).alias("low"), F.max(X.high_risk(G())).alias("high"))


def adrr(df: DataFrame, by=BY) -> DataFrame:
    """Average daily risk range and its category."""
    got = daily_risk(df, by).groupBy(*by).agg(F.avg(F.col("low") + F.col("high")).alias("adrr"), F.avg("low").alias("hypo_risk"), F.avg("high").alias("hyper_risk"))
    return got.withColumn("risk_category", F.when(F.col("adrr") < 20, "Bajo").when(F.col("adrr") < 40, "Moderado").otherwise("Alto"))


def risk_summary(df: DataFrame, by=BY) -> DataFrame:
    got = df.groupBy(*by).agg(F.avg(X.low_risk(G())).alias("lbgi"), F.avg(X.high_risk(G())).alias("hbgi"), (F.lit(0.001) * F.pow(F.avg(G()) + F.stddev_samp(G()), 2)).alias("j_index"), X.half_even(F.avg(X.m_term(G()))).alias("m_value"), F.avg(X.grade(G())).alias("grade"))
    return join_on(got, adrr(df, by).select(*by, "adrr"), by)

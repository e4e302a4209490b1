"""One wide row of all metrics per series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..schema import BY
from . import basic as B, excursions as E, risk as R, sd as S, temporal as T

BASIC = {"media": "mean", "mediana": "median", "desviacion_estandar": "sd", "cv": "cv", "gmi": "gmi", "tir": "TIR", "tir_tight": "TIR_tight", "tir_pregnancy": "TIR_pregnancy", "tar180": "TAR180", "tar250": "TAR250", "tar140": "TAR140", "tbr70": "TBR70", "tbr63": "TBR63", "tbr55": "TBR55", "asimetria": "skewness", "curtosis": "kurtosis"}
DEVIATIONS = {"sdt": "SDT", "sdw": "SDw", "sd_timepoints": "SDhhmm", "sd_noche": "noche", "sd_dia": "dia", "sd_tarde": "tarde", "sd_1h": "SDws_1h", "sd_6h": "SDws_6h", "sd_24h": "SDws_24h", "sd_daily_mean": "SDdm", "sd_same_timepoint": "SDbhhmm", "sd_same_timepoint_adj": "SDbhhmm_dm", "sd_interaction": "SDI"}


def all_metrics(df: DataFrame, by=BY) -> DataFrame:
    """Statistics, deviations, CONGA, excursions, MODD and risk of every series. Cache df if it is not a table."""
    by = tuple(by)
    basic = B.with_completeness(df, list(BASIC.values()), by).withColumnsRenamed({"data_percent": "completitud"} | {v: k for k, v in BASIC.items() if k != v})
    sds = S.all_sd(df, by).withColumnsRenamed({v: k for k, v in DEVIATIONS.items()})
    hours = [1, 2, 4, 6, 24]
    conga = T.conga(df, hours, by).groupBy(*by).agg(*(F.max(F.when(F.col("hours") == h, F.col("value"))).alias(f"CONGA{h}") for h in hours))
    mage = E.mage_baghurst(df, by=by).withColumnsRenamed({"sd_used": "mage_sd", "threshold": "mage_threshold", "num_excursions": "mage_excursions"})
    modd = T.modd(df, 1, by).select(*by, F.col("value").alias("modd"), F.col("std").alias("modd_sd"))
    gri = R.gri(df, by).select(*by, F.col("GRI").alias("gri"), F.col("hyper_component").alias("gri_high"), F.col("hypo_component").alias("gri_low"))
    pregnant = R.gri(df, by, pregnancy=True).select(*by, F.col("GRI").alias("gri_pregnancy"), F.col("hyper_component").alias("gri_pregnancy_high"), F.col("hypo_component").alias("gri_pregnancy_low"))
    return reduce(lambda a, b: S.join_on(a, b, by), [basic, sds, conga, mage, modd, R.risk_summary(df, by), gri, pregnant])

"""Metrics by period: the same builders with the period among the keys, or a user's function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..schema import BY
from ..shipping import ship
from . import basic as B, quality as Q


def complete_periods(df: DataFrame, frequency: str = "W", min_completeness: float = 70.0, by=BY) -> DataFrame:
    """Readings of the periods that are complete enough."""
    good = Q.periods(df, frequency, by).filter(F.col("completeness") >= min_completeness).select(*by, "period")
    return Q.with_period(df, frequency).join(good, [*by, "period"], "left_semi")


def period_metrics(df: DataFrame, metrics: list[str], frequency: str = "W", min_completeness: float = 70.0, by=BY) -> DataFrame:
    """Registered metrics of each complete period beside its metadata, in one aggregation."""
    rows = complete_periods(df, frequency, min_completeness, by)
    got = B.compute(rows, metrics, [*by, "period"])
    return Q.periods(df, frequency, by).join(got, [*by, "period"])


def period_apply(df: DataFrame, builder: Callable[..., DataFrame], frequency: str = "W", min_completeness: float = 70.0, by=BY, **options) -> DataFrame:
    """Any operator of this package, per period; intervals are each period's own."""
    return builder(complete_periods(df, frequency, min_completeness, by), by=(*by, "period"), **options)


def period_function(df: DataFrame, functions: list[Callable], frequency: str = "W", min_completeness: float = 70.0, by=BY) -> DataFrame:
    """Python functions of a period's glucose array (time-ordered), one double column each; errors give null."""
    ship(df.sparkSession)
    rows = complete_periods(df, frequency, min_completeness, by).select(*by, "period", "time", "glucose")
    keys = [*by, "period"]
    names = [f.__name__ for f in functions]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        glucose = pdf.sort_values("time")["glucose"].to_numpy()
        out = {k: [pdf[k].iloc[0]] for k in keys}
        for name, f in zip(names, functions, strict=True):
            try:
                out[name] = [float(f(glucose))]
            except Exception:  # noqa: BLE001  a user's function must not end the job
                out[name] = [None]
        return pd.DataFrame(out)

    schema = ", ".join([*(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys), *(f"`{n}` double" for n in names)])
    return rows.groupBy(*keys).applyInPandas(run, schema)

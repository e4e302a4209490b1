"""Thin drawing layer over the chart data; needs matplotlib. Only chart rows come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators import profiles as P


def _axes():
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("drawing needs matplotlib; the data come from glyspark.operators.profiles") from e
    return plt.subplots()


def plot_agp(df: DataFrame, smoothing: int = 15):
    fig, ax = _axes()
    rows = P.agp(df, smoothing, by=()).toPandas().sort_values("time_decimal")
    for lo, hi, alpha in (("p5_smooth", "p95_smooth", 0.2), ("p25_smooth", "p75_smooth", 0.4)):
        ax.fill_between(rows["time_decimal"], rows[lo], rows[hi], alpha=alpha)
    ax.plot(rows["time_decimal"], rows["p50_smooth"])
    return fig


def plot_bars(df: DataFrame, label: str, value: str):
    """A bar chart of any long chart table."""
    fig, ax = _axes()
    rows = df.toPandas()
    ax.bar(rows[label].astype(str), rows[value])
    return fig


def plot_lines(df: DataFrame, x: str, *values: str):
    fig, ax = _axes()
    rows = df.toPandas().sort_values(x)
    for v in values:
        ax.plot(rows[x], rows[v], label=v)
    ax.legend()
    return fig

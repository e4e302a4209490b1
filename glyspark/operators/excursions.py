"""Glycaemic excursions: the simple amplitude and three ways to find turning points.

Only the pruning of approach 1 depends on the order of its own results and runs in Python, on the list
of turning points of a series; the rest are windows.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import expr as X
from ..schema import BY
from ..shipping import ship
from .sd import join_on

G = X.value
#: The smoothing kernel.
KERNEL = (1, 2, 4, 8, 16, 8, 4, 2, 1)


def extrema(df: DataFrame, by=BY) -> DataFrame:
    """Strict local extrema: time, g, and at, their rank."""
    w = X.by_time(by)
    rows = df.select(*by, "time", G().alias("g"))
    rows = rows.withColumn("a", F.lag("g").over(w)).withColumn("b", F.lead("g").over(w))
    peaks = rows.filter("(a < g AND g > b) OR (a > g AND g < b)")
    return peaks.withColumn("at", F.row_number().over(w) - 1).drop("a", "b")


def mage(df: DataFrame, by=BY) -> DataFrame:
    """Mean amplitude above one deviation between extrema taken two by two, without overlap; 0 if none."""
    w = Window.partitionBy(*by).orderBy("time")
    pairs = extrema(df, by).withColumn("next", F.lead("g").over(w)).filter("at % 2 = 0 AND next IS NOT NULL").select(*by, F.abs(F.col("next") - F.col("g")).alias("amplitude"))
    sds = df.groupBy(*by).agg(F.stddev_samp(G()).alias("sd"))
    met = join_on(sds, pairs, by) if by else sds.join(pairs, F.lit(True), "left")
    big = F.when(F.col("amplitude") > F.col("sd"), F.col("amplitude"))
    return met.groupBy(*by).agg(F.coalesce(F.avg(big), F.lit(0.0)).alias("mage"), F.count(big).alias("excursions"), F.first("sd").alias("sd"))


def _numbered(df: DataFrame, by) -> DataFrame:
    """idx from 0, g, the series' number of readings and deviation."""
    whole = Window.partitionBy(*by)
    rows = df.select(*by, "time", G().alias("g")).withColumn("idx", F.row_number().over(X.by_time(by)) - 1)
    return rows.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("sd", F.stddev_samp("g").over(whole))


def smooth(df: DataFrame, by=BY) -> DataFrame:
    """Nine-point kernel, truncated to whole numbers; plain means at the four first and last readings."""
    rows, w = _numbered(df, by), X.by_time(by)
    taps = [F.lead("g", k - 4).over(w) if k > 4 else F.lag("g", 4 - k).over(w) if k < 4 else F.col("g") for k in range(len(KERNEL))]
    centre = reduce(lambda a, b: a + b, (F.lit(x / sum(KERNEL)) * t for x, t in zip(KERNEL, taps, strict=True)))
    # The first four readings have no more than four before them, the last no more than four after: one bounded frame serves both.
    edge = F.avg("g").over(w.rowsBetween(-4, 4))
    return rows.withColumn("smooth", F.when((F.col("idx") >= F.col("n") - 4) | (F.col("idx") < 4), edge).otherwise(centre).cast("int"))


def potential_points(df: DataFrame, by=BY) -> DataFrame:
    """The true extremum of each stretch between turning points of the smoothed curve: its highest reading where the
    curve rises over the stretch, else its lowest; the first on ties."""
    w = X.by_time(by)
    rows = smooth(df, by)
    turn = F.signum(F.lead("smooth").over(w) - F.col("smooth")) != F.signum(F.col("smooth") - F.lag("smooth").over(w))
    rows = rows.withColumn("turn", F.coalesce(turn, F.lit(False))).withColumn("stretch", F.sum(F.col("turn").cast("int")).over(w))
    best = rows.filter("stretch > 0").groupBy(*by, "stretch").agg(
        F.max_by(F.struct("idx", "g", "time"), F.struct("g", -F.col("idx"))).alias("top"),
        F.min_by(F.struct("idx", "g", "time"), F.struct("g", "idx")).alias("low"),
        F.min_by("smooth", "idx").alias("s0"),
        F.first("n").alias("n"),
        F.first("sd").alias("sd"),
    )
    s1 = F.lead("s0").over(Window.partitionBy(*by).orderBy("stretch"))
    rise = F.col("s0") < F.col("s1")
    best = best.withColumn("s1", s1).filter("s1 IS NOT NULL")
    pick = F.when(rise, F.col("top")).otherwise(F.col("low"))
    return best.select(*by, "stretch", pick["idx"].alias("idx"), pick["g"].alias("g"), pick["time"].alias("time"), F.when(rise, "peak").otherwise("valley").alias("kind"), "n", "sd")


def _ends(df: DataFrame, by) -> DataFrame:
    """First and last reading of each series, by one aggregation."""
    reading = F.struct("time", "g")
    whole = df.select(*by, "time", G().alias("g")).groupBy(*by).agg(F.min(reading).alias("a"), F.max(reading).alias("b"), F.count(F.lit(1)).alias("n"), F.stddev_samp("g").alias("sd"))
    both = F.array_distinct(F.array(*(F.struct(at.cast("int").alias("idx"), F.col(f"{x}.g").alias("g"), F.col(f"{x}.time").alias("time")) for x, at in (("a", F.lit(0)), ("b", F.col("n") - 1)))))
    return whole.filter("n > 0").select(*by, F.explode(both).alias("x"), "n", "sd").select(*by, "x.idx", "x.g", "x.time", "n", "sd")


def _prune(points: list[tuple[int, float]], thr: float) -> list[int]:
    """Places kept of (place, value) turning points, in order of place."""

    def straight(p):
        """Without inner points whose neighbours lie on both sides of them, judged all at once."""
        return [x for k, x in enumerate(p) if not 0 < k < len(p) - 1 or (x[1] - p[k - 1][1]) * (p[k + 1][1] - x[1]) <= 0]

    def inner(p, drop):
        return [x for k, x in enumerate(p) if not 0 < k < len(p) - 1 or not drop(p[k - 1][1], x[1], p[k + 1][1])]

    def minor(a, x, b):
        return abs(x - a) < thr and abs(x - b) < thr and not (x > max(a, b) or x < min(a, b))

    p = list(points)
    while True:
        kept = inner(p, minor)
        changed = len(kept) < len(p)
        p = straight(kept)
        if not changed:
            break
    if len(p) >= 3:
        p = straight(inner(p, lambda a, x, b: (abs(x - a) >= thr) != (abs(x - b) >= thr)))
    if len(p) >= 2 and abs(p[0][1] - p[1][1]) < thr:
        p = p[1:]
    if len(p) >= 2 and abs(p[-1][1] - p[-2][1]) < thr:
        p = p[:-1]
    return sorted({x[0] for x in p})


def _points_1(df: DataFrame, threshold_sd: float, by) -> DataFrame:
    ship(df.sparkSession)
    found = potential_points(df, by).select(*by, "idx", "g", "time", "n", "sd", F.col("stretch").alias("rank"))
    ends = _ends(df, by).withColumn("rank", F.when(F.col("idx") == 0, F.lit(-1)).otherwise(F.lit(2**31 - 1)).cast("long"))
    both = found.unionByName(ends.select(found.columns))
    keys = list(by)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        inner = pdf[(pdf["rank"] >= 0) & (pdf["rank"] < 2**31 - 1)]
        if not len(inner):
            return pdf.iloc[:0][[*keys, "idx", "g", "time", "sd"]]
        first, last = pdf.iloc[0], pdf.iloc[-1]
        points = list(zip(inner["idx"].astype(int), inner["g"].astype(float), strict=True))
        if first["rank"] < 0 and points[0][0] > 0 and first["g"] != points[0][1]:
            points.insert(0, (int(first["idx"]), float(first["g"])))
        if last["rank"] == 2**31 - 1 and points[-1][0] < last["idx"] and last["g"] != points[-1][1]:
            points.append((int(last["idx"]), float(last["g"])))
        keep = _prune(points, threshold_sd * float(pdf["sd"].iloc[0]))
        return pdf[pdf["idx"].isin(keep)].drop_duplicates("idx")[[*keys, "idx", "g", "time", "sd"]]

    schema = both.select(*by, "idx", "g", "time", "sd").schema
    # One group holds the turning points of a series, not its readings.
    if by:
        return both.groupBy(*by).applyInPandas(pick, schema)
    return both.groupBy(F.lit(0)).applyInPandas(pick, schema)


def _points_2(df: DataFrame, threshold_sd: float, by) -> DataFrame:
    w = X.by_time(by)
    rows = _numbered(df, by)
    turning = rows.withColumn("a", F.lag("g").over(w)).withColumn("b", F.lead("g").over(w)).filter("(a < g AND g > b) OR (a > g AND g < b)")
    # The scan goes on two readings after a point it takes: of neighbouring extrema it takes every other one.
    o = Window.partitionBy(*by).orderBy("idx")
    run = F.col("idx") - F.row_number().over(o)
    taken = turning.withColumn("run", run).withColumn("k", F.row_number().over(Window.partitionBy(*by, "run").orderBy("idx"))).filter("k % 2 = 1")
    ends = _ends(df, by)
    points = taken.select(ends.columns).unionByName(ends)
    points = points.withColumn("a", F.lag("g").over(o)).withColumn("b", F.lead("g").over(o))
    thr = F.col("sd") * threshold_sd
    extreme = F.expr("(a < g AND g > b) OR (a > g AND g < b)") & ((F.abs(F.col("g") - F.col("a")) >= thr) | (F.abs(F.col("g") - F.col("b")) >= thr))
    whole = Window.partitionBy(*by)
    points = points.withColumn("keep", F.coalesce(extreme, F.lit(False))).withColumn("some", F.max("keep").over(whole))
    edge = (F.col("idx") == 0) | (F.col("idx") == F.col("n") - 1)
    return points.filter(F.col("keep") | (F.col("some") & edge)).select(*by, "idx", "g", "time", "sd").dropDuplicates([*by, "idx"])


def _points_3(df: DataFrame, threshold_sd: float, by) -> DataFrame:
    o = Window.partitionBy(*by).orderBy("stretch")
    p = potential_points(df, by)
    for name in ("kind", "g"):
        p = p.withColumn(f"{name}0", F.lag(name).over(o)).withColumn(f"{name}1", F.lead(name).over(o))
    half = F.col("sd") * (threshold_sd / 2)
    up, down = F.col("g") - F.col("g0"), F.col("g") - F.col("g1")
    slight = F.when(F.col("kind") == "peak", (up < half) | (down < half)).otherwise((-up < half) | (-down < half))
    between = (F.col("kind0") != F.col("kind")) & (F.col("kind1") != F.col("kind"))
    skip = F.col("kind0").isNotNull() & F.col("kind1").isNotNull() & ((F.col("kind0") == F.col("kind")) | (between & slight))
    kept = p.filter(~F.coalesce(skip, F.lit(False))).select(*by, "idx", "g", "time", "sd").dropDuplicates([*by, "idx"])
    # Below two points, the ends of the series fill in: both if there is none; the last, or the first, beside a lone one.
    ends = _ends(df, by)
    many = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("kept"), F.min("idx").alias("only"))
    fill = (join_on(ends, many, by) if by else ends.crossJoin(F.broadcast(many))).withColumn("kept", F.coalesce("kept", F.lit(0)))
    first, last = F.col("idx") == 0, F.col("idx") == F.col("n") - 1
    lone = (F.col("kept") == 1) & (F.col("n") > 1) & F.when(F.col("only") == 0, last).otherwise(first)
    fill = fill.filter((F.col("kept") == 0) | lone).select(*by, "idx", "g", "time", "sd")
    return kept.unionByName(fill).dropDuplicates([*by, "idx"])


def turning_points(df: DataFrame, threshold_sd: float = 1, approach: int = 1, by=BY) -> DataFrame:
    """idx, g, time and the series' sd of the turning points of approach 1 (smoothing and pruning), 2 (direct) or 3 (smoothing and filter)."""
    try:
        return {1: _points_1, 2: _points_2, 3: _points_3}[approach](df, threshold_sd, by)
    except KeyError:
        raise ValueError("approach must be 1, 2 or 3") from None


def excursions(df: DataFrame, threshold_sd: float = 1, approach: int = 1, by=BY) -> DataFrame:
    """Steps between neighbouring turning points that reach the threshold."""
    o = Window.partitionBy(*by).orderBy("idx")
    p = turning_points(df, threshold_sd, approach, by).withColumn("g0", F.lag("g").over(o)).withColumn("start_time", F.lag("time").over(o)).filter("g0 IS NOT NULL")
    p = p.withColumn("magnitude", F.abs(F.col("g") - F.col("g0"))).filter(F.col("magnitude") >= F.col("sd") * threshold_sd)
    return p.select(*by, "start_time", F.col("time").alias("end_time"), F.col("g0").alias("start_value"), F.col("g").alias("end_value"), F.when(F.col("g") > F.col("g0"), "up").otherwise("down").alias("direction"), "magnitude")


def mage_baghurst(df: DataFrame, threshold_sd: float = 1, approach: int = 1, by=BY) -> DataFrame:
    """Mean rise, fall and both, the deviation and threshold used, and the number of excursions."""
    found = excursions(df, threshold_sd, approach, by)
    up, down = (F.when(F.col("direction") == d, F.col("magnitude")) for d in ("up", "down"))
    mean = lambda c: X.half_even(F.coalesce(F.avg(c), F.lit(0.0)))
    got = found.groupBy(*by).agg(mean(up).alias("mage_plus"), mean(down).alias("mage_minus"), mean(F.col("magnitude")).alias("mage_avg"), F.count(F.lit(1)).alias("num_excursions"))
    sds = df.groupBy(*by).agg(X.half_even(F.stddev_samp(G())).alias("sd_used"), X.half_even(F.stddev_samp(G()) * threshold_sd).alias("threshold"))
    return join_on(sds, got, by).fillna(0, subset=["mage_plus", "mage_minus", "mage_avg", "num_excursions"])

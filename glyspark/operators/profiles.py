"""Data behind the charts; drawing them is left to a thin layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import expr as X
from ..schema import BY
from . import basic as B, excursions as E, risk as R, sd as S, temporal as T, variance as V

G = X.value
FIVE = (5, 25, 50, 75, 95)


def _rolling(df: DataFrame, columns, by, order: str, width: int, full: bool = False) -> DataFrame:
    """Centred means over rows; with full, null where the window is cut."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    out = df
    for c in columns:
        mean = F.avg(c).over(w)
        out = out.withColumn(f"{c}_smooth", F.when(F.count(c).over(w) == width, mean) if full else mean)
    return out


def agp(df: DataFrame, smoothing: int = 15, by=BY) -> DataFrame:
    """Percentiles per time of day (decimal hours) and their centred means over that many rows."""
    got = df.groupBy(*by, X.decimal_hour().alias("time_decimal")).agg(F.percentile(G(), F.array(*(F.lit(p / 100) for p in FIVE))).alias("p"))
    names = [f"p{p}" for p in FIVE]
    return _rolling(got.select(*by, "time_decimal", *(F.col("p")[k].alias(n) for k, n in enumerate(names))), names, by, "time_decimal", smoothing)


def week_agp(df: DataFrame, smoothing: int = 15, combined: bool = True, by=BY) -> DataFrame:
    """The same per weekday, quartiles only if combined, with the number of days."""
    points = (25, 50, 75) if combined else FIVE
    rows = df.withColumn("weekday", X.weekday_name())
    keys = [*by, "weekday"]
    got = rows.groupBy(*keys, X.decimal_hour().alias("time_decimal")).agg(F.percentile(G(), F.array(*(F.lit(p / 100) for p in points))).alias("p"))
    names = [f"p{p}" for p in points]
    got = _rolling(got.select(*keys, "time_decimal", *(F.col("p")[k].alias(n) for k, n in enumerate(names))), names, keys, "time_decimal", smoothing)
    return got.join(rows.groupBy(*keys).agg(F.countDistinct(X.day()).alias("days")), keys)


def day_graph(df: DataFrame, date: str | None = None, by=BY) -> DataFrame:
    """Readings of a date, by default each series' first."""
    rows = df.select(*by, "time", G().alias("glucose"), X.day().alias("day"), (F.hour("time") + F.minute("time") / F.lit(60.0)).alias("time_decimal"))
    if date is not None:
        return rows.filter(F.col("day") == F.lit(date).cast("date")).drop("day")
    first = rows.withColumn("first", F.min("day").over(Window.partitionBy(*by)))
    return first.filter("day = first").drop("day", "first")


def histogram(df: DataFrame, bin_width: int = 10, by=BY, top: int = 500) -> DataFrame:
    """Counts of half-open bins from 0 up to the last edge at or below `top`; the last bin is closed; readings beyond are left out."""
    bins = top // bin_width
    last = bins * bin_width
    at = F.least(F.floor(G() / bin_width), F.lit(bins - 1))
    return df.filter(G().between(0.0, float(last))).groupBy(*by, (at * bin_width).cast("int").alias("bin_start")).agg(F.count(F.lit(1)).alias("count"))


def overlapping_days(df: DataFrame, smoothing: int = 15, by=BY) -> DataFrame:
    """Mean per time of day (unrounded hours) with its centred mean."""
    got = df.groupBy(*by, X.minute_of_day().alias("minute")).agg(F.avg(G()).alias("mean"))
    return _rolling(got, ["mean"], by, "minute", smoothing).withColumn("time_decimal", F.col("minute") / F.lit(60.0))


def day_lines(df: DataFrame, by=BY) -> DataFrame:
    """Every day's line."""
    return df.select(*by, X.day().alias("day"), (F.hour("time") + F.minute("time") / F.lit(60.0)).alias("time_decimal"), G().alias("glucose"))


def week_boxplots(df: DataFrame, by=BY) -> DataFrame:
    """Per weekday: quartiles, whiskers at the last readings within 1.5 ranges, outliers' number, days."""
    rows = df.withColumn("weekday", X.weekday_name())
    keys = [*by, "weekday"]
    q = rows.groupBy(*keys).agg(F.percentile(G(), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.countDistinct(X.day()).alias("days"))
    q = q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "days")
    low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = G().between(low, high)
    return rows.join(q, keys).groupBy(*keys, "q1", "median", "q3", "days").agg(F.min(F.when(inside, G())).alias("whisker_low"), F.max(F.when(inside, G())).alias("whisker_high"), F.sum((~inside).cast("long")).alias("fliers"))


def daily_variation(df: DataFrame, by=BY) -> DataFrame:
    """Mean and deviation of each day."""
    return S.day_table(df, by)


def daily_variation_histogram(df: DataFrame, column: str = "mean", bins: int = 20, by=BY) -> DataFrame:
    """Equal-width bins between the smallest and the largest daily value; the last is closed."""
    days = S.day_table(df, by).filter(F.col(column).isNotNull())
    w = Window.partitionBy(*by)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    days = days.withColumn("lo", lo).withColumn("width", (hi - lo) / bins)
    at = F.when(F.col("width") > 0, F.least(F.floor((F.col(column) - F.col("lo")) / F.col("width")), F.lit(bins - 1))).otherwise(0)
    return days.withColumn("bin", at.cast("int")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"), F.first("lo").alias("low"), F.first("width").alias("width"))


def sd_components(df: DataFrame, by=BY, descending: bool = False) -> DataFrame:
    """The thirteen deviations as rows; with descending, ranked from the largest."""
    wide = S.all_sd(df, by)
    names = [c for c in wide.columns if c not in by]
    long = wide.unpivot([F.col(k) for k in by], names, "component", "sd") if by else wide.unpivot([], names, "component", "sd")
    if descending:
        long = long.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sd"), "component")))
    return long


def timepoint_pattern(df: DataFrame, by=BY, min_count: float = 0.5, bin_minutes: int = 1) -> DataFrame:
    """Mean, deviation and days of each time point; low_data below the threshold."""
    points = S.timepoint_table(df, by, bin_minutes, min_count)
    return points.select(*by, "minute", X.clock(F.col("minute")).alias("clock"), "mean", "sd", "n_days", (~F.col("valid")).alias("low_data"))


def same_timepoint_profile(df: DataFrame, by=BY, min_count: float = 0.5, bin_minutes: int = 1) -> DataFrame:
    """Deviation between days per time point, and its mean over min(15, points // 10 + 1) rows where all are there."""
    points = S.same_timepoint_table(df, by, min_count, True, bin_minutes).select(*by, "minute", "sd", "mean", "n_days")
    part, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("minute")
    width = F.least(F.lit(15), F.floor(F.count(F.lit(1)).over(part) / 10) + 1)
    points = points.withColumn("width", width).withColumn("at", F.row_number().over(order))
    # The width differs by series: collect the widest frame and cut it.
    frame = F.collect_list(F.struct("at", "sd")).over(order.rowsBetween(-7, 7))
    near = F.filter(frame, lambda x: (x["at"] >= F.col("at") - F.floor(F.col("width") / 2)) & (x["at"] <= F.col("at") + F.floor((F.col("width") - 1) / 2)) & x["sd"].isNotNull())
    points = points.withColumn("near", near)
    total = F.aggregate("near", F.lit(0.0), lambda a, x: a + x["sd"])
    return points.select(*by, "minute", X.clock(F.col("minute")).alias("clock"), "sd", "mean", "n_days", F.when(F.size("near") == F.col("width"), total / F.size("near")).alias("sd_smooth"))


def hourly_pattern(df: DataFrame, by=BY, bins: int = 24) -> DataFrame:
    """Mean and readings of equal-width bins of the observed hours (right-closed, the first from a little below)."""
    h = F.hour("time") + F.minute("time") / F.lit(60.0)
    w = Window.partitionBy(*by)
    rows = df.select(*by, G().alias("g"), h.alias("h"))
    rows = rows.withColumn("lo", F.min("h").over(w)).withColumn("span", F.max("h").over(w) - F.min("h").over(w))
    at = F.when(F.col("span") > 0, F.greatest(F.ceil((F.col("h") - F.col("lo")) / F.col("span") * bins) - 1, F.lit(0))).otherwise(0)
    return rows.groupBy(*by, at.cast("int").alias("bin")).agg(F.avg("g").alias("mean"), F.count(F.lit(1)).alias("count"))


def top_days(df: DataFrame, k: int = 3, by=BY, min_count: float = 0.5) -> DataFrame:
    """The valid days of the largest deviation."""
    days = S.days_with_validity(df, by, min_count).filter("valid AND sd IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sd"), "day"))
    return days.withColumn("rank", rank).filter(F.col("rank") <= k).select(*by, "rank", "day", "sd", "mean", "n")


def dashboard_days(df: DataFrame, by=BY, min_count: float = 0.5) -> DataFrame:
    """Days with their exclusion flag, the mean over all days and a band of 20 around it."""
    days = S.days_with_validity(df, by, min_count)
    overall = F.avg(F.when(F.col("valid"), F.col("mean"))).over(Window.partitionBy(*by))
    return days.select(*by, "day", "mean", "sd", "n", (~F.col("valid")).alias("excluded"), overall.alias("overall"), (overall - 20).alias("low"), (overall + 20).alias("high"))


def daily_trend(df: DataFrame, by=BY, min_count: float = 0.5, least: int = 7) -> DataFrame:
    """Straight line through the valid days' means by their order, for series of more than `least` such days."""
    days = S.days_with_validity(df, by, min_count).filter("valid")
    days = days.withColumn("x", (F.row_number().over(Window.partitionBy(*by).orderBy("day")) - 1).cast("double"))
    return days.groupBy(*by).agg(F.regr_slope("mean", "x").alias("slope"), F.regr_intercept("mean", "x").alias("intercept"), F.count(F.lit(1)).alias("days")).filter(F.col("days") > least)


def variance_chart(df: DataFrame, by=BY) -> DataFrame:
    return V.variance_components(df, by)


def _stack(df: DataFrame, chart: str, bars, by) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(k).alias("position"), F.lit(name).alias("name"), F.lit(text).alias("label"), F.col(metric).alias("value")) for k, (name, text, metric) in enumerate(bars)))
    base = F.sum("value").over(Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return df.select(*by, F.explode(rows).alias("x")).select(*by, F.lit(chart).alias("chart"), "x.*").withColumn("base", F.coalesce(base, F.lit(0.0)))


#: Bars with their printed ranges, which differ from the bounds of what they show.
BARS = {
    "standard": (("Muy bajo", "< 54 mg/dL", "TBR55"), ("Bajo", "54 - 69 mg/dL", "TBR70"), ("Rango objetivo", "70 - 180 mg/dL", "TIR"), ("Alto", "181 - 250 mg/dL", "TAR180"), ("Muy alto", "> 250 mg/dL", "TAR250")),
    "strict": (("Muy bajo", "< 54 mg/dL", "TBR55"), ("Bajo", "54 - 69 mg/dL", "TBR70"), ("Rango objetivo", "70 - 140 mg/dL", "TIR_tight"), ("Alto", "141 - 250 mg/dL", "TAR140"), ("Muy alto", "> 250 mg/dL", "TAR250")),
    "pregnancy": (("Bajo", "< 63 mg/dL", "TBR63"), ("Rango objetivo", "63 - 140 mg/dL", "TIR_pregnancy"), ("Alto", "140 - 250 mg/dL", "TAR140"), ("Muy alto", "> 250 mg/dL", "TAR250")),
}


def time_in_range_bars(df: DataFrame, pregnancy: bool = False, by=BY) -> DataFrame:
    """Bars with their values and the heights they stand on."""
    charts = ["pregnancy"] if pregnancy else ["standard", "strict"]
    wide = B.compute(df, sorted({m for c in charts for *_, m in BARS[c]}), by)
    out = [_stack(wide, c, BARS[c], by) for c in charts]
    return out[0].unionByName(out[1]) if len(out) > 1 else out[0]


def conga_profile(df: DataFrame, max_hours: int = 24, step: int = 1, by=BY) -> DataFrame:
    """CONGA and its share of valid pairs for each number of hours, in one pass."""
    got = T.conga(df, [float(h) for h in range(1, max_hours + 1, step)], by)
    return got.select(*by, "hours", F.col("value").alias("conga"), "percent_valid")


def m_value_curve(spark: SparkSession, points: int = 1000, low: float = 40, high: float = 500, reference: float = 120) -> DataFrame:
    """M of constant glucose on an even grid, with its band."""
    g = F.lit(float(low)) + F.col("id") * F.lit((high - low) / (points - 1))
    got = spark.range(points).select(g.alias("glucose")).withColumn("m_value", X.m_term(F.col("glucose"), reference))
    return got.withColumn("band", F.when(F.col("m_value") < 18, "<18").when(F.col("m_value") < 30, "<30").otherwise(">=30"))


def gri_zone(x: Column, y: Column) -> Column:
    """Zone A to E of 3x + 1.6y in steps of 20."""
    s = 3.0 * x + 1.6 * y
    return F.when(s <= 20, "A").when(s <= 40, "B").when(s <= 60, "C").when(s <= 80, "D").otherwise("E")


def gri_grid(df: DataFrame, pregnancy: bool = False, by=BY) -> DataFrame:
    """Place of each series in the grid: low shares against high shares (unweighted), index and zone."""
    got = R.gri(df, by, pregnancy)
    x, y = F.col("VLow") + F.col("Low"), F.col("VHigh") + F.col("High")
    return got.select(*by, x.alias("hypo"), y.alias("hyper"), "GRI").withColumn("zone", gri_zone(F.col("hypo"), F.col("hyper")))


def excursion_chart(df: DataFrame, threshold_sd: float = 1, approach: int = 1, by=BY) -> DataFrame:
    """Readings with the turning points among them, for a browser by day."""
    points = E.turning_points(df, threshold_sd, approach, by).select(*by, "time", F.lit(True).alias("turning"))
    return df.select(*by, "time", G().alias("glucose")).join(points, [*by, "time"], "left").fillna(False, subset=["turning"]).withColumn("day", X.day())

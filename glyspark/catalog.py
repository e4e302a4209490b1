"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import oracles as O
from .functions import expr as X
from .operators import basic as B, excursions as E, periods as PE, pregnancy as PG, profiles as P, quality as Q, risk as R, sd as S, stability as ST, summary as SU, temporal as T, variance as V
from .sources import ingest as I, sink
from .sources.scratch import scratch

Query = Callable[[SparkSession, str], DataFrame]
PREGNANCY = PG.Pregnancy.of("2024-01-29", 28)
#: The same as text: conception, ends of the trimesters, delivery.
BOUNDS = tuple(t.isoformat(sep=" ") for t in PREGNANCY.bounds())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user, irregular in time."""
    return events(spark, sf_dir).select(F.col("user_id").cast("string").alias("series_id"), F.col("ts").cast("timestamp_ntz").alias("time"), F.floor(40 + F.col("value")).cast("int").alias("glucose"))


def grid(minutes: int) -> Query:
    """One global series: the largest value of each slot."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        slots = events(spark, sf_dir).groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.max("value").alias("v"))
        return slots.select(F.lit("all").alias("series_id"), F.col("w.start").cast("timestamp_ntz").alias("time"), F.floor(40 + F.col("v")).cast("int").alias("glucose"))

    return build


TABLES: dict[str, Query] = {"raw": raw, "m5": grid(5), "m30": grid(30)}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to the digits that are compared."""
    return df.select(*(F.round(F.col(f"`{c}`"), O.DIGITS).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def _on(table: str, f: Callable[..., DataFrame], *args, **options) -> Query:
    return lambda spark, sf_dir: rounded(f(TABLES[table](spark, sf_dir), *args, **options))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as epoch numbers (seconds for even users, milliseconds for odd) and values as text, through cleaning."""
    e = events(spark, sf_dir)
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    e = e.select("user_id", F.when(F.col("user_id") % 2 == 0, F.floor(t / 1000)).otherwise(t).alias("time"), F.when(F.col("value") > 400, "High").otherwise((40 + F.col("value")).cast("string")).alias("glucose"))
    return I.clean(e, series_col="user_id")


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-first texts of the event times, parsed."""
    text = F.date_format("ts", "dd-MM-yyyy HH:mm")
    return events(spark, sf_dir).select("event_id", X.parse_date(text).alias("time"))


def _deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users as one series by the minute: many rows share a time."""
    e = raw(spark, sf_dir).select(F.lit("all").alias("series_id"), F.date_trunc("MINUTE", F.col("time")).cast("timestamp_ntz").alias("time"), "glucose")
    return I.deduplicate(e)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = TABLES["m30"](spark, sf_dir)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return m.filter(F.col("time") < cut), m.filter(F.col("time") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).withColumn("glucose", F.col("glucose") + 1)


def _merged(rule: str) -> Query:
    return lambda spark, sf_dir: sink.merged(*_halves(spark, sf_dir), rule)


def _lines(spark: SparkSession, sf_dir: str, head: list[str], line) -> str:
    """The path of a text file of the five-minute series: head lines, then a line per slot."""
    rows = grid(5)(spark, sf_dir).select(F.unix_micros(F.col("time").cast("timestamp")).alias("at"), line.alias("value"))
    first = spark.createDataFrame([(k - len(head) - (1 << 60), x) for k, x in enumerate(head)], "at long, value string")
    path = scratch(spark, "lines")
    # One file, as a device exports it.
    first.unionByName(rows).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return path


def _text(pattern: str) -> Column:
    return F.date_format("time", pattern)


def _csv(sep: str, header: int = 0) -> Query:
    """Written with that separator and preamble; the reader finds the separator itself."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        head = [f"export {k}" for k in range(header)] + [f"device{sep}time{sep}glucose"]
        path = _lines(spark, sf_dir, head, F.concat_ws(sep, F.lit("x"), _text("yyyy-MM-dd HH:mm:ss"), F.col("glucose").cast("string")))
        return I.read_cgm(spark, path, header=header)

    return build


def _device(device: str) -> Query:
    """A device's export by its preset; every seventh slot is a row without a reading."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        preset = I.PRESETS[device]
        time = _text("dd-MM-yyyy HH:mm" if preset["dayfirst"] else "yyyy-MM-dd'T'HH:mm:ss")
        reading = F.when(F.col("glucose") % 7 != 0, F.col("glucose").cast("string")).otherwise("")
        head = [f"preamble {k}" for k in range(preset["header"])] + [f"Dispositivo,{preset['date_col']},{preset['glucose_col']}"]
        return I.read_device(spark, device, _lines(spark, sf_dir, head, F.concat_ws(",", F.lit("x"), time, reading)))

    return build


def _parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'table')}.parquet"
    raw(spark, sf_dir).withColumnRenamed("series_id", "patient").write.parquet(path)
    return I.read_cgm(spark, path, series_col="patient")


def _from_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.read_cgm(spark, grid(30)(spark, sf_dir).select("time", "glucose"))


def _date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of the range count, in two of the accepted formats."""
    return I.clean(grid(5)(spark, sf_dir), start="2024-01-09", end="11/01/2024 12:30")


def _mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as texts in a format by event, with a 12-hour clock among them, and every eleventh not understood."""
    kinds = ["yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd hh:mm:ss a"]
    text = F.coalesce(*(F.when(F.col("event_id") % 5 == k, F.date_format("ts", f)) for k, f in enumerate(kinds)))
    e = events(spark, sf_dir).select("user_id", F.when(F.col("event_id") % 11 == 0, "soon").otherwise(text).alias("time"), (F.col("event_id") % 300).alias("glucose"), "event_id")
    return I.clean(e, series_col="user_id", order_col="event_id")


def _unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    text = F.when(F.col("event_id") % 11 == 0, "soon").when(F.col("event_id") % 13 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return I.unparsed(e.select(text.alias("time"), F.when(F.col("event_id") % 17 == 0, "Low").otherwise(F.col("value").cast("string")).alias("glucose")))


def _narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of users divisible by three hold values beyond 16 bits and so keep their fractions."""
    e = events(spark, sf_dir)
    g = F.when(F.col("user_id") % 3 == 0, (F.col("event_id") % 100_000) + F.lit(32_700.25)).otherwise((F.col("event_id") % 400) + F.lit(0.75))
    return I.clean(e.select("user_id", F.col("ts").alias("time"), g.alias("glucose"), "event_id"), series_col="user_id", order_col="event_id")


def _sunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by the minute written and read again: of those with equal times the first event stays."""
    path = scratch(spark, "sink")
    e = events(spark, sf_dir).select((F.col("user_id") % 5).cast("string").alias("series_id"), F.date_trunc("MINUTE", "ts").cast("timestamp_ntz").alias("time"), F.floor(40 + F.col("value")).cast("int").alias("glucose"), "event_id")
    sink.write_cgm(e, path, order_col="event_id")
    return spark.read.parquet(path).select(F.col("series_id").cast("string").alias("series_id"), "time", F.col("glucose").cast("int").alias("glucose"))


def _ptp(x):
    return float(x.max() - x.min())


def _entries() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    std_ctes, std = O.with_data("raw", O.STANDARD)
    pre_ctes, pre = O.with_data("raw", O.PREGNANCY)
    out["time_statistics"] = _on("raw", B.time_statistics), O.final("raw", std, O.STANDARD, ["data_percent"], std_ctes)
    out["time_statistics_pregnancy"] = _on("raw", B.time_statistics_pregnancy), O.final("raw", pre, O.PREGNANCY, ["data_percent"], pre_ctes)
    dist = ["mean", "median", "sd", "cv", "skewness", "kurtosis", "p25", "p75"]
    d_ctes, d = O.with_data("raw", dist)
    out["distribution_analysis"] = _on("raw", B.distribution_analysis), O.final("raw", f"SELECT *, p75 - p25 AS IQR FROM ({d})", [*dist, "IQR"], ["data_percent"], d_ctes)
    # One query per registered metric: each is an operator of its own.
    for m in B.names():
        if m != "n":
            out[f"metric_{m}"] = _on("raw", B.compute, [m]), O.final("raw", O.agg("raw", [m]), [m])
    out["basic_stats"] = _on("raw", B.compute, ["n", "mean", "median", "sd", "cv"]), O.final("raw", O.agg("raw", ["n", "mean", "median", "sd", "cv"]), ["mean", "median", "sd", "cv"], ["n"])
    points = [1, 10, 50, 90, 99.5]
    out["percentiles"] = _on("raw", B.percentiles, points), O.final("raw", f"SELECT series_id, {', '.join(f'{O.q(p / 100)} AS p{p:g}'.replace('99.5', '99_5') for p in points[:-1])}, {O.q(0.995)} AS p99_5 FROM raw GROUP BY 1", ["p1", "p10", "p50", "p90", "p99_5"])
    out["time_in_range"] = _on("raw", B.time_in_range, 80, 160), O.final("raw", f"SELECT series_id, {O.pct('glucose BETWEEN 80 AND 160')} AS time_in_range FROM raw GROUP BY 1", ["time_in_range"])
    out["time_above"] = _on("raw", B.time_above, 200), O.final("raw", f"SELECT series_id, {O.pct('glucose > 200')} AS time_above FROM raw GROUP BY 1", ["time_above"])
    out["time_below"] = _on("raw", B.time_below, 60), O.final("raw", f"SELECT series_id, {O.pct('glucose < 60')} AS time_below FROM raw GROUP BY 1", ["time_below"])
    out["distinct_days"] = _on("raw", B.distinct_days), O.final("raw", f"SELECT series_id, count(DISTINCT {O.DAY}) AS days FROM raw GROUP BY 1", [], ["days"])
    g, t = O.gaps("raw"), O.typical()
    out["typical_interval"] = _on("raw", B.typical_interval), O.final("raw", "SELECT series_id, interval AS typical_interval FROM typ", ["typical_interval"], [], f"{g}, {t}")
    out["data_completeness"] = _on("raw", B.completeness), O.final("raw", f'SELECT series_id, first_time AS start, last_time AS "end", interval, {O.EXPECTED} AS expected, readings AS actual, {O.COMPLETE} AS percent FROM typ', ["interval", "percent"], ["start", '"end"', "expected", "actual"], f"{g}, {t}")
    g5 = O.gaps("m5")
    cut = "gap > (interval + 10) * 6e7"
    out["info_summary"] = _on("m5", Q.info), O.final("m5", f"SELECT series_id, count(*) AS num_datos, min(time) AS fecha_inicio, max(time) AS fecha_fin, any_value(interval) AS intervalo_tipico, CAST(sum(CASE WHEN {cut} THEN 1 ELSE 0 END) AS BIGINT) AS num_desconexiones, sum(CASE WHEN {cut} THEN gap ELSE 0 END) / 3.6e9 AS tiempo_total_desconexion, any_value({O.EXPECTED}) AS datos_teoricos, count(*) * 1e2 / any_value({O.EXPECTED}) AS porcentaje_disponibilidad FROM gaps JOIN typ USING (series_id) GROUP BY 1", ["intervalo_tipico", "tiempo_total_desconexion", "porcentaje_disponibilidad"], ["num_datos", "fecha_inicio", "fecha_fin", "num_desconexiones", "datos_teoricos"], f"{g5}, {t}")
    out["disconnections"] = _on("m5", Q.disconnections), O.final("m5", f"SELECT series_id, before AS gap_start, time AS gap_end, gap / 6e7 AS minutes, printf('%02d horas y %02d minutos', CAST(gap // 3600000000 AS BIGINT), CAST(gap // 60000000 % 60 AS BIGINT)) AS label FROM gaps JOIN typ USING (series_id) WHERE {cut}", ["minutes"], ["gap_start", "gap_end", "label"], f"{g5}, {t}")
    for f in ("D", "W", "M", "W-ISO"):
        out[f"period_split_{f.lower().replace('-', '_')}"] = _on("m5", Q.periods, f), O.periods("m5", f)
    out["period_metrics_week"] = _on("m5", PE.period_metrics, ["mean", "sd", "TIR"], "W", 60.0), O.period_metrics("m5", ["mean", "sd", "TIR"], "W", 60.0)
    out["period_metrics_day"] = _on("m5", PE.period_metrics, ["mean", "cv", "lbgi"], "D", 65.0), O.period_metrics("m5", ["mean", "cv", "lbgi"], "D", 65.0)
    out["period_function"] = _on("m5", PE.period_function, [_ptp], "W", 60.0), O.final("m5", "SELECT m.series_id, m.period, m.x AS _ptp FROM (SELECT series_id, " + O.period("W") + " AS period, CAST(max(glucose) - min(glucose) AS DOUBLE) AS x FROM m5 GROUP BY 1, 2) m JOIN pf USING (series_id, period) WHERE completeness >= 60", ["_ptp"], ["period"], O.periods_cte("m5", "W"))
    out["segment_filter"] = _on("m5", lambda df: Q.segment(df, "22:30", 3.5).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("glucose").alias("mean"))), O.final("m5", "SELECT series_id, count(*) AS n, avg(glucose) AS mean FROM m5 WHERE hour(time) * 60 + minute(time) >= 1350 OR hour(time) * 60 + minute(time) < 120 GROUP BY 1", ["mean"], ["n"])
    out["epoch_parse"] = _parsed, "WITH p AS (SELECT CAST(user_id AS VARCHAR) AS series_id, CASE WHEN user_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END AS time, CAST(floor(40 + value) AS INTEGER) AS glucose FROM events WHERE value <= 400), a AS (SELECT *, abs(glucose - avg(glucose) OVER (PARTITION BY series_id, time)) AS off FROM p) SELECT series_id, time, CAST(glucose AS DOUBLE) AS glucose FROM a QUALIFY row_number() OVER (PARTITION BY series_id, time ORDER BY off, glucose) = 1"
    out["date_parse"] = _dates, "SELECT event_id, date_trunc('minute', ts) AS time FROM events"
    out["dedup_closest_to_mean"] = _deduplicated, "WITH p AS (SELECT 'all' AS series_id, date_trunc('minute', ts) AS time, CAST(floor(40 + value) AS INTEGER) AS glucose FROM events), a AS (SELECT *, abs(glucose - avg(glucose) OVER (PARTITION BY time)) AS off FROM p) SELECT series_id, time, glucose FROM a QUALIFY row_number() OVER (PARTITION BY time ORDER BY off, glucose) = 1"
    load = f"WITH {O.TABLES['m5']} SELECT '0' AS series_id, time, CAST(glucose AS DOUBLE) AS glucose FROM m5"
    for name, sep, header in (("load_csv_comma", ",", 0), ("load_csv_semicolon", ";", 0), ("load_csv_preamble", ";", 2)):
        out[name] = _csv(sep, header), load
    for device in I.PRESETS:
        out[f"load_{device}"] = _device(device), f"{load} WHERE glucose % 7 <> 0"

    def closest(rows: str, ties: str) -> str:
        return f"WITH p AS ({rows}), a AS (SELECT *, abs(glucose - avg(glucose) OVER (PARTITION BY series_id, time)) AS off FROM p) SELECT series_id, time, CAST(glucose AS DOUBLE) AS glucose FROM a QUALIFY row_number() OVER (PARTITION BY series_id, time ORDER BY off, {ties}) = 1"

    out["load_parquet"] = _parquet, closest("SELECT CAST(user_id AS VARCHAR) AS series_id, ts AS time, floor(40 + value) AS glucose FROM events", "glucose")
    out["load_memory"] = _from_memory, f"WITH {O.TABLES['m30']} SELECT '0' AS series_id, time, CAST(glucose AS DOUBLE) AS glucose FROM m30"
    out["date_range"] = _date_range, f"{load} WHERE time BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-11 12:30:00'"
    out["dates_mixed"] = _mixed_dates, closest("SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('second', ts) AS time, event_id % 300 AS glucose, event_id FROM events WHERE event_id % 11 <> 0", "event_id")
    out["unparsed_rows"] = _unparsed, "SELECT count(*) AS rows, CAST(sum(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_times, CAST(sum(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_values FROM events"
    out["narrow_whole_series"] = _narrowed, closest("SELECT *, CASE WHEN max(g) OVER (PARTITION BY series_id) > 32767 THEN g ELSE trunc(g) END AS glucose FROM (SELECT CAST(user_id AS VARCHAR) AS series_id, ts AS time, event_id, CASE WHEN user_id % 3 = 0 THEN event_id % 100000 + 32700.25e0 ELSE event_id % 400 + 0.75e0 END AS g FROM events)", "event_id")
    out["sink_keep_first"] = _sunk, "SELECT CAST(user_id % 5 AS VARCHAR) AS series_id, date_trunc('minute', ts) AS time, CAST(floor(40 + value) AS INTEGER) AS glucose FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 5, date_trunc('minute', ts) ORDER BY event_id, value) = 1"
    halves = f"WITH {O.TABLES['m30']}, a AS (SELECT * FROM m30 WHERE time < TIMESTAMP '2024-01-20'), b AS (SELECT series_id, time, glucose + 1 AS glucose FROM m30 WHERE time >= TIMESTAMP '2024-01-10') "
    out["merge_keep_new"] = _merged("keep_new"), halves + "SELECT * FROM a WHERE time NOT IN (SELECT time FROM b) UNION ALL SELECT * FROM b"
    out["merge_keep_old"] = _merged("keep_old"), halves + "SELECT * FROM a UNION ALL SELECT * FROM b WHERE time NOT IN (SELECT time FROM a)"
    out["merge_keep_both"] = _merged("keep_both"), halves + "SELECT * FROM a UNION ALL SELECT * FROM b"

    out["sd_total"] = _on("m5", S.sd_total), O.final("m5", "SELECT series_id, stddev_samp(glucose) AS sd, avg(glucose) AS mean FROM m5 GROUP BY 1", ["sd", "mean"])
    valid = "sum(CASE WHEN n >= threshold THEN 1 ELSE 0 END)"
    out["sd_within_day"] = _on("raw", S.sd_within_day), O.final("raw", f"SELECT series_id, coalesce(avg(CASE WHEN n >= threshold THEN sd END), 0e0) AS sd, coalesce(avg(CASE WHEN n >= threshold THEN mean END), 0e0) AS mean, CAST({valid} AS BIGINT) AS valid_days, count(*) AS total_days, any_value(threshold) AS threshold FROM dayv GROUP BY 1", ["sd", "mean", "threshold"], ["valid_days", "total_days"], O.days("raw"))
    out["day_table"] = _on("m5", S.days_with_validity), O.final("m5", "SELECT *, n >= threshold AS valid FROM dayv", ["sd", "mean", "threshold"], ["day", "n", "valid"], O.days("m5"))
    out["sd_daily_mean"] = _on("raw", S.sd_daily_mean), O.final("raw", f"SELECT series_id, stddev_samp(CASE WHEN n >= threshold THEN mean END) AS sd, avg(CASE WHEN n >= threshold THEN mean END) AS mean, CAST({valid} AS BIGINT) AS valid_days, count(*) AS total_days FROM dayv GROUP BY 1", ["sd", "mean"], ["valid_days", "total_days"], O.days("raw"))
    out["sd_within_day_segment"] = _on("m5", S.sd_within_day_segment, "00:00", 8), O.final("m5", "SELECT series_id, coalesce(avg(sd), 0e0) AS sd, coalesce(avg(mean), 0e0) AS mean FROM days GROUP BY 1", ["sd", "mean"], [], O.days("m5", O.segment(0, 8)))
    out["sd_between_timepoints"] = _on("m5", S.sd_between_timepoints), O.between_timepoints("m5")
    out["sd_between_timepoints_binned"] = _on("m5", S.sd_between_timepoints, bin_minutes=30), O.between_timepoints("m5", 30)
    out["sd_between_timepoints_segment"] = _on("m5", S.sd_between_timepoints_segment, "08:00", 8), O.final("m5", f"SELECT series_id, stddev_samp(m) AS sd, avg(m) AS mean FROM (SELECT series_id, {O.MINUTE} AS k, avg(glucose) AS m FROM m5 WHERE {O.segment(8, 16)} GROUP BY 1, 2) GROUP BY 1", ["sd", "mean"])
    for h in (1, 6, 24):
        out[f"sd_within_series_{h}h"] = _on("m5", S.sd_within_series, h), O.within_series("m5", h)
    out["sd_same_timepoint"] = _on("m5", S.sd_same_timepoint), O.same_timepoint("m5")
    out["sd_same_timepoint_binned"] = _on("m5", S.sd_same_timepoint, bin_minutes=30), O.same_timepoint("m5", 30)
    out["sd_same_timepoint_adjusted"] = _on("m5", S.sd_same_timepoint_adjusted), O.final("m5", "SELECT series_id, avg(sd) AS sd, avg(mean) AS mean FROM adjp GROUP BY 1", ["sd", "mean"], [], O.ADJUSTED.replace("TABLE_", "m5"))
    out["sd_interaction"] = _on("m5", S.sd_interaction), O.final("m5", "SELECT series_id, stddev_samp(x) AS sd, avg(glucose) AS mean FROM inter GROUP BY 1", ["sd", "mean"], [], O.INTERACTION.replace("TABLE_", "m5"))
    for k, (start, hours) in S.SEGMENTS.items():
        a, b = O.SEGMENTS[k]
        out[f"sd_segment_{k}"] = _on("m5", S.sd_segment, start, hours), O.final("m5", f"SELECT series_id, stddev_samp(glucose) AS sd, avg(glucose) AS mean FROM m5 WHERE {O.segment(a, b)} GROUP BY 1", ["sd", "mean"])
    out["all_sd"] = _on("m5", S.all_sd), O.all_sd("m5", False)
    out["all_cv"] = _on("m5", S.all_cv), O.all_sd("m5", True)
    out["pattern_ratio"] = _on("m5", ST.ratios), O.ratios("m5")
    out["pattern_day_correlation"] = _on("m5", ST.day_correlation), O.day_correlation("m5")
    out["pattern_mean_correlation"] = _on("m5", ST.mean_correlation), O.mean_correlation("m5")
    out["pattern_rms"] = _on("m5", ST.rms_error), O.regression("m5", False)
    out["pattern_loo_rms"] = _on("m5", ST.leave_one_out), O.regression("m5", True)
    out["pattern_stability"] = _on("m5", ST.pattern_stability), O.joined(O.ratios("m5"), f"SELECT * EXCLUDE (pairs) FROM ({O.day_correlation('m5')})", O.mean_correlation("m5"), O.regression("m5", False), O.regression("m5", True))
    out["variance_components"] = _on("m5", V.variance_components), O.variance("m5")
    out["variance_segments"] = _on("m5", V.variance_segments), O.variance_segments("m5")

    out["mage"] = _on("m5", E.mage), O.mage("m5")
    out["mage_by_user"] = _on("raw", E.mage), O.mage("raw")
    for k in (1, 2, 3):
        out[f"mage_baghurst_{k}"] = _on("m5", E.mage_baghurst, 1, k), O.mage_baghurst("m5", k)
        out[f"excursions_{k}"] = _on("m5", E.excursions, 1, k), O.excursions("m5", k)
    out["excursion_chart"] = _on("m5", P.excursion_chart), O.excursion_chart("m5", 1)
    for k in (1, 2):
        out[f"modd_{k}"] = _on("m5", T.modd, k), O.modd("m5", k)
    out["conga_4"] = _on("m30", T.conga, 4), O.conga("m30", "[4]")
    out["conga_by_user"] = _on("raw", T.conga, 24), O.conga("raw", "[24]")
    out["conga_profile"] = _on("m30", P.conga_profile), O.final("m30", "SELECT series_id, hours, stddev_samp(d) AS conga, count(d) * 1e2 / nullif(sum(CASE WHEN pair THEN 1 ELSE 0 END), 0) AS percent_valid FROM met GROUP BY 1, 2", ["hours", "conga", "percent_valid"], [], O.conga_ctes("m30", "range(1, 25)"))
    out["lability_index"] = _on("m5", T.lability), O.lability("m5")
    out["lability_weekly"] = _on("m5", T.weekly_lability), O.final("m5", "SELECT * FROM wk", ["lability"], ["week"], O.LABILITY.replace("TABLE_", "m5"))
    hours = [1, 2, 4, 6, 24]
    vari = [f"(SELECT stddev_samp(d) FROM met WHERE hours = {h}) AS CONGA{h}" for h in hours]
    fits = "d0 IS NOT NULL AND day - d0 = 1"
    vari += [f"(SELECT avg(abs(glucose - g0)) FROM prs WHERE {fits}) AS MODD", "(SELECT coalesce(avg(CASE WHEN amplitude > sd THEN amplitude END), 0e0) FROM amp) AS MAGE", "(SELECT avg(lability) FROM wk) AS LI_week"]
    vari += [f"(SELECT {O.METRICS[m]} FROM m30) AS {n}" for m, n in (("j_index", "J_index"), ("lbgi", "LBGI"), ("hbgi", "HBGI"), ("m_value", "M_value"))]
    v_ctes = ", ".join([O.conga_ctes("m30", "[1, 2, 4, 6, 24]"), O.MAGE.replace("TABLE_", "m30"), O.LABILITY.replace("TABLE_", "m30"), f"prs AS (SELECT glucose, {O.DAY} AS day, lag(glucose) OVER w AS g0, lag({O.DAY}) OVER w AS d0 FROM m30 WINDOW w AS (PARTITION BY strftime(time, '%H:%M:%S') ORDER BY {O.DAY}, glucose))"])
    out["variability"] = _on("m30", T.variability), O.final("m30", f"SELECT 'all' AS series_id, {', '.join(vari)}", [x.rsplit(" AS ", 1)[1] for x in vari], [], v_ctes)

    out["m_value"] = _on("raw", R.m_value, 120), O.final("raw", f"SELECT series_id, {O.even('avg(pow(abs(1e1 * log10(glucose / 1.2e2)), 3))')} AS m_value FROM raw GROUP BY 1", ["m_value"])
    out["grade"] = _on("raw", R.grade), O.grade("raw")
    out["gri"] = _on("raw", R.gri), O.gri("raw")
    out["gri_pregnancy"] = _on("raw", R.gri, pregnancy=True), O.gri("raw", True)
    out["gri_grid"] = _on("raw", P.gri_grid), O.gri_grid("raw")
    out["adrr"] = _on("raw", R.adrr), O.adrr("raw")
    out["all_metrics"] = _on("m5", SU.all_metrics), O.all_metrics("m5")

    tri = f"tri AS (SELECT * FROM (SELECT *, {O.trimester(*BOUNDS)} AS trimester FROM m30 WHERE time BETWEEN TIMESTAMP '{BOUNDS[0]}' AND TIMESTAMP '{BOUNDS[3]}'))"
    inner_part = "within AS (SELECT * FROM tri WHERE trimester IS NOT NULL)"
    labels = "lab AS (SELECT 'all' AS series_id, unnest(['primer_trimestre', 'segundo_trimestre', 'tercer_trimestre']) AS trimester)"
    ctes, body = O.with_data("m30", ["n", *O.PREGNANCY], "series_id, trimester", "within")
    out["gestational_trimesters"] = _on("m30", PG.trimester_statistics, PREGNANCY), O.final("m30", f"SELECT lab.series_id, lab.trimester, coalesce(b.n, 0) AS n, b.* EXCLUDE (series_id, trimester, n) FROM lab LEFT JOIN ({body}) b USING (series_id, trimester)", O.PREGNANCY, ["trimester", "n", "data_percent"], f"{tri}, {inner_part}, {labels}, {ctes}")
    ctes, body = O.with_data("m30", O.PREGNANCY, "series_id", "tri")
    out["gestational_statistics"] = _on("m30", PG.statistics, PREGNANCY), O.final("m30", body, O.PREGNANCY, ["data_percent"], f"{tri}, {ctes}")
    ctes, body = O.with_data("m30", dist, "series_id, trimester", "within")
    out["gestational_distribution"] = _on("m30", PG.distribution, PREGNANCY), O.final("m30", f"SELECT *, p75 - p25 AS IQR FROM ({body})", [*dist, "IQR"], ["trimester", "data_percent"], f"{tri}, {inner_part}, {ctes}")
    phase = f"CASE WHEN time >= TIMESTAMP '{BOUNDS[3]}' - INTERVAL 1 DAY AND time < TIMESTAMP '{BOUNDS[3]}' THEN 'preparto' WHEN time > TIMESTAMP '{BOUNDS[3]}' AND time <= TIMESTAMP '{BOUNDS[3]}' + INTERVAL 1 DAY THEN 'postparto' END"
    ctes, body = O.with_data("m30", ["n", *O.PREGNANCY], "series_id, phase", "ph")
    out["gestational_delivery"] = _on("m30", PG.around_delivery, PREGNANCY), O.final("m30", f"SELECT lab.series_id, lab.phase, coalesce(b.n, 0) AS n, b.* EXCLUDE (series_id, phase, n), p75 - p25 AS IQR FROM lab LEFT JOIN ({body}) b USING (series_id, phase)", [*O.PREGNANCY, "IQR"], ["phase", "n", "data_percent"], f"ph AS (SELECT * FROM (SELECT *, {phase} AS phase FROM m30) WHERE phase IS NOT NULL), lab AS (SELECT 'all' AS series_id, unnest(['preparto', 'postparto']) AS phase), {ctes}")
    week = f"CAST(floor((epoch_us(time) - epoch_us(TIMESTAMP '{BOUNDS[0]}')) / 6048e8) + 1 AS INTEGER)"
    ctes, body = O.with_data("m30", ["n", *O.PREGNANCY], "series_id, week", "wks")
    out["gestational_weeks"] = _on("m30", PG.weekly_statistics, PREGNANCY), O.final("m30", f"SELECT lab.series_id, lab.week, coalesce(b.n, 0) AS n, b.* EXCLUDE (series_id, week, n) FROM lab LEFT JOIN ({body}) b USING (series_id, week)", O.PREGNANCY, ["week", "n", "data_percent"], f"{tri}, wks AS (SELECT *, {week} AS week FROM tri), lab AS (SELECT 'all' AS series_id, CAST(unnest(range(1, 29)) AS INTEGER) AS week), {ctes}")
    rolled = ["n", "mean", "sd", "TIR_pregnancy"]
    out["gestational_rollup"] = _on("m30", PG.rollup_statistics, PREGNANCY, rolled), O.final("m30", f"{O.agg('within', rolled, 'series_id, trimester')} UNION ALL SELECT series_id, 'embarazo_completo' AS trimester, * EXCLUDE (series_id) FROM ({O.agg('tri', rolled)})", rolled[1:], ["trimester", "n"], f"{tri}, {inner_part}")
    hist = "CAST(least(glucose // 10, 49) * 10 AS INTEGER) AS bin_start, count(*) AS count"
    out["gestational_histogram"] = _on("m30", PG.histogram, PREGNANCY), O.final("m30", f"SELECT series_id, trimester, {hist} FROM within WHERE glucose BETWEEN 0 AND 500 GROUP BY 1, 2, 3", [], ["trimester", "bin_start", "count"], f"{tri}, {inner_part}")
    span = "CASE trimester WHEN 'tercer_trimestre' THEN date_diff('day', TIMESTAMP '{}', TIMESTAMP '{}') ELSE 91 END".format(*BOUNDS[2:])
    info = f"SELECT series_id, trimester, count(*) AS num_datos, min(time) AS fecha_inicio, max(time) AS fecha_fin, any_value(interval) AS intervalo_tipico, CAST(sum(CASE WHEN {cut} THEN 1 ELSE 0 END) AS BIGINT) AS num_desconexiones, sum(CASE WHEN {cut} THEN gap ELSE 0 END) / 3.6e9 AS tiempo_total_desconexion, any_value({O.EXPECTED}) AS datos_teoricos, count(*) * 1e2 / any_value({O.EXPECTED}) AS porcentaje_disponibilidad FROM gaps JOIN typ USING (series_id, trimester) GROUP BY 1, 2"
    out["gestational_info"] = _on("m30", PG.trimester_info, PREGNANCY), O.final("m30", f"SELECT *, num_datos * 1e2 / datos_esperados AS porcentaje_datos FROM (SELECT *, CAST(floor(6e1 / intervalo_tipico * 24 * {span}) AS BIGINT) AS datos_esperados FROM ({info}))", ["intervalo_tipico", "tiempo_total_desconexion", "porcentaje_disponibilidad", "porcentaje_datos"], ["trimester", "num_datos", "fecha_inicio", "fecha_fin", "num_desconexiones", "datos_teoricos", "datos_esperados"], f"{tri}, {inner_part}, {O.gaps('within', 'series_id, trimester')}, {O.typical('series_id, trimester')}")
    inside = [f"time BETWEEN TIMESTAMP '{BOUNDS[0]}' AND TIMESTAMP '{BOUNDS[3]}'"] + [f"{O.trimester(*BOUNDS)} = '{t}' AND time BETWEEN TIMESTAMP '{BOUNDS[0]}' AND TIMESTAMP '{BOUNDS[3]}'" for t in ("primer_trimestre", "segundo_trimestre", "tercer_trimestre")]
    out["gestational_all_metrics"] = _on("m30", PG.all_metrics, PREGNANCY), O.parts_of("m30", dict(zip(("embarazo_completo", "primer_trimestre", "segundo_trimestre", "tercer_trimestre"), inside, strict=True)), "trimester", O.all_metrics)

    out["agp"] = _on("m5", P.agp), O.agp("m5")
    out["agp_even_window"] = _on("m5", P.agp, 6), O.agp("m5", 6)
    out["week_agp"] = _on("m5", P.week_agp), O.week_agp("m5")
    out["day_graph"] = _on("m5", P.day_graph), O.final("m5", f"SELECT series_id, time, glucose, hour(time) + minute(time) / 6e1 AS time_decimal FROM m5 QUALIFY {O.DAY} = min({O.DAY}) OVER (PARTITION BY series_id)", ["glucose", "time_decimal"], ["time"])
    out["day_graph_date"] = _on("m5", P.day_graph, "2024-01-09"), O.final("m5", f"SELECT series_id, time, glucose, hour(time) + minute(time) / 6e1 AS time_decimal FROM m5 WHERE {O.DAY} = DATE '2024-01-09'", ["glucose", "time_decimal"], ["time"])
    out["histogram"] = _on("raw", P.histogram), O.final("raw", f"SELECT series_id, {hist} FROM raw WHERE glucose BETWEEN 0 AND 500 GROUP BY 1, 2", [], ["bin_start", "count"])
    out["overlapping_days"] = _on("m5", P.overlapping_days), O.final("m5", f"SELECT *, {O.rolling('mean', 'series_id', 'minute', 15)}, minute / 6e1 AS time_decimal FROM mn", ["mean", "mean_smooth", "time_decimal"], ["minute"], f"mn AS (SELECT series_id, {O.MINUTE} AS minute, avg(glucose) AS mean FROM m5 GROUP BY 1, 2)")
    out["day_lines"] = _on("m5", P.day_lines), O.final("m5", f"SELECT series_id, {O.DAY} AS day, hour(time) + minute(time) / 6e1 AS time_decimal, glucose FROM m5", ["time_decimal", "glucose"], ["day"])
    box = f"bx AS (SELECT series_id, {O.WEEKDAY} AS weekday, {O.q(0.25)} AS q1, {O.q(0.5)} AS median, {O.q(0.75)} AS q3, count(DISTINCT {O.DAY}) AS days FROM m5 GROUP BY 1, 2)"
    inside = "glucose BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)"
    out["week_boxplots"] = _on("m5", P.week_boxplots), O.final("m5", f"SELECT series_id, weekday, q1, median, q3, days, min(CASE WHEN {inside} THEN glucose END) AS whisker_low, max(CASE WHEN {inside} THEN glucose END) AS whisker_high, CAST(sum(CASE WHEN {inside} THEN 0 ELSE 1 END) AS BIGINT) AS fliers FROM (SELECT *, {O.WEEKDAY} AS weekday FROM m5) JOIN bx USING (series_id, weekday) GROUP BY ALL", ["q1", "median", "q3", "whisker_low", "whisker_high"], ["weekday", "days", "fliers"], box)
    out["daily_variation"] = _on("m5", P.daily_variation), O.final("m5", "SELECT * FROM days", ["sd", "mean"], ["day", "n"], O.days("m5"))
    out["daily_variation_histogram"] = _on("m5", P.daily_variation_histogram), O.final("m5", "SELECT series_id, CAST(CASE WHEN width > 0 THEN least(floor((mean - lo) / width), 19) ELSE 0 END AS INTEGER) AS bin, count(*) AS count, any_value(lo) AS low, any_value(width) AS width FROM (SELECT *, min(mean) OVER w AS lo, (max(mean) OVER w - min(mean) OVER w) / 20 AS width FROM days WINDOW w AS (PARTITION BY series_id)) GROUP BY 1, 2", ["low", "width"], ["bin", "count"], O.days("m5"))
    out["sd_components"] = _on("m5", P.sd_components), "UNPIVOT (" + O.all_sd("m5", False) + ") ON COLUMNS(* EXCLUDE series_id) INTO NAME component VALUE sd"
    out["sd_components_ranked"] = _on("m5", P.sd_components, descending=True), "SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY sd DESC, component) AS INTEGER) AS rank FROM (UNPIVOT (" + O.all_sd("m5", False) + ") ON COLUMNS(* EXCLUDE series_id) INTO NAME component VALUE sd)"
    clock = "printf('%02d:%02d', minute // 60, minute % 60) AS clock"
    out["timepoint_pattern"] = _on("m5", P.timepoint_pattern), O.final("m5", f"SELECT series_id, minute, {clock}, mean, sd, n_days, n_days < threshold AS low_data FROM ptv", ["mean", "sd"], ["minute", "clock", "n_days", "low_data"], O.points("m5"))
    smooth = "wd AS (SELECT *, least(15, count(*) OVER (PARTITION BY series_id) // 10 + 1) AS width, row_number() OVER (PARTITION BY series_id ORDER BY minute) AS k FROM ptv WHERE n_days >= threshold), nb AS (SELECT a.series_id, a.minute, any_value(a.sd) AS sd, any_value(a.mean) AS mean, any_value(a.n_days) AS n_days, CASE WHEN count(b.sd) = any_value(a.width) THEN avg(b.sd) END AS sd_smooth FROM wd a JOIN wd b ON a.series_id = b.series_id AND b.k BETWEEN a.k - a.width // 2 AND a.k + (a.width - 1) // 2 GROUP BY 1, 2)"
    out["same_timepoint_profile"] = _on("m5", P.same_timepoint_profile), O.final("m5", f"SELECT *, {clock} FROM nb", ["sd", "mean", "sd_smooth"], ["minute", "clock", "n_days"], f"{O.points('m5')}, {smooth}")
    out["hourly_pattern"] = _on("m5", P.hourly_pattern), O.final("m5", "SELECT series_id, CAST(CASE WHEN span > 0 THEN greatest(ceil((h - lo) / span * 24) - 1, 0) ELSE 0 END AS INTEGER) AS bin, avg(glucose) AS mean, count(*) AS count FROM (SELECT *, min(h) OVER w AS lo, max(h) OVER w - min(h) OVER w AS span FROM (SELECT series_id, glucose, hour(time) + minute(time) / 6e1 AS h FROM m5) WINDOW w AS (PARTITION BY series_id)) GROUP BY 1, 2", ["mean"], ["bin", "count"])
    out["top_days"] = _on("m5", P.top_days), O.final("m5", "SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY sd DESC, day) AS INTEGER) AS rank, day, sd, mean, n FROM dayv WHERE n >= threshold AND sd IS NOT NULL QUALIFY rank <= 3", ["sd", "mean"], ["rank", "day", "n"], O.days("m5"))
    out["dashboard_days"] = _on("m5", P.dashboard_days), O.final("m5", "SELECT *, n < threshold AS excluded, overall - 20 AS low, overall + 20 AS high FROM (SELECT *, avg(CASE WHEN n >= threshold THEN mean END) OVER (PARTITION BY series_id) AS overall FROM dayv)", ["mean", "sd", "overall", "low", "high"], ["day", "n", "excluded"], O.days("m5"))
    out["daily_trend"] = _on("m5", P.daily_trend), O.final("m5", "SELECT series_id, regr_slope(mean, x) AS slope, regr_intercept(mean, x) AS intercept, count(*) AS days FROM (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS DOUBLE) AS x FROM dayv WHERE n >= threshold) GROUP BY 1 HAVING count(*) > 7", ["slope", "intercept"], ["days"], O.days("m5"))
    for pregnancy in (False, True):
        bars = [(c, k, *b) for c in (["pregnancy"] if pregnancy else ["standard", "strict"]) for k, b in enumerate(P.BARS[c])]
        rows = " UNION ALL ".join(f"SELECT series_id, '{c}' AS chart, {k} AS position, '{name}' AS name, '{label}' AS label, {metric} AS value FROM w" for c, k, name, label, metric in bars)
        used = sorted({m for *_, m in bars})
        out["time_in_range_bars" + "_pregnancy" * pregnancy] = _on("raw", P.time_in_range_bars, pregnancy), O.final("raw", f"SELECT *, coalesce(sum(value) OVER (PARTITION BY series_id, chart ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS base FROM ({rows})", ["value", "base"], ["chart", "position", "name", "label"], f"w AS ({O.agg('raw', used)})")
    out["m_value_curve"] = lambda spark, sf_dir: rounded(P.m_value_curve(spark)), f"SELECT round(g, {O.DIGITS}) AS glucose, round(m, {O.DIGITS}) AS m_value, CASE WHEN m < 18 THEN '<18' WHEN m < 30 THEN '<30' ELSE '>=30' END AS band FROM (SELECT g, pow(abs(1e1 * log10(g / 1.2e2)), 3) AS m FROM (SELECT 4e1 + i * (4.6e2 / 999) AS g FROM range(1000) t(i)))"
    return out


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _entries().items() if s}

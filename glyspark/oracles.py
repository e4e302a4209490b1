"""DuckDB SQL for the registered queries, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

#: Places that both sides round doubles to.
DIGITS = 6

RAW = "raw AS (SELECT CAST(user_id AS VARCHAR) AS series_id, ts AS time, CAST(floor(40 + value) AS INTEGER) AS glucose FROM events)"


def _grid(minutes: int) -> str:
    return f"m{minutes} AS (SELECT 'all' AS series_id, time_bucket(INTERVAL {minutes} minute, ts) AS time, CAST(floor(40 + max(value)) AS INTEGER) AS glucose FROM events GROUP BY 2)"


TABLES = {"raw": RAW, "m5": _grid(5), "m30": _grid(30)}


def final(table: str, body: str, floats: list[str], others: list[str] | None = None, ctes: str = "", keys: str = "series_id") -> str:
    """WITH the table (and ctes) SELECT keys, others as they are and floats rounded, from body."""
    cols = [c for c in [keys, *(others or [])] if c] + [f'round(CAST("{f}" AS DOUBLE), {DIGITS}) AS "{f}"' for f in floats]
    return f"WITH RECURSIVE {TABLES[table]}{', ' + ctes if ctes else ''} SELECT {', '.join(cols)} FROM ({body}) AS body"


def pct(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END) * 1e2 / count(*)"


def q(p: float, x: str = "CAST(glucose AS DOUBLE)") -> str:
    return f"quantile_cont({x}, {p})"


def even(x: str) -> str:
    return f"round_even(({x}) * 1e2, 0) / 1e2"


F_ = "1.509e0 * (pow(ln(CAST(glucose AS DOUBLE)), 1.084e0) - 5.381e0)"
LOW = f"CASE WHEN {F_} < 0 THEN 1e1 * pow({F_}, 2) ELSE 0e0 END"
HIGH = f"CASE WHEN {F_} > 0 THEN 1e1 * pow({F_}, 2) ELSE 0e0 END"
GRADE = "CASE WHEN glucose BETWEEN 37 AND 630 THEN 425e0 * pow(log10(log10(glucose / 18e0)) + 0.16e0, 2) ELSE 5e1 END"
METRICS = {
    "n": "count(*)",
    "mean": "avg(glucose)",
    "median": q(0.5),
    "sd": "stddev_samp(glucose)",
    "cv": "stddev_samp(glucose) / avg(glucose) * 100",
    "gmi": even("3.31e0 + 0.02392e0 * avg(glucose)"),
    "skewness": "skewness(glucose)",
    "kurtosis": "kurtosis(glucose)",
    "p5": q(0.05),
    "p25": q(0.25),
    "p75": q(0.75),
    "p95": q(0.95),
    "TIR": pct("glucose BETWEEN 70 AND 180"),
    "TIR_tight": pct("glucose BETWEEN 70 AND 140"),
    "TIR_pregnancy": pct("glucose BETWEEN 63 AND 140"),
    "TAR250": pct("glucose > 250"),
    "TAR180": pct("glucose BETWEEN 180 AND 250"),
    "TAR140": pct("glucose BETWEEN 140 AND 250"),
    "TBR70": pct("glucose BETWEEN 55 AND 70"),
    "TBR63": pct("glucose < 63"),
    "TBR55": pct("glucose < 55"),
    "j_index": "0.001e0 * pow(avg(glucose) + stddev_samp(glucose), 2)",
    "m_value": even("avg(pow(abs(1e1 * log10(glucose / 9e1)), 3))"),
    "lbgi": f"avg({LOW})",
    "hbgi": f"avg({HIGH})",
    "grade_score": f"avg({GRADE})",
}


def agg(table: str, metrics, by: str = "series_id") -> str:
    return f"SELECT {by}, {', '.join(f'{METRICS[m]} AS {chr(34)}{m}{chr(34)}' for m in metrics)} FROM {table} GROUP BY {by}"


def gaps(table: str, keys: str = "series_id") -> str:
    return f"gaps AS (SELECT *, epoch_us(time) AS t, epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY {keys} ORDER BY time) AS gap, lag(time) OVER (PARTITION BY {keys} ORDER BY time) AS before FROM {table})"


def typical(keys: str = "series_id") -> str:
    return f"typ AS (SELECT {keys}, coalesce(quantile_cont(CASE WHEN gap > 0 THEN CAST(gap AS DOUBLE) END, 0.5) / 6e7, 5e0) AS interval, count(*) AS readings, min(t) AS lo, max(t) AS hi, min(time) AS first_time, max(time) AS last_time FROM gaps GROUP BY {keys})"


EXPECTED = "CAST(floor((hi - lo) / 6e7 / interval) AS BIGINT)"
COMPLETE = f"CASE WHEN {EXPECTED} > 0 THEN readings * 1e0 / {EXPECTED} * 100 ELSE 0e0 END"


def with_data(table: str, metrics, keys: str = "series_id", source: str | None = None) -> tuple[str, str]:
    """(ctes, body) of metrics beside data_percent."""
    src = source or table
    ctes = f"{gaps(src, keys)}, {typical(keys)}, agg AS ({agg(src, metrics, keys)})"
    return ctes, f"SELECT agg.*, CAST(floor({COMPLETE}) AS INTEGER) AS data_percent FROM agg JOIN typ USING ({keys})"


STANDARD = ["TIR", "TIR_tight", "TBR70", "TBR55", "TAR250", "TAR180", "TAR140", "gmi", "cv", "mean", "median", "p5", "p25", "p75", "p95", "sd", "skewness", "kurtosis"]
PREGNANCY = ["TIR_pregnancy", "TBR63", "TAR140", "TAR250", "gmi", "cv", "mean", "median", "p5", "p25", "p75", "p95", "sd", "skewness", "kurtosis"]
DAY = "CAST(time AS DATE)"
MINUTE = "CAST(hour(time) * 60 + minute(time) AS INTEGER)"


def period(frequency: str) -> str:
    return {"D": DAY, "M": f"CAST(date_trunc('month', {DAY}) AS DATE)", "W": f"CAST(date_trunc('week', {DAY} - 1) AS DATE) + 1", "W-ISO": f"CAST(date_trunc('week', {DAY}) AS DATE)"}[frequency]


def segment(start: int, end: int) -> str:
    s = "(hour(time) * 3600 + minute(time) * 60 + second(time))"
    return f"({s} >= {start * 3600} AND {s} < {end * 3600})"


SEGMENTS = {"noche": (0, 8), "dia": (8, 16), "tarde": (16, 24)}


def days(table: str, where: str = "TRUE") -> str:
    return f"days AS (SELECT series_id, {DAY} AS day, stddev_samp(glucose) AS sd, avg(glucose) AS mean, count(*) AS n FROM {table} WHERE {where} GROUP BY 1, 2), dayv AS (SELECT *, quantile_cont(CAST(n AS DOUBLE), 0.5) OVER (PARTITION BY series_id) * 0.5e0 AS threshold FROM days)"


def points(table: str, width: int = 1) -> str:
    m = MINUTE if width == 1 else f"CAST({MINUTE} // {width} * {width} AS INTEGER)"
    return f"cells AS (SELECT series_id, {DAY} AS day, {m} AS minute, avg(glucose) AS mean, count(*) AS n FROM {table} GROUP BY 1, 2, 3), pts AS (SELECT series_id, minute, avg(mean) AS mean, stddev_samp(mean) AS sd, count(*) AS n_days FROM cells GROUP BY 1, 2), ptv AS (SELECT *, quantile_cont(CAST(n_days AS DOUBLE), 0.5) OVER (PARTITION BY series_id) * 0.5e0 AS threshold FROM pts)"


def between_timepoints(table: str, width: int = 1) -> str:
    body = "SELECT series_id, stddev_samp(CASE WHEN n_days >= threshold THEN mean END) AS sd, avg(CASE WHEN n_days >= threshold THEN mean END) AS mean, CAST(sum(CASE WHEN n_days >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS valid_timepoints, count(*) AS total_timepoints, quantile_cont(CAST(n_days AS DOUBLE), 0.5) AS median_count, min(n_days) AS min_count, max(n_days) AS max_count FROM ptv GROUP BY 1"
    return final(table, body, ["sd", "mean", "median_count"], ["valid_timepoints", "total_timepoints", "min_count", "max_count"], points(table, width))


def same_timepoint(table: str, width: int = 1) -> str:
    body = "SELECT series_id, sum(coalesce(sd, 0e0) * n_days) / sum(n_days) AS sd, avg(mean) AS mean, any_value(threshold) AS threshold, count(*) AS total_timepoints FROM ptv WHERE n_days >= threshold GROUP BY 1"
    return final(table, body, ["sd", "mean", "threshold"], ["total_timepoints"], points(table, width))


def within_series(table: str, hours: float) -> str:
    us = int(hours * 3_600_000_000)
    ctes = f"rows_ AS (SELECT series_id, epoch_us(time) AS t, glucose, row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS rn, greatest(1, count(*) OVER (PARTITION BY series_id) // 1000) AS step FROM {table}), win AS (SELECT a.series_id, a.t, stddev_samp(b.glucose) AS sd, avg(b.glucose) AS mean, count(*) AS n FROM rows_ a JOIN rows_ b ON a.series_id = b.series_id AND b.t >= a.t AND b.t < a.t + {us} WHERE a.rn % a.step = 0 GROUP BY 1, 2)"
    return final(table, "SELECT series_id, avg(sd) AS sd, avg(mean) AS mean, count(*) AS windows_analyzed FROM win WHERE n > 2 GROUP BY 1", ["sd", "mean"], ["windows_analyzed"], ctes)


ADJUSTED = f"adj AS (SELECT series_id, {MINUTE} AS minute, glucose - avg(glucose) OVER (PARTITION BY series_id, {DAY}) + avg(glucose) OVER (PARTITION BY series_id) AS a FROM TABLE_), adjp AS (SELECT series_id, minute, stddev_samp(a) AS sd, avg(a) AS mean FROM adj GROUP BY 1, 2)"
INTERACTION = f"inter AS (SELECT series_id, glucose, glucose - avg(glucose) OVER (PARTITION BY series_id, {DAY}) - avg(glucose) OVER (PARTITION BY series_id, {MINUTE}) + avg(glucose) OVER (PARTITION BY series_id) AS x FROM TABLE_)"


def _window_cte(table: str, name: str, hours: int) -> str:
    us = hours * 3_600_000_000
    return f"{name} AS (SELECT avg(sd) AS sd, avg(mean) AS mean FROM (SELECT a.t, stddev_samp(b.glucose) AS sd, avg(b.glucose) AS mean, count(*) AS n FROM rows_ a JOIN rows_ b ON b.t >= a.t AND b.t < a.t + {us} WHERE a.rn % a.step = 0 GROUP BY 1) WHERE n > 2)"


def all_sd(table: str, cv: bool) -> str:
    """For a table of one series."""
    ctes = ", ".join(
        [
            days(table),
            points(table),
            ADJUSTED.replace("TABLE_", table),
            INTERACTION.replace("TABLE_", table),
            f"rows_ AS (SELECT epoch_us(time) AS t, glucose, row_number() OVER (ORDER BY time) - 1 AS rn, greatest(1, count(*) OVER () // 1000) AS step FROM {table})",
            *(_window_cte(table, f"w{h}", h) for h in (1, 6, 24)),
        ]
    )
    parts = {
        "SDT": f"(SELECT stddev_samp(glucose) AS sd, avg(glucose) AS mean FROM {table})",
        "SDw": "(SELECT avg(sd) AS sd, avg(mean) AS mean FROM dayv WHERE n >= threshold)",
        "SDhhmm": "(SELECT stddev_samp(mean) AS sd, avg(mean) AS mean FROM ptv WHERE n_days >= threshold)",
        **{k: f"(SELECT stddev_samp(glucose) AS sd, avg(glucose) AS mean FROM {table} WHERE {segment(*s)})" for k, s in SEGMENTS.items()},
        **{f"SDws_{h}h": f"(SELECT sd, mean FROM w{h})" for h in (1, 6, 24)},
        "SDdm": "(SELECT stddev_samp(mean) AS sd, avg(mean) AS mean FROM dayv WHERE n >= threshold)",
        "SDbhhmm": "(SELECT sum(coalesce(sd, 0e0) * n_days) / sum(n_days) AS sd, avg(mean) AS mean FROM ptv WHERE n_days >= threshold)",
        "SDbhhmm_dm": "(SELECT avg(sd) AS sd, avg(mean) AS mean FROM adjp)",
        "SDI": "(SELECT stddev_samp(x) AS sd, avg(glucose) AS mean FROM inter)",
    }
    if cv:
        cols = {(k.replace("SD", "CV", 1) if k.startswith("SD") else f"CV{k}"): f"(SELECT sd / mean * 100 FROM {p})" for k, p in parts.items()}
    else:
        cols = {k: f"(SELECT sd FROM {p})" for k, p in parts.items()}
    body = "SELECT 'all' AS series_id, " + ", ".join(f"{v} AS {k}" for k, v in cols.items())
    return final(table, body, list(cols), [], ctes)


def ratios(table: str) -> str:
    ctes = f"{days(table)}, {points(table)}"
    parts = ["pow((SELECT stddev_samp(mean) FROM ptv WHERE n_days >= threshold) / (SELECT avg(sd) FROM dayv WHERE n >= threshold), 2) AS ratio"]
    for k, s in SEGMENTS.items():
        a = f"(SELECT stddev_samp(m) FROM (SELECT avg(glucose) AS m FROM {table} WHERE {segment(*s)} GROUP BY {MINUTE}))"
        b = f"(SELECT avg(d) FROM (SELECT stddev_samp(glucose) AS d FROM {table} WHERE {segment(*s)} GROUP BY {DAY}))"
        parts.append(f"pow({a} / {b}, 2) AS ratio_{k}")
    return final(table, f"SELECT 'all' AS series_id, {', '.join(parts)}", ["ratio", *(f"ratio_{k}" for k in SEGMENTS)], [], ctes)


CORR = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0e0)"


def day_correlation(table: str) -> str:
    c = CORR.format(x="a.mean", y="b.mean")
    body = f"SELECT series_id, avg(sign(r) * r * r) AS avg_correlation_between_days, count(*) AS pairs FROM (SELECT a.series_id, a.day, b.day, {c} AS r FROM cells a JOIN cells b ON a.series_id = b.series_id AND a.minute = b.minute AND a.day < b.day GROUP BY ALL) GROUP BY 1"
    return final(table, body, ["avg_correlation_between_days"], ["pairs"], points(table))


def mean_correlation(table: str) -> str:
    prof = "prof AS (SELECT series_id, day, mean AS y, avg(mean) OVER (PARTITION BY series_id, minute) AS x FROM cells)"
    body = f"SELECT series_id, avg(sign(r) * r * r) AS avg_correlation_with_mean FROM (SELECT series_id, day, {CORR.format(x='x', y='y')} AS r FROM prof GROUP BY 1, 2) GROUP BY 1"
    return final(table, body, ["avg_correlation_with_mean"], [], f"{points(table)}, {prof}")


def regression(table: str, leave_out: bool) -> str:
    rms, slope = ("bootstrap_rms", "avg_bootstrap_slope") if leave_out else ("rms_error", "avg_slope")
    x = "CASE WHEN count(*) OVER w > 1 THEN (sum(mean) OVER w - mean) / (count(*) OVER w - 1) END" if leave_out else "avg(mean) OVER w"
    prof = f"prof AS (SELECT * FROM (SELECT series_id, day, mean AS y, {x} AS x FROM cells WINDOW w AS (PARTITION BY series_id, minute)) WHERE x IS NOT NULL), lines AS (SELECT series_id, day, sum(x * y) / sum(x * x) AS slope, count(*) AS n FROM prof GROUP BY 1, 2 HAVING count(*) > 1)"
    body = f"SELECT p.series_id, sqrt(avg(pow(y - slope * x, 2))) AS {rms}, (SELECT avg(slope) FROM lines l WHERE l.series_id = p.series_id) AS {slope} FROM prof p JOIN lines USING (series_id, day) GROUP BY 1"
    return final(table, body, [rms, slope], [], f"{points(table)}, {prof}")


VARIANCE = f"""
v0 AS (SELECT (SELECT var_samp(glucose) FROM TABLE_) AS vt, (SELECT var_samp(m) FROM (SELECT avg(glucose) AS m FROM TABLE_ GROUP BY {DAY})) AS vd,
  (SELECT var_samp(m) FROM (SELECT avg(glucose) AS m FROM TABLE_ GROUP BY {MINUTE})) AS vp, (SELECT var_samp(m) FROM (SELECT avg(glucose) AS m FROM TABLE_ GROUP BY {DAY}, {MINUTE})) AS vc),
v1 AS (SELECT *, vt - vd AS vi, vc - vp - vd AS x0, vt - (vd + vp + (vc - vp - vd)) AS r0 FROM v0),
v2 AS (SELECT *, CASE WHEN r0 < 0 AND abs(r0) >= 0.01e0 * vt THEN x0 - abs(r0) ELSE x0 END AS vx, CASE WHEN r0 < 1e-9 * vt THEN 0e0 ELSE r0 END AS vr FROM v1),
v3 AS (SELECT *, CASE WHEN vi > 0 THEN vp / vi * 100 ELSE 0e0 END AS pp, CASE WHEN vi > 0 THEN vx / vi * 100 ELSE 0e0 END AS px, CASE WHEN vi > 0 THEN vr / vi * 100 ELSE 0e0 END AS pr FROM v2)"""


def variance(table: str) -> str:
    kinds = {"total": "vt", "interdia": "vd", "intradia": "vi", "patron": "vp", "interaccion": "vx", "residual": "vr"}
    whole = "(pp + px + pr)"
    cols = [f"{c} AS varianza_{k}" for k, c in kinds.items()]
    cols += ["vd / vt * 100 AS porcentaje_interdia", "vi / vt * 100 AS porcentaje_intradia"]
    cols += [f"CASE WHEN {whole} > 0 THEN {c} / {whole} * 100 ELSE {c} END AS porcentaje_{k}" for k, c in {"patron": "pp", "interaccion": "px", "residual": "pr"}.items()]
    cols += [f"CASE WHEN {c} > 0 THEN sqrt({c}) ELSE 0e0 END AS sd_{k}" for k, c in kinds.items()]
    return final(table, f"SELECT 'all' AS series_id, {', '.join(cols)} FROM v3", [c.split(" AS ")[1] for c in cols], [], VARIANCE.replace("TABLE_", table))


def variance_segments(table: str) -> str:
    ctes = f"seg AS (SELECT series_id, CAST(CASE WHEN hour(time) <= 8 THEN 0 WHEN hour(time) <= 16 THEN 1 ELSE 2 END AS INTEGER) AS segment, var_samp(glucose) AS varianza, avg(glucose) AS media, count(*) AS conteo FROM {table} GROUP BY 1, 2), s2 AS (SELECT *, sum(conteo) OVER w AS total, sum(media * conteo) OVER w / sum(conteo) OVER w AS grand, count(*) OVER w AS k, sum(varianza * conteo) OVER w AS whole FROM seg WINDOW w AS (PARTITION BY series_id))"
    body = "SELECT series_id, segment, varianza, CASE WHEN varianza > 0 THEN sqrt(varianza) ELSE 0e0 END AS sd, media, conteo, CASE WHEN whole > 0 THEN varianza * conteo / whole * 100 ELSE 0e0 END AS porcentaje, CASE WHEN k > 1 THEN sum(conteo * pow(media - grand, 2)) OVER (PARTITION BY series_id) / total ELSE 0e0 END AS varianza_entre_segmentos FROM s2"
    return final(table, body, ["varianza", "sd", "media", "porcentaje", "varianza_entre_segmentos"], ["segment", "conteo"], ctes)


MAGE = "ext AS (SELECT series_id, time, glucose FROM (SELECT *, lag(glucose) OVER w AS a, lead(glucose) OVER w AS b FROM TABLE_ WINDOW w AS (PARTITION BY series_id ORDER BY time)) WHERE (a < glucose AND glucose > b) OR (a > glucose AND glucose < b)), nth AS (SELECT series_id, glucose, row_number() OVER w - 1 AS k, lead(glucose) OVER w AS next FROM ext WINDOW w AS (PARTITION BY series_id ORDER BY time)), dev AS (SELECT series_id, stddev_samp(glucose) AS sd FROM TABLE_ GROUP BY 1), amp AS (SELECT dev.series_id, sd, abs(next - glucose) AS amplitude FROM dev LEFT JOIN (SELECT * FROM nth WHERE k % 2 = 0 AND next IS NOT NULL) n ON n.series_id = dev.series_id)"


def mage(table: str) -> str:
    body = "SELECT series_id, coalesce(avg(CASE WHEN amplitude > sd THEN amplitude END), 0e0) AS mage, count(CASE WHEN amplitude > sd THEN 1 END) AS excursions, any_value(sd) AS sd FROM amp GROUP BY 1"
    return final(table, body, ["mage", "sd"], ["excursions"], MAGE.replace("TABLE_", table))


def modd(table: str, n: int = 1) -> str:
    ctes = f"prs AS (SELECT series_id, glucose, {DAY} AS day, lag(glucose, {n}) OVER w AS g0, lag({DAY}, {n}) OVER w AS d0 FROM {table} WINDOW w AS (PARTITION BY series_id, strftime(time, '%H:%M:%S') ORDER BY {DAY}, glucose)), ok AS (SELECT *, d0 IS NOT NULL AND day - d0 = {n} AS fits FROM prs)"
    corr = CORR.format(x="CASE WHEN fits THEN g0 END", y="CASE WHEN fits THEN glucose END")
    body = f"SELECT series_id, avg(CASE WHEN fits THEN abs(glucose - g0) END) AS value, count(CASE WHEN fits THEN 1 END) AS n_observations, stddev_pop(CASE WHEN fits THEN abs(glucose - g0) END) AS std, {corr} AS correlation FROM ok GROUP BY 1"
    return final(table, body, ["value", "std", "correlation"], ["n_observations"], ctes)


def conga_ctes(table: str, hours: str) -> str:
    return f"{gaps(table)}, {typical()}, num AS (SELECT series_id, t, glucose, row_number() OVER (PARTITION BY series_id ORDER BY time) AS rn FROM gaps), hrs AS (SELECT CAST(unnest({hours}) AS DOUBLE) AS hours), steps AS (SELECT series_id, hours, interval, CAST(floor(hours * 60 / interval) AS BIGINT) AS step FROM typ, hrs), met AS (SELECT a.series_id, s.hours, s.interval, b.t IS NOT NULL AS pair, CASE WHEN (a.t - b.t) / 6e7 BETWEEN s.hours * 60 - 2 * s.interval AND s.hours * 60 + 2 * s.interval THEN a.glucose - b.glucose END AS d FROM num a JOIN steps s ON s.series_id = a.series_id AND s.step > 0 LEFT JOIN num b ON b.series_id = a.series_id AND b.rn = a.rn - s.step)"


def conga(table: str, hours: str) -> str:
    body = "SELECT series_id, hours, stddev_samp(d) AS value, count(d) AS n_observations, avg(d) AS mean_difference, avg(abs(d)) AS abs_mean_difference, any_value(2 * interval) AS max_gap_minutes, CAST(sum(CASE WHEN pair THEN 1 ELSE 0 END) AS BIGINT) AS total_comparisons, count(d) AS valid_comparisons, CAST(sum(CASE WHEN pair THEN 1 ELSE 0 END) - count(d) AS BIGINT) AS invalid_comparisons, count(d) * 1e2 / nullif(sum(CASE WHEN pair THEN 1 ELSE 0 END), 0) AS percent_valid FROM met GROUP BY 1, 2"
    return final(table, body, ["hours", "value", "mean_difference", "abs_mean_difference", "max_gap_minutes", "percent_valid"], ["n_observations", "total_comparisons", "valid_comparisons", "invalid_comparisons"], conga_ctes(table, hours))


LABILITY = "chg AS (SELECT series_id, CAST(week(time) AS INTEGER) AS week, pow(lead(glucose) OVER (PARTITION BY series_id, week(time) ORDER BY time) - glucose, 2) AS c FROM TABLE_), wk AS (SELECT series_id, week, coalesce(sum(c), 0e0) AS lability FROM chg GROUP BY 1, 2)"


def lability(table: str) -> str:
    body = "SELECT series_id, avg(lability) AS mean_li, avg(lability) / 324e0 AS mean_li_mmol, stddev_pop(lability) AS std_li, count(*) AS n_weeks, sqrt(avg(lability) / 168e0) AS cambio_tipico_por_hora FROM wk GROUP BY 1"
    return final(table, body, ["mean_li", "mean_li_mmol", "std_li", "cambio_tipico_por_hora"], ["n_weeks"], LABILITY.replace("TABLE_", table))


def grade(table: str) -> str:
    ctes = f"gr AS (SELECT series_id, glucose, {GRADE} AS s FROM {table})"
    share = lambda c: f"sum(CASE WHEN {c} THEN s ELSE 0e0 END) / sum(s) * 100"
    body = f"SELECT series_id, avg(s) AS grade_score, {share('glucose < 70')} AS hypo_percent, {share('glucose BETWEEN 70 AND 140')} AS eu_percent, {share('glucose > 140')} AS hyper_percent FROM gr GROUP BY 1"
    return final(table, body, ["grade_score", "hypo_percent", "eu_percent", "hyper_percent"], [], ctes)


def gri_body(table: str, pregnancy: bool = False) -> tuple[str, str]:
    low, high = (63, 140) if pregnancy else (70, 180)
    ctes = f"gp AS (SELECT series_id, {pct('glucose < 54')} AS a, {pct(f'glucose BETWEEN 54 AND {low}')} AS b, {pct('glucose > 250')} AS c, {pct(f'glucose BETWEEN {high} AND 250')} AS d FROM {table} GROUP BY 1)"
    body = f"SELECT series_id, {even('3e0 * a + 2.4e0 * b + 1.6e0 * c + 0.8e0 * d')} AS GRI, {even('a')} AS VLow, {even('b')} AS Low, {even('c')} AS VHigh, {even('d')} AS High, {even('a + 0.8e0 * b')} AS hypo_component, {even('c + 0.5e0 * d')} AS hyper_component, {even('1e2 - (a + b + c + d)')} AS TIR FROM gp"
    return ctes, body


GRI = ["GRI", "VLow", "Low", "VHigh", "High", "hypo_component", "hyper_component", "TIR"]


def gri(table: str, pregnancy: bool = False) -> str:
    ctes, body = gri_body(table, pregnancy)
    return final(table, body, GRI, [], ctes)


def gri_grid(table: str) -> str:
    ctes, body = gri_body(table)
    s = "(3e0 * hypo + 1.6e0 * hyper)"
    outer = f"SELECT *, CASE WHEN {s} <= 20 THEN 'A' WHEN {s} <= 40 THEN 'B' WHEN {s} <= 60 THEN 'C' WHEN {s} <= 80 THEN 'D' ELSE 'E' END AS zone FROM (SELECT series_id, VLow + Low AS hypo, VHigh + High AS hyper, GRI FROM ({body}))"
    return final(table, outer, ["hypo", "hyper", "GRI"], ["zone"], ctes)


def adrr(table: str) -> str:
    ctes = f"dr AS (SELECT series_id, {DAY} AS day, max({LOW}) AS low, max({HIGH}) AS high FROM {table} GROUP BY 1, 2)"
    body = "SELECT series_id, avg(low + high) AS adrr, avg(low) AS hypo_risk, avg(high) AS hyper_risk, CASE WHEN avg(low + high) < 20 THEN 'Bajo' WHEN avg(low + high) < 40 THEN 'Moderado' ELSE 'Alto' END AS risk_category FROM dr GROUP BY 1"
    return final(table, body, ["adrr", "hypo_risk", "hyper_risk"], ["risk_category"], ctes)


def periods_cte(table: str, frequency: str) -> str:
    return f"{gaps(table)}, {typical()}, per AS (SELECT series_id, {period(frequency)} AS period, min(time) AS start, max(time) AS \"end\", count(*) AS n_points FROM {table} GROUP BY 1, 2), pc AS (SELECT per.*, (epoch_us(\"end\") - epoch_us(start)) / 3.6e9 AS duration_hours, interval FROM per JOIN typ USING (series_id)), pf AS (SELECT *, CASE WHEN duration_hours > 0 THEN n_points / (duration_hours * 60 / interval) * 100 ELSE 0e0 END AS completeness FROM pc)"


def periods(table: str, frequency: str) -> str:
    return final(table, "SELECT * FROM pf", ["duration_hours", "completeness"], ["period", "start", '"end"', "n_points"], periods_cte(table, frequency))


def period_metrics(table: str, metrics, frequency: str, least: float) -> str:
    body = f"SELECT pf.*, {', '.join(f'm.{x}' for x in metrics)} FROM pf JOIN ({agg(f'(SELECT *, {period(frequency)} AS period FROM {table})', metrics, 'series_id, period')}) m USING (series_id, period) WHERE completeness >= {least}"
    return final(table, body, ["duration_hours", "completeness", *metrics], ["period", "start", '"end"', "n_points"], periods_cte(table, frequency))


def trimester(conception: str, first: str, second: str, delivery: str) -> str:
    return f"CASE WHEN time >= TIMESTAMP '{conception}' AND time < TIMESTAMP '{first}' THEN 'primer_trimestre' WHEN time >= TIMESTAMP '{first}' AND time < TIMESTAMP '{second}' THEN 'segundo_trimestre' WHEN time >= TIMESTAMP '{second}' AND time < TIMESTAMP '{delivery}' THEN 'tercer_trimestre' END"


def rolling(column: str, part: str, order: str, width: int) -> str:
    return f"avg({column}) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {width // 2} PRECEDING AND {(width - 1) // 2} FOLLOWING) AS {column}_smooth"


DECIMAL = "round(hour(time) + minute(time) / 6e1, 2)"
WEEKDAY = "CASE isodow(time) WHEN 1 THEN 'Lunes' WHEN 2 THEN 'Martes' WHEN 3 THEN 'Miércoles' WHEN 4 THEN 'Jueves' WHEN 5 THEN 'Viernes' WHEN 6 THEN 'Sábado' ELSE 'Domingo' END"


def agp(table: str, width: int = 15) -> str:
    names = [f"p{p}" for p in (5, 25, 50, 75, 95)]
    ctes = f"tp AS (SELECT series_id, {DECIMAL} AS time_decimal, {', '.join(f'{q(p / 100)} AS p{p}' for p in (5, 25, 50, 75, 95))} FROM {table} GROUP BY 1, 2)"
    body = f"SELECT *, {', '.join(rolling(n, 'series_id', 'time_decimal', width) for n in names)} FROM tp"
    return final(table, body, ["time_decimal", *names, *(f"{n}_smooth" for n in names)], [], ctes)


def week_agp(table: str, width: int = 15) -> str:
    names = [f"p{p}" for p in (25, 50, 75)]
    ctes = f"tp AS (SELECT series_id, {WEEKDAY} AS weekday, {DECIMAL} AS time_decimal, {', '.join(f'{q(p / 100)} AS p{p}' for p in (25, 50, 75))} FROM {table} GROUP BY 1, 2, 3), nd AS (SELECT series_id, {WEEKDAY} AS weekday, count(DISTINCT {DAY}) AS days FROM {table} GROUP BY 1, 2)"
    body = f"SELECT *, {', '.join(rolling(n, 'series_id, weekday', 'time_decimal', width) for n in names)} FROM tp JOIN nd USING (series_id, weekday)"
    return final(table, body, ["time_decimal", *names, *(f"{n}_smooth" for n in names)], ["weekday", "days"], ctes)


def joined(*queries: str) -> str:
    """Queries of one row per series side by side."""
    return "SELECT * FROM " + " JOIN ".join(f"({q_}) q{k}" + (" USING (series_id)" if k else "") for k, q_ in enumerate(queries))


def _numbered(table: str) -> str:
    return f"num AS (SELECT series_id, time, CAST(glucose AS DOUBLE) AS g, row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n, stddev_samp(glucose) OVER (PARTITION BY series_id) AS sd FROM {table})"


def _points_2(table: str) -> str:
    return f"""{_numbered(table)},
ext AS (SELECT * EXCLUDE (a, b) FROM (SELECT *, lag(g) OVER w AS a, lead(g) OVER w AS b FROM num WINDOW w AS (PARTITION BY series_id ORDER BY idx)) WHERE (a < g AND g > b) OR (a > g AND g < b)),
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS run FROM ext),
odd AS (SELECT * EXCLUDE (run) FROM runs QUALIFY row_number() OVER (PARTITION BY series_id, run ORDER BY idx) % 2 = 1),
lst AS (SELECT * FROM odd UNION ALL SELECT * FROM num WHERE idx = 0 OR idx = n - 1),
nb AS (SELECT *, lag(g) OVER w AS a, lead(g) OVER w AS b FROM lst WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
ok AS (SELECT *, coalesce(((a < g AND g > b) OR (a > g AND g < b)) AND (abs(g - a) >= sd OR abs(g - b) >= sd), FALSE) AS keep FROM nb),
pts AS (SELECT series_id, idx, g, time, sd FROM (SELECT *, bool_or(keep) OVER (PARTITION BY series_id) AS some_kept FROM ok) WHERE keep OR (some_kept AND (idx = 0 OR idx = n - 1)))"""


def _potential(table: str) -> str:
    taps = " + ".join(f"{w / 46!r} * " + ("g" if k == 4 else f"lag(g, {4 - k}) OVER w" if k < 4 else f"lead(g, {k - 4}) OVER w") for k, w in enumerate((1, 2, 4, 8, 16, 8, 4, 2, 1)))
    return f"""{_numbered(table)},
smo AS (SELECT *, CAST(trunc(CASE WHEN idx >= n - 4 OR idx < 4 THEN avg(g) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) ELSE {taps} END) AS INTEGER) AS s FROM num WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
trn AS (SELECT *, coalesce(sign(lead(s) OVER w - s) <> sign(s - lag(s) OVER w), FALSE) AS turn FROM smo WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
str AS (SELECT *, sum(CAST(turn AS INTEGER)) OVER (PARTITION BY series_id ORDER BY idx) AS stretch FROM trn),
ends AS (SELECT series_id, stretch, lead(arg_min(s, idx)) OVER (PARTITION BY series_id ORDER BY stretch) AS s1, arg_min(s, idx) AS s0 FROM str WHERE stretch > 0 GROUP BY 1, 2),
pot AS (SELECT str.*, s0 < s1 AS peak FROM str JOIN ends USING (series_id, stretch) WHERE s1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, stretch ORDER BY CASE WHEN s0 < s1 THEN -g ELSE g END, idx) = 1)"""


def _points_3(table: str) -> str:
    """For series whose filter leaves two points at least."""
    return f"""{_potential(table)},
nb AS (SELECT *, lag(g) OVER w AS g0, lead(g) OVER w AS g1, lag(peak) OVER w AS k0, lead(peak) OVER w AS k1 FROM pot WINDOW w AS (PARTITION BY series_id ORDER BY stretch)),
pts AS (SELECT DISTINCT series_id, idx, g, time, sd FROM nb WHERE k0 IS NULL OR k1 IS NULL OR NOT (k0 = peak OR (k0 <> peak AND k1 <> peak AND CASE WHEN peak THEN g - g0 < sd / 2 OR g - g1 < sd / 2 ELSE g0 - g < sd / 2 OR g1 - g < sd / 2 END)))"""


def _points_1(table: str) -> str:
    """Passes over the list of points of a series, until one drops nothing."""
    before, after = "p[i - 1].v", "p[i + 1].v"

    def kept(points: str, drop: str) -> str:
        return f"list_filter({points}, lambda x, i: i = 1 OR i = len({points}) OR NOT ({drop.replace('p[', points + '[')}))"

    minor = f"abs(x.v - {before}) < thr AND abs(x.v - {after}) < thr AND NOT (x.v > greatest({before}, {after}) OR x.v < least({before}, {after}))"
    straight = f"(x.v - {before}) * ({after} - x.v) > 0"
    one_sided = f"(abs(x.v - {before}) >= thr) <> (abs(x.v - {after}) >= thr)"
    return f"""{_potential(table)},
lst AS (SELECT series_id, any_value(sd) AS thr, list(struct_pack(i := idx, v := g) ORDER BY stretch) AS p FROM pot GROUP BY 1),
fst AS (SELECT series_id, min(CASE WHEN idx = 0 THEN g END) AS g0, min(CASE WHEN idx = n - 1 THEN g END) AS g1, max(n) - 1 AS top FROM num GROUP BY 1),
beg AS (SELECT series_id, thr, list_concat(list_concat(CASE WHEN p[1].i > 0 AND g0 <> p[1].v THEN [struct_pack(i := CAST(0 AS BIGINT), v := g0)] ELSE [] END, p), CASE WHEN p[-1].i < top AND g1 <> p[-1].v THEN [struct_pack(i := top, v := g1)] ELSE [] END) AS p FROM lst JOIN fst USING (series_id)),
rec AS (SELECT series_id, thr, p, TRUE AS changed FROM beg
  UNION ALL
  SELECT series_id, thr, {kept("r", straight)}, len(r) < len(p) FROM (SELECT *, {kept("p", minor)} AS r FROM rec WHERE changed)),
mid AS (SELECT series_id, thr, CASE WHEN len(p) >= 3 THEN {kept("p", one_sided)} ELSE p END AS p, len(p) >= 3 AS many FROM rec WHERE NOT changed),
lin AS (SELECT series_id, thr, CASE WHEN many THEN {kept("p", straight)} ELSE p END AS p FROM mid),
lef AS (SELECT series_id, thr, CASE WHEN len(p) >= 2 AND abs(p[1].v - p[2].v) < thr THEN p[2:] ELSE p END AS p FROM lin),
rig AS (SELECT series_id, CASE WHEN len(p) >= 2 AND abs(p[-1].v - p[-2].v) < thr THEN p[:-2] ELSE p END AS p FROM lef),
kpt AS (SELECT DISTINCT series_id, x.i AS idx FROM (SELECT series_id, unnest(p) AS x FROM rig)),
pts AS (SELECT series_id, idx, g, time, sd FROM num JOIN kpt USING (series_id, idx))"""


_POINTS = {1: _points_1, 2: _points_2, 3: _points_3}
_EXCURSIONS = "exc AS (SELECT * FROM (SELECT series_id, lag(time) OVER w AS start_time, time AS end_time, lag(g) OVER w AS start_value, g AS end_value, abs(g - lag(g) OVER w) AS magnitude, sd FROM pts WINDOW w AS (PARTITION BY series_id ORDER BY idx)) WHERE magnitude >= sd)"


def excursions(table: str, approach: int) -> str:
    ctes = f"{_POINTS[approach](table)}, {_EXCURSIONS}"
    body = "SELECT *, CASE WHEN end_value > start_value THEN 'up' ELSE 'down' END AS direction FROM exc"
    return final(table, body, ["start_value", "end_value", "magnitude"], ["start_time", "end_time", "direction"], ctes)


def excursion_chart(table: str, approach: int) -> str:
    body = f"SELECT series_id, time, glucose, pts.time IS NOT NULL AS turning, {DAY} AS day FROM {table} LEFT JOIN pts USING (series_id, time)"
    return final(table, body, ["glucose"], ["time", "turning", "day"], _POINTS[approach](table))


def mage_baghurst(table: str, approach: int) -> str:
    ctes = f"{_POINTS[approach](table)}, {_EXCURSIONS}, dev AS (SELECT series_id, stddev_samp(glucose) AS sd FROM {table} GROUP BY 1)"
    mean = lambda c: even(f"coalesce(avg(CASE WHEN {c} THEN magnitude END), 0e0)")
    body = f"SELECT dev.series_id, any_value({even('dev.sd')}) AS sd_used, any_value({even('dev.sd')}) AS threshold, {mean('end_value > start_value')} AS mage_plus, {mean('end_value <= start_value')} AS mage_minus, {mean('magnitude IS NOT NULL')} AS mage_avg, count(magnitude) AS num_excursions FROM dev LEFT JOIN exc ON exc.series_id = dev.series_id GROUP BY 1"
    return final(table, body, ["sd_used", "threshold", "mage_plus", "mage_minus", "mage_avg"], ["num_excursions"], ctes)


#: The wide row's names of the statistics, deviations and risk columns.
WIDE_BASIC = {"mean": "media", "median": "mediana", "sd": "desviacion_estandar", "cv": "cv", "gmi": "gmi", "TIR": "tir", "TIR_tight": "tir_tight", "TIR_pregnancy": "tir_pregnancy", "TAR180": "tar180", "TAR250": "tar250", "TAR140": "tar140", "TBR70": "tbr70", "TBR63": "tbr63", "TBR55": "tbr55", "skewness": "asimetria", "kurtosis": "curtosis"}
WIDE_SD = {"SDT": "sdt", "SDw": "sdw", "SDhhmm": "sd_timepoints", "noche": "sd_noche", "dia": "sd_dia", "tarde": "sd_tarde", "SDws_1h": "sd_1h", "SDws_6h": "sd_6h", "SDws_24h": "sd_24h", "SDdm": "sd_daily_mean", "SDbhhmm": "sd_same_timepoint", "SDbhhmm_dm": "sd_same_timepoint_adj", "SDI": "sd_interaction"}


def all_metrics(table: str) -> str:
    """The wide row of a table that holds the one series 'all'."""

    def named(query: str, names: dict[str, str]) -> str:
        return f"SELECT series_id, {', '.join(f'{quoted} AS {new}' for quoted, new in ((chr(34) + k + chr(34), v) for k, v in names.items()))} FROM ({query})"

    ctes, body = with_data(table, list(WIDE_BASIC))
    basic = named(final(table, body, list(WIDE_BASIC), ["data_percent"], ctes), {"data_percent": "completitud"} | WIDE_BASIC)
    hours = (1, 2, 4, 6, 24)
    c = final(table, f"SELECT 'all' AS series_id, {', '.join(f'(SELECT stddev_samp(d) FROM met WHERE hours = {h}) AS CONGA{h}' for h in hours)}", [f"CONGA{h}" for h in hours], [], conga_ctes(table, str(list(hours))))
    mage_ = named(mage_baghurst(table, 1), {"sd_used": "mage_sd", "threshold": "mage_threshold", "mage_plus": "mage_plus", "mage_minus": "mage_minus", "mage_avg": "mage_avg", "num_excursions": "mage_excursions"})
    risk = {m: METRICS[m] for m in ("lbgi", "hbgi", "j_index")} | {"m_value": even("avg(pow(abs(1e1 * log10(glucose / 9e1)), 3))"), "grade": f"avg({GRADE})"}
    r = final(table, f"SELECT series_id, {', '.join(f'{x} AS {m}' for m, x in risk.items())} FROM {table} GROUP BY 1", list(risk))
    parts = [
        basic,
        named(all_sd(table, False), WIDE_SD),
        c,
        mage_,
        named(modd(table, 1), {"value": "modd", "std": "modd_sd"}),
        r,
        named(adrr(table), {"adrr": "adrr"}),
        named(gri(table), {"GRI": "gri", "hyper_component": "gri_high", "hypo_component": "gri_low"}),
        named(gri(table, True), {"GRI": "gri_pregnancy", "hyper_component": "gri_pregnancy_high", "hypo_component": "gri_pregnancy_low"}),
    ]
    return joined(*parts)


def parts_of(table: str, parts: dict[str, str], column: str, query: Callable[[str], str]) -> str:
    """A query of one row per series on each part (name: condition) of a table, with the part's name."""
    out = []
    for k, (name, where) in enumerate(parts.items()):
        TABLES[f"{table}_{k}"] = f"{TABLES[table]}, {table}_{k} AS (SELECT * FROM {table} WHERE {where})"
        out.append(f"SELECT '{name}' AS {column}, * FROM ({query(f'{table}_{k}')})")
    return " UNION ALL ".join(out)

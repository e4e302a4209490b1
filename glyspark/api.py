"""One-series convenience classes: methods that return plain Python values.

Each call runs one Spark plan and brings its one row (or a short table) to the driver. For many series,
call the operators, which return DataFrames for all series at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import plotting
from .operators import basic as B, excursions as E, periods as PE, pregnancy as PG, profiles as P, quality as Q, risk as R, sd as S, stability as ST, summary as SU, temporal as T, variance as V
from .sources import ingest as I, sink
from .functions import expr as X

NO_DATA = "No hay datos disponibles"


def _row(df: DataFrame) -> dict:
    rows = df.limit(1).collect()
    return {k: v for k, v in rows[0].asDict(recursive=True).items() if k != "series_id"} if rows else {}


class GlucoseData:
    """A cleaned series from a path or a DataFrame."""

    def __init__(self, data_source, date_col: str = "time", glucose_col: str = "glucose", delimiter: str | None = None, header: int = 0, start_date=None, end_date=None, spark: SparkSession | None = None, **options):
        spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.data = I.read_cgm(spark, data_source, date_col, glucose_col, delimiter, header, start_date, end_date, **options).cache()

    def info(self, include_disconnections: bool = False) -> dict:
        out = _row(Q.info(self.data))
        if include_disconnections:
            out["lista_desconexiones"] = [{"inicio": f"{r.gap_start:%d/%m/%Y %H:%M}", "fin": f"{r.gap_end:%d/%m/%Y %H:%M}", "duracion": r.label} for r in Q.disconnections(self.data).orderBy("gap_start").collect()]
        return out

    def get_typical_interval(self) -> float:
        return _row(B.typical_interval(self.data))["typical_interval"]

    def to_parquet(self, file_path: str, compression: str = "snappy", sort: bool = True) -> None:
        sink.write_cgm(self.data, file_path, compression, sort)

    def append_to_parquet(self, file_path: str, compression: str = "snappy", handle_duplicates: str = "keep_new") -> int:
        return sink.append_cgm(self.data, file_path, compression, handle_duplicates)

    def __str__(self) -> str:
        return "\n".join(Q.describe(self.data))


def _metric(name: str) -> Callable[[GlucoseData], float]:
    def get(self):
        return _row(B.compute(self.data, [name])).get(name)

    get.__name__, get.__doc__ = name, f"The metric {name} of the series."
    return get


class GlucoseMetrics(GlucoseData):
    """Metrics by name."""

    mean, median, sd, cv, gmi = (_metric(m) for m in ("mean", "median", "sd", "cv", "gmi"))
    TIR, TIR_tight, TIR_pregnancy = (_metric(m) for m in ("TIR", "TIR_tight", "TIR_pregnancy"))
    TAR250, TAR180, TAR140, TBR70, TBR63, TBR55 = (_metric(m) for m in ("TAR250", "TAR180", "TAR140", "TBR70", "TBR63", "TBR55"))
    j_index, LBGI, HBGI = (_metric(m) for m in ("j_index", "lbgi", "hbgi"))

    def percentile(self, percentile: float) -> float:
        return next(iter(_row(B.percentiles(self.data, [percentile])).values()))

    def calculate_time_in_range(self, low: float, high: float) -> float:
        return _row(B.time_in_range(self.data, low, high))["time_in_range"]

    def TAR(self, threshold: float) -> float:
        return _row(B.time_above(self.data, threshold))["time_above"]

    def TBR(self, threshold: float) -> float:
        return _row(B.time_below(self.data, threshold))["time_below"]

    def data_completeness(self, interval_minutes: float | None = None) -> int:
        return int(_row(B.completeness(self.data, interval=interval_minutes))["percent"])

    def time_statistics(self) -> dict:
        return _row(B.time_statistics(self.data))

    def time_statistics_pregnancy(self) -> dict:
        return _row(B.time_statistics_pregnancy(self.data))

    def distribution_analysis(self) -> dict:
        return _row(B.distribution_analysis(self.data))

    def sd_total(self) -> dict:
        return _row(S.sd_total(self.data))

    def sd_within_day(self, min_count_threshold: float = 0.5) -> dict:
        days = S.days_with_validity(self.data, min_count=min_count_threshold).collect()
        out = _row(S.sd_within_day(self.data, min_count=min_count_threshold))
        for name, column in (("sds", "sd"), ("means", "mean"), ("counts", "n")):
            out[f"daily_{name}"] = {r.day: r[column] for r in days if r.valid}
            out[f"all_days_{name}"] = {r.day: r[column] for r in days}
        return out

    def sdw(self, min_count_threshold: float = 0.5) -> float:
        return _row(S.sd_within_day(self.data, min_count=min_count_threshold))["sd"]

    def sd_within_day_segment(self, start_time: str, duration_hours: float) -> dict:
        return _row(S.sd_within_day_segment(self.data, start_time, duration_hours)) or {"sd": 0.0, "mean": 0.0}

    def sd_between_timepoints(self, min_count_threshold: float = 0.5, filter_outliers: bool = True, agrupar_por_intervalos: bool = False, intervalo_minutos: int = 5) -> dict:
        return _row(S.sd_between_timepoints(self.data, min_count=min_count_threshold, filter_outliers=filter_outliers, bin_minutes=intervalo_minutos if agrupar_por_intervalos else 1))

    def sd_between_timepoints_segment(self, start_time: str, duration_hours: float) -> dict:
        return _row(S.sd_between_timepoints_segment(self.data, start_time, duration_hours))

    def sd_within_series(self, hours: float = 1) -> dict:
        return _row(S.sd_within_series(self.data, hours))

    def sd_daily_mean(self, min_count_threshold: float = 0.5) -> dict:
        return _row(S.sd_daily_mean(self.data, min_count=min_count_threshold))

    def sd_same_timepoint(self, min_count_threshold: float = 0.5, filter_outliers: bool = True, agrupar_por_intervalos: bool = False, intervalo_minutos: int = 5) -> dict:
        options = {"min_count": min_count_threshold, "filter_outliers": filter_outliers, "bin_minutes": intervalo_minutos if agrupar_por_intervalos else 1}
        out = _row(S.sd_same_timepoint(self.data, **options))
        points = S.same_timepoint_table(self.data, **options).withColumn("clock", X.clock(F.col("minute"))).collect()
        for name, column in (("sd_por_marca", "sd"), ("valores_por_marca", "mean"), ("conteo_por_marca", "n_days")):
            out[name] = {r.clock: r[column] for r in points}
        return out

    def sd_same_timepoint_adjusted(self) -> dict:
        return _row(S.sd_same_timepoint_adjusted(self.data))

    def sd_interaction(self) -> dict:
        return _row(S.sd_interaction(self.data))

    def sd_segment(self, start_time: str, duration_hours: float) -> dict:
        return _row(S.sd_segment(self.data, start_time, duration_hours))

    def calculate_all_sd_metrics(self) -> dict:
        return _row(S.all_sd(self.data))

    def calculate_all_cv_metrics(self) -> dict:
        return _row(S.all_cv(self.data))

    def pattern_stability_metrics(self) -> dict:
        return _row(ST.pattern_stability(self.data))

    def variance_components(self) -> dict:
        return _row(V.variance_components(self.data)) | {"segmentos": {r.segment: r.asDict() for r in V.variance_segments(self.data).collect()}}

    def MAGE(self) -> float:
        return _row(E.mage(self.data))["mage"]

    def MAGE_Baghurst(self, threshold_sd: float = 1, approach: int = 1) -> dict:
        return _row(E.mage_baghurst(self.data, threshold_sd, approach))

    def MODD(self, days: int = 1) -> dict:
        return _row(T.modd(self.data, days))

    def CONGA(self, hours: float = 4, max_gap_minutes: float | None = None) -> dict:
        return _row(T.conga(self.data, hours, max_gap_minutes=max_gap_minutes))

    def Lability_index(self, interval: int = 1, period: str = "week") -> dict:
        weekly = [r.lability for r in T.weekly_lability(self.data, interval).orderBy("week").collect()]
        return {"weekly_values": weekly} | _row(T.lability(self.data, interval, period=period))

    def Variability(self) -> dict:
        return _row(T.variability(self.data))

    def M_Value(self, reference_glucose: float = 90) -> float:
        return _row(R.m_value(self.data, reference_glucose))["m_value"]

    def GRADE(self, unit: str = "mg/dL") -> dict:
        return _row(R.grade(self.data, unit=unit))

    def GRI(self, pregnancy: bool = False) -> dict:
        r = _row(R.gri(self.data, pregnancy=pregnancy))
        return {"GRI": r["GRI"], "components": {k: r[k] for k in ("VLow", "Low", "VHigh", "High")}, "derived_metrics": {k: r[k] for k in ("hypo_component", "hyper_component", "TIR")}}

    def ADRR(self) -> dict:
        return _row(R.adrr(self.data))

    def calculate_all_metrics(self) -> dict:
        return _row(SU.all_metrics(self.data))

    def calculate_metrics(self, metric_func: str | Callable, frequency: str = "W", min_data_completeness: float = 70.0) -> dict:
        return self.calculate_multiple_metrics([metric_func], frequency, min_data_completeness)[metric_func if isinstance(metric_func, str) else metric_func.__name__]

    def calculate_multiple_metrics(self, metric_funcs: list, frequency: str = "W", min_data_completeness: float = 70.0) -> dict:
        """{name: {period: {value, metadata}}}; names are registered metrics, functions get the period's glucose."""
        meta = {r.period: r.asDict() for r in Q.periods(self.data, frequency).collect()}
        names, functions = [m for m in metric_funcs if isinstance(m, str)], [m for m in metric_funcs if not isinstance(m, str)]
        out: dict = {}
        if names:
            rows = PE.period_metrics(self.data, names, frequency, min_data_completeness).collect()
            out |= {n: {r.period: {"value": r[n], "metadata": meta[r.period]} for r in rows} for n in names}
        if functions:
            rows = PE.period_function(self.data, functions, frequency, min_data_completeness).collect()
            out |= {f.__name__: {r.period: {"value": r[f.__name__], "metadata": meta[r.period]} for r in rows} for f in functions}
        return out


class GlucosePlot(GlucoseMetrics):
    """Charts; the data of each come from the profile operators."""

    def plot_agp(self, smoothing_window: int = 15):
        return plotting.plot_agp(self.data, smoothing_window)

    def generate_week_agp(self, smoothing_window: int = 15, combined: bool = True):
        return plotting.plot_lines(P.week_agp(self.data, smoothing_window, combined), "time_decimal", "p50_smooth")

    def day_graph(self, fecha: str | None = None):
        return plotting.plot_lines(P.day_graph(self.data, fecha), "time_decimal", "glucose")

    def histogram(self, bin_width: int = 10):
        return plotting.plot_bars(P.histogram(self.data, bin_width), "bin_start", "count")

    def plot_overlapping_days(self):
        return plotting.plot_lines(P.overlapping_days(self.data), "time_decimal", "mean", "mean_smooth")

    def plot_week_boxplots(self):
        return plotting.plot_bars(P.week_boxplots(self.data), "weekday", "median")

    def plot_daily_variations(self):
        return plotting.plot_lines(P.daily_variation(self.data), "day", "mean", "sd")

    def plot_sd_components(self):
        return plotting.plot_bars(P.sd_components(self.data), "component", "sd")

    def plot_sd_between_timepoints(self, min_count_threshold: float = 0.5, agrupar_por_intervalos: bool = False, intervalo_minutos: int = 5):
        return plotting.plot_lines(P.timepoint_pattern(self.data, min_count=min_count_threshold, bin_minutes=intervalo_minutos if agrupar_por_intervalos else 1), "minute", "mean")

    def plot_sd_same_timepoint(self, min_count_threshold: float = 0.5, agrupar_por_intervalos: bool = False, intervalo_minutos: int = 5):
        return plotting.plot_lines(P.same_timepoint_profile(self.data, min_count=min_count_threshold, bin_minutes=intervalo_minutos if agrupar_por_intervalos else 1), "minute", "sd", "sd_smooth")

    def plot_variability_dashboard(self):
        return [plotting.plot_lines(P.hourly_pattern(self.data), "bin", "mean"), plotting.plot_lines(P.dashboard_days(self.data), "day", "mean", "low", "high"), plotting.plot_bars(P.sd_components(self.data, descending=True), "component", "sd")]

    def plot_variance_components(self) -> dict:
        return self.variance_components()

    def plot_time_in_range(self, pregnancy: bool = False):
        return plotting.plot_bars(P.time_in_range_bars(self.data, pregnancy), "name", "value")

    def plot_conga_profile(self, max_hours: int = 24, step: int = 1) -> dict:
        rows = P.conga_profile(self.data, max_hours, step).orderBy("hours").collect()
        return {"hours": [r.hours for r in rows], "conga_values": [r.conga for r in rows], "valid_percentages": [r.percent_valid for r in rows]}

    def plot_m_value_curve(self):
        return plotting.plot_lines(P.m_value_curve(self.data.sparkSession), "glucose", "m_value")

    def plot_gri(self):
        return plotting.plot_bars(P.gri_grid(self.data), "hypo", "hyper")

    def plot_gri_array(self, gri_dict: dict):
        points = [(k, v["components"]["VLow"] + v["components"]["Low"], v["components"]["VHigh"] + v["components"]["High"]) for k, v in gri_dict.items()]
        return plotting.plot_bars(self.data.sparkSession.createDataFrame(points, "series string, hypo double, hyper double"), "series", "hyper")


class GlucoseAnalysis(GlucosePlot):
    """Loading, metrics and charts of one series."""


class Dexcom(GlucoseAnalysis):
    def __init__(self, file_path: str, start_date=None, end_date=None, **options):
        super().__init__(file_path, start_date=start_date, end_date=end_date, **(I.PRESETS["dexcom"] | options))


class Libreview(GlucoseAnalysis):
    def __init__(self, file_path: str, header: int = 2, start_date=None, end_date=None, **options):
        super().__init__(file_path, start_date=start_date, end_date=end_date, **(I.PRESETS["libreview"] | {"header": header} | options))


class GestationalDiabetes(GlucoseAnalysis):
    """A series with a delivery date and the gestational age then; statistics use the pregnancy ranges."""

    def __init__(self, file_path, fecha_parto: str, week: int, day: int = 0, date_col: str = "time", glucose_col: str = "glucose", delimiter: str | None = None, header: int = 0, **options):
        super().__init__(file_path, date_col, glucose_col, delimiter, header, **options)
        self.pregnancy = PG.Pregnancy.of(fecha_parto, week, day)
        self.whole = self.data
        self.data = PG.during(self.data, self.pregnancy)

    def __str__(self) -> str:
        return "\n".join(PG.describe(self.whole, self.pregnancy))

    def decimal_a_semanas_dias(self, semanas: float) -> tuple[int, int]:
        return PG.weeks_and_days(semanas)

    def get_semanas_dias(self) -> tuple[int, int]:
        return self.pregnancy.week, self.pregnancy.day

    def _by(self, df: DataFrame, key: str, labels, empty=lambda r: r.get("n") == 0) -> dict:
        rows = {r[key]: {k: v for k, v in r.asDict().items() if k not in (key, "series_id")} for r in df.collect()}
        return {k: rows[k] if k in rows and not empty(rows[k]) else NO_DATA for k in labels}

    def info_gestational(self) -> dict:
        return self._by(PG.trimester_info(self.whole, self.pregnancy), "trimester", PG.TRIMESTERS)

    def before_and_after_partum(self) -> dict:
        return self._by(PG.around_delivery(self.whole, self.pregnancy), "phase", ("preparto", "postparto"))

    def time_statistics(self) -> dict:
        return self.time_statistics_pregnancy()

    def time_statistics_trimestres(self) -> dict:
        return self._by(PG.trimester_statistics(self.whole, self.pregnancy), "trimester", PG.TRIMESTERS)

    def time_statistics_weeks(self) -> dict:
        rows = PG.weekly_statistics(self.whole, self.pregnancy).orderBy("week").collect()
        return {f"semana_{r.week}": {"datos": r.n, "metricas": {k: v for k, v in r.asDict().items() if k not in ("series_id", "week", "n")} if r.n else NO_DATA} for r in rows}

    def calculate_all_metrics(self) -> dict:
        found = self._by(PG.all_metrics(self.whole, self.pregnancy), "trimester", (PG.WHOLE, *PG.TRIMESTERS))
        return {PG.WHOLE: found.pop(PG.WHOLE), "por_trimestre": found}

    def distribution_trimestres(self) -> dict:
        return self._by(PG.distribution(self.whole, self.pregnancy), "trimester", PG.TRIMESTERS)

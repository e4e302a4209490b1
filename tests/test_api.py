import datetime as dt

import numpy as np
import pytest
from glyspark import api

from .helpers import frame, series, wave


@pytest.fixture(scope="module")
def one_series(spark):
    return api.GlucoseAnalysis(series(spark, wave(4 * 288)).select("time", "glucose"))


def test_scalars(one_series):
    v = wave(4 * 288)
    assert one_series.mean() == pytest.approx(v.mean()) and one_series.sd() == pytest.approx(np.std(v, ddof=1))
    assert one_series.percentile(90) == pytest.approx(np.percentile(v, 90)) and one_series.data_completeness() == 100
    assert one_series.TAR(180) == pytest.approx(100 * (v > 180).mean()) and one_series.get_typical_interval() == 5


CALLS = ["info", "time_statistics", "time_statistics_pregnancy", "distribution_analysis", "sd_within_day", "sd_between_timepoints", "sd_same_timepoint", "sd_daily_mean", "sd_interaction", "sd_same_timepoint_adjusted", "variance_components", "MAGE_Baghurst", "MODD", "CONGA", "Lability_index", "GRADE", "GRI", "ADRR", "pattern_stability_metrics", "plot_conga_profile"]


@pytest.mark.parametrize("name", CALLS)
def test_results_are_dicts(one_series, name):
    out = getattr(one_series, name)()
    assert isinstance(out, dict) and out


def test_period_metrics(one_series):
    def spread(x):
        return x.max() - x.min()

    out = one_series.calculate_multiple_metrics(["mean", spread], "D")
    assert len(out["mean"]) == len(out["spread"]) == 4
    assert one_series.calculate_metrics("sd", "D")[dt.date(2024, 1, 1)]["metadata"]["n_points"] == 288


def test_gestational(spark):
    g = api.GestationalDiabetes(frame(wave(300), 6 * 60), "2024-03-11", 10, 0, spark=spark)
    assert g.time_statistics_trimestres()["tercer_trimestre"] == api.NO_DATA
    assert len(g.time_statistics_weeks()) == 10 and g.get_semanas_dias() == (10, 0)
    assert g.before_and_after_partum()["postparto"] != api.NO_DATA
    assert set(g.calculate_all_metrics()) == {"embarazo_completo", "por_trimestre"}


def test_charts_say_what_they_need(one_series):
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            one_series.plot_agp()

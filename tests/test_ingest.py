import datetime as dt

import pandas as pd
import pytest
from glyspark.sources import ingest as I, sink

from .helpers import START, one, series


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_comma_or_semicolon(spark, tmp_path):
    for sep in ",;":
        p = write(tmp_path / f"a{ord(sep)}.csv", f"time{sep}glucose\n2024-01-01 10:00:00{sep}100\n2024-01-01 10:05:00{sep}110\n")
        assert [r.glucose for r in I.read_cgm(spark, p).orderBy("time").collect()] == [100, 110]


def test_wrong_columns_and_missing_file(spark, tmp_path):
    p = write(tmp_path / "a.csv", "x,y\n1,2\n")
    with pytest.raises(ValueError):
        I.read_cgm(spark, p)
    with pytest.raises(ValueError):
        I.read_cgm(spark, p, "x", "y", delimiter="|")
    with pytest.raises(FileNotFoundError):
        I.read_cgm(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        I.read_cgm(spark, 7)


def test_device_presets(spark, tmp_path):
    d = I.PRESETS["dexcom"]
    p = write(tmp_path / "d.csv", f'Indice,{d["date_col"]},Tipo,{d["glucose_col"]}\n1,,Nombre,\n2,2024-01-01T10:00:00,EGV,100\n3,2024-01-01T10:05:00,EGV,Bajo\n')
    assert one(I.read_device(spark, "dexcom", p))["glucose"] == 100
    d = I.PRESETS["libreview"]
    p = write(tmp_path / "l.csv", f'Nombre,Fecha\nAna,2024\nDispositivo,{d["date_col"]},Tipo,{d["glucose_col"]}\nL,02-01-2024 10:00,0,101\nL,02-01-2024 10:15,1,\n')
    row = one(I.read_device(spark, "libreview", p))
    assert row["glucose"] == 101 and row["time"] == dt.datetime(2024, 1, 2, 10)


def test_parquet_and_pandas_sources(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    series(spark, [100, 120]).write.parquet(path)
    assert I.read_cgm(spark, path).count() == 2
    pdf = pd.DataFrame({"time": ["2024-01-01 10:00:00"], "glucose": [99.9]})
    assert one(I.read_cgm(spark, pdf))["glucose"] == 99


def clean(spark, rows, schema="time string, glucose string", **options):
    return I.clean(spark.createDataFrame(rows, schema), **options)


def test_bad_values_go(spark):
    rows = [("2024-01-01 10:00:00", x) for x in ("Low", "Alto", "5,6", "", None)] + [("nonsense", "100"), (None, "100"), ("2024-01-01 11:00:00", " 101 ")]
    assert one(clean(spark, rows))["glucose"] == 101


def test_ambiguous_dates(spark):
    rows = [("01/02/2024 10:00", "1"), ("13/02/2024 10:00", "2")]
    got = {r.glucose: r.time for r in clean(spark, rows).collect()}
    assert got == {1: dt.datetime(2024, 1, 2, 10), 2: dt.datetime(2024, 2, 13, 10)}
    got = {r.glucose: r.time for r in clean(spark, rows, dayfirst=True).collect()}
    assert got[1] == dt.datetime(2024, 2, 1, 10)


def test_epoch_seconds_and_millis(spark):
    s = 1_704_103_200
    got = [r.time for r in clean(spark, [(s, 100.0), (s * 1000 + 300_000, 100.0)], "time long, glucose double").orderBy("time").collect()]
    assert got == [dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 10, 5)]


def test_truncation_and_wide_values(spark):
    rows = [(f"2024-01-01 10:0{k}:00", v) for k, v in enumerate((5.9, -5.9, 40_000.0, float("nan")))]
    assert [r.glucose for r in clean(spark, rows, "time string, glucose double").orderBy("time").collect()] == [5.9, -5.9, 40_000]
    assert [r.glucose for r in clean(spark, rows[:2], "time string, glucose double").orderBy("time").collect()] == [5, -5]


def test_twelve_hour_clock_and_unparsed_rows(spark):
    rows = [("01/02/2024 03:05 pm", "1"), ("2024-01-02 12:10:00 AM", "2"), ("13/02/2024 1:00 PM", "3"), ("soon", "4"), ("2024-01-02", "x"), (None, "5")]
    got = {r.glucose: r.time for r in clean(spark, rows).collect()}
    assert got == {1: dt.datetime(2024, 1, 2, 15, 5), 2: dt.datetime(2024, 1, 2, 0, 10), 3: dt.datetime(2024, 2, 13, 13)}
    lost = one(I.unparsed(spark.createDataFrame(rows, "time string, glucose string")))
    assert lost == {"rows": 6, "bad_times": 1, "bad_values": 1}


def test_units(spark):
    assert one(clean(spark, [("2024-01-01 10:00:00", 5.5)], "time string, glucose double", unit="mmol/L"))["glucose"] == 99
    with pytest.raises(ValueError):
        clean(spark, [("2024-01-01", 5.5)], "time string, glucose double", unit="g")


def test_duplicates_keep_the_value_closest_to_the_mean(spark):
    t, u = "2024-01-01 10:00:00", "2024-01-01 10:05:00"
    rows = [(t, 100.0, 0), (t, 110.0, 1), (t, 120.0, 2), (u, 100.0, 3), (u, 90.0, 4)]
    got = [r.glucose for r in clean(spark, rows, "time string, glucose double, pos int", order_col="pos").orderBy("time").collect()]
    assert got == [110, 100]
    assert [r.glucose for r in clean(spark, rows, "time string, glucose double, pos int").orderBy("time").collect()] == [110, 90]


def test_date_range_is_inclusive_and_after_parsing(spark):
    rows = [(f"2024-01-0{d} 00:00:00", "100") for d in range(1, 6)]
    assert clean(spark, rows, start="2024-01-02", end="04-01-2024 00:00").count() == 3
    with pytest.raises(ValueError):
        I.parse_date("yesterday")
    with pytest.raises(ValueError):
        I.require_rows(clean(spark, rows, start="2025-01-01"))


def test_sink_round_trip_and_merge_rules(spark, tmp_path):
    path = str(tmp_path / "cgm")
    sink.write_cgm(series(spark, [100, 110, 120]), path)
    other = series(spark, [50], series_id="b")
    assert sink.append_cgm(other, path) == 1
    late = series(spark, [7, 8], start=START + dt.timedelta(minutes=10))
    assert sink.append_cgm(late, path, rule="keep_old") == 1
    got = {(r.series_id, r.time.minute): r.glucose for r in spark.read.parquet(path).collect()}
    assert got == {("a", 0): 100, ("a", 5): 110, ("a", 10): 120, ("a", 15): 8, ("b", 0): 50}
    # Replacements count as added under keep_new.
    assert sink.append_cgm(late, path, rule="keep_new") == 2
    assert {r.glucose for r in spark.read.parquet(path).filter("series_id = 'a'").collect()} == {100, 110, 7, 8}
    assert sink.append_cgm(late, path, rule="keep_both") == 2
    with pytest.raises(ValueError):
        sink.append_cgm(late, path, rule="other")


def test_sink_widens_large_values(spark, tmp_path):
    sink.write_cgm(series(spark, [100, 40_000]), str(tmp_path / "w"))
    assert dict(spark.read.parquet(str(tmp_path / "w")).dtypes)["glucose"] == "int"

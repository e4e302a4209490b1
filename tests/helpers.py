"""Small series for tests."""

import datetime as dt

import numpy as np
import pandas as pd

START = dt.datetime(2024, 1, 1)


def series(spark, values, minutes=5, start=START, series_id="a"):
    rows = [(series_id, start + dt.timedelta(minutes=minutes * k), int(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, time timestamp_ntz, glucose int")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def wave(n=2 * 288, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return np.clip(120 + 60 * np.sin(t / 30) + rng.normal(0, 15, n), 41, 400).astype(int)


def frame(values, minutes=5, start=START):
    return pd.DataFrame({"time": [start + dt.timedelta(minutes=minutes * k) for k in range(len(values))], "glucose": np.asarray(values, float)})

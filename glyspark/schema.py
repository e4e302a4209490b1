"""The canonical series: one row per reading, many series in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ShortType, StringType, StructField, StructType, TimestampNTZType

SERIES, TIME, GLUCOSE = "series_id", "time", "glucose"
BY = (SERIES,)
CGM = StructType([StructField(SERIES, StringType(), False), StructField(TIME, TimestampNTZType(), False), StructField(GLUCOSE, ShortType(), False)])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or a ValueError that lists its columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {', '.join(missing)} not found; available: {', '.join(df.columns)}")
    return df


def require_datetime(df: DataFrame) -> DataFrame:
    if dict(df.dtypes)[TIME] not in ("timestamp_ntz", "timestamp"):
        raise ValueError(f"column {TIME} is not a timestamp")
    return df

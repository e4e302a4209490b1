"""Reading and cleaning of sensor exports into the canonical series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from ..functions import expr as X
from ..schema import BY, GLUCOSE, SERIES, TIME, require_columns

#: Columns and header rows of device exports.
PRESETS = {
    "dexcom": {"date_col": "Marca temporal (AAAA-MM-DDThh:mm:ss)", "glucose_col": "Nivel de glucosa (mg/dL)", "header": 0, "dayfirst": False},
    "libreview": {"date_col": "Sello de tiempo del dispositivo", "glucose_col": "Historial de glucosa mg/dL", "header": 2, "dayfirst": True},
}
#: 12-hour clock times, after a month-first, day-first or ISO date.
CLOCK = ("hh:mm:ss a", "hh:mm a", "h:mm:ss a", "h:mm a")
MONTH_FIRST = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM-dd-yyyy HH:mm:ss", "MM-dd-yyyy HH:mm", "MM/dd/yyyy", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
_HALF_DAYS = {d: tuple(f"{d} {t}" for t in CLOCK) for d in ("MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "yyyy-MM-dd")}
DAY_FIRST = MONTH_FIRST[:5] + MONTH_FIRST[10:15] + MONTH_FIRST[5:10] + MONTH_FIRST[15:]
for _d in ("MM/dd/yyyy", "MM-dd-yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd"):
    MONTH_FIRST += _HALF_DAYS[_d]
for _d in ("dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy-MM-dd"):
    DAY_FIRST += _HALF_DAYS[_d]
SMALL = (-32_768, 32_767)


def read_csv(spark: SparkSession, path: str, date_col: str, glucose_col: str, delimiter: str | None = None, header: int = 0) -> DataFrame:
    """Text columns of a CSV; without a delimiter, ',' and then ';' are tried against the header row.

    Only header + 1 lines come to the driver.
    """
    lines = [r[0] for r in spark.read.text(path).limit(header + 1).collect()]
    if len(lines) <= header:
        raise ValueError(f"{path} has no row {header}")
    for sep in [delimiter] if delimiter else [",", ";"]:
        names = [n.strip().strip('"').lstrip("﻿") for n in lines[header].split(sep)]
        if date_col in names and glucose_col in names:
            break
    else:
        raise ValueError(f"columns {date_col}, {glucose_col} not found in row {header}: {lines[header]}")
    if not header:
        df = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
        return df.toDF(*names[: len(df.columns)]).select(date_col, glucose_col)
    # Preamble lines are told by their text; the header row likewise.
    ddl = ", ".join(f"c{k} STRING" for k in range(len(names)))
    body = spark.read.text(path).filter(~F.col("value").isin(lines))
    row = F.from_csv("value", F.lit(ddl), {"sep": sep, "mode": "PERMISSIVE"})
    return body.select(row.alias("r")).select(F.col(f"r.c{names.index(date_col)}").alias(date_col), F.col(f"r.c{names.index(glucose_col)}").alias(glucose_col))


def to_time(column: str, kind, dayfirst: bool = False) -> Column:
    """A naive timestamp from a date, a time, an epoch number (milliseconds above 1e10) or text."""
    c = F.col(f"`{column}`")
    if isinstance(kind, (TimestampNTZType, TimestampType, DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(kind, NumericType):
        c = c.cast("double")
        return F.timestamp_micros((F.when(c > 1e10, c * 1e3).otherwise(c * 1e6)).cast("long")).cast("timestamp_ntz")
    if isinstance(kind, StringType):
        return X.parse_date(F.upper(F.trim(c)), DAY_FIRST if dayfirst else MONTH_FIRST)
    raise ValueError(f"column {column} holds {kind.simpleString()}, not times")


def clean(df: DataFrame, date_col: str = TIME, glucose_col: str = GLUCOSE, series_col: str | None = None, series: str = "0", start=None, end=None, dayfirst: bool = False, unit: str = "mg/dL", order_col: str | None = None, drop_nonpositive: bool = False) -> DataFrame:
    """series_id, time, glucose: coerced, filtered to [start, end], with one row per time, the one closest to the mean
    of that time's rows.

    A series whose values all fit 16 bits is truncated to whole numbers; another keeps its values as they are. Rows
    whose time or value is not understood go (unparsed() counts them). Ties go to the first by order_col, else to the
    smaller value.
    """
    require_columns(df, date_col, glucose_col, *([series_col] if series_col else []))
    g = F.col(f"`{glucose_col}`")
    g = F.expr(f"try_cast(trim(`{glucose_col}`) AS double)") if isinstance(df.schema[glucose_col].dataType, StringType) else g.cast("double")
    if unit == "mmol/L":
        g = g * 18.0
    elif unit != "mg/dL":
        raise ValueError("unit must be 'mg/dL' or 'mmol/L'")
    key = F.col(f"`{series_col}`").cast("string") if series_col else F.lit(series)
    rank = F.col(f"`{order_col}`") if order_col else F.lit(0)
    out = df.select(key.alias(SERIES), to_time(date_col, df.schema[date_col].dataType, dayfirst).alias(TIME), F.when(~F.isnan(g), g).alias("g"), rank.alias("_order")).na.drop(subset=[SERIES, TIME, "g"])
    if start is not None:
        out = out.filter(F.col(TIME) >= F.lit(as_time(start)).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col(TIME) <= F.lit(as_time(end)).cast("timestamp_ntz"))
    if drop_nonpositive:
        out = out.filter("g > 0")
    # One row per series; usually broadcast.
    wide = out.groupBy(SERIES).agg((F.min(F.col("g").between(*SMALL))).alias("small"))
    out = out.join(wide, SERIES).withColumn(GLUCOSE, F.when(F.col("small"), F.col("g").cast("int").cast("double")).otherwise(F.col("g"))).drop("small")
    return deduplicate(out).select(SERIES, TIME, GLUCOSE)


def unparsed(df: DataFrame, date_col: str = TIME, glucose_col: str = GLUCOSE, dayfirst: bool = False) -> DataFrame:
    """One row: rows, and those whose time or value is given but not understood by clean()."""
    time = to_time(date_col, df.schema[date_col].dataType, dayfirst)
    g = F.expr(f"try_cast(trim(`{glucose_col}`) AS double)") if isinstance(df.schema[glucose_col].dataType, StringType) else F.col(f"`{glucose_col}`").cast("double")

    def lost(column: str, parsed: Column) -> Column:
        return F.coalesce(F.sum((F.col(f"`{column}`").isNotNull() & parsed.isNull()).cast("long")), F.lit(0))

    return df.agg(F.count(F.lit(1)).alias("rows"), lost(date_col, time).alias("bad_times"), lost(glucose_col, g).alias("bad_values"))


def deduplicate(df: DataFrame, by=BY) -> DataFrame:
    """One row per series and time: the value closest to the mean of that time's values."""
    same = Window.partitionBy(*by, TIME)
    off = F.abs(F.col(GLUCOSE) - F.avg(GLUCOSE).over(same))
    order = [off, *([F.col("_order")] if "_order" in df.columns else []), F.col(GLUCOSE)]
    best = df.withColumn("_off", off).withColumn("_n", F.row_number().over(same.orderBy(F.col("_off"), *order[1:])))
    return best.filter("_n = 1").drop("_n", "_off", "_order", "g")


def as_time(x) -> str:
    """A literal in one of the accepted formats, as ISO text."""
    if isinstance(x, (dt.datetime, dt.date)):
        return x.isoformat(sep=" ") if isinstance(x, dt.datetime) else f"{x} 00:00:00"
    return parse_date(x).isoformat(sep=" ")


def parse_date(text: str) -> dt.datetime:
    """The first accepted format that fits, else a ValueError."""
    for f in ("%Y-%m-%d", "%d/%m/%Y %H:%M", "%Y-%m-%dT%H:%M:%S", "%d-%m-%Y %H:%M", "%Y-%m-%d %H:%M:%S"):
        try:
            return dt.datetime.strptime(text, f)
        except ValueError:
            continue
    raise ValueError(f"date {text!r} has none of the accepted formats")


def read_cgm(spark: SparkSession, source, date_col: str = TIME, glucose_col: str = GLUCOSE, delimiter: str | None = None, header: int = 0, start_date=None, end_date=None, **options) -> DataFrame:
    """A cleaned series from a path (.parquet, else CSV), a Spark DataFrame or a pandas one."""
    if isinstance(source, DataFrame):
        df = source
    elif isinstance(source, str):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop):
            raise FileNotFoundError(source)
        df = spark.read.parquet(source) if source.lower().endswith(".parquet") else read_csv(spark, source, date_col, glucose_col, delimiter, header)
    elif hasattr(source, "iloc"):
        df = spark.createDataFrame(source)
    else:
        raise ValueError("source must be a path or a DataFrame")
    return clean(df, date_col, glucose_col, start=start_date, end=end_date, **options)


def read_device(spark: SparkSession, device: str, path: str, start_date=None, end_date=None, **options) -> DataFrame:
    """A device's export, by its preset."""
    return read_cgm(spark, path, start_date=start_date, end_date=end_date, **(PRESETS[device] | options))


def require_rows(df: DataFrame) -> DataFrame:
    """df, or a ValueError if it is empty."""
    if df.isEmpty():
        raise ValueError("no readings in the chosen range")
    return df

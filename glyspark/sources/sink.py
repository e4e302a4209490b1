"""Parquet sinks, partitioned by series."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import BY, GLUCOSE, SERIES, TIME

RULES = ("keep_new", "keep_old", "keep_both")


def first_per_time(df: DataFrame, by=BY, order_col: str | None = None) -> DataFrame:
    """One row per series and time: the first by order_col, else the one with the smallest value."""
    w = Window.partitionBy(*by, TIME).orderBy(*([order_col] if order_col else []), GLUCOSE)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def narrowed(df: DataFrame) -> DataFrame:
    """glucose as 16-bit numbers if all fit, else 32-bit."""
    low, high = df.agg(F.min(GLUCOSE), F.max(GLUCOSE)).first()
    small = low is None or (low >= -32_768 and high <= 32_767)
    return df.withColumn(GLUCOSE, F.col(GLUCOSE).cast("smallint" if small else "int"))


def write_cgm(df: DataFrame, path: str, compression: str = "snappy", sort: bool = True, mode: str = "overwrite", order_col: str | None = None) -> None:
    """One row per series and time, in time order inside each file. Files lie in folders by series.

    Rows are dealt by ranges of series and time, so that a long series is written by several tasks. Of rows with equal
    times the first by order_col (say, the place in the source) is kept, else the smallest value.
    """
    out = narrowed(first_per_time(df, order_col=order_col).select(SERIES, TIME, GLUCOSE)).repartitionByRange(SERIES, TIME)
    if sort:
        out = out.sortWithinPartitions(SERIES, TIME)
    out.write.mode(mode).option("compression", compression).partitionBy(SERIES).parquet(path)


def merged(old: DataFrame, new: DataFrame, rule: str = "keep_new", by=BY) -> DataFrame:
    """Both tables under a rule for times that both have."""
    keys = [*by, TIME]
    if rule == "keep_new":
        return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)
    if rule == "keep_old":
        return old.unionByName(new.join(old.select(keys).distinct(), keys, "left_anti"))
    if rule == "keep_both":
        return old.unionByName(new)
    raise ValueError(f"rule must be one of {', '.join(RULES)}")


def append_cgm(df: DataFrame, path: str, compression: str = "snappy", rule: str = "keep_new") -> int:
    """Merge df into the table at path and return the rows added: rows after, less old rows that stay.

    Series that df does not hold are not rewritten: the merge reads and replaces only df's partitions,
    and is written aside first, as a path cannot be overwritten while it is read.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        write_cgm(df, path, compression)
        return spark.read.parquet(path).count()
    schema = spark.read.parquet(path).schema
    old = spark.read.schema(schema).parquet(path).withColumn(SERIES, F.col(SERIES).cast("string")).join(df.select(SERIES).distinct(), SERIES, "left_semi")
    new = df.select(SERIES, TIME, F.col(GLUCOSE).cast(schema[GLUCOSE].dataType))
    kept = old.join(new.select(SERIES, TIME).distinct(), [SERIES, TIME], "left_anti").count() if rule == "keep_new" else old.count()
    aside = f"{path.rstrip('/')}._{uuid.uuid4().hex}"
    merged(old.select(SERIES, TIME, GLUCOSE), new, rule).repartitionByRange(SERIES, TIME).sortWithinPartitions(SERIES, TIME).write.option("compression", compression).partitionBy(SERIES).parquet(aside)
    staged = spark.read.schema(schema).parquet(aside)
    added = staged.count() - kept
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy(SERIES).parquet(path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(aside), True)
    return added

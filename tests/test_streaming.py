from glyspark.schema import CGM
from glyspark.streaming import daily

from .helpers import series, wave


def test_daily_stream_matches_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    series(spark, wave(600)).select("series_id", "time", "glucose").withColumn("glucose", __import__("pyspark").sql.functions.col("glucose").cast("smallint")).write.parquet(path)
    stream = spark.readStream.schema(CGM).parquet(path)
    q = daily.daily_statistics(stream).writeStream.format("memory").queryName("daily").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT * FROM daily").collect()
    assert sum(r.n for r in got) >= 600 and len({r.day for r in got}) == 3

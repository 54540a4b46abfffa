"""A stream with more pages than a polled list remembers."""

from pyspark.sql import functions as F

from pagelode.plans.queries import stream_repeating


def test_more_pages_than_a_list_remembers(spark, tmp_path):
    pages = spark.range(0, 110_000, numPartitions=1)
    twice = pages.union(pages).select(F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    twice.write.parquet(str(tmp_path / "events.parquet"))
    got = stream_repeating(spark, str(tmp_path))
    assert got.count() == 110_000 == got.distinct().count()

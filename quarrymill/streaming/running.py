"""Incremental forms: statistics over arriving files, and windows with late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, folder: str, schema, files_a_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and kind; events later than the watermark are dropped, state is bounded by it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).count().select(F.col("window.start").alias("start"), kind, "count")


def filter_statistics(stream: DataFrame, kept, folder: str, checkpoint: str) -> None:
    """Process all files that are there: append the rows that pass `kept` and one row of counts for each batch."""

    def each(batch: DataFrame, number: int) -> None:
        passed = batch.where(kept)
        passed.write.mode("append").parquet(f"{folder}/rows")
        batch.agg(F.count("*").alias("read"), F.count_if(kept).alias("kept")).withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/counts")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def paired_stream(parents: DataFrame, children: DataFrame, key: str, time: str, within: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Children joined with the parents of their key that came at most `within` before them, as both arrive.

    The state holds the rows that a row within the watermark can still meet: it grows with the rate of arrival, not with
    the length of the stream. Columns other than the key take the prefixes parent_ and child_."""
    named = lambda df, p: df.select(F.col(key).alias(f"{p}_{key}"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key]).withWatermark(f"{p}_{time}", late)
    p, c = named(parents, "parent"), named(children, "child")
    at, before = F.col(f"child_{time}"), F.col(f"parent_{time}")
    met = p.join(c, (F.col(f"parent_{key}") == F.col(f"child_{key}")) & (before <= at) & (before >= at - F.expr(f"INTERVAL {within}")))
    return met.withColumnRenamed(f"parent_{key}", key).drop(f"child_{key}")

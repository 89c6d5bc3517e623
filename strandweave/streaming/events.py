"""Structured Streaming: event-time windows with watermarks, deduplication, sessions, and mapping of arriving reads."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.session import shared_dir, table


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table as a stream of its Parquet files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there (availableNow), into Parquet in the shared folder; returns the result."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream_{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        # A batch that runs again after a failure replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{root}/out").parquet(f"{root}/out")


def mapped(stream: DataFrame, place: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `place` gives for each micro-batch of a stream of queries, run to its end (availableNow).

    A query comes whole in one row, so batches are mapped apart and nothing is kept between them; a batch that runs again
    after a failure replaces its own folder. A stream without rows gives none.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream_{uuid.uuid4().hex}"
    schema = place(spark.createDataFrame([], stream.schema)).schema
    spark.createDataFrame([], schema).write.parquet(f"{root}/out/batch=-1")

    def put(batch: DataFrame, n: int) -> None:
        place(batch).write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).option("basePath", f"{root}/out").parquet(f"{root}/out").select(*schema.names)


def timed(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with the session's time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Counts by window and type; rows later than the watermark are left out."""
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("w"), "event_type", "n")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first event of each id within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    return timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("w"), "n")


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all windows at the end of the stream: the last batch of the complete mode."""
    stream = source(spark, sf_dir).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("w"), "event_type", "n")
    root = f"{shared_dir(spark)}/stream_{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")

"""Streams of events: late data, repeated rows, an incremental board, and resuming from a content key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as files arrive in a folder; ``ts`` becomes an event time with a zone."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_cells(events: DataFrame, late: str = "1 day", width: str = "6 hours") -> DataFrame:
    """Score cells of event-time windows; state older than the watermark goes, repeated events count
    once."""
    seen = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return seen.groupBy(F.window("ts", width).alias("case_window"), F.col("event_type").alias("tool")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")
    )


def upsert_latest(spark: SparkSession, target: str):
    """A foreachBatch function that appends a batch's cells under its number. A batch that is run
    again after a failure replaces what it wrote before, so a reader that takes the latest batch of
    each cell sees every result once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cells = batch.select(F.col("case_window.start").alias("case_start"), "tool", "n", "total", "top")
        cells.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def latest_cells(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.parquet(target)
    return rows.groupBy("case_start", "tool").agg(F.max_by(F.struct("n", "total", "top"), "batch").alias("r")).select("case_start", "tool", "r.*")


def pending(inputs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``inputs`` whose content key has no finished result: where a broken run resumes."""
    return inputs.join(done.select(*key).distinct(), key, "left_anti")


def content_key(*columns: str):
    """The key of a result: a digest of everything it was made from."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)

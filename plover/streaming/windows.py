"""Structured Streaming over event files, run to completion with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.session import scratch_path


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream; ``ts`` becomes a timestamp, because watermarks need one."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "false").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def lookback_counts(events: DataFrame, out: str, checkpoint: str, lateness: str, key: str = "event_id", by: str = "event_type", width: str = "1 hour") -> DataFrame:
    """Counts per ``by`` and window over micro-batches that read a look-back again, each event once.

    ``events`` is a stream with a timestamp ``ts``. Events of one ``key`` that
    come again within ``lateness`` of each other count once; ``lateness`` must
    cover a batch and its look-back. Keys and windows leave the state once the
    watermark, ``lateness`` behind the newest event, has passed them, and
    events older than that are dropped. A batch writes the windows that it
    changed to a folder of its own, so a batch that is run again replaces what
    it wrote. A restart with the same ``checkpoint`` goes on where it ended.
    """
    once = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])
    counts = once.groupBy(by, F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    flat = counts.select(by, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    flat.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return current_counts(events.sparkSession, out, by)


def current_counts(spark: SparkSession, out: str, by: str = "event_type") -> DataFrame:
    """The last count that any batch wrote for each window."""
    rows = spark.read.parquet(out)
    return rows.groupBy(by, "window_start").agg(F.max_by("n", "batch").alias("n"))


def hourly_counts(spark: SparkSession, path: str, lateness: str = "1 hour") -> DataFrame:
    """Counts per type and hour of the events in a file, as `lookback_counts`; sink and checkpoint are in the shared folder."""
    return lookback_counts(read_events(spark, path), scratch_path(spark, "windows"), scratch_path(spark, "windows-state"), lateness)


def read_slices(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the files in a folder, one to a micro-batch, oldest first."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))

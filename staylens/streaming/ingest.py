"""Streams: deduplication with a watermark, windowed sums, and reviews kept up by key."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.operators import quality, store
from staylens.session import folder


def work_folder(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder."""
    return f"{folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table at a path, a folder or one file, as a stream."""
    schema = spark.read.parquet(path).schema
    held = path if not path.endswith(".parquet") or os.path.isdir(path) else os.path.dirname(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", "*" if held == path else os.path.basename(path)).parquet(held)


def windowed(spark: SparkSession, path: str, delay: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """Sums by window and kind of the events at a path, read as a stream to its end: (hour, event_type, events, total).

    An event that comes again within the watermark counts once. All that is there is one batch, in
    which events of any age are seen; results go to a table in the shared folder.
    """
    rows = stream_of(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicates(["event_id", "ts"])
    sums = rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    sums = sums.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))
    out = work_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={number}")

    sums.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(f"{out}/table")
    return store.latest(kept, ["hour", "event_type"], "batch").select("hour", "event_type", "events", "total")


def keep_up(stream: DataFrame, path: str, checkpoint: str, key: str = "review_id", time: str = "crawled_at", text_col: str = "review_text"):
    """Start keeping a table of reviews up: filtered, once each within the watermark, put in by key.

    Each batch is merged with the table's last version into a new one, so that a repeated batch
    gives the same; versions are folders named by their batch.
    """
    rows = quality.keep_reviews(stream.withWatermark(time, "1 day"), text_col).dropDuplicatesWithinWatermark([key])

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = read_table(spark, path, before=number)
        fresh = batch if held is None else store.upsert(held, batch, [key], time)
        fresh.write.mode("overwrite").parquet(f"{path}/v={number:012d}")

    return rows.writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last version of a table that keep_up() writes, or the last one before a batch; None if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    held = jvm.org.apache.hadoop.fs.Path(path)
    system = held.getFileSystem(conf)
    if not system.exists(held):
        return None
    names = sorted(s.getPath().getName() for s in system.listStatus(held) if s.getPath().getName().startswith("v="))
    names = [n for n in names if before is None or int(n[2:]) < before]
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None

"""Latency metrics over an append-only log of events, as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lineage import ensure_checkpoint_dir


def read_events(spark: SparkSession, folder: str, files: str, files_a_batch: int = 16) -> DataFrame:
    """The folder's Parquet files of that name pattern, as they come; the schema is that of the files there are."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def latency_windows(events: DataFrame, width: str = "1 day", late: str | None = "1 day", time: str = "ts", policy: str = "event_type", ms: str = "value", id_col: str = "event_id") -> DataFrame:
    """(window_start, policy, n, total_ms, max_ms) by tumbling windows of event time.

    A watermark of `late` bounds the state, for sinks that append or update; None keeps all windows. Null times are dropped.
    """
    rows = events.select(F.col(time).cast("timestamp").alias("ts"), F.col(policy).alias("policy"), F.col(ms).alias("ms"), F.col(id_col).alias("id")).where("ts IS NOT NULL")
    if late is not None:
        rows = rows.withWatermark("ts", late)
    got = rows.groupBy(F.window("ts", width).alias("w"), "policy").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))
    return got.select(F.col("w.start").alias("window_start"), "policy", "n", "total_ms", "max_ms")


def drain(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs an aggregating stream over what there is and returns its final result, kept in the shared checkpoint folder.

    Batches write to folders of their own number, so that a repeated batch replaces itself.
    """
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    done = []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={number}")
        done.append(number)

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/batch={max(done)}") if done else spark.createDataFrame([], stream.schema)

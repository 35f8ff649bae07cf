"""Structured Streaming ingest: files to nodes, each batch upserted, and windowed event counts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str):
    """Runs until the source is drained: each batch is transformed and appended for the keys that the target lacks, so a retry adds nothing."""

    def save(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = transform(batch).dropDuplicates([key])
        try:
            known = spark.read.parquet(target).select(key)
            new = new.join(known, key, "left_anti")
        except Exception as e:  # the target's first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and kind; for streams, events later than the watermark are dropped."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(F.window(at, length).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def drained(stream: DataFrame) -> DataFrame:
    """The complete result of a streaming aggregate once its source is drained, through the shared folder of the session."""
    spark = stream.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    folder = os.path.join(named or os.path.join(tempfile.gettempdir(), "veriloom-stream"), f"stream-{uuid.uuid4().hex}")
    save = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")
    query = stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")

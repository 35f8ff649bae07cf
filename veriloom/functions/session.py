"""Settings of a session: Arrow batches, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in one Arrow batch: whole texts travel in them, so a batch stays small.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "512"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "4194304")}


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, which Spark reads when a plan runs; settings other than Spark's own stay as they are."""
    for name, (usual, small) in ARROW.items():
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, small)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where the session names none, one of our own in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "veriloom-checkpoint")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)

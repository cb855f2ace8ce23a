"""Steps that are written before they are read again."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from tidewire.streaming.streams import shared_folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: computed once, and not again when an executor is lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/tidewire-checkpoints")
    return df.checkpoint()


def freed(spark: SparkSession) -> None:
    """Spark drops shuffle files and checkpoints of plans that nothing refers to any more, in either collector; for large steps, as it takes seconds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

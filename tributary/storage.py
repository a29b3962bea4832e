"""Intermediate results that are read more than once, kept where driver and executors both reach them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from a reliable checkpoint, so a lost executor loses none of them.

    The folder is that of ``spark.checkpoint.dir``; a local one is made only where driver and executors are one process.
    """
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet in that folder: smaller than a checkpoint where rows are many pairs of ids."""
    folder = f"{_folder(df.sparkSession)}/pairs-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="tributary-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()

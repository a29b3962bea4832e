"""What the operators of this subpackage share: cutting lineage, batch sizes, word rules."""

from __future__ import annotations

import gc
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Words are runs of characters outside these: space and the controls 09 to 0D.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch sent to Python: long texts stay within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the plans built from here on, by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


#: Folders of intermediate rows, until ``clear_written`` removes them.
_FOLDERS: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder: smaller than a checkpoint where rows are many."""
    folder = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffles of plans that are done: it does so once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that ``left_out`` broadcasts at most; more are joined by a shuffle.
FEW_ROWS = 500_000


def left_out(documents: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``documents`` but those that the stored ``dropped(id, h)`` names, by doc_id and hash of the text.

    A few dropped rows are broadcast, so that the texts aren't shuffled.
    """
    gone = dropped.distinct()
    gone = F.broadcast(gone) if dropped.count() <= FEW_ROWS else gone
    same = [documents["doc_id"] == gone["id"], F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == gone["h"]]
    return documents.join(gone, same, "left_anti")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. The full-Unicode lower() gives the same, faster, where it leaves all other characters alone.

    That is told by its own result, not by a list of capitals, as libraries differ in the Unicode that they know.
    """
    low, others = F.lower(text), lambda x: F.regexp_replace(x, r"[\x00-\x7F]+", "")
    same = (F.octet_length(text) == F.char_length(text)) | (others(text) == others(low))
    return F.when(same, low).otherwise(F.translate(text, UPPER, LOWER))


def clear_written(spark: SparkSession) -> None:
    """Remove what operators have written on the way; for when their results are stored."""
    while _FOLDERS:
        remove_folder(spark, _FOLDERS.pop())


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

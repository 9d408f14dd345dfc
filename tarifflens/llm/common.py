"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are separated by these characters, and only these (fixed value of the contracts).
BLANKS = " \t\n\x0b\x0c\r"

# Whole texts travel in these batches; rows of text are large, so the default of 10,000 is too many.
BATCH_ROWS = 1000

# Tasks of a small stage: one per so many rows, and so many at least.
ROWS_PER_TASK, FEW_TASKS = 50_000, 8


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that carry whole texts; a smaller setting of the cluster stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, through Spark's reader only.

    The setting ``spark.tarifflens.inputSplits`` deals its rows out anew: for benchmarks on files of one row group.
    """
    rows = prepare(spark).read.parquet(f"{folder}/{name}.parquet")
    splits = spark.conf.get("spark.tarifflens.inputSplits", None)
    return rows.repartition(int(splits)) if splits else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a private one in local mode only."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = tempfile.mkdtemp(prefix="corpus-shared-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, rows: int) -> DataFrame:
    """A frame of at most so many small rows in no more tasks than they need, so that its stages leave few files and logs."""
    tasks = max(FEW_TASKS, -(-rows // ROWS_PER_TASK))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def boxed(df: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that no name of theirs clashes with what an operator adds."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def whole(text: Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; bytes.split divides at exactly the six characters of BLANKS."""
    return (text or "").encode("utf-8", "surrogatepass").split()

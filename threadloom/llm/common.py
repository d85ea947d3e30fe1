"""Shared plumbing of the training-data operators: tables, batches, checkpoints.

Everything that an operator keeps between jobs goes to the folder named by
``spark.checkpoint.dir``, which all executors share. A session that names none
gets a temporary folder if its master is local, and an error on a cluster.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Small, as a single text may have megabytes.
ARROW_ROWS = 256


def arrow_rows(spark: SparkSession, rows: int | None = None) -> None:
    """Set the rows of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows or ARROW_ROWS))


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that go to a Python worker at a time."""
    arrow_rows(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; read by Spark alone, so any store works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; one of our own only where none is set."""
    sc = spark.sparkContext
    held = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if held:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(held)
        return held
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="threadloom-checkpoint-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder.

    Rows that two later branches read stay the same after a lost executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: like ``cut``, but columnar and compressed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))

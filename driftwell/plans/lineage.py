"""Cutting lineage in loops, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def deal_after_unions(spark: SparkSession) -> None:
    """Has rows dealt anew above a union, though its inputs are dealt by the same keys already.

    Without this, Spark 4.1 leaves that exchange out, and where a join below the union is planned anew at run time, rows of
    one key end up in two tasks; windows and sorted runs above it then give wrong results.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


#: Bytes of rows that go to a Python worker at once. Spark's 64 MB are held by the executor, and again by its worker, for each core.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Has rows go to Python workers in batches of at most BATCH_BYTES, or of a smaller limit that is set; a longer row goes alone."""
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if not limit.isdigit() or int(limit) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftwell-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, not made yet, in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and returns it without its lineage."""
    deal_after_unions(df.sparkSession)
    small_batches(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, most: int = 1 << 18) -> DataFrame:
    """df, which is cut and has short rows, marked for broadcast if it has at most so many rows; else as it is."""
    return F.broadcast(df) if df.count() <= most else df

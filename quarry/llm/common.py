"""What the operators share: tables, scratch space and text defaults."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts write it.
WHITE = r"[\x20\x09-\x0D]"
#: Bytes of a batch that goes to a Python worker; a single longer row is a batch of its own.
MOST_BATCH = 4 << 20
NOT_WHITE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it is unset, one of our own in the warehouse, which a cluster shares too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        found = context._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quarry-checkpoints"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later jobs start from the written table, which survives lost executors."""
    return cut_at(df, scratch(df.sparkSession, name))


def cut_at(df: DataFrame, path: str) -> DataFrame:
    """The same at a path that the caller names, so that it can ``remove`` the table when nothing reads it any more."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table of our own that later jobs don't read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of ``MOST_BATCH`` bytes at most (the session's setting from here on): Spark's own bound lets
    long texts fill several copies of 64 MB in a task and its worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MOST_BATCH))
    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

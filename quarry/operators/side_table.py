"""One pass over rows, two tables: the good ones, and an error table of those that fail a check.

Rows are tagged and written once, partitioned by the tag, so nothing is computed
twice; the counts are observed on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The columns that a row gets beside its own.
TAG, SOURCE, ITEM, MESSAGE = "__outcome", "__source", "__item", "__message"


def split(df: DataFrame, path: str, message: Column, source: Column, item: Column) -> dict[str, int]:
    """Writes ``df`` below ``path``; a row whose ``message`` is not null is bad.  The number of good and bad rows.

    A check should answer rather than raise (``try_cast``, ``from_json``): a row that raises ends the write, and nothing is left of it."""
    tagged = df.withColumn(MESSAGE, message).withColumn(SOURCE, source.cast("string")).withColumn(ITEM, item.cast("string")).withColumn(TAG, F.when(F.col(MESSAGE).isNull(), "good").otherwise("bad"))
    seen = Observation()
    counted = tagged.observe(seen, F.count_if(F.col(TAG) == "good").alias("good"), F.count_if(F.col(TAG) == "bad").alias("bad"))
    counted.write.partitionBy(TAG).parquet(path)
    return {k: seen.get[k] for k in ("good", "bad")}


def _read(spark: SparkSession, path: str, schema, tag: str) -> DataFrame:
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    # the partition is a filter on folders: the other outcome's files are not opened
    return spark.read.schema(f"{held}, {MESSAGE} string, {SOURCE} string, {ITEM} string, {TAG} string").parquet(path).where(F.col(TAG) == tag)


def good(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that passed, with the columns of ``schema``."""
    return _read(spark, path, schema, "good").select(*[F.col(f"`{f.name}`") for f in schema])


def errors(spark: SparkSession, path: str, schema) -> DataFrame:
    """(source, item, message) of the rows that failed."""
    return _read(spark, path, schema, "bad").select(F.col(SOURCE).alias("source"), F.col(ITEM).alias("item"), F.col(MESSAGE).alias("message"))

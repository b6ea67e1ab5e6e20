"""Total orders.  The many ways to sort in one process are one range-partitioned sort here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def total(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def stable(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Equal keys keep their input order."""
    return df.orderBy(key, ordinal)


def ranged(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Sampled ranges, each sorted: the parallel merge sort's result as ordered partitions."""
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def placed(df: DataFrame, *keys: str, name: str = "place", parts: int | None = None) -> DataFrame:
    """Adds each row's place in the total order (nulls first), without one task for all rows.

    Rows are range-partitioned by all keys, so equal values of the first are
    spread by the others; a row number inside each range follows the number of
    rows in the ranges before.  The driver sees a count a range.  Rows equal in
    all keys take their places in any order."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k).asc_nulls_first() for k in keys]
    rows = written(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = {r["__range"]: r["n"] for r in rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [0]
    for i in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(i, 0))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return rows.withColumn(name, F.element_at(F.array(*[F.lit(b) for b in before]), F.col("__range") + 1).cast("long") + inside).drop("__range")


def digits(column: str, n: int, base: int = 10) -> list:
    """Least significant digit first, as the radix passes see them."""
    return [F.expr(f"cast(floor(`{column}` / {base ** i}) as bigint) % {base}").cast("int").alias(f"d{i}") for i in range(n)]


def random_unique(spark, n: int, low: int, high: int, seed: int) -> DataFrame:
    """n distinct integers of [low, high]: a seeded affine walk through the range, so no draw is repeated."""
    span = high - low + 1
    if n > span:
        raise ValueError("the range holds fewer integers")
    from math import gcd

    step = (seed * 2654435761 + 40503) % span or 1
    while gcd(step, span) != 1:
        step += 1
    return spark.range(n).select((F.lit(low) + F.expr(f"cast(pmod(cast(id as decimal(38,0)) * {step} + {seed % span}, {span}) as bigint)")).alias("v"))

"""Running totals without one task for a key's rows: a blocked prefix sum.

Rows are range-partitioned by key and order, so a key's rows lie in as many
neighbouring blocks as they need.  A window inside a block gives the total so
far in it, the blocks' totals give what lies before each block: they are a row a
key and block, and few of a key even where it holds a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def before(df: DataFrame, key: str, order: list[str], name: str = "before", value: Column | None = None, parts: int | None = None) -> DataFrame:
    """Adds the total of ``value`` (the number of rows, if none is given) over the key's rows that come earlier.

    Rows equal in all ``order`` columns are not before one another: they get the
    same total.  Null keys are one key; a null value adds nothing; nulls come first."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1).cast("long") if value is None else F.coalesce(value, F.lit(0))
    dealt = df.withColumn("__value", one).repartitionByRange(parts, key, *order).withColumn("__block", F.spark_partition_id())
    rows = written(dealt, "running")  # the blocks stay as they are, whatever task is run again
    place = [F.col(c).asc_nulls_first() for c in order]
    peers = F.sum("__value").over(Window.partitionBy("__block", key, *order))
    upto = F.sum("__value").over(Window.partitionBy("__block", key).orderBy(*place).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__inside", upto - peers)
    totals = rows.groupBy(F.col(key).alias("__key"), F.col("__block").alias("__b")).agg(F.sum("__value").alias("__total"))
    earlier = F.sum("__total").over(Window.partitionBy("__key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("__key", "__b", F.coalesce(earlier, F.lit(0)).alias("__base"))
    out = rows.join(base, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__b")))
    return out.select(*df.columns, (F.col("__base") + F.col("__inside")).alias(name))

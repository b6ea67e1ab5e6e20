"""Which range encloses a point, by hierarchical bins.

A range of integers is the union of at most two aligned bins of each size 1, 2,
4, ...: (level, number) with 2^level integers each.  A point lies in one bin of
each level.  So a point and the ranges around it meet by equal (key, level,
bin), and a key that holds half of all ranges is spread over its bins.  Every
range in a bin covers all of it; hence one range a bin is enough, the one that
would win, and a point meets at most one row a level, however deep ranges nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of 62-bit numbers.
LEVELS = 62


def bins(start: Column, end: Column) -> Column:
    """The (level, bin) pairs whose union is [start, end]; none if the range is empty or an end is null.  Ends lie within 2^62 of zero."""
    low, high = start.cast("long"), end.cast("long") + 1
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(high - low, F.lit(1)).cast("double") + 1)).cast("int"))

    def at(level: Column) -> Column:
        shift = lambda x: F.call_function("shiftright", x, level)
        a, b = -shift(-low), shift(high)  # the first whole bin at or after the start, and the one after the last whole bin
        pair = lambda when, number: F.when((a < b) & when, F.struct(level.alias("level"), number.alias("bin")))
        return F.array(pair(F.abs(a) % 2 == 1, a), pair(F.abs(b) % 2 == 1, b - 1))

    found = F.filter(F.flatten(F.transform(levels, at)), lambda x: x.isNotNull())
    return F.when(low < high, found).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))


def enclosing(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, ident: str, point_id: list[str]) -> DataFrame:
    """Each point with the range of its key that holds it and starts last (the largest id on a tie); null if none.

    ``point_id`` with the key names a point; both ends belong to a range."""
    best = F.max(F.struct(F.col(start).alias("s"), F.col(ident).alias("i"))).alias("b")
    binned = ranges.select(key, start, ident, F.explode(bins(F.col(start), F.col(end))).alias("x")).groupBy(key, F.col("x.level").alias("level"), F.col("x.bin").alias("bin")).agg(best)
    used = sorted(r[0] for r in binned.select("level").distinct().collect())  # LEVELS at most
    levels = F.array(*[F.lit(n) for n in used]) if used else F.array().cast("array<int>")
    probes = points.select(key, *point_id, F.col(at).cast("long").alias("__at"), F.explode(levels).alias("level"))
    probes = probes.withColumn("bin", F.call_function("shiftright", F.col("__at"), F.col("level"))).drop("__at")
    met = probes.join(binned, [key, "level", "bin"]).groupBy(key, *point_id).agg(F.max("b").alias("b")).select(key, *point_id, F.col("b.i").alias(ident))
    return points.join(met, [key, *point_id], "left")

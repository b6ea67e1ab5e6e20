"""Key-value dictionaries: which of several values a key has is the only difference between the structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated lines of at least three fields."""
    f = F.split(column, "\t")
    return lines.where(F.size(f) >= 3).select(f[0].alias("english"), f[1].alias("transcription"), f[2].alias("russian"))


def build(df: DataFrame, key: str, ordinal: str, values: list[str], wins: str = "last") -> DataFrame:
    """One row a key: the last (ordered buckets, search tree, trie) or the first (chained hash table) inserted."""
    pick = F.max_by if wins == "last" else F.min_by
    return df.groupBy(key).agg(pick(F.struct(*values), ordinal).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in values])


def find(probes: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    return probes.join(dictionary, key, "left")


def with_prefix(dictionary: DataFrame, key: str, prefix: str) -> DataFrame:
    return dictionary.where(F.col(key).startswith(prefix)).orderBy(key)


def bucket_of(key: str, low: int, high: int, n: int):
    """Order-preserving bucket number of an integer key."""
    return F.floor((F.col(key) - low) * n / (high - low + 1)).cast("int")

"""Latest versions, fallbacks, snapshots and keyed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``; Spark limits each group before its shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def resolve(names: DataFrame, *choices: tuple[DataFrame, list[str]], ident: str = "id") -> DataFrame:
    """The id from the first table of ``choices`` that knows the name; in each, the largest id wins."""
    out, found = names, []
    for i, (table, keys) in enumerate(choices):
        best = table.groupBy(*keys).agg(F.max(ident).alias(f"__id{i}"))
        out = out.join(best, keys, "left")
        found.append(f"__id{i}")
    return out.withColumn(ident, F.coalesce(*found)).drop(*found)


def snapshot_diff(before: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): added, deleted, updated or unchanged."""
    a = before.select(F.col(key).alias("k"), F.col(digest).alias("was"), F.lit(True).alias("old"))
    b = now.select(F.col(key).alias("k"), F.col(digest).alias("is"), F.lit(True).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("is")), "unchanged").otherwise("updated")
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), status.alias("status"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of ``new`` whose key is free, the first of each key, after those of ``old``."""
    return old.unionByName(latest(new.join(old.select(*keys), keys, "left_anti"), keys, *order))


def accumulate(old: DataFrame, new: DataFrame, keys: list[str], counters: list[str], weighted: dict[str, str] | None = None, first: list[str] | None = None) -> DataFrame:
    """Upsert that adds counters and averages ``weighted`` columns by their weight counter; one shuffle of both sides after partial sums.

    ``first`` columns keep the old value, and take the new one (the least, of several) only where there was none.
    Null keys are one key; a weighted value that is null does not count."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    mean = lambda c, w: (F.sum(F.col(c) * F.col(w)) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col(w))), F.lit(0))).alias(c)
    stays = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("__new", c)))[c].alias(c)
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters], *[mean(c, w) for c, w in (weighted or {}).items()], *[stays(c) for c in first or []])


def update(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null values of ``changes`` replace those of the same key."""
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in changes.columns if c not in keys])
    out = old.join(new, keys, "left")
    return out.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if f"__{c}" in new.columns else F.col(c) for c in old.columns])


def cascade(parents: DataFrame, children: DataFrame, key: str, foreign: str) -> DataFrame:
    """Children whose parent is left."""
    return children.join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")


def children_of(children: DataFrame, key: str, order: list[str], fields: list[str], name: str = "children") -> DataFrame:
    """One row a key with its children as an ordered array of structs."""
    return children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))

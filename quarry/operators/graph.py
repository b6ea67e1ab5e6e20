"""Traversals of the polymorphic edge list.

The vertex tables are one view keyed by (type, id), so an edge's names take two
joins, not one outer join a type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of which a task finds the distinct ones, about: tasks grow in number with the edges, not in size.
ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` by its keys over a task for every ``ROWS`` rows, where these are more tasks than the session's."""
    tasks = -(-rows // ROWS)
    return df.repartition(tasks, *by) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _named(symbols: DataFrame, prefix: str) -> DataFrame:
    return symbols.select(F.col("symbol_type").alias(f"{prefix}_type"), F.col("entity_id").alias(f"{prefix}_id"), F.col("symbol_name").alias(f"{prefix}_name"))


def edge_details(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names of both ends; an end without a symbol is written type:id."""
    out = edges
    for side in ("source", "target"):
        out = out.join(_named(symbols, side), [f"{side}_type", f"{side}_id"], "left").withColumn(f"{side}_name", F.coalesce(f"{side}_name", F.concat_ws(":", f"{side}_type", f"{side}_id")))
    return out


def of_symbols(edges: DataFrame, wanted: DataFrame, side: str) -> DataFrame:
    """Edges whose end is among the wanted symbols: one semi-join for all types."""
    keys = wanted.select(F.col("symbol_type").alias(f"{side}_type"), F.col("entity_id").alias(f"{side}_id")).distinct()
    return edges.join(keys, [f"{side}_type", f"{side}_id"], "left_semi")


def reaching(edges: DataFrame, symbols: DataFrame, targets: DataFrame, direct: list[str], onward: list[str], other: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Who reaches the targets by one ``direct`` edge, or by an ``onward`` edge to such a one: with provenance, distinct.

    ``other`` adds branches of their own, each by the types it joins: (source type, kind of edge, target type)."""
    one = of_symbols(edges.where(F.col("relation_type").isin(direct)), targets, "target")
    named = _named(symbols, "source")
    first = one.join(named, ["source_type", "source_id"])
    near = first.select("source_id", F.col("source_name").alias("caller_name"), F.col("source_type").alias("caller_type"), "line_number", F.lit(False).alias("is_indirect"), F.lit("").alias("via"), "relation_type")
    hops = first.select(F.col("source_type").alias("target_type"), F.col("source_id").alias("target_id"), F.col("source_name").alias("via"), F.col("relation_type").alias("then"))
    far = edges.where(F.col("relation_type").isin(onward)).join(hops, ["target_type", "target_id"]).join(named, ["source_type", "source_id"])
    far = far.select("source_id", F.col("source_name").alias("caller_name"), F.col("source_type").alias("caller_type"), "line_number", F.lit(True).alias("is_indirect"), "via", F.concat_ws("->", "relation_type", "then").alias("relation_type"))
    out = near.unionByName(far)
    for source, kind, target in other:
        ends = edges.where((F.col("relation_type") == kind) & (F.col("source_type") == source) & (F.col("target_type") == target))
        more = of_symbols(ends, targets, "target").join(named.where(F.col("source_type") == source), ["source_type", "source_id"])
        out = out.unionByName(more.select("source_id", F.col("source_name").alias("caller_name"), F.col("source_type").alias("caller_type"), "line_number", F.lit(False).alias("is_indirect"), F.lit("").alias("via"), "relation_type"))
    return out.distinct()


def path(edges: DataFrame, symbols: DataFrame, kinds: tuple[str, str], final: DataFrame) -> DataFrame:
    """source -> middle -> final through two kinds of edges, with all three names."""
    last = of_symbols(edges.where(F.col("relation_type") == kinds[1]), final, "target").select(F.col("source_type").alias("mid_type"), F.col("source_id").alias("mid_id"), F.col("target_type").alias("end_type"), F.col("target_id").alias("end_id"))
    first = edges.where(F.col("relation_type") == kinds[0]).select("source_type", "source_id", F.col("target_type").alias("mid_type"), F.col("target_id").alias("mid_id"), "line_number")
    out = first.join(last, ["mid_type", "mid_id"])
    for side in ("source", "mid", "end"):
        out = out.join(_named(symbols, side), [f"{side}_type", f"{side}_id"])
    return out.select("source_id", "source_name", "mid_name", "end_name", "line_number")


def neighbours(edges: DataFrame, symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """Counts of incoming and outgoing edges and of distinct neighbours, for each wanted symbol.

    Edges without an end of a wanted type are left out first: that prunes whole branches of the edge view, and nothing
    of them is sorted or shuffled for the joins."""
    types = [r[0] for r in wanted.select("symbol_type").distinct().collect()]  # kinds of symbols, not symbols
    out_ = of_symbols(edges.where(F.col("source_type").isin(types)), wanted, "source").select(F.col("source_type").alias("symbol_type"), F.col("source_id").alias("entity_id"), F.col("target_type").alias("n_type"), F.col("target_id").alias("n_id"), F.lit(0).alias("incoming"), F.lit(1).alias("outgoing"))
    in_ = of_symbols(edges.where(F.col("target_type").isin(types)), wanted, "target").select(F.col("target_type").alias("symbol_type"), F.col("target_id").alias("entity_id"), F.col("source_type").alias("n_type"), F.col("source_id").alias("n_id"), F.lit(1).alias("incoming"), F.lit(0).alias("outgoing"))
    both = written(out_.unionByName(in_), "ends")
    by = ["symbol_type", "entity_id", "n_type", "n_id"]
    pairs = dealt(both, both.count(), *by).groupBy(*by).agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"))
    known = F.col("n_type").isNotNull() & F.col("n_id").isNotNull()
    per = pairs.groupBy("symbol_type", "entity_id").agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"), F.count_if(known).alias("neighbours"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return wanted.join(per, ["symbol_type", "entity_id"], "left").select(*wanted.columns, zero("incoming"), zero("outgoing"), zero("neighbours"))


def relevance(value: str, type_: str = "", entity_type: str = ""):
    """Score of a match: exact name 10, wanted type 5, wanted entity type 3."""
    hit = lambda c, v, n: F.when((F.lower(c) == v.lower()) & F.lit(v != ""), n).otherwise(0)
    return hit("symbol_name", value, 10) + hit("symbol_type", type_, 5) + hit("entity_type", entity_type, 3)

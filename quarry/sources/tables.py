"""Table sources and the derived views: an edge list, a symbol index and a transition graph over plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _edge(df: DataFrame, source: str, sid: str, target: str, tid: str, kind: str, line: str | int = 0) -> DataFrame:
    at = F.col(line) if isinstance(line, str) else F.lit(line)
    return df.select(F.lit(source).alias("source_type"), F.col(sid).cast("long").alias("source_id"), F.lit(target).alias("target_type"), F.col(tid).cast("long").alias("target_id"), F.lit(kind).alias("relation_type"), at.cast("int").alias("line_number"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polymorphic edges.  Each branch reads two or three columns; a filter on a type prunes whole branches."""
    from ..operators.graph import dealt

    t = lambda n: read(spark, sf_dir, n)
    lines = t("lineitem").select("l_partkey", "l_suppkey")
    return reduce(DataFrame.unionByName, [
        _edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "located_in"),
        _edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "located_in"),
        _edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "part_of"),
        _edge(t("orders"), "order", "o_orderkey", "customer", "o_custkey", "placed_by"),
        _edge(t("lineitem"), "order", "l_orderkey", "part", "l_partkey", "contains_part", "l_linenumber"),
        _edge(dealt(lines, lines.count(), "l_partkey", "l_suppkey").distinct(), "part", "l_partkey", "supplier", "l_suppkey", "supplied_by"),
    ])


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified index of named entities."""
    def one(name, kind, entity, ident, label):
        return read(spark, sf_dir, name).select(F.lit(kind).alias("symbol_type"), F.lit(entity).alias("entity_type"), F.col(ident).cast("long").alias("entity_id"), label.alias("symbol_name"))

    return reduce(DataFrame.unionByName, [
        one("region", "region", "geo", "r_regionkey", F.col("r_name")), one("nation", "nation", "geo", "n_nationkey", F.col("n_name")),
        one("customer", "customer", "party", "c_custkey", F.col("c_name")), one("supplier", "supplier", "party", "s_suppkey", F.col("s_name")),
        one("part", "part", "item", "p_partkey", F.col("p_name")), one("orders", "order", "document", "o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string"))),
    ])


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between a user's consecutive events, with outcome counters."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = read(spark, sf_dir, "events").select(F.col("event_type").alias("parent"), F.lead("event_type").over(w).alias("child"), "value").where("child is not null")
    n = lambda c: F.count_if(c)
    v = F.col("value")
    return steps.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("games_count"), n(v >= 66).alias("wins"), n((v >= 33) & (v < 66)).alias("draws"), n(v < 33).alias("losses"))


#: The same views for a SQL engine that has the tables.
RELATIONS_SQL = """relations_v as (
select 'customer' source_type, c_custkey source_id, 'nation' target_type, cast(c_nationkey as bigint) target_id, 'located_in' relation_type, 0 line_number from customer
union all select 'supplier', s_suppkey, 'nation', cast(s_nationkey as bigint), 'located_in', 0 from supplier
union all select 'nation', cast(n_nationkey as bigint), 'region', cast(n_regionkey as bigint), 'part_of', 0 from nation
union all select 'order', o_orderkey, 'customer', o_custkey, 'placed_by', 0 from orders
union all select 'order', l_orderkey, 'part', l_partkey, 'contains_part', l_linenumber from lineitem
union all select distinct 'part', l_partkey, 'supplier', l_suppkey, 'supplied_by', 0 from lineitem)"""
SYMBOLS_SQL = """symbols_v as (
select 'region' symbol_type, 'geo' entity_type, cast(r_regionkey as bigint) entity_id, r_name symbol_name from region
union all select 'nation','geo',cast(n_nationkey as bigint),n_name from nation
union all select 'customer','party',c_custkey,c_name from customer
union all select 'supplier','party',s_suppkey,s_name from supplier
union all select 'part','item',p_partkey,p_name from part
union all select 'order','document',o_orderkey,concat('Order#',cast(o_orderkey as varchar)) from orders)"""
MOVES_SQL = """moves_v as (
select parent, child, count(*) games_count, count(*) filter (value >= 66) wins, count(*) filter (value >= 33 and value < 66) draws, count(*) filter (value < 33) losses
from (select event_type parent, lead(event_type) over (partition by user_id order by ts, event_id) child, value from events) t where child is not null group by parent, child)"""

"""Edges stored by kind, and kinds that are rebuilt as a whole.

The table is partitioned by relation_type.  A rebuild writes one kind's rows with
dynamic partition overwrite, so other kinds are neither read nor written, and a
rebuild that is run again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import resolve
from ..operators.predicates import trimmed
from .shared import removed, written

COLUMNS = "source_type string, source_id long, target_type string, target_id long, confidence string, line_number int, relation_type string"
SUBSCRIBES = "subscribes_to_event"


def save(edges: DataFrame, path: str) -> None:
    edges.select(*[c.split()[0] for c in COLUMNS.split(", ")]).write.partitionBy("relation_type").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).parquet(path)


def rebuild(edges: DataFrame, path: str, relation_type: str) -> int:
    """Replaces all edges of one kind by ``edges``, which may be made from the table itself; their number."""
    rows = written(edges.withColumn("relation_type", F.lit(relation_type)).select(*[c.split()[0] for c in COLUMNS.split(", ")]), "edges")
    n = rows.count()
    if n:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("relation_type").parquet(path)
    else:  # without a row, no partition would be overwritten
        removed(edges.sparkSession, f"{path.rstrip('/')}/relation_type={relation_type}")
    return n


def subscriptions(contracts: DataFrame) -> DataFrame:
    """Edges from callback contracts to the event they use: the newest event of that name in the named module, else the newest of that name.

    Names match without regard to case and space around them; a callback that uses nothing, or nothing known, has no edge."""
    low = lambda c: F.lower(trimmed(c))
    callbacks = contracts.where((F.lower("contract_kind") == "callback_event") & (trimmed("used_object_name") != ""))
    wanted = callbacks.select(F.col("id").alias("source_id"), low("used_object_name").alias("__name"), F.coalesce(low("used_module_sys_name"), F.lit("")).alias("__module"))
    events = contracts.where(F.lower("contract_kind") == "event").select("id", F.lower("contract_name").alias("__name"), F.lower("owner_module").alias("__module"))
    found = resolve(wanted, (events.where("__module != ''"), ["__name", "__module"]), (events, ["__name"])).where("id is not null")
    return found.select(
        F.lit("api_contract").alias("source_type"), "source_id", F.lit("api_contract").alias("target_type"), F.col("id").alias("target_id"), F.lit("xml").alias("confidence"), F.lit(1).alias("line_number"),
    ).distinct()


def rebuild_subscriptions(contracts: DataFrame, path: str) -> int:
    return rebuild(subscriptions(contracts), path, SUBSCRIBES)

"""Output shapes of a query's answer.  Envelopes are for answers with a limit; larger ones go to ``ndjson``."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT_VERSION = "1.0"


class InvalidArguments(ValueError):
    """The query was called without what it needs."""


class Unconfigured(RuntimeError):
    """There is no catalog to ask."""


class Unavailable(RuntimeError):
    """The catalog's storage does not answer."""


class NoSchema(RuntimeError):
    """The catalog's tables could not be made."""


# The codes of an error, by its class; the first that fits holds.
CODES = [
    (Unconfigured, "config_error"), (Unavailable, "database_unavailable"), (NoSchema, "schema_init_failed"), ((ValueError, TypeError, KeyError), "invalid_arguments"), (PySparkException, "query_failed"),
]


def success(df: DataFrame, command: str, limit: int, filters: dict[str, Any] | None = None, output: str = "", summary: dict | None = None) -> dict:
    """The answer as one object; empty filters and an empty summary are left out.  Takes at most ``limit`` rows to the driver."""
    items = [json.loads(r[0]) for r in df.limit(limit).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    meta = {"limit": limit} | ({"filters": kept} if (kept := {k: v for k, v in (filters or {}).items() if v}) else {}) | ({"output": output} if output else {})
    body = {"success": True, "format_version": FORMAT_VERSION, "command": command, "count": len(items), "items": items}
    return body | ({"summary": summary} if summary else {}) | {"meta": meta}


def error_code(error: Exception) -> str:
    return next((code for kind, code in CODES if isinstance(error, kind)), "internal_error")


def failure(error: Exception, command: str) -> dict:
    return {"success": False, "format_version": FORMAT_VERSION, "command": command, "error": {"code": error_code(error), "message": str(error)}}


def stamp(moment: Column | str) -> Column:
    """A time as text with its offset, in the session's zone: 2024-01-31T10:00:00Z."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssXXX")


def ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line, written by the executors."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


#: The columns that name an answer row's kind, and those of its two ends.
KIND_COLUMNS = ["type", "entity_type", "caller_type", "report_type", "scenario_type"]
ENDS = ["source", "target"]


def summary(df: DataFrame) -> DataFrame:
    """One row: count, rows by kind, relation and end types, distinct files, distinct names of the ends.

    Columns that the answer lacks count nothing; null and empty values do not
    count; a map without entries is null.  Each map is counted where the rows
    are: only types and their counts are gathered, by one row a type.
    """
    has = set(df.columns)
    parts = [F.struct(F.lit("kinds").alias("of"), F.col(c).cast("string").alias("value")) for c in KIND_COLUMNS if c in has]
    parts += [F.struct(F.lit("relation_types").alias("of"), F.col("relation_type").cast("string").alias("value")) for _ in has & {"relation_type"}]
    for end in ENDS:
        if f"{end}_type" in has:
            parts.append(F.struct(F.lit(f"{end}_types").alias("of"), F.col(f"{end}_type").cast("string").alias("value")))
        parts += [F.struct(F.lit(of).alias("of"), F.col(f"{end}_{c}").cast("string").alias("value")) for of, c in (("files", "file"), ("names", "name")) if f"{end}_{c}" in has]
    parts += [F.struct(F.lit("files").alias("of"), F.col("file").cast("string").alias("value")) for _ in has & {"file"}]
    maps = ["kinds", "relation_types", "source_types", "target_types"]
    parts.append(F.struct(F.lit("rows").alias("of"), F.lit("all").alias("value")))
    values = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("value != ''").groupBy("of", "value").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("value", "n")
    gathered = values.agg(
        F.coalesce(F.sum(F.when(F.col("of") == "rows", F.col("n"))), F.lit(0)).alias("count"),
        *[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("of") == m, entry)))).alias(m) for m in maps],
        F.count_if(F.col("of") == "files").alias("files"), F.count_if(F.col("of") == "names").alias("distinct_targets"),
    )
    return gathered.select("count", *[F.when(F.size(m) > 0, F.col(m)).alias(m) for m in maps], "files", "distinct_targets")

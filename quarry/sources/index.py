"""An index of files that is made once and then follows the files: new and changed ones are read, gone ones go with all their rows.

The index is a ``Store``: the table of files, and a table for each extractor,
keyed by file.  A run compares digests, hands the text of changed files alone to
the extractors, and commits every table at once; a run that dies leaves the
index as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import snapshot_diff
from .shared import written
from .store import Change, Store, Table

#: An extractor: from (file_id, text) rows to rows with file_id.
Extractor = Callable[[DataFrame], DataFrame]
FILES = Table("file_id long, digest string, size_bytes long", "file_id")
SYMBOLS = Table("file_id long, symbol_name string, line_number int", "file_id")


def open_index(spark: SparkSession, path: str, tables: Mapping[str, Table], buckets: int = 64) -> Store:
    """The index at ``path``, made if there is none; every table but ``files`` is keyed by file_id."""
    if any(t.key != "file_id" for t in tables.values()):
        raise ValueError("an extractor's table is keyed by file_id")
    return Store(spark, path, {"files": FILES, **tables}, buckets)


def update(store: Store, files: DataFrame, extractors: Mapping[str, Extractor]) -> dict[str, int]:
    """Brings the index to ``files`` (file_id, text): the number of files added, updated, deleted and unchanged.  The first run adds all.

    File ids are unique and not null; a null text counts as empty.  Of two runs at once, one ends with ``Conflict`` and changes nothing."""
    since = store.version()
    now = files.select("file_id", F.coalesce("text", F.lit("")).alias("text"))
    digests = now.select("file_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size_bytes"))
    status = written(snapshot_diff(store.read("files", since), digests, "file_id", "digest"), "index-status")
    counts = {"added": 0, "updated": 0, "deleted": 0, "unchanged": 0} | {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts["added"] + counts["updated"] + counts["deleted"] == 0:
        return counts
    gone = status.where("status in ('updated', 'deleted')").select("file_id")
    fresh = status.where("status in ('added', 'updated')").select("file_id")
    changed = now.join(fresh, "file_id", "left_semi")
    changes = {"files": Change(gone, digests.join(fresh, "file_id", "left_semi"))}
    store.commit(changes | {name: Change(gone, run(changed)) for name, run in extractors.items()}, since=since)
    return counts


def symbols(files: DataFrame) -> DataFrame:
    """(file_id, symbol_name, line_number): every capitalised ASCII name once, with the first line that has it."""
    lines = files.select("file_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    names = lines.select("file_id", (F.col("at") + 1).alias("line_number"), F.explode(F.regexp_extract_all("line", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("symbol_name"))
    return names.groupBy("file_id", "symbol_name").agg(F.min("line_number").alias("line_number"))

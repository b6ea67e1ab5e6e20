"""Tables that change as a whole or not at all: copy-on-write Parquet under a manifest.

Below the store's folder lie

    data/<table>/<commit>/bucket=<n>/*.parquet    rows by the hash of the table's key
    manifests/<version>.json                      which commits' folders are live for each bucket

A commit reads the buckets that its changes touch, writes those anew into a
folder of its own, and then puts the next manifest in place by one rename that
fails if another commit was first.  Until then, and after a commit that died,
readers see the manifest before; what they read is never changed or removed
(``vacuum`` removes it when asked).  The cost of a commit follows the touched
buckets, not the table; a manifest has a line a bucket, whatever the rows.

The driver holds manifests and the numbers of touched buckets only.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import hadoop, removed, written


class Conflict(RuntimeError):
    """Another commit was first; begin again from the new version."""


class Table(NamedTuple):
    """Columns as DDL and the key column: rows of one key lie in one bucket and change together."""

    columns: str
    key: str


class Change(NamedTuple):
    """Keys (in the table's key column) whose rows go, and the rows that come, those of changed keys among them."""

    gone: DataFrame | None = None
    rows: DataFrame | None = None


def typed(rows: DataFrame, columns: str) -> DataFrame:
    """Rows with the declared columns, in their order and types."""
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromDDL(columns)])


class Store:
    """A store's versions.  ``tables`` and ``buckets`` count when it is made; later both are read from its manifest."""

    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, Table] | None = None, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        if self.version() is None:
            if not tables:
                raise FileNotFoundError(f"no store at {path}")
            made = {n: {"columns": t.columns, "key": t.key, "live": {}} for n, t in tables.items()}
            self._put({"version": 0, "buckets": buckets, "tables": made, "marks": {}})

    # --- manifests --------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        files, at = hadoop(self.spark, f"{self.path}/manifests")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def version(self) -> int | None:
        return max(self._versions(), default=None)

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        version = self.version() if version is None else version
        files, at = hadoop(self.spark, f"{self.path}/manifests/{version:012d}.json")
        stream = files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _put(self, manifest: dict[str, Any]) -> None:
        final = f"{self.path}/manifests/{manifest['version']:012d}.json"
        files, made = hadoop(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = files.create(made)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        nothing = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(made).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(made), files.makeQualified(hadoop(self.spark, final)[1]), nothing)
        except Exception as error:
            files.delete(made, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {manifest['version']} is there already") from error
            raise

    # --- reading ----------------------------------------------------------------------------

    def bucket(self, name: str, manifest: dict[str, Any] | None = None, key: Column | None = None) -> Column:
        manifest = manifest or self.manifest()
        return F.pmod(F.xxhash64(F.col(manifest["tables"][name]["key"]) if key is None else key), F.lit(manifest["buckets"])).cast("int")

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a version (the newest, if none is given); of some buckets only, if they are named."""
        return self._read(self.manifest(version), name, buckets)

    def _read(self, manifest: dict[str, Any], name: str, buckets: list[int] | None = None) -> DataFrame:
        table = manifest["tables"][name]
        wanted = {int(b): folders for b, folders in table["live"].items() if buckets is None or int(b) in set(buckets)}
        paths = [f"{self.path}/data/{name}/{folder}/bucket={b}" for b, folders in sorted(wanted.items()) for folder in folders]
        return self.spark.read.schema(table["columns"]).parquet(*paths) if paths else self.spark.createDataFrame([], table["columns"])

    def mark(self, stream: str) -> int:
        """The last batch that a stream has committed; -1 for none."""
        return self.manifest()["marks"].get(stream, -1)

    # --- changing ---------------------------------------------------------------------------

    def commit(self, changes: Mapping[str, Change], mark: tuple[str, int] | None = None, since: int | None = None) -> dict[str, int]:
        """Applies the changes of all tables as one new version; the number of buckets that each table had written.

        ``mark`` is a stream and its batch: a batch that has been committed before changes nothing.  ``since`` is
        the version that the changes were made from: if there is a newer one, nothing is changed either (``Conflict``)."""
        manifest = self.manifest()
        if since is not None and manifest["version"] != since:
            raise Conflict(f"made from version {since}, but {manifest['version']} is there")
        if mark and manifest["marks"].get(mark[0], -1) >= mark[1]:
            return {}
        live, counts = {}, {}
        for name, change in changes.items():
            live[name], counts[name] = self._rewritten(manifest, name, change)
        tables = {n: t | {"live": live.get(n, t["live"])} for n, t in manifest["tables"].items()}
        self._put(manifest | {"version": manifest["version"] + 1, "tables": tables, "marks": manifest["marks"] | (dict([mark]) if mark else {})})
        return counts

    def append(self, rows: Mapping[str, DataFrame]) -> None:
        """Adds rows to tables, whatever keys they have, without reading what is there: a bucket gets one more folder."""
        manifest = self.manifest()
        tables = dict(manifest["tables"])
        for name, new in rows.items():
            folder, made = self._put_rows(manifest, name, typed(new, tables[name]["columns"]))
            live = tables[name]["live"]
            tables[name] = tables[name] | {"live": live | {b: [*live.get(b, []), folder] for b in made}}
        self._put(manifest | {"version": manifest["version"] + 1, "tables": tables})

    def _put_rows(self, manifest: dict[str, Any], name: str, rows: DataFrame) -> tuple[str, set[str]]:
        """The folder that holds the rows now, and the buckets in it."""
        folder = f"{manifest['version'] + 1:012d}-{uuid.uuid4().hex[:12]}"
        target = f"{self.path}/data/{name}/{folder}"
        rows.withColumn("bucket", self.bucket(name, manifest)).hint("rebalance", "bucket").sortWithinPartitions("bucket", manifest["tables"][name]["key"]).write.partitionBy("bucket").parquet(target)
        files, at = hadoop(self.spark, target)
        return folder, {str(int(s.getPath().getName()[7:])) for s in files.listStatus(at) if s.getPath().getName().startswith("bucket=")}

    def _rewritten(self, manifest: dict[str, Any], name: str, change: Change) -> tuple[dict[str, list[str]], int]:
        table = manifest["tables"][name]
        key = table["key"]
        if change.gone is None and change.rows is None:
            return table["live"], 0
        rows = None if change.rows is None else written(typed(change.rows, table["columns"]), f"{name}-rows")
        parts = [df.select(F.col(key).alias("__key")) for df in (change.gone, rows) if df is not None]
        keys = written((parts[0] if len(parts) == 1 else parts[0].union(parts[1])).distinct(), f"{name}-keys")
        touched = [r[0] for r in keys.select(self.bucket(name, manifest, F.col("__key"))).distinct().collect()]  # as many as there are buckets, at most
        if not touched:
            return table["live"], 0
        left = self._read(manifest, name, touched).join(keys, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        new = left if rows is None else left.unionByName(rows)
        folder, made = self._put_rows(manifest, name, new)
        return {b: f for b, f in table["live"].items() if int(b) not in set(touched)} | {b: [folder] for b in made}, len(touched)

    def upsert(self, name: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, mark: tuple[str, int] | None = None) -> dict[str, int]:
        """Rows replace those of their keys; with ``merge``, what it makes of the old rows of those keys and the new rows does."""
        since = self.version() if merge else None
        return self.commit({name: self.merged(name, rows, merge)}, mark, since)

    def merged(self, name: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Change:
        if merge is None:
            return Change(rows=rows)
        manifest = self.manifest()
        key = manifest["tables"][name]["key"]
        rows = written(rows, f"{name}-new")
        keys = rows.select(F.col(key).alias("__key")).distinct()
        touched = [r[0] for r in keys.select(self.bucket(name, manifest, F.col("__key"))).distinct().collect()]
        old = self._read(manifest, name, touched).join(keys, F.col(key).eqNullSafe(F.col("__key")), "left_semi")
        return Change(rows=merge(old, rows))

    def vacuum(self) -> int:
        """Removes older manifests and every folder that the newest does not use; the number of folders.  For times without readers of old versions."""
        manifest = self.manifest()
        gone = 0
        for v in self._versions()[:-1]:
            removed(self.spark, f"{self.path}/manifests/{v:012d}.json")
        for name, table in manifest["tables"].items():
            files, at = hadoop(self.spark, f"{self.path}/data/{name}")
            for status in files.listStatus(at) if files.exists(at) else []:
                if status.getPath().getName() not in {f for folders in table["live"].values() for f in folders}:
                    gone += files.delete(status.getPath(), True)
        return gone

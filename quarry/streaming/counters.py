"""Counters that follow a stream of files, each file's rows counted once.

A micro-batch is summed by key and merged into a ``Store``: counters add, a rating
is the mean weighted by the counter of its rows, and the first annotation and
code that a key got stay.  The same commit writes the batch's number and the
digests of its files, so a batch that is run again after a failure changes
nothing, and neither does a file that is delivered again under another name or
after the stream's checkpoint was lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lookup import accumulate
from ..sources.shared import written
from ..sources.store import Change, Store, Table

#: Rows of a batch that one task sums up, about: tasks grow in number with the batch, not in size.
ROWS = 500_000
ADDED = ["games_count", "wins", "draws", "losses"]
TABLES = {
    "counters": Table("name string, games_count long, wins long, draws long, losses long, rating double, annotation string, code string, since timestamp", "name"),
    "taken": Table("digest string, rows long", "digest"),
}


def batch_counts(events: DataFrame, name: Column, tasks: int | None = None) -> DataFrame:
    """A batch's counters by name: events with their value as won (66 and over), drawn (33 and over) or lost, its mean as rating, the earliest event's kind and day.

    Which event came first is settled by sorting a task's rows; with ``tasks`` they are dealt by name over so many (where these are
    more than the session's) first."""
    v = F.col("value")
    rows = events.select(name.alias("name"), v.alias("v"), "ts", F.struct("ts", "event_id").alias("place"), "event_type")
    if tasks and tasks > int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, "name")
    hit = lambda c: F.count_if(c).alias
    return rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("games_count"), hit(F.col("v") >= 66)("wins"), hit((F.col("v") >= 33) & (F.col("v") < 66))("draws"), hit(F.col("v") < 33)("losses"), F.avg("v").alias("rating"),
        F.min_by("event_type", "place").alias("annotation"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("code"), F.min("ts").alias("since"),
    )


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a key has after a batch; what came first stays, whatever the time it bears."""
    return accumulate(old, new, ["name"], ADDED, {"rating": "games_count"}, ["annotation", "code", "since"])


def _taken(batch: DataFrame) -> DataFrame:
    """Files by content: rows and a digest that does not hang on their order."""
    columns = [c for c in batch.columns if c != "__file"]
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    return batch.groupBy("__file").agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(row), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)"))).alias("digest"), F.count(F.lit(1)).alias("rows"))


def take(store: Store, batch: DataFrame, number: int, stream: str, name: Column) -> dict[str, int]:
    """One micro-batch of events with ``__file``, the file of each row."""
    since = store.version()
    if store.mark(stream) >= number:
        return {}
    files = _taken(batch)
    fresh = files.join(store.read("taken").select("digest"), "digest", "left_anti")
    once = fresh.groupBy("digest").agg(F.min("__file").alias("__file"), F.first("rows").alias("rows"))  # the same content twice in a batch counts once
    once = written(once, "taken-files")
    tasks = -(-once.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] // ROWS)
    events = batch.join(once.select("__file"), "__file", "left_semi")
    return store.commit({"counters": store.merged("counters", batch_counts(events, name, tasks), merge), "taken": Change(rows=once.select("digest", "rows"))}, (stream, number), since)


def follow(spark: SparkSession, folder: str, schema, store: Store, checkpoint: str, name: Column, stream: str = "events", glob: str = "*.parquet", files_a_batch: int = 1000) -> StreamingQuery:
    """Takes what is new in ``folder`` and ends.  ``checkpoint`` lies in a shared folder; a new one needs a new ``stream`` name, as its batches begin at 0."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", glob).parquet(folder).select("*", F.col("_metadata.file_path").alias("__file"))
    run = lambda batch, number: take(store, batch, number, stream, name) and None
    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

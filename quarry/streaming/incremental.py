"""Incremental runs of batch functions: a file stream whose checkpoint is the list of files already taken."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def new_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """The files below ``root`` as a stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def process_new(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch function to what is new since the last run and puts it below ``target``, one folder a batch.

    A batch that is repeated after a failure replaces its own folder, so no row
    is written twice.  ``checkpoint`` must lie in a shared folder.
    """

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

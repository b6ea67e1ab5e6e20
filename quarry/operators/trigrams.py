"""A substring index: which texts have which three characters in a row.

Two tables of a ``Store``: the texts by id, and for each trigram of the texts in
lower case sorted lists of ids, cut into parts so that a trigram which every text
has is many short rows.  A batch of texts is appended to both without reading
what is there; tasks gather the lists of their own texts before the shuffle.  A search reads the lists of the pattern's trigrams, begins with
the shortest, and compares only the texts that are in all it takes; of those it
reads the buckets that hold any.
"""

from __future__ import annotations

import re

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.store import Store, Table
from .anchors import groups

#: Ids of a list's part, about; and the lists that a search intersects.
PART, LISTS = 50_000, 3


def open_index(spark: SparkSession, path: str, id_type: str = "long", buckets: int = 64) -> Store:
    return Store(spark, path, {"texts": Table(f"id {id_type}, text string", "id"), "lists": Table(f"gram string, part int, n long, ids array<{id_type}>", "gram")}, buckets)


_BITS = 21  # of a code point


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, part, ids) of a task's texts (part, id, text), some texts at a time; each id once."""
    for some, points, begin in groups(batches):
        points = points.astype(np.uint64)
        code = points[:-2] << np.uint64(2 * _BITS) | points[1:-1] << np.uint64(_BITS) | points[2:]
        text = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(points))))
        whole = (text[:-2] == text[2:]) & (points[2:] != 0x110000)
        seen, number = np.unique(code[whole], return_inverse=True)
        each = np.unique(number * len(begin) + text[:-2][whole])  # a gram and a text, once
        gram, row = each // len(begin), each % len(begin)
        part = some.column(0).to_numpy()[row]
        order = np.lexsort((part, gram))
        gram, row, part = gram[order], row[order], part[order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(gram) != 0) | (np.diff(part) != 0)])) if len(gram) else gram
        kinds = seen[gram[starts]]
        mask = np.uint64((1 << _BITS) - 1)
        three = np.stack([kinds >> np.uint64(2 * _BITS), kinds >> np.uint64(_BITS) & mask, kinds & mask], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(gram)), pa.int32()), some.column(1).take(pa.array(row)))
        yield pa.RecordBatch.from_arrays([pa.array([three[i : i + 3] for i in range(0, len(three), 3)], pa.string()), pa.array(part[starts], pa.int32()), lists], ["gram", "part", "ids"])


def add(store: Store, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Appends texts whose ids are new to the index; null texts have no trigrams and are never found."""
    rows = written(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null"), "indexed")
    parts = max(1, -(-rows.count() // PART))
    kind = rows.schema["id"].dataType.simpleString()
    some = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", F.lower("text").alias("text")).mapInArrow(_grams, f"gram string, part int, ids array<{kind}>")
    lists = some.groupBy("gram", "part").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    store.append({"texts": rows, "lists": lists.select("gram", "part", F.size("ids").cast("long").alias("n"), "ids")})


def wanted(pattern: str) -> list[str]:
    """The trigrams that a text needs to match: those of the stretches between the wildcards ``%`` and ``_``."""
    runs = re.split("[%_]", pattern.lower())
    return sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})


def search(store: Store, pattern: str) -> DataFrame:
    """(id, text) of the texts that hold the pattern, without regard to case; ``%`` is any run in it, ``_`` any character.

    A pattern without three characters in a row is compared with every text."""
    spark, need, like = store.spark, wanted(pattern), F.col("text").ilike(f"%{pattern}%")
    if not need or "\\" in pattern:
        return store.read("texts").where(like)
    places = spark.createDataFrame([(g,) for g in need], "gram string")
    buckets = [r[0] for r in places.select(store.bucket("lists")).distinct().collect()]  # as many as the pattern has characters
    lists = store.read("lists", buckets=buckets).where(F.col("gram").isin(need))
    sizes = sorted((r["n"], r["gram"]) for r in lists.groupBy("gram").agg(F.sum("n").alias("n")).collect())
    if len(sizes) < len(need):
        return store.read("texts", buckets=[]).select("id", "text")
    rarest = [g for _, g in sizes[:LISTS]]
    ids = lists.where(F.col("gram").isin(rarest)).select("gram", F.explode("ids").alias("id")).groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(rarest))
    met = written(ids.select("id"), "candidates")
    hold = [r[0] for r in met.select(store.bucket("texts")).distinct().collect()]  # as many as there are buckets, at most
    return store.read("texts", buckets=hold).join(met, "id", "left_semi").where(like)

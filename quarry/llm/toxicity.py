"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of lower-cased words, word pairs and pairs with one
word between, hashed to 2^20 places.  Training runs in one task over a bounded
sample of labelled rows (at most ``most_rows`` of them and ``most_bytes`` of
text, chosen by hash; both are parameters):
per-coordinate learning rates and L1 give a sparse weight vector of a few
thousand entries at most, which is what is broadcast to score every text whole.

The score depends on the text alone.  Defined results: null and empty texts
score what the intercept gives; rows labelled more than once count with the mean
of their labels (1 from a half on); without labels of both kinds every score is
that of the intercept; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, text_of

BITS = 20
#: Labelled rows that training reads at most.
MOST_ROWS = 8_000
#: Bytes of text that training holds at most.
MOST_BYTES = 256 << 20
#: Words of a text are hashed through a memo of this size.
MEMO = 100_000
#: Weights are broadcast; L1 keeps far fewer, and this is the bound.
MOST_WEIGHTS = 100_000

_WORD = re.compile(r"\w+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return value


_hashes = _Hashes()


def features(text: str) -> np.ndarray:
    """Places (with repeats) of a text's words, pairs and skip pairs."""
    words = _WORD.findall(text.lower())
    h = np.fromiter((_hashes[w] for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pair = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]
        skip = h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] + np.uint64(1)
        mixed = np.concatenate([h, pair, skip])
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def train(texts: Iterable[str], labels: list[int], *, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the nonzero weights, and the intercept."""
    n, z = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_n = bias_z = 0.0
    rows = [(np.unique(features(t)), y) for t, y in zip(texts, labels)]

    def weight(z, n, l1=l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for at, y in rows:
            w = weight(z[at], n[at])
            bias = float(-bias_z / ((beta + math.sqrt(bias_n)) / alpha))
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(w.sum()))))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    w = weight(z, n)
    at = np.flatnonzero(w)
    return at, w[at], float(-bias_z / ((beta + math.sqrt(bias_n)) / alpha))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> DataFrame:
    """(id, text, y): at most ``most_rows`` labelled documents, chosen by a hash of their id.  The ids are bounded, so they are broadcast."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(11)), "id").limit(most_rows)
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")


def fit(rows: DataFrame, most_bytes: int = MOST_BYTES, **options) -> list[tuple[int, float]]:
    """Trains in one task on (id, text, y) rows; the weights, with the intercept at place -1.

    Rows are taken in the order of their ids' hashes until their texts reach ``most_bytes``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        texts, left = table.column("text"), most_bytes
        chosen = []
        for at in sorted(range(table.num_rows), key=lambda i: (zlib.crc32(str(table.column("id")[i].as_py()).encode()), i)):
            left -= len(texts[at].as_buffer() or b"")
            if left < 0:
                break
            chosen.append(at)
        table = table.take(pa.array(sorted(chosen), pa.int64()))
        at, w, bias = train((t.as_py() for t in table.column("text")), table.column("y").to_pylist(), **options)
        return pa.table({"at": pa.array([-1, *at.tolist()], pa.int64()), "w": pa.array([bias, *w.tolist()], pa.float64())})

    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(run, "at long, w double").limit(MOST_WEIGHTS + 2).collect()
    if len(found) > MOST_WEIGHTS + 1:
        raise ValueError(f"more than {MOST_WEIGHTS} weights: raise l1")
    return [(r.at, r.w) for r in found]


class Scorer:
    """The score of a text by given weights."""

    def __init__(self, weights: list[tuple[int, float]]):
        self.bias = sum(w for at, w in weights if at < 0)
        self.dense = np.zeros(1 << BITS)
        for at, w in weights:
            if at >= 0:
                self.dense[at] = w
        self.on = self.dense != 0

    def __call__(self, text: str | None) -> float:
        at = features(text or "")
        total = self.bias + self.dense[np.unique(at[self.on[at]])].sum()
        return float(1 / (1 + math.exp(-max(-35.0, min(35.0, total)))))


def score(docs: DataFrame, weights: list[tuple[int, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            s = [scorer(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.transform(in_arrow, run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def held_out(id_col: str = "doc_id"):
    """Fold 0 of 5 by crc32 of the id as text is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_labels(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, **options) -> list[tuple[int, float]]:
    return fit(sample(docs, labels.where(~held_out()), most_rows=most_rows), **options)


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that score under 0.5, with their columns; the score is taken in the same pass as the row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_labels(docs, labels, **options))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer(text.as_py()) < 0.5 for text in batch.column(place)], pa.bool_()))

    return docs.transform(in_arrow, run, docs.schema)

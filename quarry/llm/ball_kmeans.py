"""Centroid clustering: exact k-means by balls.

Vectors are packed into blocks of a few thousand, a row each, and stay in their
block.  A round is one pass over the blocks.  Inside a block the members of a
cluster are a ball: its centroid and the distance of its farthest member, the
radius r.  By the triangle inequality

* only centroids within 2r of the ball's own can be nearer to any member (the
  neighbours; their distances come from the k x k table of centroids);
* with the neighbours in order of distance, a member at distance d of its
  centroid need be compared with those within 2d alone.  Members within half the
  distance of the first neighbour are the stable core and are not compared at
  all; the others lie in annuli, each of which is compared with the neighbours
  that its members can reach.

Nothing is approximate: components are integers, squared distances exact, ties
go to the smaller number, and a neighbour is passed over only if it is strictly
farther.  The first round has no balls yet and compares with every centroid.

A block's row also carries the sums of each cluster's members in it; the next
centroids are those columns alone, read from the written table and added by
Spark: k rows of ``dim`` sums reach the driver, never vectors.  Each round's
table replaces the last one in the shared folder, so a lost executor costs its
tasks of one round and no more than two tables exist at a time.

Defined results: vectors of another length, or with a null or non-finite
component, are left out, null vectors too; a null id is the empty string in the
start order; rows of one start key are ordered by their components; repeated
rows each count and each give a row; with fewer than k vectors there are fewer
centroids; without any the result is empty; other columns are ignored.
Components of ``MOST`` or more raise an error, as a squared distance would not
fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_at, in_arrow, remove, scratch

#: Components below this give squared distances (times 4) that fit a long.
MOST = 1 << 25
#: Components below this give squared distances that are exact in doubles.
EXACT = 1 << 22


def kept(df: DataFrame, vec_col: str = "embedding", dim: int = 64) -> Column:
    """Whether a vector has exactly ``dim`` components, none null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & F.forall(F.col(vec_col).cast("array<double>"), finite)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors x to centroids c, as longs."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def to_all(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on a tie) and squared distance, by comparing with all."""
    d = squared(x, centroids)
    label = d.argmin(1)
    return label.astype(np.int32), d[np.arange(len(x)), label]


def by_balls(x: np.ndarray, label: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from the last round's clusters as balls; also the number of distances computed."""
    between = squared(centroids, centroids)
    own = ((x - centroids[label]) ** 2).sum(1)
    new, best, made = label.copy(), own.copy(), len(x)
    for i in np.unique(label):
        members = np.flatnonzero(label == i)
        diameter = 4 * int(own[members].max())
        near = np.flatnonzero(between[i] <= diameter)
        near = near[near != i]
        if not len(near):
            continue  # the whole ball is stable
        near = near[np.argsort(between[i][near], kind="stable")]
        reach = np.searchsorted(between[i][near], 4 * own[members], side="right")  # neighbours within 2d: 0 in the core
        for n in np.unique(reach[reach > 0]):
            ring = members[reach == n]
            others = np.sort(np.append(near[:n], i))
            d = squared(x[ring], centroids[others])
            made += d.size
            at = d.argmin(1)
            new[ring], best[ring] = others[at], d[np.arange(len(ring)), at]
    return new, best, made


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _packed(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """Blocks (ids, data): a batch's ids and its integer components as bytes."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.floor(scale * _floats(batch.column(1), dim))
                if np.abs(x).max() >= MOST:
                    raise ValueError(f"a component of {MOST} or more after scaling: squared distances would not fit a long")
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.astype("<i4").tobytes()], pa.binary())], ["ids", "data"])

    return rows.transform(in_arrow, run, f"ids array<{kind}>, data binary")


def _round(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Blocks (ids, data, label, distance, sums): sums has for each cluster its members' components, their number and their distances."""
    k, dim = centroids.shape
    first = "label" not in blocks.columns
    kind = blocks.schema["ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, data = batch.column(0).slice(row, 1), batch.column(1).slice(row, 1)
                x = np.frombuffer(data[0].as_buffer(), "<i4").reshape(-1, dim).astype(np.int64)
                if first:
                    label, distance = to_all(x, centroids)
                else:
                    label, distance, _ = by_balls(x, np.frombuffer(batch.column(2)[row].as_buffer(), "<i4").copy(), centroids)
                sums = np.zeros((k, dim + 2), np.int64)
                np.add.at(sums, label, np.column_stack([x, np.ones(len(x), np.int64), distance]))
                made = [ids, data, *[pa.array([a.tobytes()], pa.binary()) for a in (label.astype("<i4"), distance.astype("<i8"), sums.astype("<i8"))]]
                yield pa.RecordBatch.from_arrays(made, ["ids", "data", "label", "distance", "sums"])

    names = ["ids", "data"] if first else ["ids", "data", "label"]
    return blocks.select(*names).transform(in_arrow, run, f"ids {kind}, data binary, label binary, distance binary, sums binary")


def _totals(blocks: DataFrame, k: int, dim: int) -> np.ndarray:
    """The blocks' sums added: partitions in numpy, their k rows by Spark.  Python integers, so no total overflows here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 2), np.int64)
        for batch in batches:
            for one in batch.column(0):
                total += np.frombuffer(one.as_buffer(), "<i8").reshape(k, dim + 2)
        used = np.flatnonzero(total[:, dim])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = blocks.select("sums").transform(in_arrow, run, "cluster int, sums array<bigint>")
    added = parts.select("cluster", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k rows of dim + 2 at most
    out = np.zeros((k, dim + 2), object)
    for r in added:
        out[r["cluster"], r["at"]] = int(r["s"])
    return out


def starts(rows: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors of smallest digest of ``seed:id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return np.array([[int(np.floor(scale * x)) for x in r["vector"]] for r in found], np.int64)


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, dim: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid array<bigint>) for every kept vector, after ``rounds`` rounds and one more assignment."""
    spark = df.sparkSession
    rows = df.where(kept(df, vec_col, dim)).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    kind = rows.schema["id"].dataType.simpleString()
    centroids = starts(rows, k, seed, scale)
    shape = f"id {kind}, cluster int, distance bigint"
    if not len(centroids):
        return spark.createDataFrame([], f"{shape}, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    if np.abs(centroids).max() >= MOST:
        raise ValueError(f"a component of {MOST} or more after scaling: squared distances would not fit a long")
    path = scratch(spark, "ball-blocks")
    blocks = cut_at(_packed(rows, dim, scale), path)
    for left in range(rounds, -1, -1):
        last, path = path, scratch(spark, "ball-round")
        blocks = cut_at(_round(blocks, centroids), path)
        remove(spark, last)
        totals = _totals(blocks, *centroids.shape)
        if left:
            centroids = np.array([[int(s) // int(t[dim]) for s in t[:dim]] if t[dim] else c.tolist() for t, c in zip(totals, centroids)], np.int64)
    whole = int(totals[:, dim + 1].sum())
    about = [(i, int(t[dim + 1]), whole, c.tolist()) for i, (t, c) in enumerate(zip(totals, centroids))]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                label, distance = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in ((1, "<i4"), (2, "<i8")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1).flatten(), pa.array(label), pa.array(distance)], ["id", "cluster", "distance"])

    each = blocks.select("ids", "label", "distance").transform(in_arrow, unpack, shape)
    return each.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # about: k rows

"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1.  Every source has a weight schedule of its own:
a piecewise linear rate over time, given by knots (time, rate); sources take the
``SCHEDULES`` in turn, in code-point order, so one source's share falls while
another's rises.  A source's target words are spread over time by its schedule:
with W(t) the integral of its rate from 0 to t, the words of the source demanded
by time t are

    D(t) = target * W(t) / W(1)

and the document that begins at word c of its source's stream is assigned the
position t with D(t) = c: the segment whose integral holds c, then the root of a
quadratic.  A source's stream is its documents in a seeded hash order, repeated
once more where the target exceeds its size, so no document is taken more than
twice.  Range-sorting by position gives the training order.

A document's offset in its stream is a prefix sum.  Sources are split into hash
buckets: bucket totals are summed by partial aggregation, a window over at most
``buckets`` rows a source gives bucket offsets, and a window inside each
(source, bucket) the rest, so a source with a third of all rows is spread over
``buckets`` tasks.  The table of sources stays a table: places in code-point
order come from range-sorted parts and the number of sources in each, the level
at which excess is dealt again from a few sums over it.  The driver sees sums
and a count per part, never sources.

Defined results: null or blank text has size 0, is never taken and has no
position; null is a source of its own, ordered last; repeated rows each count;
an empty table gives an empty result; other columns are ignored, or kept as they
are by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WHITE, cut, partitions, text_of

#: Weights by the place of the source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Schedules by the same place, repeating: knots (time, rate).
SCHEDULES = (
    ((0.0, 2.0), (1.0, 1.0)),
    ((0.0, 1.0), (1.0, 3.0)),
    ((0.0, 1.0), (0.5, 2.0), (1.0, 1.0)),
    ((0.0, 1.0), (1.0, 1.0)),
)
#: The table of sources is broadcast up to this many rows; beyond it Spark joins it as any other table.
MOST_BROADCAST = 10_000

Knots = Sequence[tuple[float, float]]


def word_count(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(NOT_WHITE)).cast("long")


def segments(knots: Knots) -> list[tuple[float, float, float, float, float]]:
    """(begin, end, rate at begin, rate at end, share of all words demanded before) of each stretch; shares are exact integrals."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:])) or min(r for _, r in knots) < 0:
        raise ValueError("knots run from time 0 to 1, rising, with rates of at least 0")
    parts = [(a, b, p, q, (b - a) * (p + q) / 2) for (a, p), (b, q) in zip(knots, knots[1:])]
    whole = sum(x[4] for x in parts)
    if not whole:
        raise ValueError("a schedule demands something at some time")
    out, before = [], 0.0
    for a, b, p, q, area in parts:
        out.append((a, b, p / whole, q / whole, before))
        before += area / whole
    return out


def _schedule_literal(schedules: Sequence[Knots]) -> Column:
    kind = "array<struct<begin:double,end:double,at:double,to:double,before:double>>"
    each = [F.array(*[F.struct(*[F.lit(float(x)) for x in s]) for s in segments(k)]).cast(kind) for k in schedules]
    return F.array(*each)


def position(share: Column, schedule: Column) -> Column:
    """The time in [0, 1] by which a source has demanded this share of its words."""
    x = F.least(F.lit(1.0), share)
    s = F.element_at(F.filter(schedule, lambda s: s["before"] <= x), -1)
    # before + at * d + slope * d^2 / 2 = x for the time d since the segment's begin; the form of the root that also holds for slope 0
    need, slope = x - s["before"], (s["to"] - s["at"]) / (s["end"] - s["begin"])
    root = F.sqrt(F.greatest(F.lit(0.0), s["at"] * s["at"] + 2 * slope * need))
    since = F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (s["at"] + root))
    return F.least(s["end"], s["begin"] + since)


def ranked(sources: DataFrame) -> DataFrame:
    """Adds place: the number of sources before, by code point, null last."""
    spark = sources.sparkSession
    ordered = sources.repartitionByRange(partitions(spark), F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    ordered = cut(ordered, "mix-sources").withColumn("inside", inside)
    counts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a part
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    base = F.element_at(F.array(*[F.lit(b) for b in before]), F.col("part") + 1) if before else F.lit(0)
    return ordered.withColumn("place", (base + F.col("inside")).cast("long")).drop("part", "inside")


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds place and target to (source, source_size): ``share`` of all sizes dealt by weight, no source above ``cap`` times its size; the excess is dealt again by weight."""
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    out = cut(ranked(sources).withColumn("weight", F.element_at(kinds, (F.col("place") % len(weights) + 1).cast("int"))), "mix-weights")
    most = F.lit(float(cap)) * F.col("source_size")
    total = float(share) * float(out.agg(F.sum("source_size")).first()[0] or 0)
    # every source gets the same words a weight, or its most: raise that level until the words are dealt
    level = 0.0
    while True:
        full = most <= F.lit(level) * F.col("weight")
        capped, open_ = out.agg(F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (total - (capped or 0.0)) / open_ if open_ else level
        if new <= level:
            break
        level = new
    return out.withColumn("target", F.least(most, F.lit(level) * F.col("weight"))).drop("weight")


def offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = 1024, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(id, source, size, start) rows, where start is the document's first word in its source's stream; and the (source, source_size) table."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    rows = rows.withColumn("key", F.xxhash64(F.col("id").cast("string"), F.lit(seed))).withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 40), F.lit(buckets)).cast("int"))
    rows = cut(rows, "mix-sizes")
    per = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    totals = per.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = per.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(base, F.expr("source <=> s and bucket = b"))
    return joined.select("id", "source", "size", (F.col("base") + F.col("inner")).alias("start")), totals


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, schedules: Sequence[Knots] = SCHEDULES, buckets: int = 1024, seed: int = 7) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, position (of its first copy), position_again (of its second), in training order.

    ``taken`` cuts the last document of a source at the target, so a source's
    taken words are its target rounded to whole words."""
    if not 0 < cap <= 2:
        raise ValueError("a document is taken twice at most")
    rows, totals = offsets(docs, id_col, text_col, source_col, buckets, seed)
    plan = with_targets(totals, weights, share, cap)
    schedule = F.element_at(_schedule_literal(schedules), (F.col("place") % len(schedules) + 1).cast("int"))
    plan = cut(plan.select(F.col("source").alias("s"), "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("words"), schedule.alias("schedule")), "mix-plan")
    plan = F.broadcast(plan) if plan.count() <= MOST_BROADCAST else plan
    joined = rows.join(plan, F.expr("source <=> s")).drop("s")
    took = lambda start: F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - start))
    first, again = took(F.col("start")), took(F.col("start") + F.col("source_size"))
    at = lambda part, start: F.when(part > 0, position(start / F.col("target"), F.col("schedule")))
    out = joined.select(
        "id", "source", "size", "source_size", "target", (first + again).alias("taken"), first.alias("taken_first"), again.alias("taken_again"),
        at(first, F.col("start")).alias("position"), at(again, F.col("start") + F.col("source_size")).alias("position_again"),
    )
    return out.orderBy(F.col("position").asc_nulls_last(), F.col("id"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document once for every copy of which the mix takes at least half, range-sorted by training position; columns as they came.

    Rows that share an id are told apart by source and size; rows alike in all
    three share their decision."""
    plan = mix(docs, id_col, text_col, source_col, **options)
    wanted = F.filter(
        F.array(F.struct(F.col("position").alias("p"), F.col("taken_first").alias("n")), F.struct(F.col("position_again").alias("p"), F.col("taken_again").alias("n"))),
        lambda x: (x["n"] > 0) & (x["n"] * 2 >= F.col("size")),
    )
    copies = plan.select(F.col("id").alias("__quarry_id"), F.col("source").alias("__quarry_source"), F.col("size").alias("__quarry_size"), wanted.alias("__quarry_at")).filter(F.size("__quarry_at") > 0)
    copies = copies.groupBy("__quarry_id", "__quarry_source", "__quarry_size").agg(F.min("__quarry_at").alias("__quarry_at"))
    keyed = docs.withColumn("__quarry_n", word_count(text_col))
    on = keyed[id_col].eqNullSafe(copies["__quarry_id"]) & keyed[source_col].cast("string").eqNullSafe(copies["__quarry_source"]) & (keyed["__quarry_n"] == copies["__quarry_size"])
    out = keyed.join(copies, on).withColumn("__quarry_at", F.explode("__quarry_at"))
    return out.orderBy(F.col("__quarry_at.p"), F.col(id_col)).select(*[F.col(f"`{c}`") for c in docs.columns])

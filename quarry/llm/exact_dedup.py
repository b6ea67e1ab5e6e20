"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row.

Two texts are equal when they are identical after every ASCII white-space
character is deleted.  The steps:

1. one small row per document: md5 of the normalised text, its SHA-256, the
   number of code points.  Repeated rows of a document collapse to one row with
   a count;
2. per hash, a partial aggregation yields the group's size and smallest id (the
   reference member).  A hot group is a few partial rows, not a task's burden;
3. only texts of groups of two or more are fetched: their ids are broadcast up
   to ``MOST_BROADCAST`` of them, beyond it the texts are joined by id.  Each is
   compared, byte by byte, with its group's reference member; members that
   differ (a collision of the 128-bit hash) form groups of their own;
4. the final groups are aggregated again and joined to their members.

Defined results: null text is the empty text; all empty texts form one group;
a null id sorts after every other id; repeated rows (same id, same text) count
as that many members and only one of them is kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, text_of

#: Ids (of about 40 bytes with their hash) are broadcast up to so many rows.
MOST_BROADCAST = 250_000


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), WHITE + "+", "")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text_of(text_col)).cast("long").alias("n"), normalised(text_col).alias("norm"))
    return (
        rows.select("id", "n", F.unhex(F.md5("norm")).alias("h"), F.sha2("norm", 256).alias("sha"))
        .groupBy("h", "id", "n", "sha")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def _order() -> Column:
    """Most code points first, then the smallest id, null last."""
    return F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("z"), F.col("id").alias("id"))


def _few(spark_rows: DataFrame) -> DataFrame:
    """Small rows are sent to every task where they are few; else Spark shuffles both sides."""
    return F.broadcast(spark_rows) if spark_rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else spark_rows


def _collisions(docs: DataFrame, digests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, id, variant): members whose bytes differ from their group's reference member; normally none."""
    groups = digests.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("ref")).filter("members > 1").select("h", "ref")
    members = cut(digests.join(groups, "h").select("h", F.col("id").alias("i"), "ref").distinct(), "exact-members")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = rows.join(_few(members), F.expr("id <=> i")).select("id", "h", "ref", normalised("text").alias("norm")).filter(F.unhex(F.md5("norm")) == F.col("h"))
    texts = cut(texts, "exact-texts")
    ref = texts.filter("id <=> ref").select("h", F.col("norm").alias("ref_norm")).dropDuplicates(["h"])
    return texts.filter("not id <=> ref").join(ref, "h").filter("norm != ref_norm").select("h", "id", F.col("norm").alias("variant")).distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha (hex SHA-256 of the normalised text), h (the 128-bit hash)."""
    digests = cut(_digests(docs, id_col, text_col), "exact-digests")
    odd = _collisions(docs, digests, id_col, text_col)
    rows = digests.join(odd, ["h", "id"], "left").withColumn("variant", F.coalesce("variant", F.lit("")))
    # written first, so that the rows of a very large group are dealt out afresh and can be split
    groups = cut(rows.groupBy("h", "variant").agg(F.min(_order()).alias("first"), F.sum("copies").alias("group_size")), "exact-groups")
    joined = rows.join(groups, ["h", "variant"]).select("h", "id", "n", "sha", "copies", "group_size", F.col("first.id").alias("keep_id"), F.col("first.n").alias("keep_n"))
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "id", "keep_id", "group_size", (F.expr("id <=> keep_id") & (-F.col("keep_n") == F.col("n")) & (F.col("copy") == 1)).alias("kept"), "sha", "h",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with; of repeated rows one."""
    decided = cut(exact_groups(docs, id_col, text_col).select("id", "h", "kept"), "exact-decided")
    twice = cut(decided.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "exact-repeated")
    gone = decided.filter("not kept").select("id").union(twice).distinct().withColumnRenamed("id", "__quarry_id")
    stays = docs.join(_few(gone), docs[id_col].eqNullSafe(F.col("__quarry_id")), "left_anti")
    if twice.isEmpty():
        return stays
    # ids with several rows are told apart by their text: of the kept id and text the longest row
    kept = decided.alias("d").filter("kept").join(twice.alias("t"), F.expr("d.id <=> t.id"), "left_semi")
    kept = kept.select(F.col("id").alias("__quarry_id"), F.col("h").alias("__quarry_h"))
    keyed = docs.withColumn("__quarry_h", F.unhex(F.md5(normalised(text_col)))).withColumn("__quarry_n", F.char_length(text_of(text_col)))
    joined = keyed.join(kept, (keyed[id_col].eqNullSafe(kept["__quarry_id"])) & (keyed["__quarry_h"] == kept["__quarry_h"]), "left_semi")
    one = joined.groupBy("__quarry_h", F.col(id_col).alias("__quarry_key")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "__quarry_n").alias("row"))
    return stays.union(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))

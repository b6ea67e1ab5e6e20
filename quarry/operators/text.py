"""Longest words and exact substring search with byte offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_words(df: DataFrame, column: str, n: int, word: str = r"\p{L}+") -> DataFrame:
    """The n distinct words that take most bytes."""
    words = df.select(F.explode(F.regexp_extract_all(column, F.lit(word), F.lit(0))).alias("word")).distinct()
    return words.select("word", F.octet_length("word").alias("bytes")).orderBy(F.desc("bytes"), "word").limit(n)


#: Code points of a chunk, and of a piece of it: looking from a hit to the next reads no more than a piece.
CHUNK, PIECE = 1 << 16, 1 << 8


def _based(pieces: Column, ahead: int, rest: Column) -> Column:
    """(piece, more, base): each piece, itself with ``ahead`` code points of what follows, and the bytes before it; ``rest`` follows the last one."""
    ends = F.aggregate(pieces, F.array(F.lit(0).cast("long")), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.octet_length(p)))
    part = lambda i: F.coalesce(F.get(pieces, i), F.when(i == F.size(pieces), rest), F.lit(""))
    next_ = lambda i: F.substring(F.concat(part(i + 1), part(i + 2)), 1, ahead)  # noqa: E731  the last piece may be short
    row = lambda p, e: F.transform(p, lambda x, i: F.struct(x.alias("piece"), F.concat(x, next_(i)).alias("more"), F.get(e, i).alias("base")))
    return F.element_at(F.transform(F.array(ends), lambda e: row(pieces, e)), 1)


def _in_piece(piece: Column, more: Column, base: Column, pattern: str) -> Column:
    """Byte offsets of the hits that begin in a piece, each step looking from the last hit on; ``more`` is the piece and what follows it."""
    more = F.substring(more, F.lit(1), F.char_length(piece) + len(pattern) - 1)
    found = F.aggregate(
        F.sequence(F.lit(1), F.floor((F.char_length(more) - F.char_length(F.replace(more, F.lit(pattern), F.lit("")))) / len(pattern)).cast("int") * len(pattern) + 1),
        F.struct(F.locate(pattern, more, 1).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda acc, _: F.when(acc["at"] > 0, F.struct(F.call_function("locate", F.lit(pattern), more, acc["at"] + 1).alias("at"), F.array_append(acc["found"], acc["at"]).alias("found"))).otherwise(acc),
    )["found"]
    return F.transform(found, lambda i: base + F.octet_length(F.substring(more, F.lit(1), i - 1)))


def offsets(df: DataFrame, patterns: list[str], keep: list[str], text_col: str = "text") -> DataFrame:
    """(*keep, pattern, offsets array<long>): byte offsets of every occurrence, overlapping ones too; a row for each chunk of a text and pattern with hits.

    Texts are cut into chunks and those into pieces, each read with what follows
    it as far as a pattern reaches; the bytes before each are known, so the work
    is linear in the text whatever the number of hits, and a chunk is as much as
    a row ever holds.  A null text has no hits; an empty pattern is an error."""
    if not all(patterns) or max(map(len, patterns)) > PIECE:
        raise ValueError(f"patterns have 1 to {PIECE} characters")
    ahead = max(map(len, patterns)) - 1
    cut = lambda c, n: F.regexp_extract_all(c, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))
    chunks = df.select(*keep, cut(F.col(text_col), CHUNK).alias("__c")).select(*keep, F.explode(_based(F.col("__c"), ahead, F.lit(""))).alias("__c"))
    pieces = chunks.select(*keep, "__c.base", cut(F.col("__c.piece"), PIECE).alias("__p"), F.substring("__c.more", F.char_length("__c.piece") + 1, F.lit(ahead)).alias("__rest"))
    pieces = pieces.withColumn("__p", _based(F.col("__p"), ahead, F.col("__rest")))
    hits = lambda p: F.flatten(F.transform("__p", lambda x: _in_piece(x["piece"], x["more"], F.col("base") + x["base"], p)))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), hits(p).alias("offsets")) for p in patterns])).alias("__x")
    return pieces.select(*keep, each).select(*keep, "__x.pattern", "__x.offsets").where(F.size("offsets") > 0)


def occurrences(text: Column | str, pattern: str) -> Column:
    """Number of occurrences, overlapping ones too."""
    ahead = "(?=" + "".join("\\" + ch if not ch.isalnum() and ch.isascii() else ch for ch in pattern) + ")"
    return F.regexp_count(text, F.lit(ahead)).cast("long")

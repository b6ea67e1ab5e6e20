"""Fill-in-middle transformation in Spark SQL functions alone.

``regexp_extract_all`` cuts a text into its units (code points).  Four numbers
are read from the hex digest of ``seed:id`` by ``conv`` and ``substring``: two
place the cuts, one decides whether the text stays plain, one the arrangement.
``slice`` and ``array_join`` give prefix, middle and suffix, which sentinels join
to

    psm   P prefix S suffix M middle
    spm   S suffix P prefix M middle

``restored`` splits an arrangement at its sentinels and joins the pieces in text
order.  Sentinels may not overlap one another, so that the only places where one
is read are those where one was put; a text that holds a sentinel stays plain.

Everything is a projection: no shuffle, a row at a time, the same at any size.

Defined results: a null text is the empty text; empty texts are plain; a null id
is the empty string in the digest; equal ids get equal cuts of equal lengths;
repeated rows each give a row; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are arranged, and of 100 arranged ones so many are spm.
ARRANGED, SUFFIX_FIRST = 90, 20
#: A unit: one code point, line ends too.
UNIT = "(?s)."


def _checked(sentinels: Sequence[str]) -> None:
    """No sentinel may begin inside another one or at its end, else a restored text could differ."""
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels, none empty")
    for a in sentinels:
        for b in sentinels:
            if (a != b and a in b) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels overlap: {a!r} and {b!r}")


def numbers(ident: Column, seed: int, count: int = 4) -> list[Column]:
    """The first 8-digit groups of the digest as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def arranged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 1, share: int = ARRANGED, suffix_first: int = SUFFIX_FIRST, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row; the two lengths are null where the text stays plain."""
    _checked(sentinels)
    p, s, m = (F.lit(x) for x in sentinels)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.select("id", "text", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"), *[h.alias(f"h{i}") for i, h in enumerate(numbers(F.col("id"), seed), 1)])
    rows = rows.select("id", "text", "units", F.size("units").cast("long").alias("n"), "h1", "h2", "h3", "h4")
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    holds = F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    form = F.when((F.col("n") == 0) | holds | (F.col("h3") % 100 >= share), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("id", "text", "units", "n", form.alias("form"), F.least(a, b).alias("cut"), F.greatest(a, b).alias("end"))
    cut, end, n = (F.col(c).cast("int") for c in ("cut", "end", "n"))
    piece = lambda begin, until: F.array_join(F.slice("units", begin + 1, until - begin), "")
    before, middle, after = piece(F.lit(0), cut), piece(cut, end), piece(end, n)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, before, s, after, m, middle)).otherwise(F.concat(s, after, p, before, m, middle))
    length = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select("id", "n", "form", length(F.col("cut")).alias("prefix_chars"), length(F.col("end") - F.col("cut")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an arrangement was made from, read from the arrangement and its form."""
    _checked(sentinels)
    pieces = F.split(output, "|".join(rf"\Q{x}\E" for x in sentinels), -1)  # nothing, then the three pieces as they stand
    return F.when(form == "plain", output).when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2])).otherwise(F.concat(pieces[2], pieces[3], pieces[1]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``arranged`` with the text rebuilt from each output."""
    return arranged(docs, id_col, text_col, **options).withColumn("restored", restored(F.col("output"), F.col("form"), options.get("sentinels", SENTINELS)))

"""Source trees as tables: a scan with content digests, and decoding of legacy code pages in Arrow batches.

A scan reads files by Spark's own reader, so a tree may lie in any store.  Null
content decodes to null; bytes that a code page leaves open become U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Extension, code page, language.
EXTENSIONS = [
    ("sql", "CP866", "SQL"), ("h", "CP866", "H"), ("pas", "WIN1251", "PAS"), ("inc", "WIN1251", "INC"), ("js", "WIN1251", "JS"), ("smf", "WIN1251", "SMF"),
    ("dfm", "WIN1251", "DFM"), ("tpr", "CP866", "TPR"), ("rpt", "WIN1251", "RPT"), ("xml", "UTF8", "XML"), ("t01", "CP866", "T01"),
]
CODECS = {"CP866": "cp866", "WIN1251": "cp1251", "UTF8": "utf-8"}
TRY_IN_ORDER = ("WIN1251", "CP866", "UTF8")


def glob_pattern(glob: str) -> str:
    """A case-insensitive regular expression for the whole of a name: ``*`` is any run, ``?`` any character."""
    return "(?iu)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def include_patterns(wanted: Iterable[str], known: Iterable[str] = tuple(f".{e[0]}" for e in EXTENSIONS)) -> list[str]:
    """Include patterns of files: those of ``*.ext`` with a known extension, in lower case, once each and sorted; all known extensions, as they are, where none is left."""
    low = {w.strip().lower() for w in wanted}
    exts = {e.strip().lower() for e in known}
    return sorted(p for p in low if p.removeprefix("*") in exts and p.removeprefix("*").startswith(".")) or list(known)


def _matches(globs: Iterable[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit |= F.col("rel_path").rlike(glob_pattern(g)) | F.col("name").rlike(glob_pattern(g))
    return hit


def scan(spark: SparkSession, root: str, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """(path, rel_path, extension, size, sha256, modified_at, encoding, language, content) of the files below ``root``.

    Folders whose name starts with a dot are left out.  Exclusions come before
    inclusions; a pattern holds for the relative path or the base name.
    """
    include, exclude = list(include), list(exclude)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    base = re.sub(scheme, "", root).rstrip("/") + "/"
    files = files.withColumn("rel_path", F.expr(f"substring(regexp_replace(path, '{scheme}', ''), {len(base) + 1})"))
    files = files.withColumn("name", F.element_at(F.split("rel_path", "/"), -1)).where(~F.col("rel_path").rlike(r"(^|/)\.[^/]+/"))
    if exclude:
        files = files.where(~_matches(exclude))
    if include:
        files = files.where(_matches(include))
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    kind = lambda i, other: F.coalesce(F.create_map(*[F.lit(x) for e in EXTENSIONS for x in (e[0], e[i])])[ext], F.lit(other))
    return files.select(
        "path", "rel_path", ext.alias("extension"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified_at"),
        kind(1, "UTF8").alias("encoding"), kind(2, "UNKNOWN").alias("language"), "content",
    )


def whole_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of UTF-8 files, each whole in one row."""
    return spark.read.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pgn_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the game files below ``root``, whatever the case of the extension."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][gG][nN]").load(root).select("path", "content")


def decode_bytes(data: bytes | None, encoding: str | None) -> str | None:
    return None if data is None else bytes(data).decode(CODECS.get(encoding or "UTF8", "utf-8"), "replace")


def cyrillic_share(text: str) -> float:
    """The share of Russian letters among the characters beyond ASCII; 1 where there are none."""
    beyond = [c for c in text if not c.isascii()]
    return sum("А" <= c <= "я" or c in "Ёё" for c in beyond) / len(beyond) if beyond else 1.0


def first_plausible(data: bytes | None, order: Iterable[str] = TRY_IN_ORDER) -> str | None:
    """The decoding that gives most Russian letters, by case as people write; the first in order of several."""
    if data is None:
        return None

    def likely(text: str) -> tuple[float, float]:
        words = re.findall("[А-яЁё]+", text)
        return round(cyrillic_share(text), 2), sum(w.islower() or w.isupper() or w.istitle() for w in words) / len(words) if words else 0.0

    return max((decode_bytes(data, e) for e in order), key=likely)  # the first of equals


def utf8_or_1251(data: bytes | None) -> str | None:
    if data is None:
        return None
    try:
        return bytes(data).decode("utf-8")
    except UnicodeDecodeError:
        return bytes(data).decode("cp1251", "replace")


def guess(data: bytes | None) -> str | None:
    """CP866 where any byte is beyond ASCII, else UTF8."""
    return None if data is None else "UTF8" if bytes(data).isascii() else "CP866"


@pandas_udf(StringType())
def decode(content: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(c, e) for c, e in zip(content, encoding)], dtype=object)


@pandas_udf(StringType())
def decode_in_order(content: pd.Series) -> pd.Series:
    return pd.Series([first_plausible(c) for c in content], dtype=object)


@pandas_udf(StringType())
def decode_games(content: pd.Series) -> pd.Series:
    return pd.Series([utf8_or_1251(c) for c in content], dtype=object)


@pandas_udf(StringType())
def guess_encoding(content: pd.Series) -> pd.Series:
    return pd.Series([guess(c) for c in content], dtype=object)


def texts(files: DataFrame) -> DataFrame:
    """Adds ``text``: reports and jobs by trial, the rest by their extension's code page."""
    tried = F.col("language").isin("TPR", "SMF")
    fixed = files.where(~tried).withColumn("text", decode("content", "encoding"))
    return fixed.unionByName(files.where(tried).withColumn("text", decode_in_order("content")))

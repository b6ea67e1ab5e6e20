"""License scans: Dice coefficient over word bigrams against licence templates, with DataFrame functions only.

Units of a text are its lines, its paragraphs of several lines, and the whole of
a text of several paragraphs.  A unit is normalised to lower-case ASCII words;
its set of word bigrams is compared with every template whose size allows the
threshold: with sizes n and m the coefficient is at most 2 min(n, m) / (n + m).

Two further prunings lose nothing.  A match shares more than t m / (2 - t) of a
template's m bigrams, so a set of anchor words that leaves fewer than that many
bigrams untouched in every template is in every match; ``anchors`` finds such a
set, and a text or unit without any anchor is not compared.  Each row is scanned
where it stands: no shuffle, and a row's work does not depend on other rows.

Defined results: null, empty or wordless text has no match (license null, score
0, matches 0); on equal scores the smaller identifier wins; repeated rows each
give a row; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .license_texts import templates

THRESHOLD = 0.8
#: Words too common to serve as anchors.
_COMMON = frozenset("the of and to in a is for this that with be or by on as it are at an any not under other without following including public subject notice express source purpose obtain publish from all work you may either will even".split())


def words(text: str) -> list[str]:
    return re.sub(r"[^A-Za-z0-9]+", " ", text).lower().split()


def bigrams(text: str) -> set[str]:
    w = words(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


@lru_cache
def table() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(identifier, sorted bigrams), each once."""
    return tuple(sorted({(i, tuple(sorted(bigrams(t)))) for i, t in templates()}))


def anchors(rows=None, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every match has one."""
    rows = table() if rows is None else rows
    chosen: list[str] = []
    left = [(set(b), threshold * len(b) / (2 - threshold)) for _, b in rows]
    while left := [(free, need) for free, need in left if len(free) >= need]:
        gain: dict[str, int] = {}
        for free, _ in left:
            for w in {w for b in free for w in b.split() if w not in _COMMON and len(w) > 4} or {w for b in free for w in b.split()}:
                gain[w] = gain.get(w, 0) + 1
        best = max(gain, key=lambda w: (gain[w], len(w), w))
        chosen.append(best)
        left = [({b for b in free if best not in b.split()}, need) for free, need in left]
    return chosen


def _units(text: Column, pattern: str) -> Column:
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: p.contains("\n"))
    whole = F.when(text.rlike(r"\n[ \t\r]*\n"), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(lines, paragraphs, whole), lambda u: u.rlike(pattern))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, hits array<struct<license, score, unit>>) for every row, in the text's order of units."""
    pattern = "(?i)(?<![a-z0-9])(" + "|".join(anchors(threshold=threshold)) + ")(?![a-z0-9])"
    literal = json.dumps([{"id": i, "n": len(b), "b": b} for i, b in table()], separators=(",", ":"))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    units = F.when(F.col("text").rlike(pattern), _units(F.col("text"), pattern)).otherwise(F.array().cast("array<string>"))

    def compared(templates: Column, unit: Column) -> Column:
        w = F.filter(F.split(F.lower(F.regexp_replace(unit, "[^A-Za-z0-9]+", " ")), " "), lambda x: x != "")
        pairs = lambda w: F.when(F.size(w) > 1, F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))).otherwise(F.array().cast("array<string>"))
        own = F.transform(F.array(w), pairs)
        n = lambda b: F.size(b)
        fits = lambda b, t: 2.0 * F.least(n(b), t["n"]) / (n(b) + t["n"]) >= threshold
        dice = lambda b, t: F.struct((-2.0 * F.size(F.array_intersect(b, t["b"])) / (n(b) + t["n"])).alias("score"), t["id"].alias("id"))
        best = F.transform(own, lambda b: F.array_min(F.filter(F.transform(F.filter(templates, lambda t: fits(b, t)), lambda t: dice(b, t)), lambda x: x["score"] <= -threshold)))
        return F.element_at(F.transform(best, lambda x: F.when(x.isNotNull(), F.struct(x["id"].alias("license"), (-x["score"]).alias("score"), unit.alias("unit")))), 1)

    fixed = F.from_json(F.lit(literal), "array<struct<id:string,n:int,b:array<string>>>")
    found = F.when(F.size("units") > 0, F.element_at(F.transform(F.array(fixed), lambda t: F.array_compact(F.transform("units", lambda u: compared(t, u)))), 1))
    return rows.withColumn("units", units).select("id", F.coalesce(found, F.array().cast("array<struct<license:string,score:double,unit:string>>")).alias("hits"))


def best_license(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, license, score, matches): each row's best hit."""
    hits = scan(docs, id_col, text_col, threshold)
    best = F.array_min(F.transform("hits", lambda h: F.struct((-h["score"]).alias("score"), h["license"].alias("license"))))
    return hits.select("id", F.size("hits").cast("long").alias("matches"), best.alias("best")).select("id", F.col("best.license").alias("license"), F.coalesce(-F.col("best.score"), F.lit(0.0)).alias("score"), "matches")

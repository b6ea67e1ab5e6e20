"""Filters of the query surface, as Column builders."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that a lookup value loses at its ends.
SPACE = " \t\n\r\f\v\u0085 "


def trimmed(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(SPACE))


def pattern(value: str, escape: bool = False) -> str:
    """The substring pattern; the value's own wildcards stay live unless escaped."""
    v = value.strip(SPACE)
    if escape:
        v = v.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{v}%"


def name_lookup(columns: list[str], value: str, like: bool = False, escape: bool = False) -> Column:
    """Any of the columns equals the value, or contains it without regard to case."""
    if like:
        return reduce(or_, [F.col(c).ilike(pattern(value, escape)) for c in columns])
    return reduce(or_, [F.col(c) == value.strip(SPACE) for c in columns])


def equals_ci(column: str, value: str) -> Column:
    return F.lower(F.col(column)) == value.strip(SPACE).lower()


def under_path(column: str, root: str) -> Column:
    return (F.col(column) == root) | F.col(column).startswith(root.rstrip("/") + "/")


def filtered(df: DataFrame, *, equal: dict | None = None, like: dict | None = None, require: bool = False) -> DataFrame:
    """Conjunction of the filters that have a value; with ``require`` at least one must."""
    equal = {k: v for k, v in (equal or {}).items() if v not in (None, "")}
    like = {k: v for k, v in (like or {}).items() if v not in (None, "")}
    if require and not equal and not like:
        raise ValueError("at least one filter is required")
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    for k, v in like.items():
        df = df.where(F.col(k).ilike(pattern(v)))
    return df


def null_if_empty(c: Column | str) -> Column:
    return F.nullif(trimmed(c), F.lit(""))

"""Hashes with 64-bit wrap-around, in decimal arithmetic so that ANSI mode does not overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WRAP = "18446744073709551616"


def polynomial(text: str, base: int = 31, start: int = 0) -> Column:
    """h = base * h + code point, modulo 2^64, over the characters of a column; the result as decimal(20,0)."""
    chars = f"filter(split(`{text}`, ''), c -> c != '')"
    return F.expr(f"cast(aggregate({chars}, cast({start} as decimal(38,0)), (h, c) -> cast(pmod(h * {base} + ascii(c), {WRAP}) as decimal(38,0))) as decimal(20,0))")


def signed(unsigned: Column) -> Column:
    """The two's-complement long of an unsigned decimal."""
    return F.when(unsigned >= F.lit(2**63).cast("decimal(20,0)"), unsigned - F.lit(2**64).cast("decimal(38,0)")).otherwise(unsigned).cast("long")


def zobrist_key(piece: int, square: int) -> int:
    """Table entry of a piece on a square, modulo 2^64, as a signed long."""
    k = (64 * piece + square + 1) * 0x9E3779B97F4A7C15 % 2**64
    return k - 2**64 if k >= 2**63 else k

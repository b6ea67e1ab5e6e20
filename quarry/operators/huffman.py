"""Huffman coding of binary columns: histogram, scaled weights, code table, archive and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, data: Column, *keys: str) -> DataFrame:
    """(*keys, byte, n): bytes counted by their hex pairs, summed map-side."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    return df.select(*keys, F.explode(pairs).alias("h")).groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n")).select(*keys, F.conv("h", 16, 10).cast("int").alias("byte"), "n")


def scaled(hist: DataFrame) -> DataFrame:
    """Weights of at most 255, as the archive's header holds them; one row of totals is joined to at most 256 rows."""
    top = hist.agg(F.max("n").alias("top"))
    return hist.join(F.broadcast(top), F.lit(True)).select("byte", "n", F.when(F.col("top") > 255, F.greatest(F.lit(1), F.expr("n * 255 div top"))).otherwise(F.col("n")).cast("long").alias("weight"))


def ratio(packed: Column, plain: Column) -> Column:
    """The packed size in whole per cent of the plain one, rounded down; null for nothing."""
    return F.floor(packed * 100 / F.nullif(plain, F.lit(0))).cast("long")


def weights(data: bytes) -> dict[int, int]:
    counts: dict[int, int] = {}
    for b in data:
        counts[b] = counts.get(b, 0) + 1
    top = max(counts.values(), default=0)
    return {b: max(1, n * 255 // top) if top > 255 else n for b, n in sorted(counts.items())}


def codes(weight: dict[int, int]) -> dict[int, str]:
    """Bits of every byte: leaves in byte order, first in first out among equal weights, 0 for the lighter side."""
    if len(weight) == 1:
        return {next(iter(weight)): "0"}
    queue = sorted(((w, i, b) for i, (b, w) in enumerate(sorted(weight.items()))), key=lambda x: x[:2])
    stamp = len(queue)
    while len(queue) > 1:
        a, b, *queue = queue
        node = (a[0] + b[0], stamp, (a[2], b[2]))
        stamp += 1
        at = next((k for k, x in enumerate(queue) if x[0] > node[0]), len(queue))
        queue.insert(at, node)
    out: dict[int, str] = {}

    def walk(node, bits):
        if isinstance(node, tuple):
            walk(node[0], bits + "0")
            walk(node[1], bits + "1")
        else:
            out[node] = bits

    if queue:
        walk(queue[0][2], "")
    return out


def compress(data: bytes) -> bytes:
    """4-byte little-endian length, count of symbols (256 as 0), symbol and weight pairs, bits from the low end of each byte."""
    w = weights(data)
    code = codes(w)
    bits = "".join(code[b] for b in data)
    body = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    return struct.pack("<IB", len(data), len(w) & 255) + b"".join(bytes(p) for p in w.items()) + body


def decompress(archive: bytes) -> bytes:
    size, count = struct.unpack_from("<IB", archive)
    if not size:
        return b""
    count = count or 256
    w = {archive[5 + 2 * i]: archive[6 + 2 * i] for i in range(count)}
    back = {bits: b for b, bits in codes(w).items()}
    out, bits = bytearray(), ""
    for x in archive[5 + 2 * count :]:
        for k in range(8):
            bits += "1" if x >> k & 1 else "0"
            if bits in back:
                out.append(back[bits])
                bits = ""
                if len(out) == size:
                    return bytes(out)
    return bytes(out)


def archives(df: DataFrame, id_col: str, data: Column) -> DataFrame:
    """(id, size, archive, restored): each value compressed and read back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            packed = [compress(bytes(x)) for x in f["data"]]
            yield pd.DataFrame({"id": f["id"], "size": [len(x) for x in f["data"]], "archive": packed, "restored": [decompress(x) == bytes(d) for x, d in zip(packed, f["data"])]})

    return df.select(F.col(id_col).alias("id"), data.alias("data")).mapInPandas(run, "id long, size long, archive binary, restored boolean")

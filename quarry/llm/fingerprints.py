"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Leaves are runs of four words inside a paragraph (a line); a paragraph's node
hashes its leaves, a section's its paragraphs, the root its sections.  Sections
end at a blank line or at a paragraph whose hash says so, so they realign after
an edit.  The fingerprint writes the root (128 bits) and, by section, the short
leaf hashes of each paragraph:

    <root>;<section>:<leaves>,<leaves>;<section>:<leaves>...

Equal roots mean equal texts.  Otherwise sections that agree are skipped whole
and the likeness is the Dice coefficient of the leaves; ``differing`` names the
branches that hold an edit.

The next document is found by one range shuffle on the id: bounds are quantiles
of the ids, each bound's document travels to the range before it as well, and
the first document of all to the last range, so no text is collected and no
range waits for another.

Defined results: null text is the empty text, whose tree is a root alone; ids
are ordered ascending (texts by code point), null first; rows that share an id follow one another by
text; of a single document the next is itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampType

from .common import in_arrow, partitions, text_of

#: Four words with the white space around them; together the pieces are the paragraph.
_PIECE = re.compile(r"\s*\S+(?:\s+\S+){0,3}\s*|\s+")
SHORT = 5
#: Bytes of text that a range has about.
RANGE_BYTES = 64 << 20
_xxh = xxhash.xxh3_128_digest


def fingerprint(text: str) -> str:
    sections: list[str] = []
    nodes: list[bytes] = []
    leaves: list[str] = []
    paragraphs: list[bytes] = []

    def close() -> None:
        if paragraphs:
            node = _xxh(b"".join(paragraphs))
            nodes.append(node)
            sections.append(node.hex()[:8] + ":" + ",".join(leaves))
            paragraphs.clear()
            leaves.clear()

    for line in text.split("\n") if text else ():
        hashes = [_xxh(p) for p in _PIECE.findall(line)]
        node = _xxh(b"".join(hashes) + b"\n")
        paragraphs.append(node)
        leaves.append("".join([h.hex()[:SHORT] for h in hashes]))
        if not line.strip() or not node[0] & 7:
            close()
    close()
    root = hashlib.md5(b"".join(nodes)).hexdigest()
    return ";".join([root, *sections])


def _leaves(section: str) -> list[str]:
    return [p[i : i + SHORT] for p in section.partition(":")[2].split(",") for i in range(0, len(p), SHORT)]


def likeness(a: str, b: str) -> float:
    """1.0 exactly if the roots agree, else the leaves' Dice coefficient, below 1."""
    (root, *left), (other, *right) = a.split(";"), b.split(";")
    if root == other:
        return 1.0
    ours, theirs = Counter(left), Counter(right)
    same = ours & theirs
    agree = sum(len(_leaves(s)) * n for s, n in same.items())
    x = Counter(leaf for s, n in (ours - same).items() for _ in range(n) for leaf in _leaves(s))
    y = Counter(leaf for s, n in (theirs - same).items() for _ in range(n) for leaf in _leaves(s))
    total = 2 * agree + x.total() + y.total()
    shared = agree + sum(min(n, y[leaf]) for leaf, n in x.items())
    return min(2 * shared / total, 1 - 1 / (total + 1)) if total else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places in ``b`` whose branch has no equal in ``a``."""
    (root, *left), (other, *right) = a.split(";"), b.split(";")
    if root == other:
        return []
    known, lines = set(left), {p for s in left for p in s.partition(":")[2].split(",")}
    return [(i, j) for i, s in enumerate(right) if s not in known for j, p in enumerate(s.partition(":")[2].split(",")) if p not in lines]


def edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def _range_of(bounds: list[int]):
    """The number of bounds at or below the key, by binary descent; a null key is in the first range."""
    steps, k = [], 1
    while k <= len(bounds):
        steps.insert(0, k)
        k *= 2
    if not steps:
        return F.lit(0)
    table, n, key = F.array(*[F.lit(b) for b in bounds]), len(bounds), F.col("key")
    return F.coalesce(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(table, at + s - 1) <= key), at + s).otherwise(at)), F.lit(0))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds key: a long that never falls as the id rises; for texts the seven bytes after what all ids begin with."""
    if isinstance(rows.schema["id"].dataType, (NumericType, TimestampType)):
        return rows.withColumn("key", F.floor(F.col("id")).cast("long") if isinstance(rows.schema["id"].dataType, NumericType) else F.col("id").cast("long"))
    ends = rows.agg(F.min(F.encode(F.col("id").cast("string"), "utf-8")), F.max(F.encode(F.col("id").cast("string"), "utf-8"))).first()
    low, high = bytes(ends[0] or b""), bytes(ends[1] or b"")
    same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    part = F.rpad(F.hex(F.substring(F.encode(F.col("id").cast("string"), "utf-8"), same + 1, 7)), 14, "0")
    return rows.withColumn("key", F.conv(part, 16, 10).cast("long"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (range, turn, id, text, guest), partitioned by range and sorted, each range followed by the guest that comes next."""
    rows = _keyed(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")))
    size = rows.agg(F.min("id").alias("first"), F.count_if(F.col("id").isNull()).alias("nulls"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    parts = max(partitions(docs.sparkSession), size.bytes // RANGE_BYTES)
    cuts = [i / (2 * parts) for i in range(1, 2 * parts)]
    found = rows.agg(F.percentile_approx("key", cuts, max(10_000, 20 * parts)).alias("q"), F.min("key").alias("least")).first()
    # quantiles are doubles, so the least key that each range really has becomes its bound
    near = rows.withColumn("range", _range_of(sorted(set(found.q or [])))).groupBy("range").agg(F.min("key").alias("key"))
    bounds = sorted({r.key for r in near.where("key is not null").collect()} - {found.least})
    last = len(bounds)
    is_first = F.col("id").isNull() if size.nulls else F.col("id") == F.lit(size.first)
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("turn"), F.lit(False).alias("guest"))
    # a bound's first document goes to the range before too; where several ids share its key, all do and the least is met
    before = F.when(F.col("key").isin(bounds) if bounds else F.lit(False), F.struct((F.col("range") - 1).alias("range"), F.lit(0).alias("turn"), F.lit(True).alias("guest")))
    wrap = F.when(is_first, F.struct(F.lit(last).alias("range"), F.lit(1).alias("turn"), F.lit(True).alias("guest")))
    placed = rows.withColumn("range", _range_of(bounds)).withColumn("to", F.explode(F.array_compact(F.array(here, before, wrap)))).select("to.range", "to.turn", "id", "text", "to.guest")
    return placed.repartition(parts, "range").sortWithinPartitions("range", "turn", "id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, guest, id, text, fingerprint) whose next row is awaited
        for batch in batches:
            out: list[tuple] = []
            for place, ident, text, guest in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                row = (place, guest, ident, text, fingerprint(text))
                if held and held[0] == place and not held[1]:
                    changed = edited(held[3], text)
                    mark = held[4] if changed == held[3] else fingerprint(changed)
                    out.append((held[2], len(held[3]), hashlib.sha256(changed.encode()).hexdigest(), held[4], mark, likeness(held[4], mark), likeness(held[4], row[4])))
                held = row
            kinds = (batch.column(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema[id_col].dataType.simpleString()
    return with_next(docs, id_col, text_col).transform(in_arrow, run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

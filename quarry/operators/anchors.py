"""Substring search for a table of patterns: anchors.

A pattern is met by one q-gram of its own, its anchor: the one that the texts have
least often.  q is the largest of ``CLASSES`` that fits in the pattern.  Texts
give their q-grams by place; an equal-key join with the anchors leaves the places
where a pattern may stand, and the characters around each decide.  There is no
comparison of every text with every pattern, whatever their lengths.

Up to ``MOST_BROADCAST`` anchors go to the texts, which are read in Arrow batches:
rolling hashes of all q-grams of a block of code points meet the table of anchors
at once, and the characters decide.  More anchors are joined by gram with narrow
rows, each anchor ``SALTS`` times and each place once, so a gram that stands
everywhere is spread.  For that join texts are cut into pieces that carry what
stands around them as far as the longest pattern reaches, and the pieces are
fetched for what is met.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Lengths of anchors: a pattern of n characters has one of the largest length up to n.
CLASSES = (16, 8, 4, 2, 1)
#: Characters of a piece, at least.
PIECE = 256
#: Anchors (and characters of their patterns) that are broadcast at most.
MOST_BROADCAST, MOST_CHARACTERS = 100_000, 4 << 20
#: Code points of texts that a task holds at once, about; of those it hashes at once; places that it verifies at once, about.
TEXTS, BLOCK, PLACES = 1 << 20, 1 << 16, 1 << 20
SALTS = 16


def grams(text: Column, q: int) -> Column:
    """Every run of q characters, overlapping ones too, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))."), F.lit(1))  # each match takes one character on, a whole one


def _pieces(texts: DataFrame, id_col: str, text_col: str, longest: int) -> DataFrame:
    """(row, id, base, piece, before, after): a text's pieces, the characters in front of each and its neighbours."""
    size = max(PIECE, longest)
    cut = texts.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("p"))
    reach = max(0, longest - 1)
    # the piece after may be a short last one: nothing follows it, so a neighbour is always enough
    near = lambda i: F.struct(F.get("p", i).alias("piece"), (i * size).cast("long").alias("base"), F.coalesce(F.right(F.get("p", i - 1), F.lit(reach)), F.lit("")).alias("before"), F.coalesce(F.left(F.get("p", i + 1), F.lit(reach)), F.lit("")).alias("after"))
    return cut.where(F.size("p") > 0).select("row", "id", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 1), near)).alias("x")).select("row", "id", "x.*")


def _places(pieces: DataFrame, classes: list[int], *keep: str) -> DataFrame:
    """(*keep, q, gram, at) of every q-gram that begins in a piece."""
    each = F.array(*[F.struct(F.lit(q).alias("q"), grams(F.concat("piece", F.left("after", F.lit(q - 1))) if q > 1 else F.col("piece"), q).alias("g")) for q in classes])
    return pieces.select(*keep, F.explode(each).alias("x")).select(*keep, "x.q", F.posexplode("x.g").alias("at", "gram"))


# --- broadcast anchors ------------------------------------------------------------------------

#: After every text there is one that no pattern has.
_END = np.array([0x110000], np.uint32)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Table(NamedTuple):
    """Patterns end to end; by class the hashes of grams in order, and each hash's grams: from ``first`` on in ``pattern`` and ``off``."""

    patterns: list[str]
    codes: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def _rolled(codes: np.ndarray, classes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(q, hash of the q code points at each place) for every class."""
    mixed = lambda x: (x ^ (x >> np.uint64(29))) * _PRIME
    h, size = mixed(codes.astype(np.uint64)), 1
    while True:
        if size in classes:
            yield size, h
        if size >= max(classes) or len(h) <= size:
            return
        h = mixed(h[:-size] * np.uint64(0x100000001B3) + h[size:])
        size *= 2


def _table(patterns: list[str], codes: list[np.ndarray], chosen: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> _Table:
    """From (hash, pattern, off) by class."""
    grams = {}
    for q, (h, pattern, off) in chosen.items():
        order = np.argsort(h, kind="stable")
        keys, first = np.unique(h[order], return_index=True)
        grams[q] = keys, np.append(first, len(h)), pattern[order].astype(np.int32), off[order].astype(np.int32)
    length = np.array([len(c) for c in codes], np.int64)
    return _Table(patterns, np.concatenate(codes), np.cumsum(length) - length, length, grams)


def _all_grams(codes: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, pattern, off) of every gram of the patterns, by class."""
    by: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        by.setdefault(next(q for q in CLASSES if q <= len(c)), []).append(i)
    out = {}
    for q, mine in by.items():
        h = [next(x for _, x in _rolled(codes[i], [q])) for i in mine]
        out[q] = np.concatenate(h), np.repeat(mine, [len(x) for x in h]), np.concatenate([np.arange(len(x)) for x in h])
    return out


class _Finder:
    """Where a block of code points has grams of a table: a bit by the hash's highest bits first, then the hash."""

    def __init__(self, table: _Table):
        self.table, self.bits = table, {}
        for q, (keys, *_) in table.grams.items():
            shift = 64 - min(24, max(16, len(keys).bit_length() + 4))
            bits = np.zeros(1 << 64 - shift, bool)
            bits[keys >> np.uint64(shift)] = True
            self.bits[q] = np.uint64(shift), bits

    def grams(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(class, places, numbers of the hash) of what stands in ``codes``, block by block."""
        classes = sorted(self.table.grams)
        for start in range(0, len(codes), BLOCK):
            for q, h in _rolled(codes[start : start + BLOCK + classes[-1] - 1], classes):
                h, (shift, bits), keys = h[:BLOCK], self.bits[q], self.table.grams[q][0]
                at = np.flatnonzero(bits[h >> shift])
                number = np.searchsorted(keys, h[at])
                good = keys[np.minimum(number, len(keys) - 1)] == h[at]
                if good.any():
                    yield q, at[good] + start, number[good]

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, numbers of patterns) of all hits; every character is compared."""
        t = self.table
        codes = np.concatenate([codes, np.repeat(_END, int(t.length.max()))])
        for q, at, number in self.grams(codes):
            _, first, pattern, off = t.grams[q]
            many = first[number + 1] - first[number]
            cuts = np.flatnonzero(np.diff(np.cumsum(many) // PLACES)) + 1
            for at, number, many in zip(*[np.split(x, cuts) for x in (at, number, many)]):
                entry = np.arange(many.sum()) + np.repeat(first[number] - np.cumsum(many) + many, many)
                begin, found = np.repeat(at, many) - off[entry], pattern[entry]
                begin, found = begin[begin >= 0], found[begin >= 0]
                k = 0
                while len(begin):
                    same = codes[begin + k] == t.codes[t.begin[found] + k]
                    begin, found, k = begin[same], found[same], k + 1
                    whole = t.length[found] == k
                    if whole.any():
                        yield begin[whole], found[whole]
                        begin, found = begin[~whole], found[~whole]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, code points end to end, where each text begins) of about ``TEXTS`` code points at a time; the text is the last column."""
    for batch in batches:
        codes, size, first = [], 0, 0
        for row, text in enumerate(batch.column(batch.num_columns - 1), 1):
            raw = text.as_buffer()
            codes += [_points(raw.to_pybytes()) if raw is not None else _END[:0], _END]
            size += len(codes[-2]) + 1
            if size > TEXTS or row == batch.num_rows:
                lengths = np.array([len(c) + 1 for c in codes[::2]])
                yield batch.slice(first, row - first), np.concatenate(codes), np.cumsum(lengths) - lengths
                codes, size, first = [], 0, row


def _anchored(texts: DataFrame, patterns: list[str]) -> _Table | None:
    """The patterns by their anchors, the rarest gram of each in all texts; none if the texts have no pattern's grams."""
    codes = [_points(p.encode("utf-8", "surrogatepass")) for p in patterns]
    every = _all_grams(codes)
    table = _table(patterns, codes, every)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(shared.value)
        n = {q: np.zeros(len(g[0]), np.int64) for q, g in shared.value.grams.items()}
        for _, points, _ in groups(batches):
            for q, _, number in finder.grams(points):
                n[q] += np.bincount(number, minlength=len(n[q]))
        for q, x in n.items():
            used = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), q, np.int32)), pa.array(used.astype(np.int64)), pa.array(x[used])], ["q", "gram", "n"])

    counted = texts.mapInArrow(run, "q int, gram long, n long").groupBy("q", "gram").agg(F.sum("n").alias("n")).toPandas()  # as many as the patterns have grams, at most
    chosen = {}
    for q, (h, pattern, off) in every.items():
        n = np.zeros(len(table.grams[q][0]), np.int64)
        mine = counted[counted["q"] == q]
        n[mine["gram"].to_numpy()] = mine["n"].to_numpy()
        n = n[np.searchsorted(table.grams[q][0], h)]
        order = np.lexsort((off, n, pattern))
        order = order[np.concatenate([[True], np.diff(pattern[order]) > 0])]
        order = order[n[order] > 0]
        if len(order):
            chosen[q] = h[order], pattern[order], off[order]
    shared.destroy()
    return _table(patterns, codes, chosen) if chosen else None


def _known(patterns: DataFrame, pattern_col: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """The distinct patterns with their length and class; the longest, the characters of all and their number."""
    known = patterns.select(F.col(pattern_col).alias("pattern")).where("pattern != ''").distinct().withColumn("m", F.char_length("pattern"))
    q = F.lit(CLASSES[-1])
    for size in reversed(CLASSES):
        q = F.when(F.col("m") >= size, size).otherwise(q)
    known = written(known.withColumn("q", q), "patterns")
    return known, known.agg(F.max("m"), F.coalesce(F.sum("m"), F.lit(0)), F.count(F.lit(1))).first()


def _few(n: int, characters: int) -> bool:
    return n <= MOST_BROADCAST and characters <= MOST_CHARACTERS


def hits(texts: DataFrame, patterns: DataFrame, id_col: str, pattern_col: str, text_col: str = "text") -> DataFrame:
    """(id, pattern, at): every place (counted in characters from 0) at which a text has a pattern, overlapping places too.

    Patterns count once each; null and empty ones have no places, nor have null texts.  Repeated rows of a text each give theirs."""
    known, (longest, characters, n) = _known(patterns, pattern_col)
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    none = rows.select("id", F.lit("").alias("pattern"), F.lit(0).cast("long").alias("at")).where("false")
    if not n:
        return none
    if not _few(n, characters):
        return _joined(texts, known, longest, id_col, text_col)
    table = _anchored(rows.select("text"), [r[0] for r in known.select("pattern").collect()])
    if table is None:
        return none
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, names = _Finder(shared.value), pa.array(shared.value.patterns, pa.string())
        for some, points, begin in groups(batches):
            for at, found in finder.hits(points):
                row = np.searchsorted(begin, at, "right") - 1
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), names.take(pa.array(found)), pa.array(at - begin[row])], ["id", "pattern", "at"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pattern string, at long")


def counts(texts: DataFrame, patterns: DataFrame, pattern_col: str, text_col: str = "text") -> DataFrame:
    """(pattern, n): at how many places texts have each pattern, as ``hits`` finds them; tasks add up their own."""
    known, (longest, characters, n) = _known(patterns, pattern_col)
    rows = texts.select(F.col(text_col).alias("text"))
    table = _anchored(rows, [r[0] for r in known.select("pattern").collect()]) if n and _few(n, characters) else None
    if table is None:
        if n and not _few(n, characters):
            return _joined(rows.withColumn("id", F.lit(0)), known, longest, "id", "text").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        return known.select("pattern", F.lit(0).cast("long").alias("n")).where("false")
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, n = _Finder(shared.value), np.zeros(len(shared.value.patterns), np.int64)
        for _, points, _ in groups(batches):
            for _, found in finder.hits(points):
                n += np.bincount(found, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([shared.value.patterns[i] for i in used], pa.string()), pa.array(n[used])], ["pattern", "n"])

    return rows.mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


# --- more anchors than can be broadcast ---------------------------------------------------------


def _joined(texts: DataFrame, known: DataFrame, longest: int, id_col: str, text_col: str) -> DataFrame:
    classes = sorted(r[0] for r in known.select("q").distinct().collect())  # as many as CLASSES, at most
    pieces = written(_pieces(texts, id_col, text_col, longest), "pieces")
    own = [known.where(F.col("q") == size).select("pattern", "m", "q", F.posexplode(grams(F.col("pattern"), size)).alias("off", "gram")) for size in classes]
    inside = own[0]
    for more in own[1:]:
        inside = inside.union(more)
    counts = _places(pieces, classes).join(inside.select("q", "gram").distinct(), ["q", "gram"], "left_semi").groupBy("q", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = inside.join(counts, ["q", "gram"], "left").groupBy("pattern", "m", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "gram")).alias("a"))
    anchors = written(rarest.where("a.n > 0").select("pattern", "m", "q", "a.off", "a.gram"), "anchors")
    salted = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = _places(pieces, classes, "row", "base").withColumn("salt", F.pmod(F.xxhash64("row", "base", "at"), F.lit(SALTS)).cast("int"))
    met = places.join(salted, ["q", "gram", "salt"]).select("row", "base", "at", "pattern", "m", "off").join(pieces, ["row", "base"])
    begin = F.char_length("before") + F.col("at") - F.col("off")
    stands = (begin >= 0) & (F.substring(F.concat("before", "piece", "after"), begin + 1, F.col("m")) == F.col("pattern"))
    return met.where(stands).select("id", "pattern", (F.col("base") + F.col("at") - F.col("off")).alias("at"))


def containing(texts: DataFrame, passages: DataFrame, id_col: str, passage_id: str, text_col: str = "text") -> DataFrame:
    """(id, passage id) of every text that contains a whole passage, without regard to case; empty passages are in none."""
    low = lambda df, i: df.select(F.col(i), F.lower(text_col).alias("t"))
    wanted = low(passages, passage_id)
    met = hits(low(texts, id_col), wanted, id_col, "t", "t").select(F.col("id").alias(id_col), F.col("pattern").alias("t")).distinct()
    return met.join(wanted, "t").select(id_col, passage_id)

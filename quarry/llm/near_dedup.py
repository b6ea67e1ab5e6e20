"""MinHash near-dedup with Order MinHash sketches and banded alignment.

A text's words (lower case, without punctuation) form k-mers of ``WORDS`` = 5
words, each labelled with its occurrence number.  A sketch samples the few least
labelled k-mers under one hash function and retains their text order, so two
texts share a sketch with a chance that falls with their edit distance, not only
with their sets of k-mers.  Edits scattered evenly at the threshold leave hardly
any five words in a row, and short texts have few of them, so further functions
sample shorter k-mers: three words, two or one, by the length of the text
(``BANDS``).  The lengths overlap so that any two texts of similar length share
a band.

Links are texts whose words align with an edit similarity of 0.8 or more:
1 - (word edits) / (words of the longer), computed in the band of diagonals that
the threshold allows.  Classes are the connected components of the links.

No full bucket is expanded into its pairs and none is capped:

1. Texts of the same words are one node from the start.
2. In each bucket (equal sketch) every member meets the bucket's first and last
   node, so buckets of up to three give all their pairs and larger ones two
   stars.
3. Pairs whose lengths differ too much go.  Each node is aligned with its first
   partner; of the other pairs those already joined through such a link go too,
   and the rest is aligned.
4. A larger bucket whose members are not all joined by then has its other pairs
   searched exactly.  Members without one of another label and a like length are
   done.  Up to ``SMALL`` nodes give their pairs themselves.  In fuller buckets
   texts that align within the threshold have a word in common among the rarest
   of each, so the members meet by rare word, in any bucket, and a pair is kept
   where none of the words right before is common and enough words are left for
   the threshold (``_meetings``).  Pairs whose words differ in too many places go
   (``_close``); what is left is aligned, in tiles of two blocks of texts.  No
   pair of a bucket that aligns is lost, however full the bucket is.

Only small rows (key, node) and (node, node) are shuffled by key, and the hashed
words of nodes that have a partner.  A node is a number given once, in a written
table; its lowest bits tell the text's rough length.

Defined results: a text without words is compared by its other characters; null,
empty and blank texts form one class; texts of up to three words have only equal
ones as near copies (one edit is more than a fifth); a null id sorts after any
other; rows that repeat an id each have a row in the result, and ``keep_one``
keeps one of rows alike in id and text; an empty table gives an empty result;
other columns are ignored, or kept as they are by ``keep_one``.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_arrow, text_of
from .components import components

WORDS = 5
SIMILARITY = 0.8
#: (texts of at least so many words, under so many; words of a k-mer, k-mers a sketch, functions).
BANDS = (
    (4, 8, 1, 3, 48),
    (7, 20, 1, 4, 48),
    (16, 62, 2, 3, 48),
    (50, math.inf, 3, 2, 40),
    (100, math.inf, WORDS, 2, 8),
)
#: Texts are sketched in blocks of about so many words.
BLOCK = 1 << 17
#: Texts, and words, of a block of a crowd: pairs of crowded texts are aligned by two blocks at once.
TILE, TILE_WORDS = 32, 1 << 18
#: A bucket of so many nodes at most gives its other pairs itself.
SMALL = 16
#: Words before a rare word that are compared, so that a pair is seldom met again at a later common word; bits a word of a text's parities.
BEFORE, PARITY_BITS = 16, 4
MEMO = 100_000
#: Texts of so many words at most are aligned by bit vectors where more edits than so many are allowed.
BITS, FEW_EDITS = 8192, 8
#: Lowest bits of a node: 16 times the binary logarithm of its number of words.
LENGTH_BITS, STEPS = 10, 16

_WORD = re.compile(r"\w+")
_PLACES = 20
_LOW = np.uint64((1 << _PLACES) - 1)
_TOP = np.uint64(2**64 - 1)
_PRIME = np.uint64(0x100000001B3)


def _seeds(band: int, count: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(b"order-minhash-%d-%d" % (band, i)) | 1 for i in range(count)]


_SEEDS = [_seeds(b, band[4]) for b, band in enumerate(BANDS)]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Hashes()


def words(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    return found or list("".join(text.split()))


def word_hashes(text: str) -> np.ndarray:
    found = words(text)
    return np.fromiter((_hashes[w] for w in found), np.uint64, len(found))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def kmers(h: np.ndarray, k: int = WORDS) -> np.ndarray:
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * _PRIME + h[j : len(h) - k + 1 + j]
    return _mix(out)


def _labels(grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The k-mers told apart by their occurrence number in their text."""
    mark = grams ^ _mix(owner * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    slot = (mark & _LOW).astype(np.int64)
    at = np.flatnonzero(np.bincount(slot)[slot] > 1)  # few but the repeated ones share a slot
    at = at[np.lexsort((at, mark[at]))]
    fresh = np.ones(len(at), bool)
    fresh[1:] = mark[at[1:]] != mark[at[:-1]]
    starts = np.flatnonzero(fresh)
    out = grams.copy()
    out[at] += (np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out


def sketches(h: np.ndarray, sizes: np.ndarray, k: int, take: int, seeds: list[int]) -> np.ndarray:
    """A row of keys for each text; the texts' word hashes lie end to end in ``h``, ``sizes`` has their numbers, each at least k."""
    counts = sizes - k + 1
    ends = np.cumsum(sizes)
    inside = np.ones(len(h) - k + 1, bool)
    for j in range(1, k):
        inside[ends[:-1] - j] = False
    grams = kmers(h, k)[inside]
    n, starts = len(grams), np.cumsum(counts) - counts
    base = _mix(_labels(grams, np.repeat(np.arange(len(sizes), dtype=np.uint64), counts))) & ~_LOW
    with_end = np.append(grams, np.uint64(0))
    place = np.arange(n, dtype=np.uint64)
    out = np.empty((len(sizes), len(seeds)), np.uint64)
    least, value = np.empty((take, len(sizes)), np.int64), np.empty_like(base)
    for f, seed in enumerate(seeds):
        np.multiply(base, np.uint64(seed), out=value)
        if n <= int(_LOW):
            np.add(value, place, out=value)
        for j in range(take):
            if n <= int(_LOW):
                at = (np.minimum.reduceat(value, starts) & _LOW).astype(np.int64)
            else:  # places do not fit beside the hash: each text is searched for its leftmost least
                at = np.array([s + int(value[s : s + c].argmin()) for s, c in zip(starts, counts)])
            at[counts <= j] = n
            least[j] = at
            value[at[at < n]] = _TOP
        order = np.sort(least, axis=0)
        key = np.full(len(sizes), seed, np.uint64)
        for j in range(take):
            key = _mix(key * _PRIME + with_end[order[j]])
        out[:, f] = key
    return out


def text_keys(h: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """The sketch keys of texts whose word hashes lie end to end."""
    out: list[list[int]] = [[] for _ in sizes]
    with np.errstate(over="ignore"):
        for (lo, hi, k, take, _), seeds in zip(BANDS, _SEEDS):
            mine = (sizes >= lo) & (sizes < hi)
            if mine.any():
                keys = sketches(h[np.repeat(mine, sizes)], sizes[mine], k, take, seeds).view(np.int64).tolist()
                for at, row in zip(np.flatnonzero(mine).tolist(), keys):
                    out[at] += row
    return out


def _edits_by_bits(x: np.ndarray, y: np.ndarray, most: int) -> int | None:
    """The same by bit vectors (Myers): a column of differences between neighbours is two whole numbers."""
    places: dict[int, int] = {}
    for i, word in enumerate(x.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    n, m = len(x), len(y)
    whole, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score = whole, 0, n
    for j, word in enumerate(y.tolist(), 1):
        same = places.get(word, 0)
        level = (((same & up) + up) ^ up) | same
        more, less = down | (~(level | up) & whole), up & level
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        if score - (m - j) > most:
            return None
        more, same = (more << 1 | 1) & whole, same | down
        up, down = (less << 1 & whole) | (~(same | more) & whole), more & same
    return score if score <= most else None


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edit distance if at most ``most``: furthest-reaching points on the diagonals of the band; by bit vectors where many edits are allowed."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    x, y = (a, b) if n <= m else (b, a)
    n, m = len(x), len(y)
    same = np.flatnonzero(x != y[:n])
    head = int(same[0]) if len(same) else n
    x, y = x[head:], y[head:]
    n, m = len(x), len(y)
    if n:
        same = np.flatnonzero(x[::-1] != y[::-1][:n])
        tail = int(same[0]) if len(same) else n
        x, y = x[: n - tail], y[: m - tail]
        n, m = len(x), len(y)
    if not n:
        return m if m <= most else None
    if most > FEW_EDITS and m <= BITS:
        return _edits_by_bits(x, y, most)
    gaps: dict[int, list[int]] = {}

    def slide(d: int, i: int) -> int:
        """From word i of x along diagonal d, past all equal words."""
        stops = gaps.get(d)
        if stops is None:
            lo, hi = max(0, -d), min(n, m - d)
            stops = gaps[d] = [*(np.flatnonzero(x[lo:hi] != y[lo + d : hi + d]) + lo).tolist(), max(hi, lo)]
        k = bisect.bisect_left(stops, i)
        return stops[k] if k < len(stops) else i

    goal = m - n
    reach = {0: slide(0, 0)}
    if goal == 0 and reach[0] >= n:
        return 0
    for e in range(1, most + 1):
        new: dict[int, int] = {}
        spare = most - e
        for d in range(max(-e, goal - spare, -n), min(e, goal + spare, m) + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            if i < 0:
                continue
            i = min(i, n, m - d)
            if i < max(0, -d):
                continue
            new[d] = slide(d, i)
        if new.get(goal, -1) >= n:
            return e
        reach = new
    return None


def _anchored(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the alignment through k-mers that occur once in either text stays within ``most`` edits; gaps are aligned in their own bands."""
    if min(len(a), len(b)) < 4 * WORDS:
        return False
    with np.errstate(over="ignore"):
        x, y = kmers(a), kmers(b)
    ux, ix, cx = np.unique(x, return_index=True, return_counts=True)
    uy, iy, cy = np.unique(y, return_index=True, return_counts=True)
    _, px, py = np.intersect1d(ux[cx == 1], uy[cy == 1], assume_unique=True, return_indices=True)
    i, j = ix[cx == 1][px], iy[cy == 1][py]
    order = np.argsort(i)
    i, j = i[order], j[order]
    ahead = j > np.concatenate([[-1], np.maximum.accumulate(j)[:-1]])  # drop what steps back
    i, j = i[ahead], j[ahead]
    # the words between the end of one k-mer and the next, at the same or another diagonal
    i, j = np.concatenate([[-WORDS], i, [len(a)]]), np.concatenate([[-WORDS], j, [len(b)]])
    di, dj = np.diff(i), np.diff(j)
    gap = ~((di == dj) & (di <= WORDS))
    # overlapping k-mers on different diagonals overlap by their words: count the shift
    ga, gb = np.maximum(di[gap] - WORDS, 0), np.maximum(dj[gap] - WORDS, 0)
    shift = np.abs(di[gap] - dj[gap])
    cost = np.maximum(np.maximum(ga, gb), shift)
    if cost.sum() <= most:
        return True
    total = int(shift.sum())
    if total > most:
        return False
    total = 0
    for s, t, n, m, least in zip(i[:-1][gap] + WORDS, j[:-1][gap] + WORDS, ga, gb, cost):
        if least > 2 and n and m:
            e = edits_within(a[s : s + n], b[t : t + m], min(int(least), most - total))
            total += int(least) if e is None else max(e, abs(int(n) - int(m)))
        else:
            total += int(least)
        if total > most:
            return False
    return True


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common, counted: from above, what an alignment can match."""
    x, cx = np.unique(a, return_counts=True)
    y, cy = np.unique(b, return_counts=True)
    _, px, py = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(cx[px], cy[py]).sum())


def similar(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    if not longest:
        return True
    most = int((1 - threshold) * longest + 1e-9)
    if longest - min(len(a), len(b)) > most or longest - _common(a, b) > most:
        return False
    return _anchored(a, b, most) or edits_within(a, b, most) is not None


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, digest, n, keys): a hash of the text as it stands, the 128-bit digest of the words, their number, the sketch keys."""

    def block(ids: list, marks: list, hashes: list[int], sizes: list[int]) -> pa.RecordBatch:
        h, n = np.fromiter(hashes, np.uint64, len(hashes)), np.array(sizes, np.int64)
        ends = np.cumsum(n)
        digests = [xxhash.xxh3_128_digest(h[e - s : e].tobytes()) for s, e in zip(n.tolist(), ends.tolist())]
        columns = [pa.concat_arrays(ids), pa.concat_arrays(marks), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(text_keys(h, n), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["id", "mark", "digest", "n", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, hashes, sizes = batch.column(0), batch.column(2), [], []
            for at, text in enumerate(batch.column(1), 1):
                found = words(text.as_py())
                hashes += [_hashes[w] for w in found]
                sizes.append(len(found))
                if len(hashes) >= BLOCK or at == batch.num_rows:
                    yield block([ids.slice(at - len(sizes), len(sizes))], [marks.slice(at - len(sizes), len(sizes))], hashes, sizes)
                    hashes, sizes = [], []

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    return rows.transform(in_arrow, run, f"id {rows.schema['id'].dataType.simpleString()}, mark long, digest binary, n int, keys array<long>")


def _numbered(nodes: DataFrame) -> DataFrame:
    """Adds node: a number of the row in the table as it is written, with the rough length of its text in the lowest bits."""
    row = F.monotonically_increasing_id()
    rough = F.when(F.col("n") > 0, F.floor(F.log2("n") * STEPS)).otherwise(0)
    fits = F.when(row < F.lit(1 << (63 - LENGTH_BITS)), row).otherwise(F.raise_error(F.lit("more than 2^20 partitions")).cast("long"))
    return nodes.withColumn("node", F.shiftleft(fits, LENGTH_BITS) + rough.cast("long"))


def _steps(threshold: float) -> int:
    """How far the rough lengths of two texts within the threshold are apart at most."""
    return math.ceil(STEPS * math.log2(1 / threshold)) + 1


def _rough(node: str) -> Column:
    return F.col(node).bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))


def _near_lengths(threshold: float) -> Column:
    return F.abs(_rough("u") - _rough("v")) <= _steps(threshold)


def _met(nodes: DataFrame) -> DataFrame:
    """(key, node, low, high, members): the nodes of every bucket of two or more, with its first and its last one."""
    rows = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    bucket = Window.partitionBy("key")  # keys and nodes are shuffled once, and a full bucket's rows spill
    stars = rows.select("key", "node", F.min("node").over(bucket).alias("low"), F.max("node").over(bucket).alias("high"), F.count(F.lit(1)).over(bucket).alias("members"))
    return stars.where("low < high")


def _pairs(met: DataFrame, threshold: float) -> DataFrame:
    """(u, v), u < v: every member of a bucket with its first and its last node, where their lengths allow the threshold."""
    ends = F.array(F.struct(F.col("low").alias("u"), F.col("node").alias("v")), F.struct(F.col("node").alias("u"), F.col("high").alias("v")))
    return met.select(F.inline(ends)).where("u < v").where(_near_lengths(threshold)).distinct()


def _labelled_words(texts: DataFrame) -> DataFrame:
    """(node, label, size, word): every word of a text (node, label, words), told apart by its occurrence, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, label, column in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                h = np.frombuffer(column.as_buffer(), np.uint64)
                with np.errstate(over="ignore"):
                    found = _labels(_mix(h), np.zeros(len(h), np.uint64)).view(np.int64)
                columns = [np.full(len(h), node), np.full(len(h), label), np.full(len(h), len(h), np.int32), found]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "label", "size", "word"])

    return texts.select("node", "label", "words").transform(in_arrow, run, "node long, label long, size int, word long")


def _parities(marks: np.ndarray) -> np.ndarray:
    """Bits, 256 at least and four or more for each of a text's words as ``_labelled_words`` tells them apart, a power of two in all: whether a place has an odd number of them."""
    size = max(256, 1 << (PARITY_BITS * max(1, len(marks)) - 1).bit_length())
    return np.packbits(np.bincount((marks & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).view(np.uint64)


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """Words, at least, that one of two texts has and the other lacks, by their ``_parities``; more places fold into fewer."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _signatures(texts: DataFrame) -> DataFrame:
    """(node, bits 0 to 7): whether each of 512 places has an odd number of the text's words as ``_labelled_words`` tells them apart."""
    names = [f"bits{i}" for i in range(8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((batch.num_rows, 512), np.uint8)
            for row, column in zip(bits, batch.column(1)):
                h = np.frombuffer(column.as_buffer(), np.uint64)
                with np.errstate(over="ignore"):
                    row += np.bincount((_labels(_mix(h), np.zeros(len(h), np.uint64)) >> np.uint64(55)).astype(np.int64), minlength=512).astype(np.uint8) & 1
            packed = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(packed[:, i]) for i in range(8)]], ["node", *names])

    return texts.select("node", "words").transform(in_arrow, run, "node long, " + ", ".join(f"{n} long" for n in names))


def _differ() -> Column:
    """Words, at least, that one of u and v has and the other lacks: every such word turns one of the bits."""
    return sum((F.bit_count(F.col(f"u_bits{i}").bitwiseXOR(F.col(f"v_bits{i}"))) for i in range(8)), F.lit(0))


def _with_others(rows: DataFrame, by: str, rough: Column, threshold: float) -> DataFrame:
    """The rows (label, ...) that have one of another label at the same ``by`` whose ``rough`` length allows the threshold; where
    rows tell the words ``left`` and ``needed``, one that leaves as many as either text needs."""
    placed = rows.withColumn("rough", rough)
    ends = {"least": F.min("needed"), "most": F.max("left")} if "left" in rows.columns else {}
    cells = placed.groupBy(by, "rough").agg(F.min("label").alias("l"), F.max("label").alias("h"), *[x.alias(n) for n, x in ends.items()])
    # as many as there are rough lengths, at most
    near = cells.groupBy(by).agg(F.collect_list(F.struct("rough", "l", "h", *ends)).alias("near")).where("array_min(near.l) < array_max(near.h)")
    fits = f"abs(x.rough - rough) <= {_steps(threshold)} and (x.l < label or x.h > label)" + (" and x.most >= needed and x.least <= left" if ends else "")
    return placed.join(near, by).where(f"exists(near, x -> {fits})").select(*rows.columns)


def _labelled(crowd: DataFrame, labels: DataFrame) -> DataFrame:
    return crowd.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _meetings(crowd: DataFrame, texts: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(word, node, label, size, needed, left, before, bits): the rare words by which nodes of ``crowd`` (key, node) with several labels meet.

    Two texts within the threshold have ``needed`` words of the longer in common, counted.  In the order of all words by
    their number of texts, nothing before the first common word is common: so either text has ``needed`` words ``left``
    from there on, and none of the words ``before`` it, of which the last ``BEFORE`` are kept, is the other's."""
    several = lambda df, by: df.groupBy(by).agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select(by)
    named = cut(_labelled(crowd, labels), "crowd-labels")
    members = cut(named.join(several(named, "key"), "key").select("node", "label").distinct(), "crowd")
    found = cut(_labelled_words(texts.join(members, "node")), "crowd-words")
    seen = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "word")
    needed = F.col("size") - F.floor((1 - threshold) * F.col("size") + 1e-9).cast("int")
    placed = found.join(seen, "word", "left").withColumn("needed", needed).withColumn("left", F.col("size") - F.row_number().over(order) + 1)
    placed = placed.withColumn("before", F.collect_list(F.when(F.col("n") > 1, F.col("word"))).over(order.rowsBetween(-BEFORE, -1)))
    rows = cut(placed.where("left >= needed and n > 1").drop("n"), "crowd-rare")
    bits = cut(_signatures(texts.join(members, "node", "left_semi")), "crowd-bits")
    return cut(_with_others(rows, "word", F.floor(F.log2("size") * STEPS), threshold).join(bits, "node"), "crowd-meetings")


def _crowd_pairs(meetings: DataFrame) -> DataFrame:
    """(u, v), u < v: the pairs that no link joins so far and that may align.

    Exact: a pair that aligns stands at its first common word, and no more words differ than the threshold allows."""
    ends = [meetings.select("word", F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in meetings.columns if c not in ("word", "node")]) for x in "uv"]
    both = ends[0].join(ends[1], "word").where("u < v and u_label != v_label and not arrays_overlap(u_before, v_before)")
    needed = F.greatest("u_needed", "v_needed")
    return both.where(F.least("u_left", "v_left") >= needed).where(_differ() <= F.col("u_size") + F.col("v_size") - 2 * needed).select("u", "v").distinct()


def _with_parities(texts: DataFrame) -> DataFrame:
    """(node, size, parities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, made = [], []
            for column in batch.column(1):
                h = np.frombuffer(column.as_buffer(), np.uint64)
                with np.errstate(over="ignore"):
                    made.append(_parities(_labels(_mix(h), np.zeros(len(h), np.uint64))).tobytes())
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(made, pa.binary())], ["node", "size", "parities"])

    return texts.select("node", "words").transform(in_arrow, run, "node long, size int, parities binary")


def _close(pairs: DataFrame, parities: DataFrame, threshold: float) -> DataFrame:
    """The (u, v) pairs but those whose parities tell that more words differ than the threshold allows: those don't align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
        for batch in batches:
            good = []
            for n, m, a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                longest = max(n, m)
                needed = longest - int((1 - threshold) * longest + 1e-9)
                good.append(_apart(bits(a), bits(b)) <= n + m - 2 * needed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    ends = [parities.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("parities").alias(f"{x}_parities")) for x in "uv"]
    both = pairs.join(ends[0], "u").join(ends[1], "v").select("u", "v", "u_size", "v_size", "u_parities", "v_parities")
    return both.transform(in_arrow, run, "u long, v long")


def _small_pairs(small: DataFrame, threshold: float) -> DataFrame:
    """(u, v), u < v: the pairs of buckets (key, node, label) of ``SMALL`` nodes at most that no link joins so far and whose lengths allow the threshold."""
    ends = [small.select("key", F.col("node").alias(x), F.col("label").alias(f"{x}_label")) for x in "uv"]
    return ends[0].join(ends[1], "key").where("u < v and u_label != v_label").where(_near_lengths(threshold)).select("u", "v").distinct()


def _blocks(meetings: DataFrame) -> DataFrame:
    """(node, block): nodes that meet at the same word, some ``TILE`` or ``TILE_WORDS`` words a block; those of a large class apart from the others."""
    met = meetings.groupBy("word").agg(F.count(F.lit(1)).alias("met"))
    often = meetings.join(met, "word").groupBy("node").agg(F.max(F.struct("met", "word")).alias("often"), F.first("label").alias("label"), F.first("size").alias("size"))
    rows = cut(often.select("node", F.col("often.word").alias("word"), "label", "size"), "crowd-often")
    parts = rows.groupBy("word", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    parts = parts.withColumn("large", F.when(F.col("n") >= TILE, F.col("label")))
    cuts = F.ceil(F.greatest(F.sum("n") / TILE, F.sum("words") / TILE_WORDS))
    sizes = parts.groupBy("word", "large").agg(cuts.alias("cuts"))
    named = rows.join(parts.select("word", "label", "large"), ["word", "label"])
    same = (named["word"] == sizes["word"]) & named["large"].eqNullSafe(sizes["large"])
    return named.join(sizes, same).select("node", F.xxhash64(named["word"], named["large"], F.pmod(F.xxhash64("node"), "cuts")).alias("block"))


def _aligned_in_tiles(pairs: DataFrame, texts: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """The (u, v) pairs whose words align, by tiles of two blocks: a text goes to a tile once, not to each of its pairs."""
    of = [blocks.select(F.col("node").alias(x), F.col("block").alias(f"{x}_block")) for x in "uv"]
    tile = F.xxhash64(F.least("u_block", "v_block"), F.greatest("u_block", "v_block"))
    dealt = cut(pairs.join(of[0], "u").join(of[1], "v").select(tile.alias("tile"), "u", "v"), "crowd-tiles")
    nodes = dealt.select(F.col("tile").alias("at"), F.col("u").alias("node")).union(dealt.select(F.col("tile").alias("at"), F.col("v").alias("node"))).distinct()

    def run(some: pa.Table, texts: pa.Table) -> pa.Table:
        words = {n: np.frombuffer(w.as_buffer(), np.uint64) for n, w in zip(texts["node"].to_pylist(), texts["words"])}
        good = [similar(words[u], words[v], threshold) for u, v in zip(some["u"].to_pylist(), some["v"].to_pylist())]
        return some.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return dealt.groupBy("tile").cogroup(nodes.join(texts, "node").select("at", "node", "words").groupBy("at")).applyInArrow(run, "u long, v long")


def _words_of(docs: DataFrame, nodes: DataFrame, met: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, words): the word hashes, 8 bytes each, of every node of ``met``, from its first row."""
    wanted = nodes.join(met, "node", "left_semi").select("node", "digest", F.col("first.id").alias("i")).hint("shuffle_hash")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # rows may repeat an id, with the node's text or another
        for batch in batches:
            keep, out = [], []
            for node, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if node not in done:
                    h = word_hashes(text.as_py()).tobytes()
                    if xxhash.xxh3_128_digest(h) == digest:
                        done.add(node)
                        keep.append(node)
                        out.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(out, pa.binary())], ["node", "words"])

    return rows.join(wanted, rows["id"].eqNullSafe(wanted["i"])).select("node", "digest", "text").transform(in_arrow, run, "node long, words binary")


def _aligned(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The (u, v) pairs with whether their words align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3))
            good = [similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), threshold) for a, b in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["u", "v", "good"])

    ends = [texts.select(F.col("node").alias(x), F.col("words").alias(f"{x}_words")) for x in "uv"]
    joined = pairs.join(ends[1], "v").join(ends[0], "u").select("u", "v", "u_words", "v_words")
    return joined.transform(in_arrow, run, "u long, v long, good boolean")


def links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(u, v) links whose components are those of all pairs of a bucket that align."""
    met = cut(_met(nodes), "met")
    pairs = cut(_pairs(met, threshold), "pairs")
    crowd = met.where("members > 3").select("key", "node", "members")
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).union(crowd.select("node")).distinct()
    texts = cut(_words_of(docs, nodes, wanted, id_col, text_col), "words")
    first = cut(_aligned(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), texts, threshold), "first-partners")
    # v and its first partner are joined if they aligned; a pair whose ends lead to one node needs no alignment
    heads = first.select("v", F.col("u").alias("tried"), F.when(F.col("good"), F.col("u")).otherwise(F.col("v")).alias("v_head"))
    leads = first.where("good").select(F.col("v").alias("u"), F.col("u").alias("u_head"))
    rest = pairs.join(heads, "v").where("u != tried").join(leads, "u", "left").where("coalesce(u_head, u) != v_head").select("u", "v")
    more = cut(_aligned(rest, texts, threshold), "other-partners")
    found = first.union(more).where("good").select("u", "v")
    labels = components(found)
    others = cut(_with_others(cut(_labelled(crowd, labels), "crowd-buckets"), "key", _rough("node"), threshold), "crowd-others")
    meetings = _meetings(others.where(F.col("members") > SMALL).select("key", "node"), texts, labels, threshold)
    small = cut(_small_pairs(others.where(F.col("members") <= SMALL), threshold).join(pairs, ["u", "v"], "left_anti"), "small-pairs")
    large = cut(_crowd_pairs(meetings).join(pairs, ["u", "v"], "left_anti"), "large-pairs")
    near = others.where(F.col("members") <= SMALL).select("node").union(meetings.select("node")).distinct()  # no more than the members, however many pairs
    parities = cut(_with_parities(texts.join(near, "node", "left_semi")), "parities")
    of_small = cut(_aligned(_close(small, parities, threshold), texts, threshold), "small-partners").where("good").select("u", "v")
    of_large = cut(_aligned_in_tiles(cut(_close(large, parities, threshold), "close-pairs"), texts, _blocks(meetings), threshold), "crowd-partners")
    return found.union(of_small).union(of_large)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(id, class_id, class_size, kept) for every row; class_id is the least id of the class.  Of rows with that id, those are kept that are
    alike in words with the first by digest: rows that repeat an id may have different texts, in one class or in several."""
    return _classes(docs, id_col, text_col, threshold).select("id", "class_id", "class_size", "kept", "digest")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """The same rows with mark and label, the number of their class."""
    base = cut(_sketched(docs, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"))).alias("first")
    same = base.groupBy("digest").agg(first, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = cut(_numbered(same), "nodes")
    labels = components(links(nodes, docs, id_col, text_col, threshold))
    named = nodes.select("node", "digest", "first", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = named.groupBy("label").agg(F.min(F.struct("first.z", "first.id", F.col("digest").alias("least"))).alias("least"), F.sum("copies").alias("class_size"))
    # written first, so that the rows of a very large class are dealt out afresh and can be split
    named = named.join(cut(groups, "classes"), "label").select("digest", "label", F.col("least.id").alias("class_id"), F.col("least.least").alias("head"), "class_size")
    return base.select("id", "mark", "digest").join(named, "digest").select("id", "class_id", "class_size", F.expr("id <=> class_id and digest = head").alias("kept"), "digest", "mark", "label")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class, with its columns: the least id's.  Rows that repeat that id with other texts have their own classes' fate."""
    kept = _classes(docs, id_col, text_col, threshold).where("kept").groupBy("label").agg(F.first("id").alias("__quarry_id"), F.min("mark").alias("__quarry_mark")).drop("label")
    marked = docs.withColumn("__quarry_own", F.xxhash64(text_of(text_col)))
    out = marked.join(kept, marked[id_col].eqNullSafe(kept["__quarry_id"]) & (F.col("__quarry_own") == F.col("__quarry_mark")), "left_semi")
    same = Window.partitionBy(F.col(id_col), "__quarry_own").orderBy(F.col(id_col))
    return out.withColumn("__quarry_turn", F.row_number().over(same)).where("__quarry_turn = 1").select(*[F.col(f"`{c}`") for c in docs.columns])

"""Suffix-array dedup: removes every byte of a 400-byte string that starts more than once.

A full suffix array has an entry a byte.  Here suffixes start at anchors only: the
position of the least hashed ``GRAM``-byte string in each window of ``LENGTH``
bytes (the leftmost if equal).  An anchor depends on the window's bytes alone, so
two equal windows have equal anchors at the same place, and a window's equal can
be sought among the suffixes that begin with the same gram.  What surrounds an
anchor decides its windows: with ``left`` bytes before the gram and ``right``
bytes after it in common with another anchor, the strings of ``LENGTH`` bytes in
common exist exactly if left + GRAM + right >= LENGTH, and together they cover
those bytes without a gap.

1. Anchors are (gram hash, context hash, document, position).  Grams that occur
   once go; anchors whose whole context occurs again are settled by two 64-bit
   hashes.
2. Grams with several contexts send one copy of each context into two suffix
   sorts: by the bytes after the anchor, and by those before it read backwards.
   Sampled splitters range-partition the suffixes by their leading bytes (so a
   gram that a third of all documents hold is spread), each bucket sorts locally
   by multikey quicksort, and neighbours are compared, also across boundaries.
   The neighbour gives the longest match to that side.
3. If the best neighbours to the right and to the left each reach LENGTH in total
   the extents are exact; if the two longest sides cannot reach it together there
   is nothing; what remains meets the contexts of its gram: by pairs
   where they are few, else by counting equal strings of LENGTH bytes.
4. Spans return to their document, are merged, and the rest is hashed.

Strings are judged on the input.  Defined results: null text is empty; matches
stay inside a document; a repeated row (same id and text) is another document;
texts under 400 bytes stay whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, partitions, text_of

LENGTH = 400
GRAM = 100
#: Bytes of context on either side of a gram.
SIDE = LENGTH - GRAM
#: Positions are searched for anchors in blocks of this many.
STEP = 1 << 22
BLOCK = 1 << 19
#: Grams with up to this many contexts are compared by pairs; the others by counting.
FEW = 64
#: A range of the suffix sorts holds about so many contexts (of some 700 bytes) at most; sorting takes a few times their bytes.
MOST_RANGE = 50_000
_LOW = np.uint64((1 << 24) - 1)

_rng = np.random.default_rng(20240501)
_TABLES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2^64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        out = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[which] = (out[0], out[1])
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substring from sums over the prefixes."""

    def __init__(self, data: np.ndarray, which: int):
        power, self.inverse = _power(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def anchors(data: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes, context hashes and document numbers of the anchors of documents that lie end to end in ``data``."""
    ends = np.array([len(data)]) if ends is None else ends
    count = len(data) - GRAM + 1
    width, found = SIDE + 1, []
    if count < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        first = Hashes(data, 0)
        grams = (first.sums[GRAM:] - first.sums[:count]) * first.inverse[:count]
        mixed = _mix(grams) & ~_LOW
        inside = np.zeros(len(data) + 1, np.int8)  # windows that begin here and stay in their document
        begins = np.concatenate([[0], ends[:-1]])
        long = ends - begins >= LENGTH
        np.add.at(inside, begins[long], 1)
        np.add.at(inside, ends[long] - LENGTH + 1, -1)
        inside = np.cumsum(inside)[: count - width + 1].astype(bool)
        for lo in range(0, count - width + 1, STEP):
            key = mixed[lo : min(count, lo + STEP + width - 1)] | np.arange(min(count, lo + STEP + width - 1) - lo, dtype=np.uint64)
            m = len(key)
            padded = np.full(-(-m // width) * width, np.uint64(2**64 - 1))
            padded[:m] = key
            grid = padded.reshape(-1, width)
            ahead = np.minimum.accumulate(grid, axis=1).ravel()
            back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            least = (np.minimum(back[: m - width + 1], ahead[width - 1 : m]) & _LOW)[inside[lo : lo + m - width + 1]]
            keep = np.ones(len(least), bool)
            keep[1:] = least[1:] != least[:-1]
            found.append(least[keep].astype(np.int64) + lo)
        at = np.unique(np.concatenate(found))
        doc = np.searchsorted(ends, at, side="right")
        second = Hashes(data, 1)
        lo, hi = np.maximum(at - SIDE, begins[doc]), np.minimum(at + GRAM + SIDE, ends[doc])
        context = _mix(second.of(lo, hi) ^ _mix((at - lo).astype(np.uint64) * np.uint64(1009) + (hi - at).astype(np.uint64)))
    return at, grams[at], context, doc


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of big-endian words: three-way partitions by one word at a time."""
    order = np.arange(len(rows))
    todo = [(0, len(rows), 0)]
    while todo:
        lo, hi, k = todo.pop()
        if hi - lo < 2 or k >= rows.shape[1]:
            continue
        part = order[lo:hi]
        word = rows[part, k]
        if hi - lo <= 24:
            part = part[np.lexsort(rows[part, k:].T[::-1])]
            order[lo:hi] = part
            continue
        pivot = np.sort(word[:: max(1, len(word) // 9)])[min(4, len(word) // 2)]
        less, same = word < pivot, word == pivot
        order[lo:hi] = np.concatenate([part[less], part[same], part[~(less | same)]])
        a, b = lo + int(less.sum()), lo + int(less.sum()) + int(same.sum())
        todo += [(lo, a, k), (a, b, k + 1), (b, hi, k)]
    return order


def _words(column: pa.Array, width: int) -> np.ndarray:
    """Fixed-width binaries as rows of big-endian words."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, width)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the rows of two matrices share from the start."""
    unequal = a != b
    return np.where(unequal.any(axis=1), unequal.argmax(axis=1), a.shape[1])


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "at", "rest", "gram", "context"]
        for batch in batches:
            k1, k2, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(sizes) // BLOCK  # documents are taken in blocks of about this many bytes
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                ends = np.cumsum(sizes[a:b])
                data = np.frombuffer(b"".join(t.as_buffer() for t in texts[a:b]), np.uint8)
                at, gram, context, doc = anchors(data, ends)
                begin = ends[doc] - sizes[a:b][doc]
                columns = [k1[a:b][doc], k2[a:b][doc], (at - begin).astype(np.int32), (ends[doc] - at).astype(np.int32), gram.view(np.int64), context.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return docs.select("k1", "k2", "text").transform(in_arrow, run, "k1 long, k2 long, at int, rest int, gram long, context long")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, context, before, after, n_before, n_after): bytes to the left read backwards and bytes to the right, padded with 0xFF."""
    by_doc = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "context", "at")).alias("places")).hint("shuffle_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "context", "before", "after", "n_before", "n_after"]
        for batch in batches:
            out: list[tuple] = []
            for text, places in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.as_py().encode()
                for p in places:
                    at = p["at"]
                    before, after = data[max(0, at - SIDE) : at][::-1], data[at + GRAM : at + GRAM + SIDE]
                    out.append((p["gram"], p["context"], before.ljust(SIDE, b"\xff"), after.ljust(SIDE, b"\xff"), len(before), len(after)))
                if len(out) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], names)

    return docs.join(by_doc, ["k1", "k2"]).select("text", "places").transform(in_arrow, run, "gram long, context long, before binary, after binary, n_before int, n_after int")


_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())


def _neighbours(contexts: DataFrame, side: str, other: str) -> DataFrame:
    """(gram, context, reach, whole): the longest match on ``side`` with another context of the gram, and whether a neighbour with that match reaches LENGTH."""
    parts = max(partitions(contexts.sparkSession), -(-contexts.count() // MOST_RANGE))
    ranged = contexts.repartitionByRange(parts, "gram", side, other)
    n_side, n_other = f"n_{side}", f"n_{other}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bucket = TaskContext.get().partitionId()
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        col = lambda name: table.column(name).to_numpy()
        gram, near, far = col("gram"), _words(table.column(side), SIDE), _words(table.column(other), SIDE)
        lead = (gram.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
        pad = np.zeros((len(gram), -(2 * SIDE) % 8), np.uint8)
        order = multikey_quicksort(np.ascontiguousarray(np.hstack([lead, near, far, pad])).view(">u8").astype(np.uint64))
        gram, near, far, context = gram[order], near[order], far[order], col("context")[order]
        n_near, n_far = col(n_side)[order], col(n_other)[order]
        m = len(order)
        reach, whole, edge = np.zeros(m, np.int64), np.zeros(m, bool), np.zeros(m, np.int64)
        if m > 1:
            same = gram[1:] == gram[:-1]
            r = np.minimum(np.where(same, common_prefix(near[1:], near[:-1]), 0), np.minimum(n_near[1:], n_near[:-1]))
            o = np.minimum(np.where(same, common_prefix(far[1:], far[:-1]), 0), np.minimum(n_far[1:], n_far[:-1]))
            full = same & (r + o + GRAM >= LENGTH)
            up, down = np.zeros(m, np.int64), np.zeros(m, np.int64)
            up[1:], down[:-1] = np.where(same, r, -1), np.where(same, r, -1)
            up[0] = down[-1] = -1
            reach = np.maximum(up, down)
            f_up, f_down = np.zeros(m, bool), np.zeros(m, bool)
            f_up[1:], f_down[:-1] = full, full
            whole = (f_up & (up == reach)) | (f_down & (down == reach))
        else:
            reach[:] = -1
        edge[0] += 1
        edge[-1] += 2
        body = [pa.array(gram), pa.array(context), pa.array(reach), pa.array(whole), pa.array(np.full(m, bucket, np.int64)), pa.array(edge)]
        ends = [bytes(x) if e else None for x, e in zip(near, edge)], [bytes(x) if e else None for x, e in zip(far, edge)]
        body += [pa.array(ends[0], pa.binary()), pa.array(ends[1], pa.binary()), pa.array(n_near, pa.int32()), pa.array(n_far, pa.int32())]
        yield pa.RecordBatch.from_arrays(body, ["gram", "context", "reach", "whole", "bucket", "edge", "near", "far", "n_near", "n_far"])

    found = cut(ranged.transform(in_arrow, run, "gram long, context long, reach long, whole boolean, bucket long, edge long, near binary, far binary, n_near int, n_far int"), f"neighbours-{side}")
    # the last suffix of a bucket and the first of the next one: two rows a bucket, so at most twice the number of partitions
    ends = sorted(found.where("edge > 0").collect(), key=lambda r: (r.bucket, r.edge))
    tell: dict[tuple[int, int], tuple[int, bool]] = {}
    for a, b in zip(ends, ends[1:]):
        if a.bucket != b.bucket and a.gram == b.gram:
            lcp = lambda x, y, most: min(most, next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), SIDE))
            r, o = lcp(a.near, b.near, min(a.n_near, b.n_near)), lcp(a.far, b.far, min(a.n_far, b.n_far))
            for x in (a, b):
                old = tell.get((x.gram, x.context), (-1, False))
                new = (r, r + o + GRAM >= LENGTH)
                tell[x.gram, x.context] = max(old, new)
    out = found.select("gram", "context", "reach", "whole")
    if tell:
        across = contexts.sparkSession.createDataFrame([(*k, *v) for k, v in tell.items()], "gram long, context long, r long, w boolean")
        out = out.join(F.broadcast(across), ["gram", "context"], "left")
        better = F.col("r") > F.col("reach")
        out = out.select("gram", "context", F.when(better, F.col("r")).otherwise(F.col("reach")).alias("reach"), F.when(better, F.col("w")).when(F.col("r") == F.col("reach"), F.col("w") | F.col("whole")).otherwise(F.col("whole")).alias("whole"))
    return out


def _counted(contexts: DataFrame, both: DataFrame, open_: DataFrame) -> DataFrame:
    """As ``_compared``, for grams with many contexts: counts equal strings of LENGTH bytes instead of meeting pairs.

    With l bytes before the gram and SIDE - l after it, a string is settled by l; a context can only share
    those within its best extents.  Rows are contexts times their few l, and equal ones are summed map-side."""
    asked = open_.groupBy("gram").agg(F.min(SIDE - F.col("after")).alias("lo"), F.max("before").alias("hi"))
    own = both.join(asked, "gram").join(open_.select("gram", "context", F.lit(True).alias("open")), ["gram", "context"], "left")
    own = own.select("gram", "context", "open", F.greatest("lo", SIDE - F.col("after")).cast("int").alias("lo"), F.least("hi", "before").cast("int").alias("hi")).where("lo <= hi")
    strings = contexts.join(own, ["gram", "context"]).withColumn("l", F.explode(F.sequence("lo", "hi")))
    left, right = F.substring(F.col("before"), F.lit(1), F.col("l")), F.substring(F.col("after"), F.lit(1), SIDE - F.col("l"))
    strings = strings.select("gram", "context", "open", "l", F.xxhash64("gram", "l", left, right).alias("h1"), F.xxhash64(F.lit(1), right, left, "l", "gram").alias("h2"))
    twice = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    hit = strings.where("open").join(twice, ["h1", "h2"])
    return hit.groupBy("gram", "context").agg(F.max("l").cast("long").alias("n_before"), F.max(SIDE - F.col("l")).cast("long").alias("n_after"))


def _compared(contexts: DataFrame, open_: DataFrame) -> DataFrame:
    """(gram, context, n_before, n_after): exact extents of the few anchors that their neighbours do not settle."""
    # A pair that reaches LENGTH shares at least SIDE - (the other side's best) on each side.  Contexts meet
    # on the bytes of that much, rounded down to few sizes, so a common gram is not expanded into its pairs.
    coarse = lambda n: F.when(n < 25, n).otherwise(n - n % 25).cast("int")
    least = lambda best: coarse(F.greatest(F.lit(0), F.lit(SIDE) - F.col(best)))
    want = open_.select("gram", "context", least("after").alias("t"), least("before").alias("u"))
    keyed = contexts.join(want.select("gram", "t", "u").distinct(), "gram")
    keyed = keyed.withColumn("meet", F.xxhash64("gram", "t", "u", F.substring(F.col("before"), F.lit(1), F.col("t")), F.substring(F.col("after"), F.lit(1), F.col("u"))))
    mine = keyed.join(want, ["gram", "context", "t", "u"]).select("gram", "meet", *[F.col(c).alias(f"my_{c}") for c in ("context", "before", "after", "n_before", "n_after")])
    contexts = keyed.drop("t", "u")
    pairs = mine.join(contexts, ["gram", "meet"]).where("context != my_context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda name: batch.column(batch.schema.get_field_index(name))
            n = {}
            for side in ("before", "after"):
                shared = common_prefix(_words(col(f"my_{side}"), SIDE), _words(col(side), SIDE))
                n[side] = np.minimum(shared, np.minimum(col(f"my_n_{side}").to_numpy(), col(f"n_{side}").to_numpy()))
            ok = n["before"] + n["after"] + GRAM >= LENGTH
            yield pa.RecordBatch.from_arrays([col("gram").filter(pa.array(ok)), col("my_context").filter(pa.array(ok)), pa.array(n["before"][ok].astype(np.int64)), pa.array(n["after"][ok].astype(np.int64))], ["gram", "context", "n_before", "n_after"])

    return pairs.transform(in_arrow, run, "gram long, context long, n_before long, n_after long").groupBy("gram", "context").agg(F.max("n_before").alias("n_before"), F.max("n_after").alias("n_after"))


def spans(docs: DataFrame, few_contexts: int = FEW) -> DataFrame:
    """(k1, k2, lo, hi) for rows (k1, k2, text); spans of a document may overlap."""
    rows = _anchor_rows(docs)
    grams = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed"))
    # written first, so that the join's rows are dealt out afresh and those of a very common gram can be split
    shared = cut(rows.join(cut(grams, "shared-grams"), "gram"), "shared-anchors")
    whole = lambda d: d.select("k1", "k2", (F.col("at") - F.least(F.lit(SIDE), F.col("at"))).alias("lo"), (F.col("at") + F.least(F.lit(GRAM + SIDE), F.col("rest"))).alias("hi"))
    mixed = shared.where("mixed")
    by_context = mixed.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one"))
    by_context = cut(by_context, "mixed-contexts")
    contexts = cut(_contexts(docs, by_context.select("gram", "context", "one.*")), "contexts")
    after = _neighbours(contexts, "after", "before").select("gram", "context", F.col("reach").alias("after"), F.col("whole").alias("after_whole"))
    before = _neighbours(contexts, "before", "after").select("gram", "context", F.col("reach").alias("before"), F.col("whole").alias("before_whole"))
    both = cut(after.join(before, ["gram", "context"]).where(f"after + before + {GRAM} >= {LENGTH}"), "extents")
    settled = both.where("after_whole and before_whole").select("gram", "context", F.col("before").alias("n_before"), F.col("after").alias("n_after"))
    open_ = both.where("not (after_whole and before_whole)")
    if not open_.isEmpty():
        sizes = by_context.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        few, many = (open_.join(sizes.where(w).select("gram"), "gram", "left_semi") for w in (f"n <= {few_contexts}", f"n > {few_contexts}"))
        settled = settled.unionByName(_compared(contexts, few)).unionByName(_counted(contexts, both, many))
    again = by_context.where("n > 1").select("gram", "context")
    partly = mixed.join(settled, ["gram", "context"]).select("k1", "k2", (F.col("at") - F.col("n_before")).cast("int").alias("lo"), (F.col("at") + GRAM + F.col("n_after")).cast("int").alias("hi"))
    return whole(shared.where("not mixed")).union(whole(mixed.join(again, ["gram", "context"], "left_semi"))).union(partly)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few_contexts: int = FEW) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary's hex SHA-256, spans) for every row."""
    text = text_of(text_col)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null"))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(name, text).alias("k1"), F.xxhash64(F.lit(1), text, name).alias("k2"))
    by_doc = spans(keyed, few_contexts).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).hint("shuffle_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                data, merged = text.as_py().encode(), []
                for s in sorted(found or (), key=lambda s: s["lo"]):
                    if merged and s["lo"] <= merged[-1]["hi"]:
                        merged[-1]["hi"] = max(merged[-1]["hi"], s["hi"])
                    else:
                        merged.append(dict(s))
                kept, last = hashlib.sha256(), 0
                for s in merged:
                    kept.update(data[last : s["lo"]])
                    last = s["hi"]
                kept.update(data[last:])
                out.append((len(data), sum(s["hi"] - s["lo"] for s in merged), len(merged), kept.hexdigest(), merged))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    joined = keyed.join(by_doc, ["k1", "k2"], "left").select("id", "text", "spans")
    return joined.transform(in_arrow, run, f"id {keyed.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:int,hi:int>>")

"""Byte-level BPE: encode by ranked merges over the distinct words, decode by joining pieces.

A text is split by the tokenizer's pattern.  Each distinct word of a task is a
byte array over which the ranked merges are folded once: the adjacent pair of
lowest rank merges (leftmost on a tie) until no pair has a rank.  A bounded memo
holds the ids of words seen.  Decoding joins the binary piece of every id.

Two forms give the same ids:

* ``encode_native`` folds with Spark's higher-order functions over a literal
  rank map (an array of small maps addressed by hash, since a lookup in one map
  of 50,000 entries is a linear scan).  It stays in the JVM;
* ``encode`` runs the same fold in Arrow batches with a memo of distinct words.
  It is the main path, see the README for the figures that decided it.

Defined results: null text is the empty text, with no ids; bytes round-trip
exactly; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, text_of

#: Slots of the literal rank map.
SLOTS = 1 << 16
#: Words held in a worker's memo; it is emptied when full.
MEMO = 200_000
#: Words of more bytes are folded with a heap, and not kept in the memo.
LONG = 64
NO_RANK = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the ranked merges folded over its bytes."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(parts[i] + parts[i + 1], NO_RANK) for i in range(len(parts) - 1)]
    while pairs and (least := min(pairs)) != NO_RANK:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs, in n log n steps: ``end`` has the end of the part that begins at each place, -1 within a part."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (rank := ranks.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[end[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if 0 < j < n and end[j] == e:  # else one of the two parts has merged meanwhile
            end[i], end[j] = e, -1
            if e < n:
                before[e] = i
            offer(i)
            offer(before[i])
    starts = [i for i in range(n) if end[i] > 0]
    return [ranks[word[i : end[i]]] for i in starts]


class Codec:
    """Encodes and decodes texts with one rank file and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.words = ranks, regex.compile(pattern).findall
        self.pieces = {i: p for p, i in ranks.items()}
        self.memo: dict[str, list[int]] = {}

    def ids(self, text: str) -> list[int]:
        memo, ranks, out = self.memo, self.ranks, []
        if len(memo) > MEMO:
            memo.clear()
        for word in self.words(text):
            found = memo.get(word)
            if found is None:
                found = fold(word.encode(), ranks)
                if len(word) <= LONG:
                    memo[word] = found
            out += found
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = pa.array([own.ids(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.transform(in_arrow, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, bytes binary) for every (id, ids) row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            out = pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["id", "bytes"])

    rows = encoded.select("id", "ids")
    return rows.transform(in_arrow, run, f"id {rows.schema['id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids and digests both, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        names = [str(i) for i in range(max(own.pieces, default=0) + 1)]
        for batch in batches:
            counts, sums, back = [], [], []
            for text in batch.column(1):
                ids = own.ids(text.as_py())
                counts.append(len(ids))
                sums.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.transform(in_arrow, run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


# --- the form of Spark's higher-order functions -----------------------------------------------


def _literal(ranks: dict[bytes, int]) -> str:
    """The rank map as SQL: slot -> {hex of the piece: rank}; constant folding makes it one literal."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        slots[xxhash.xxh64(key.encode(), seed=42).intdigest() & (SLOTS - 1)][key] = rank
    return "from_json('" + json.dumps(slots, separators=(",", ":")) + "', 'array<map<string,int>>')"


def _rank(piece: str) -> str:
    return f"element_at(element_at(rk, cast(xxhash64({piece}) & {SLOTS - 1} as int) + 1), {piece})"


def fold_native(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word") -> DataFrame:
    """Adds ids array<int> to a table of distinct words."""
    least = f"array_min(transform(sequence(1, size(acc) - 1), i -> struct(coalesce({_rank('concat(acc[i-1], acc[i])')}, {NO_RANK}) as r, i as i)))"
    step = (
        f"(acc, x) -> element_at(transform(array({least}), b -> if(b.r = {NO_RANK}, acc, "
        "concat(slice(acc, 1, b.i - 1), array(concat(acc[b.i-1], acc[b.i])), slice(acc, b.i + 2, size(acc))))), 1)"
    )
    n = f"octet_length(`{word_col}`)"
    start = f"transform(sequence(1, {n}), i -> substring(h, 2*i - 1, 2))"
    parts = f"if({n} < 2 or {_rank('h')} is not null, array(h), aggregate(sequence(2, {n}), {start}, {step}))"
    ids = f"element_at(transform(array({_literal(ranks)}), rk -> transform({parts}, p -> {_rank('p')})), 1)"
    return words.withColumn("h", F.hex(F.col(word_col))).withColumn("ids", F.when(F.col("h") == "", F.array().cast("array<int>")).otherwise(F.expr(ids))).drop("h")


def encode_native(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) by DataFrame functions alone: split, fold the distinct words, join back by word, gather in text order."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    split = rows.select("row", "id", F.posexplode_outer(F.regexp_extract_all("text", F.lit("(?U)" + pattern), F.lit(0))).alias("at", "word"))
    coded = fold_native(split.select("word").where("word is not null").distinct(), read_ranks(path))
    joined = split.join(coded, "word", "left")
    gathered = joined.groupBy("row", "id").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return gathered.select("id", F.flatten(F.filter(F.transform("parts", lambda x: x["ids"]), lambda x: x.isNotNull())).alias("ids"))


def native_literal_column(path: str) -> Column:
    return F.expr(_literal(read_ranks(path)))

"""Token counts behind a digest cache.

The cache is a Parquet table of (content, tokenizer, n_tokens): the 128-bit
digest of the content, the digest of the tokenizer's file, the count.  A run

1. digests every text (nothing but digests is shuffled) and joins the distinct
   ones with the cache, anti-joining to find the misses;
2. fetches one text for each distinct miss, encodes it and appends the counts to
   the cache;
3. joins the counts to the rows by digest.  A text that a third of all rows
   share is encoded once, and its join is a skewed key that AQE splits.

Content is normalised by what the tokenizer surely ignores: nothing but the
difference between null and the empty text.  (The tokenizer's own Unicode steps
run inside it; a wider normalisation could merge texts whose counts differ.)

Counting is by distinct word where that is provably the same: in texts of
printable ASCII, Latin-1 letters and plain white space the tokenizer's pattern,
lower-casing and merges act on each word alone, so a bounded memo of words
serves.  Any other text, or one holding an added token's string, goes to the
library whole.

Defined results: null text counts as empty with 0 tokens; repeated rows each
give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_arrow, scratch, shared_dir, text_of

MEMO = 150_000
#: Misses (of about 40 bytes) are broadcast up to so many.
MOST_BROADCAST = 100_000
#: Longer words are not kept in the memo.
LONG = 64


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.md5(file.read()).hexdigest()


class Counter:
    """Counts a text's tokens exactly as the library would."""

    #: Characters on which lower-casing, composition and the split pattern act one by one.
    PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")

    def __init__(self, path: str):
        self.path, self.memo = path, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda text: len(model.encode(text))
            self.words = None
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.library = lambda text: len(tokenizer.encode(text, add_special_tokens=False))
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        self.words = self._split(spec)

    def _split(self, spec: dict):
        """The word splitter, if the file's steps are those for which counting by word is sound."""
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [x["type"] for x in norm.get("normalizers", ())]
        parts = pre.get("pretokenizers", ())
        sound = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
        if not sound or not (parts[0]["behavior"] == "Removed" and parts[0]["invert"]) or spec.get("post_processor"):
            return None
        return regex.compile(parts[0]["pattern"]["Regex"]).findall

    def __call__(self, text: str) -> int:
        if self.words is None or not self.PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return self.library(text)
        memo, total = self.memo, 0
        if len(memo) > MEMO:
            memo.clear()
        for word in self.words(text.lower()):
            n = memo.get(word)
            if n is None:
                n = self.library(word)
                if len(word) <= LONG:
                    memo[word] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def shared_cache(spark: SparkSession, path: str) -> str:
    """The lasting cache of this tokenizer in the shared folder: runs on the same texts find their counts there."""
    return f"{shared_dir(spark).rstrip('/')}/quarry/token-cache-{tokenizer_digest(path)}"


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row.  ``cache`` is the cache table's folder; a new one in the shared folder if none is named."""
    spark = docs.sparkSession
    cache = cache or scratch(spark, "token-cache")
    version = tokenizer_digest(path)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("content", F.unhex(F.md5("text")))
    digests = rows.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes"))

    schema = "content binary, tokenizer string, n_tokens long"
    exists = spark._jvm.org.apache.hadoop.fs.Path(cache)
    known = exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists)
    stored = spark.read.schema(schema).parquet(cache) if known else spark.createDataFrame([], schema)
    stored = stored.where(F.col("tokenizer") == version)

    # one row for each distinct miss, by its first id; the text itself is fetched after
    first = digests.groupBy("content").agg(F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"))).getField("id").alias("id"))
    misses = first.join(stored.select("content"), "content", "left_anti") if known else first
    wanted = cut(misses.select(F.col("content").alias("c"), F.col("id").alias("i")), "token-misses")
    missing = wanted.limit(MOST_BROADCAST + 1).count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["content", "n_tokens"])

    # few misses are sent to the texts; many are the side to build on, so the texts are shuffled but not sorted
    wanted = F.broadcast(wanted) if missing <= MOST_BROADCAST else wanted.hint("shuffle_hash")
    texts = rows.join(wanted, (F.col("content") == F.col("c")) & F.col("id").eqNullSafe(F.col("i")))
    if missing or not known:
        counted = texts.select("content", "text").transform(in_arrow, run, "content binary, n_tokens long")
        counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    # two runs at once may both have appended a count; they agree
    counts = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return digests.join(counts, "content").select("id", "n_bytes", "n_tokens")

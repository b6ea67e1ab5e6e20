"""A prefix tree of sequences as a table, and the longest unique prefix of other sequences in it.

A node is a prefix, keyed by its length and a rolling hash of its moves: one long
a ply, whatever the length, so the tree and the probes are linear in the
sequences.  Nodes count the entries below them and keep the lowest code.  A probe
joins its own (length, hash) rows with the nodes; the first length with a single
entry decides, and only there are the moves themselves compared.

The first plies are shared by many probes: that side of the join is split by
adaptive execution, as the tree is a written table and not summed in the join's
stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Plies that are hashed by one inner fold; the outer one appends whole runs, so an array is copied once a run and not once a ply.
RUN = 128


def prefix_hashes(moves: Column) -> Column:
    """One long for every prefix, the shortest first: h(k) = hash(h(k - 1), k-th move).  Null for null, no hash for an empty array."""
    long_ = "array<bigint>"
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(moves) - 1) / RUN).cast("int")), lambda r: F.slice(moves, r * RUN + 1, F.lit(RUN)))
    step = lambda acc, m: F.struct(F.xxhash64(acc["h"], m).alias("h"), F.array_append(acc["all"], F.xxhash64(acc["h"], m)).alias("all"))
    inner = lambda h, run: F.aggregate(run, F.struct(h.alias("h"), F.array().cast(long_).alias("all")), step)
    begin = F.struct(F.lit(0).cast("bigint").alias("h"), F.array().cast(f"array<{long_}>").alias("runs"))
    both = lambda acc, run: F.element_at(F.transform(F.array(inner(acc["h"], run)), lambda x: F.struct(x["h"].alias("h"), F.array_append(acc["runs"], x["all"]).alias("runs"))), 1)
    return F.when(F.size(moves) > 0, F.flatten(F.aggregate(runs, begin, both)["runs"])).when(moves.isNotNull(), F.array().cast(long_))


def _plies(df: DataFrame, *keep: str) -> DataFrame:
    found = df.select(*keep, F.posexplode(prefix_hashes(F.col("moves"))).alias("k", "hash"))
    return found.select(*keep, (F.col("k") + 1).alias("k"), "hash")


def tree(book: DataFrame) -> DataFrame:
    """(k, hash, n, code): the nodes of (code, moves) entries, how many entries begin so, and the lowest code of them."""
    return _plies(book, "code").groupBy("k", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("code"))


def longest_unique_prefix(lines: DataFrame, book: DataFrame, default: str = "A00") -> DataFrame:
    """(id, code) of every (id, moves) line: the entry that alone has the line's shortest prefix of that kind; else the lowest code of
    the longest prefix that several have; else ``default``.

    ``id`` is unique, ``code`` need not be (equal entries are several).  A prefix that no entry has ends the search by itself: no longer one can be met.
    Lines are cut at the longest entry before they are hashed, since nothing beyond can be met.  A null or empty line has the default."""
    book = book.where(F.size("moves") > 0)
    nodes = written(tree(book), "prefix-tree")
    longest = nodes.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    within = lines.where(F.size("moves") > 0).select("id", F.slice("moves", 1, max(1, longest)).alias("moves"))
    met = _plies(within, "id").join(nodes, ["k", "hash"])
    found = met.groupBy("id").agg(F.min(F.when(F.col("n") == 1, F.struct("k", "code"))).alias("one"), F.max(F.when(F.col("n") > 1, F.struct("k", "code"))).alias("many"))
    chosen = found.select("id", F.coalesce("one", "many").alias("c")).select("id", "c.k", "c.code")
    # the text itself, for the chosen length alone: an entry of that code which begins as the line does
    own = chosen.join(lines.select("id", "moves"), "id").select("id", "code", F.slice("moves", F.lit(1), F.col("k")).alias("head"))
    entries = book.select("code", F.col("moves").alias("entry"))
    same = own.join(entries, "code").where(F.slice("entry", F.lit(1), F.size("head")) == F.col("head")).select("id", "code").distinct()
    return lines.select("id").join(same, "id", "left").select("id", F.coalesce("code", F.lit(default)).alias("code"))

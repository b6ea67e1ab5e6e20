"""Best continuations of a state, with moves of similar states where its own are few.

A state is words; similar ones have the same first ``FIELDS`` (on a chess board:
the position, whose move it is, castling and en passant, without the counters).
A state with some moves but fewer than ``count`` takes up to three times
``count`` more from similar ones, the best rated first.  They come from a pool
that holds the best of each kind of state, cut to what any one state can use
before it is joined: a join never makes more than that for a state, however many
states are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .ratings import round2

FIELDS = 4
#: So many times the wanted number of moves come from similar states.
MORE = 3


def state_key(state: Column | str, fields: int = FIELDS) -> Column:
    return F.array_join(F.slice(F.split(state, " "), 1, fields), " ")


def _first(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n best rows of each key; Spark cuts each task's rows to n before they are shuffled."""
    w = Window.partitionBy(*keys).orderBy(F.desc("rating"), F.desc("games_count"), "from", "child")
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def candidates(moves: DataFrame, count: int) -> DataFrame:
    """(state, color, from, child, rating, games_count): a state's own moves and those of similar states that it takes; ``from`` is where a move was played.

    ``moves`` has state, color, child, rating and games_count, a row a move."""
    own = written(moves.select("state", "color", F.col("state").alias("from"), "child", "rating", "games_count", state_key("state").alias("key")), "moves")
    few = written(own.groupBy("state", "key", "color").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < count).drop("n"), "few-moves")
    # a state that takes any has fewer than ``count`` of its own among the pool's rows
    pool = written(_first(own.drop("state"), ["key", "color"], MORE * count + count - 1), "pool")
    more = few.join(pool, ["key", "color"]).where(F.col("state") != F.col("from"))
    return own.drop("key").unionByName(_first(more, ["state", "color"], MORE * count).drop("key"))


def search(moves: DataFrame, count: int, depth: int) -> DataFrame:
    """(state, color, from, child, rating, games_count, value, line): each candidate with the summed rating of the best line of ``depth`` moves that it begins.

    Colours alternate: below a white move the black moves of its child count, with
    the child's own fallback.  A line ends early where a child has no move.  Of
    equal values the better rated, then more played, then lower named move leads."""
    found = written(candidates(moves, count), "continuations")
    level = found.select("*", F.col("rating").alias("value"), F.array("child").alias("line"))
    for _ in range(depth - 1):
        best = level.groupBy("state", "color").agg(F.max_by(F.struct("value", "line"), F.struct("value", "rating", "games_count", F.struct(_low("child"), _low("from")))).alias("b"))
        other = F.when(F.col("color") == "white", "black").otherwise("white")
        best = written(best.select(F.col("state").alias("child"), other.alias("color"), F.col("b.value").alias("below"), F.col("b.line").alias("rest")), "best")
        level = found.join(best, ["child", "color"], "left").select(*found.columns, round2(F.col("rating") + F.coalesce("below", F.lit(0.0))).alias("value"), F.concat(F.array("child"), F.coalesce("rest", F.array().cast("array<string>"))).alias("line"))
    return level


def _low(name: str) -> Column:
    """A column that is larger for a lower string, for use in a maximum: each code point turned around, then one that ends it."""
    return F.concat(F.transform(F.split(name, ""), lambda c: -F.ascii(c)), F.array(F.lit(1)))

"""Ratings of transitions and the best continuation, as column arithmetic and an unrolled join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Base rating by annotation.
BASE = {1: 1.2, 2: 1.5, 3: 2.0, -1: 0.8, -2: 0.5}


def round2(x: Column) -> Column:
    return F.round(x * 100) / 100


def rating(wins: Column, draws: Column, losses: Column, games: Column, total: Column, annotation: Column | None = None) -> Column:
    base = F.lit(1.0)
    if annotation is not None:
        for k, v in BASE.items():
            base = F.when(annotation == k, v).otherwise(base)
    played = wins + draws + losses
    e = (wins + draws / 2) / played
    effect = F.when(played > 0, F.when(e > 0.5, 0.8 * (e - 0.5)).otherwise(-0.6 * (0.5 - e))).otherwise(0.0)
    p = games / total
    popular = F.when((total > 0) & (p > 0.1), 0.5 * (p - 0.1)).when((total > 0) & (p < 0.01), -0.1).otherwise(0.0)
    return round2(F.least(F.lit(3.0), F.greatest(F.lit(0.1), base + effect + popular)))


def confidence(games: Column) -> Column:
    return F.when(games < 3, 0.3).when(games < 5, 0.6).when(games < 10, 0.8).otherwise(1.0)


def rated(moves: DataFrame) -> DataFrame:
    """Adds the parent's total and the rating."""
    total = F.sum("games_count").over(Window.partitionBy("parent"))
    return moves.withColumn("total", total).withColumn("rating", rating(F.col("wins"), F.col("draws"), F.col("losses"), F.col("games_count"), F.col("total")))


def best_continuation(rated_: DataFrame, depth: int) -> DataFrame:
    """For each first move its rating plus that of the best line below it: O(depth) joins, built from the last ply up.

    Among a node's moves the best is by value, then rating, then games, then name."""
    level = rated_.select("parent", "child", F.col("rating").alias("value"), "rating", "games_count", F.array("child").alias("line"))
    for _ in range(depth - 1):
        best = level.groupBy("parent").agg(F.max_by(F.struct("value", "line"), F.struct("value", "rating", "games_count", "child")).alias("b")).select(F.col("parent").alias("child"), F.col("b.value").alias("below"), F.col("b.line").alias("rest"))
        level = rated_.join(best, "child", "left").select("parent", "child", round2(F.col("rating") + F.coalesce("below", F.lit(0.0))).alias("value"), "rating", "games_count", F.concat(F.array("child"), F.coalesce("rest", F.array().cast("array<string>"))).alias("line"))
    return level

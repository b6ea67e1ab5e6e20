"""Games in a store: saved, read, changed and removed by id, in batches; and statistics over a games base.

Every change is a table of changes, applied in one commit that rewrites the
buckets of the ids in it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import schema
from ..sources.shared import written
from ..sources.store import Change, Store, Table
from .lookup import update

GAMES = Table(schema("games"), "id")
#: The columns that a change may set; the others follow.
OWN = ["white_player", "black_player", "result", "eco_code", "pgn_content", "processed"]


def open_games(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, {"games": GAMES}, buckets)


def save(store: Store, games: DataFrame, id_col: str | None = None) -> DataFrame:
    """Appends games and gives their (id): the named column's, which must be new, or a random one."""
    ident = F.col(id_col).cast("string") if id_col else F.expr("uuid()")
    now = F.current_timestamp()
    held = lambda c: F.col(c) if c in games.columns else F.lit(False if c == "processed" else None).alias(c)
    rows = written(games.select(ident.alias("id"), *[held(c) for c in OWN], now.alias("created_at"), now.alias("updated_at")), "games")
    store.append({"games": rows})
    return rows.select("id")


def get(store: Store, ids: DataFrame) -> DataFrame:
    """The games of (id); ids without a game have no row.  Only the buckets of the ids are read."""
    keys = written(ids.select(F.col("id").cast("string").alias("id")).distinct(), "game-ids")
    buckets = [r[0] for r in keys.select(store.bucket("games")).distinct().collect()]  # as many as there are buckets, at most
    return store.read("games", buckets=buckets).join(keys, "id", "left_semi")


def change(store: Store, changes: DataFrame) -> int:
    """Sets the non-null columns of (id, ...) in the games of those ids, one row an id; the number of games that changed.  Ids without a game change nothing."""
    since = store.version()
    wanted = written(changes.select(F.col("id").cast("string").alias("id"), *[c for c in changes.columns if c in OWN]), "game-changes")
    rows = written(update(get(store, wanted), wanted, ["id"]).withColumn("updated_at", F.current_timestamp()), "games-changed")
    store.commit({"games": Change(rows=rows)}, since=since)
    return rows.count()


def delete(store: Store, ids: DataFrame) -> None:
    store.commit({"games": Change(gone=ids.select(F.col("id").cast("string").alias("id")))})


def stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row: positions, moves and games, and the distinct codes that moves have."""
    one = lambda name, n, agg=F.count(F.lit(1)): tables[name].agg(agg.alias(n))
    codes = F.countDistinct(F.nullif(F.col("eco_code"), F.lit("")))
    moves = tables["moves"].agg(F.count(F.lit(1)).alias("moves_count"), codes.alias("eco_codes_count"))
    parts = [one("positions", "positions_count"), moves, one("games", "games_count")]
    # three one-row tables side by side
    out = parts[0].withColumn("__one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("__one", F.lit(1)), "__one")
    return out.select("positions_count", "moves_count", "games_count", "eco_codes_count")


def eco_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(code, name, total_games, avg_rating, total_positions) of every opening, also of those no move has: its moves, their mean rating and their games."""
    per = tables["moves"].where("eco_code is not null").groupBy(F.col("eco_code").alias("code")).agg(F.count(F.lit(1)).alias("total_games"), F.avg("rating").alias("avg_rating"), F.sum("games_count").alias("total_positions"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return tables["eco_codes"].select("code", "name").join(per, "code", "left").select("code", "name", zero("total_games", "long"), zero("avg_rating", "double"), zero("total_positions", "long")).orderBy("code")

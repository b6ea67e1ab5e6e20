"""Links between rows of different files: classes to forms, methods and fields to classes, fields to components, includes to files.

Each is an equal-key left join with the newest row of a name (the largest id),
so no row is lost or doubled.  A link that is there stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import latest
from .predicates import trimmed


def _newest(df: DataFrame, name: str, *more: str) -> DataFrame:
    """(key, more..., found): the largest id of each name, without regard to case."""
    return df.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("__key"), *more).agg(F.max("id").alias("__found"))


def _filled(df: DataFrame, link: str, key: str, newest: DataFrame, *more: str) -> DataFrame:
    out = df.withColumn("__key", F.lower(key)).join(newest, ["__key", *more], "left")
    return out.withColumn(link, F.coalesce(link, "__found")).select(*df.columns)


def class_forms(classes: DataFrame, forms: DataFrame) -> DataFrame:
    """Classes with the newest form of their class name."""
    return _filled(classes, "dfm_form_id", "class_name", _newest(forms, "form_class"))


def member_classes(members: DataFrame, classes: DataFrame, class_name: str = "class_name") -> DataFrame:
    """Methods or fields, which carry their class's name, with the newest class of that name where they have none."""
    return _filled(members, "class_id", class_name, _newest(classes, "class_name"))


def field_components(fields: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    """Fields with the component of their class's form that has their name."""
    forms = classes.where("dfm_form_id is not null").select(F.col("id").alias("class_id"), F.col("dfm_form_id").alias("form_id"))
    placed = fields.join(forms, "class_id", "left")
    return _filled(placed, "dfm_component_id", "field_name", _newest(components, "component_name", "form_id"), "form_id").select(*fields.columns)


def unlinked(classes: DataFrame) -> DataFrame:
    return classes.where("dfm_form_id is null")


def cleaned(path: Column) -> Column:
    """A path with slashes only, without empty and . pieces; .. takes the piece before it away."""
    pieces = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(pieces, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.concat(F.when(F.replace(path, F.lit("\\"), F.lit("/")).startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def folder(path: Column, up: int = 1) -> Column:
    """The folder ``up`` levels above, empty if there is none."""
    return F.substring_index(cleaned(path), "/", -1) if up == 0 else F.array_join(F.slice(F.split(cleaned(path), "/"), F.lit(1), F.greatest(F.size(F.split(cleaned(path), "/")) - up, F.lit(0))), "/")


def candidates(source: Column, include: Column) -> Column:
    """Where an include may be, the likeliest first: as written, beside the source, in Include beside the source's folder."""
    name = F.replace(trimmed(include), F.lit("\\"), F.lit("/"))
    beside = cleaned(F.concat(folder(source), F.lit("/"), name))
    shared = cleaned(F.concat(folder(source, 2), F.lit("/Include/"), F.substring_index(name, "/", -1)))
    return F.when(name != "", F.array_distinct(F.array(cleaned(name), beside, shared))).otherwise(F.array().cast("array<string>"))


def includes(found: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, include_path, line_number, resolved_file_id): the newest file at the likeliest place, else the newest header of that name, else null.

    ``files`` has id, path, rel_path and extension."""
    rows = found.withColumn("__row", F.xxhash64("file_id", "include_path", "line_number")).join(files.select(F.col("id").alias("file_id"), F.col("path").alias("__source")), "file_id")
    tries = rows.select("__row", F.posexplode(candidates(F.col("__source"), F.col("include_path"))).alias("__place", "__path"))
    known = files.select("id", F.explode(F.array_distinct(F.array("path", "rel_path"))).alias("__path")).groupBy("__path").agg(F.max("id").alias("__id"))
    exact = latest(tries.join(known, "__path"), ["__row"], F.asc("__place")).select("__row", F.col("__id").alias("__exact"))
    base = lambda c: F.lower(F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1))
    header = files.where(F.lower("extension") == "h").groupBy(base(F.col("rel_path")).alias("__base")).agg(F.max("id").alias("__header"))
    out = rows.join(exact, "__row", "left").withColumn("__base", base(F.col("include_path"))).join(header, "__base", "left")
    return out.select("file_id", "include_path", "line_number", F.coalesce("__exact", "__header").alias("resolved_file_id"))


# --- small shapes -----------------------------------------------------------------------------------


def unique_in_order(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """The values of each group once, trimmed, without regard to case: the first spelling, in order of first place."""
    v = trimmed(value)
    rows = df.where(v != "").groupBy(*group, F.lower(v).alias("__key")).agg(F.min(F.struct(F.col(position).alias("p"), v.alias("v"))).alias("first"))
    return rows.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["v"]).alias("values"))


def timings(df: DataFrame, step: str, worker: str, seconds: str) -> DataFrame:
    """(step, n, total, mean, least, most, imbalance): imbalance is what the busiest worker takes over the mean worker, in per cent; the longest step first."""
    each = df.groupBy(step, worker).agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("t"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))
    out = each.groupBy(step).agg(F.sum("n").alias("n"), F.sum("t").alias("total"), (F.sum("t") / F.sum("n")).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"), ((F.max("t") / F.avg("t") - 1) * 100).alias("imbalance"))
    return out.orderBy(F.desc("total"), step)


def random_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in an order that the seed alone decides."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def without_failed(plies: DataFrame, game: str, failed: str) -> DataFrame:
    """Rows of games none of whose rows failed."""
    return plies.join(plies.where(failed).select(game).distinct(), game, "left_anti")


def engine_line(line: str = "line") -> Column:
    """depth, multipv, score (in pawns, or moves to mate), nodes, time and moves of an engine's ``info`` line; null for any other line."""
    number = lambda key: F.expr(f"try_cast(nullif(regexp_extract(`{line}`, '\\\\b{key} (-?[0-9]+)', 1), '') as bigint)").alias(key)
    mate = F.expr(f"try_cast(nullif(regexp_extract(`{line}`, '\\\\bscore mate (-?[0-9]+)', 1), '') as int)")
    pawns = F.expr(f"try_cast(nullif(regexp_extract(`{line}`, '\\\\bscore cp (-?[0-9]+)', 1), '') as double)") / 100
    moves = F.split(F.nullif(F.regexp_extract(line, r"\spv\s+(.*)$", 1), F.lit("")), r"\s+")
    parts = F.struct(number("depth"), F.coalesce(number("multipv"), F.lit(1)).alias("multipv"), pawns.alias("score"), mate.alias("mate"), number("nodes"), number("time"), moves.alias("moves"))
    return F.when(F.col(line).startswith("info ") & F.col(line).contains(" pv "), parts)


def eco_book(df: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(code, name, moves, family) of opening files: a Site tag begins an entry, White names it, other lines are its moves without their numbers; the first entry of a code counts."""
    lines = df.select(F.col(path_col).alias("path"), F.posexplode(F.split(text_col, "\n")).alias("at", "raw")).select("path", "at", trimmed("raw").alias("line")).where("line != ''")
    tag = lambda name: F.nullif(F.regexp_extract("line", rf'^\[{name} "(.*)"\]$', 1), F.lit(""))
    turn = F.count(F.when(F.col("line").startswith('[Site "'), 1)).over(Window.partitionBy("path").orderBy("at"))
    words = F.array_join(F.filter(F.split(F.regexp_replace("line", r"\d+\.+", " "), r"\s+"), lambda w: w != ""), " ")
    rows = lines.withColumn("entry", turn).where("entry > 0").withColumn("moves", F.when(~F.col("line").startswith("["), F.nullif(words, F.lit(""))))
    per = rows.groupBy("path", "entry").agg(
        F.min("at").alias("at"), F.max(tag("Site")).alias("code"), F.max(tag("White")).alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("moves").isNotNull(), F.struct("at", "moves")))), lambda m: m["moves"]), " ").alias("moves"),
    ).where("code is not null and name is not null and moves != ''")
    first = latest(per, ["code"], F.asc("path"), F.asc("at"))
    letter = F.upper(F.substring("code", 1, 1))
    return first.select("code", "name", "moves", F.when(letter.isin(*"ABCDE"), letter).otherwise("Other").alias("family"))

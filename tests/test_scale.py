"""Operators that must hold whatever one key has: against brute force, with hot keys, ties, nulls and very long rows."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import intervals, prefixes, running, text

# --- prefix tree --------------------------------------------------------------------------------


def code_of(line, book, default="A00"):
    many = None
    for k in range(1, len(line or []) + 1):
        codes = sorted(c for c, m in book if m and m[:k] == line[:k] and len(m) >= k)
        if len(codes) == 1:
            return codes[0]
        if not codes:
            break
        many = codes[0]
    return many or default


def check_prefixes(spark, lines, book):
    l = spark.createDataFrame(lines, "id long, moves array<string>")
    b = spark.createDataFrame(book, "code string, moves array<string>")
    got = {r.id: r.code for r in prefixes.longest_unique_prefix(l, b).collect()}
    assert got == {i: code_of(m, book) for i, m in lines}


def test_longest_unique_prefix_brute_force(spark):
    rng = random.Random(3)
    seq = lambda n: [rng.choice("ab") for _ in range(n)]
    book = [(f"C{i}", seq(rng.randint(1, 9))) for i in range(40)] + [("D1", ["a", "b"]), ("D2", ["a", "b"]), ("E", []), ("F", None)]
    lines = [(i, seq(rng.randint(0, 12))) for i in range(300)] + [(900, None), (901, []), (902, ["z"]), (903, [None, "a"])]
    check_prefixes(spark, lines, book)


def test_longest_unique_prefix_of_lines_that_differ_late(spark):
    common = [f"m{i}" for i in range(700)]  # over several runs of the fold
    book = [(f"C{k}", common[:k] + ["x"] + [f"t{k}"] * 5) for k in (41, 127, 128, 129, 400, 650)] + [("Z", common + ["end"])]
    lines = [(i, common[:i] + ["x", "y"]) for i in (41, 127, 128, 129, 400, 650)] + [(1000, common), (1001, common[:300]), (1002, common + ["end", "more"]), (1003, common[:500] + ["q"])]
    check_prefixes(spark, lines, book)
    check_prefixes(spark, lines, [])


def test_prefix_hashes_are_rolling(spark):
    moves = [f"m{i}" for i in range(300)]
    got = spark.createDataFrame([(moves,), (moves[:200] + ["z"] * 100,), (None,), ([],)], "moves array<string>").select(prefixes.prefix_hashes(F.col("moves")).alias("h")).collect()
    a, b = got[0].h, got[1].h
    assert len(a) == 300 and len(set(a)) == 300 and a[:200] == b[:200] and not set(a[200:]) & set(b[200:]) and got[2].h is None and got[3].h == []


# --- enclosing ranges -----------------------------------------------------------------------------


def test_bins_cover_each_range_once(spark):
    rng = random.Random(1)
    rows = [(i, a, a + rng.choice([-1, 0, 1, 5, 63, 1000])) for i, a in enumerate(rng.randint(-2000, 2000) for _ in range(200))] + [(500, 2**60, 2**60 + 7), (501, -(2**61), 2**61), (502, None, 4)]
    for r in spark.createDataFrame(rows, "i int, a long, b long").select("*", intervals.bins(F.col("a"), F.col("b")).alias("x")).collect():
        assert len(r.x) <= 2 * intervals.LEVELS
        spans = sorted((x.bin << x.level, (x.bin + 1 << x.level) - 1) for x in r.x)
        if r.a is None or r.b < r.a:
            assert not spans
        else:
            assert spans[0][0] == r.a and spans[-1][1] == r.b and all(p[1] + 1 == q[0] for p, q in zip(spans, spans[1:]))


def test_enclosing_brute_force_and_hot_key(spark):
    rng = random.Random(2)
    ranges = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, s, s + rng.randint(-2, 400)) for i, s in enumerate(rng.randint(-500, 500) for _ in range(400))]
    ranges += [("hot", 1000 + i, -5 - i, 5 + i) for i in range(600)]  # nested: a point lies in hundreds
    ranges += [("a", 5000, 10, 20), ("a", 5001, 10, 20)]
    points = [(rng.choice(["hot", "a", "b", "none", None]), rng.randint(-700, 700)) for _ in range(300)]
    points = sorted(set(points), key=str)
    p, r = spark.createDataFrame(points, "key string, at long"), spark.createDataFrame(ranges, "key string, rid long, lo long, hi long")
    out = intervals.enclosing(p, r, "key", "at", "lo", "hi", "rid", ["at"])
    want = {}
    for key, at in points:
        fits = [(lo, i) for k, i, lo, hi in ranges if k is not None and k == key and lo <= at <= hi]
        want[key, at] = max(fits)[1] if fits else None
    got = [((x.key, x.at), x.rid) for x in out.collect()]
    assert len(got) == len(points) and dict(got) == want
    assert intervals.enclosing(p, r.limit(0), "key", "at", "lo", "hi", "rid", ["at"]).where("rid is not null").count() == 0


# --- totals before each row -------------------------------------------------------------------------


def test_running_totals_spread_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.randint(0, 200), i, rng.choice([1, 2, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, ts int, eid int, v int")
    for order, value in ((["ts", "eid"], None), (["ts"], None), (["ts"], F.col("v"))):
        got = {r.eid: r.t for r in running.before(df, "key", order, "t", value, parts=8).collect()}
        place = lambda r: tuple(r[{"ts": 1, "eid": 2}[c]] for c in order)
        for row in rng.sample(rows, 150):
            assert got[row[2]] == sum(1 if value is None else (o[3] or 0) for o in rows if o[0] == row[0] and place(o) < place(row))
    blocks = df.repartitionByRange(8, "key", "ts", "eid").where("key = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert blocks > 3  # what the operator deals rows by


# --- offsets ------------------------------------------------------------------------------------------


def found(spark, rows, patterns):
    df = spark.createDataFrame(rows, "id long, text string")
    out = {}
    for r in text.offsets(df, patterns, ["id"]).collect():
        out.setdefault((r.id, r.pattern), []).extend(r.offsets)
    return {k: sorted(v) for k, v in out.items()}


def test_offsets_brute_force(spark, monkeypatch):
    monkeypatch.setattr(text, "CHUNK", 40)
    monkeypatch.setattr(text, "PIECE", 7)
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("aab é𝒳\n") for _ in range(rng.randint(0, 200)))) for i in range(60)] + [(100, None), (101, ""), (102, "aaaaaaaaaa" * 20)]
    patterns = ["a", "aa", "aab", "é", "𝒳\n", "baaaaab", "aaaaaaa"]
    want = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in patterns:
            if hits := [k for k in range(len(data)) if data.startswith(p.encode(), k)]:
                want[i, p] = hits
    assert found(spark, rows, patterns) == want
    for bad in ([""], ["x" * 8]):
        with pytest.raises(ValueError):
            text.offsets(spark.createDataFrame(rows, "id long, text string"), bad, ["id"])


def test_offsets_of_a_text_of_20_mb(spark):
    body = "ab é" * 1_000_000 + "x" * 15_000_000 + "ab"
    df = spark.createDataFrame([(1, "ab é", 1_000_000)], "id long, s string, n int").select("id", F.concat(F.repeat("s", F.col("n")), F.repeat(F.lit("x"), 15_000_000), F.lit("ab")).alias("text"))
    got = text.offsets(df, ["ab"], ["id"]).select(F.explode("offsets").alias("o")).agg(F.count("o").alias("n"), F.max("o").alias("last"), F.sum("o").alias("s")).first()
    assert got.n == 1_000_001 and got.last == len(body.encode()) - 2 and got.s == sum(5 * i for i in range(1_000_000)) + got.last


# --- tasks grow in number with the rows -----------------------------------------------------------------


def test_neighbours_and_counters_are_dealt_by_rows(spark, monkeypatch):
    from quarry.operators import graph
    from quarry.streaming import counters

    monkeypatch.setattr(graph, "ROWS", 100)
    edges = spark.createDataFrame([("a", i % 7, "b" if i % 11 else None, i % 50) for i in range(2000)], "source_type string, source_id long, target_type string, target_id long")
    symbols = spark.createDataFrame([("a", i, f"a{i}") for i in range(9)], "symbol_type string, entity_id long, symbol_name string")
    got = {r.entity_id: (r.incoming, r.outgoing, r.neighbours) for r in graph.neighbours(edges, symbols, symbols).collect()}
    own = lambda s: [i for i in range(2000) if i % 7 == s]
    assert got == {s: (0, len(own(s)), len({i % 50 for i in own(s) if i % 11})) for s in range(9)}
    assert "REPARTITION_BY_NUM, " in graph.dealt(edges, 2000, "source_id")._jdf.queryExecution().executedPlan().toString()
    events = spark.range(300).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit(50.0).alias("value"), F.concat(F.lit("t"), F.col("id") % 3).alias("event_type"))
    counted = counters.batch_counts(events, F.col("event_type"), 9)
    assert "hashpartitioning(name" in (plan := counted._jdf.queryExecution().executedPlan().toString()) and ", 9), REPARTITION_BY_NUM" in plan
    assert {(r.name, r.games_count, r.annotation) for r in counted.collect()} == {(f"t{k}", 100, f"t{k}") for k in range(3)}

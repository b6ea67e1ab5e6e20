"""Anchored substring search, the trigram index, continuation search and error tables: brute force on small tables, hot keys, and the plans."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import anchors, continuations, side_table, trigrams

# --- anchors --------------------------------------------------------------------------------------


def places(texts, patterns):
    return sorted((str(i), p, a) for i, t in texts for p in {p for p in patterns if p} for a in range(len(t or "") - len(p) + 1) if t[a : a + len(p)] == p)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_hits_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(anchors, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(anchors, "PIECE", 5)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("aab é𝒳\n") for _ in range(n))
    texts = [(i, word(rng.randint(0, 120))) for i in range(60)] + [(70, None), (71, ""), (72, "a" * 90), (72, "a" * 90)]
    patterns = ["a", "aa", "é", "ab", "a" * 17, "a" * 33, "zz", "", None] + [texts[i][1][3 : 3 + n] for i in range(20) for n in (2, 3, 5, 8, 16, 30)]
    t = spark.createDataFrame(texts, "id long, text string").withColumn("row", F.lit(1)).withColumn("q", F.lit(1))
    p = spark.createDataFrame([(x,) for x in patterns + patterns[:5]], "pattern string")
    assert sorted((str(r.id), r.pattern, r.at) for r in anchors.hits(t, p, "id", "pattern").collect()) == places(texts, patterns)
    assert anchors.hits(t, p.limit(0), "id", "pattern").collect() == []


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_counts_and_small_blocks(spark, monkeypatch, broadcast):
    """A pattern's places by blocks smaller than it, many patterns with one anchor; a task hands on one row a pattern."""
    rng = random.Random(5)
    for name, value in (("MOST_BROADCAST", broadcast), ("TEXTS", 50), ("BLOCK", 7), ("PLACES", 3)):
        monkeypatch.setattr(anchors, name, value)
    texts = [(i, "".join(rng.choice("ab𝒳") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(70, None), (71, "a" * 90), (71, "a" * 90)]
    patterns = ["a", "ab", "aab", "aaaa", "aaaaa", "aaaaaa", "a" * 40, "b𝒳", "c", "", None]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in patterns], "pattern string")
    want = places(texts, patterns)
    assert sorted((str(r.id), r.pattern, r.at) for r in anchors.hits(t, p, "id", "pattern").collect()) == want
    assert {r.pattern: r.n for r in anchors.counts(t, p, "pattern").collect()} == Counter(x[1] for x in want)
    assert anchors.counts(t, p.where("pattern = 'c'"), "pattern").collect() == anchors.counts(t, p.limit(0), "pattern").collect() == []
    codes = [anchors._points(x.encode()) for x in patterns if x]
    finder = anchors._Finder(anchors._table([x for x in patterns if x], codes, anchors._all_grams(codes)))  # here the small sizes count
    for text in {x for _, x in texts if x}:
        assert {(patterns[k], a) for at, found in finder.hits(anchors._points(text.encode())) for a, k in zip(at.tolist(), found.tolist())} == {x[1:] for x in places([(0, text)], patterns)}
    if broadcast:
        plan = anchors.hits(t, p, "id", "pattern")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan  # no row a place of the texts


def test_containment_has_no_nested_loop(spark):
    texts = [(i, f"Text {i} has THE end{'.' if i % 2 else ''} here") for i in range(40)] + [(50, None)]
    passages = [(1, "the end."), (2, "THE"), (3, "text 7 has the end. here"), (4, ""), (5, None), (6, "The"), (7, "not there at all")]
    t, p = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")
    df = anchors.containing(t, p, "doc_id", "item_id")
    want = sorted((i, j) for i, x in texts for j, y in passages if x and y and y.lower() in x.lower())
    assert sorted(map(tuple, df.collect())) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lists_are_gathered_before_the_shuffle():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([0, 1, 0, 0, 0], pa.int32()), pa.array([5, 6, 7, 8, 9]), pa.array(["aaaab", "aaa", "aaa\x00", None, "é𝒳"])], ["part", "id", "text"])
    got = sorted((r["gram"], r["part"], sorted(r["ids"])) for b in trigrams._grams(iter([rows])) for r in b.to_pylist())
    assert got == [("aa\x00", 0, [7]), ("aaa", 0, [5, 7]), ("aaa", 1, [6]), ("aab", 0, [5])]


# --- trigram index ----------------------------------------------------------------------------------


def test_index_finds_what_ilike_finds_and_reads_candidates_only(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["alpha", "Beta", "gam_ma", "de%lta", "Éclair", "x"]) for _ in range(rng.randint(0, 6)))) for i in range(300)] + [(400, None), (401, ""), (402, "a Needle\nhere"), (403, "NEEDLE\nHERE")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    kept = trigrams.open_index(spark, str(tmp_path), buckets=8)
    monkeypatch.setattr(trigrams, "PART", 40)
    for part in range(3):
        trigrams.add(kept, df.where(F.col("doc_id") % 3 == part))
    assert kept.version() == 3
    for pattern in ("needle", "LPHA B", "éclair", "a%b", "be_a", "gam_ma%x", "de%l", "x", "", "zzz", "needle_here", "%", "alpha beta alpha", "lph%eta%lph"):
        want = sorted(r.doc_id for r in df.where(F.col("text").ilike(f"%{pattern}%")).collect())
        assert sorted(r.id for r in trigrams.search(kept, pattern).collect()) == want, pattern
    found = trigrams.search(kept, "needle")
    buckets = {r[0] for r in df.where("doc_id in (402, 403)").select(F.pmod(F.xxhash64("doc_id"), F.lit(8))).collect()}
    read = {int(f.rpartition("/bucket=")[2].partition("/")[0]) for f in found.inputFiles() if "/texts/" in f}
    assert read == buckets and len(read) < 8


# --- continuations ------------------------------------------------------------------------------------


def naive(moves, count, depth):
    """The search state by state, as it is told."""
    other = {"white": "black", "black": "white"}
    order = lambda m: (-m[3], -m[4], m[0], m[2])
    key = lambda s: s.split(" ")[:4]

    def found(state, color):
        own = [m for m in moves if m[0] == state and m[1] == color]
        alike = sorted((m for m in moves if m[0] != state and m[1] == color and key(m[0]) == key(state)), key=order)
        return own + (alike[: 3 * count] if own and len(own) < count else [])

    def lines(state, color, left):
        out = []
        for m in found(state, color):
            below = max(lines(m[2], other[color], left - 1), key=lambda x: (x[0], x[2], x[3], [-ord(c) for c in x[4]] + [1], [-ord(c) for c in x[5]] + [1]), default=None) if left > 1 else None
            out.append((round(m[3] + (below[0] if below else 0), 2), [m[2]] + (below[1] if below else []), m[3], m[4], m[2], m[0]))
        return out

    return sorted((s, c, x[5], x[4], x[0], x[1]) for s, c in {(m[0], m[1]) for m in moves} for x in lines(s, c, depth))


def test_continuations_brute_force(spark):
    rng = random.Random(9)
    states = [f"{a} {c} x y {n}" for a in "pqr" for c in ("white", "black") for n in range(6)]
    turn = lambda c: [s for s in states if s.split()[1] == c]
    moves = {}
    for s in states[:-2]:
        c = s.split()[1]
        for child in rng.sample(turn("black" if c == "white" else "white"), rng.choice([0, 1, 1, 2, 5])):
            moves[s, child] = (s, c, child, rng.choice([0.5, 1.0, 1.25]), rng.randint(1, 4))
    rows = list(moves.values())
    df = spark.createDataFrame(rows, "state string, color string, child string, rating double, games_count long")
    for count, depth in ((1, 2), (2, 3), (4, 2)):
        got = sorted((r.state, r.color, r["from"], r.child, r.value, r.line) for r in continuations.search(df, count, depth).collect())
        assert got == naive(rows, count, depth)
    assert continuations.search(df.limit(0), 3, 2).collect() == []


def test_fallback_is_bounded_where_all_states_are_alike(spark):
    df = spark.range(3000).select(F.concat(F.lit("a white b c "), F.col("id")).alias("state"), F.lit("white").alias("color"), F.concat(F.lit("z black b c "), F.col("id")).alias("child"), (F.col("id") % 100 / 50).alias("rating"), F.col("id").alias("games_count"))
    found = continuations.candidates(df, 2)
    assert found.count() == 3000 + 3000 * 6
    best = {r[0] for r in found.where("state != `from`").select("from").distinct().collect()}
    assert len(best) == 7  # six, and one more for those that are among the six


# --- error tables -------------------------------------------------------------------------------------


def test_one_pass_two_tables(spark, tmp_path):
    rows = [(i, '{"k": %d}' % i) for i in range(20)] + [(30, "{bad"), (31, None), (32, '{"k": "x"}')]
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, "event_id long, props string").repartition(3)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    counted = df.mapInPandas(count, df.schema)
    message = F.when(F.col("props").isNull(), "no props").when(F.from_json("props", "k bigint")["k"].isNull(), "props without k")
    path = str(tmp_path / "events")
    assert side_table.split(counted, path, message, F.lit("events.parquet"), F.col("event_id")) == {"good": 20, "bad": 3}
    assert seen.value == len(rows)  # good rows were not computed again for the bad ones
    assert sorted(tuple(r) for r in side_table.errors(spark, path, df.schema).collect()) == [("events.parquet", "30", "props without k"), ("events.parquet", "31", "no props"), ("events.parquet", "32", "props without k")]
    good = side_table.good(spark, path, df.schema)
    assert good.columns == df.columns and sorted(map(tuple, good.collect())) == rows[:20]
    empty = str(tmp_path / "none")
    assert side_table.split(df.limit(0), empty, message, F.lit("f"), F.col("event_id")) == {"good": 0, "bad": 0}

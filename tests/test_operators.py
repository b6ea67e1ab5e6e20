"""Properties that hold whatever the tables: coding round-trips, orders are total."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import huffman, lookup, predicates, sorting

@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_huffman_round_trip(data):
    assert huffman.decompress(huffman.compress(data)) == data


def test_huffman_all_bytes_and_scaling():
    data = bytes(range(256)) * 3 + b"a" * 5000
    assert huffman.decompress(huffman.compress(data)) == data
    assert max(huffman.weights(data).values()) == 255 and min(huffman.weights(data).values()) == 1


def test_guard_and_escape():
    with pytest.raises(ValueError):
        predicates.filtered(None, equal={"a": ""}, like={}, require=True)
    assert predicates.pattern(" 5%_ ", escape=True) == "%5\\%\\_%"


def test_random_unique(spark):
    values = [r.v for r in sorting.random_unique(spark, 500, 10, 900, seed=3).collect()]
    assert len(set(values)) == 500 and min(values) >= 10 and max(values) <= 900
    with pytest.raises(ValueError):
        sorting.random_unique(spark, 5, 1, 3, seed=1)


def test_snapshot_and_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, h string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, h string")
    assert {r.k: r.status for r in lookup.snapshot_diff(a, b, "k", "h").collect()} == {1: "deleted", 2: "updated", 3: "unchanged", 4: "added"}
    old = spark.createDataFrame([(1, 2, 1.0)], "k int, n int, r double")
    new = spark.createDataFrame([(1, 2, 2.0), (5, 1, 3.0)], "k int, n int, r double")
    got = {r.k: (r.n, r.r) for r in lookup.accumulate(old, new, ["k"], ["n"], {"r": "n"}).collect()}
    assert got == {1: (4, 1.5), 5: (1, 3.0)}


def test_includes_and_engine_lines(spark):
    from pyspark.sql import functions as F

    from quarry.operators import linking

    files = spark.createDataFrame([(1, "/s/a/x.sql", "a/x.sql", "SQL"), (2, "/s/a/y.h", "a/y.h", "h"), (3, "/s/Include/z.h", "Include/z.h", "h"), (4, "/s/b/w.H", "b/w.H", "H"), (5, "/t/w.h", "t/w.h", "h")], "id long, path string, rel_path string, extension string")
    found = spark.createDataFrame([(1, "y.h", 1), (1, "..\\Include\\z.h", 2), (1, "deep/z.h", 3), (1, "any/w.h", 4), (1, "none.h", 5), (1, " ", 6)], "file_id long, include_path string, line_number int")
    got = {r.line_number: r.resolved_file_id for r in linking.includes(found, files).collect()}
    assert got == {1: 2, 2: 3, 3: 3, 4: 5, 5: None, 6: None}
    lines = spark.createDataFrame([("info depth 12 seldepth 20 multipv 2 score cp -35 nodes 1000 time 7 pv e2e4 e7e5",), ("info depth 3 score mate -2 pv a1a2",), ("bestmove e2e4",)], "line string")
    a, b, c = [r.x for r in lines.select(linking.engine_line().alias("x")).collect()]
    assert (a.depth, a.multipv, a.score, a.nodes, a.moves) == (12, 2, -0.35, 1000, ["e2e4", "e7e5"]) and (b.multipv, b.mate, b.score) == (1, -2, None) and c is None
    once = [r.id for r in linking.random_rows(spark.range(50), 5, "id", 3).collect()]
    assert once == [r.id for r in linking.random_rows(spark.range(50).repartition(7), 5, "id", 3).collect()] and once != [r.id for r in linking.random_rows(spark.range(50), 5, "id", 4).collect()]
    assert spark.range(1).select(linking.cleaned(F.lit("a/./b/../../../c\\d"))).first()[0] == "../c/d"


def test_catalog(spark, tmp_path):
    from quarry.sources.catalog import Catalog, collisions, key

    files = spark.createDataFrame([("/a.sql",), ("/b.sql",)], "path string").withColumn("id", key("path"))
    a, b = [r.id for r in files.orderBy("path").collect()]
    procs = spark.createDataFrame([(1, a, "A"), (2, b, "B")], "id long, file_id long, proc_name string")
    edges = spark.createDataFrame([(1, "sql_procedure", 1, "sql_procedure", 2, "calls_procedure"), (2, "sql_procedure", 2, "sql_procedure", 2, "calls_procedure")], "id long, source_type string, source_id long, target_type string, target_id long, relation_type string")
    c = Catalog(spark, {"files": files, "sql_procedures": procs, "relations": edges})
    left = c.without_files(spark.createDataFrame([(a,)], "id long"))
    assert [r.proc_name for r in left["sql_procedures"].collect()] == ["B"] and [r.id for r in left["relations"].collect()] == [2] and left["files"].count() == 1
    c.save(str(tmp_path))
    back = Catalog.load(spark, str(tmp_path), ["files", "sql_procedures", "relations"])
    assert back["files"].count() == 2 and back["pas_units"].count() == 0 and collisions(files, "path").count() == 0


def test_extractors_in_sql(spark):
    from quarry.functions.register import register

    assert "sql_rows" in register(spark)
    got = spark.sql("select inline(header_rows(t)) from values ('#define A 1\n#define B \"x\"'), (null), ('') as v(t)").collect()
    assert [(r.name, r.value) for r in got] == [("A", "1"), ("B", '"x"')]
    names = spark.sql("select x.name from values ('select * from tDeal d join tClient c on 1 = 1') v(t) lateral view inline(sql_table_rows(t)) x").collect()
    assert [r.name for r in names] == ["tDeal", "tClient"]


def test_places_spread_equal_first_keys(spark):
    rows = [(5 if i % 3 else None if i % 2 else i, i) for i in range(600)]
    got = {r.i: r.place for r in sorting.placed(spark.createDataFrame(rows, "a int, i int"), "a", "i", parts=6).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {i: n for n, (_, i) in enumerate(want, 1)}


def test_limits_may_be_left_out(spark):
    from quarry.operators import named
    from quarry.sources.catalog import Catalog

    c = Catalog(spark, {"games": spark.range(300).selectExpr("cast(id as string) as id", "'w' as white_player")})
    assert named.games(c, white="w").count() == 100 and named.games(c, white="w", limit=None).count() == named.games(c, white="w", limit=0).count() == 300


def test_stamps_and_whole_texts(spark, tmp_path):
    from quarry.operators import envelope
    from quarry.sources.files import whole_texts

    df = spark.sql("select timestamp '2024-01-31 10:00:00' as t union all select null")
    assert {r.x for r in df.select(envelope.stamp("t").alias("x")).collect()} == {"2024-01-31T10:00:00Z", None}
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    (tmp_path / "b.txt").write_text("é")
    assert {r.path.rpartition("/")[2]: r.text for r in whole_texts(spark, str(tmp_path)).collect()} == {"a.txt": "one\n\ntwo\n", "b.txt": "é"}

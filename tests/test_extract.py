"""Scans, decoding, extractors, output shapes and incremental runs on small own inputs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import envelope, extract, sqltext
from quarry.sources import files
from quarry.streaming import incremental

RUSSIAN = "Привет, мир"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, data in {
        "a.SQL": RUSSIAN.encode("cp866"), "sub/b.pas": RUSSIAN.encode("cp1251"), "sub/c.xml": RUSSIAN.encode(), ".git/d.sql": b"x", "sub/old.bak": b"y", "e.h": b"#define A 1\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


def test_scan_and_decode(spark, tree):
    found = files.texts(files.scan(spark, str(tree), exclude=["*.bak"]))
    rows = {r.rel_path: r for r in found.collect()}
    assert set(rows) == {"a.SQL", "sub/b.pas", "sub/c.xml", "e.h"}
    assert {rows[k].text for k in ("a.SQL", "sub/b.pas", "sub/c.xml")} == {RUSSIAN}
    assert (rows["a.SQL"].encoding, rows["a.SQL"].language, rows["sub/b.pas"].extension) == ("CP866", "SQL", "pas")
    assert rows["e.h"].sha256 == hashlib.sha256(b"#define A 1\n").hexdigest() and rows["e.h"].size == 12
    only = files.scan(spark, str(tree), include=["*.pas", "SUB/*.XML"])
    assert {r.rel_path for r in only.select("rel_path").collect()} == {"sub/b.pas", "sub/c.xml"}


def test_decoding_rules():
    assert files.utf8_or_1251(RUSSIAN.encode("cp1251")) == RUSSIAN == files.utf8_or_1251(RUSSIAN.encode())
    assert files.first_plausible(RUSSIAN.encode("cp1251")) == RUSSIAN
    assert files.guess(b"abc") == "UTF8" and files.guess(b"\x80") == "CP866"
    assert files.decode_bytes(None, "CP866") is files.first_plausible(None) is files.utf8_or_1251(None) is files.guess(None) is None


def test_headers(spark):
    text = '#include <a/b.h>\n#include "c.h"\n-- no\n#define N 5\n#define M -7 /* seven */\n#define T abc -- note\n#define F(a,b) \\\n  a+b\n#define G(x)\n#define E\n#define V some text\n'
    got = extract.headers(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).orderBy("ordinal").collect()
    assert [(r.kind, r.name, r.value, r.define_type, r.line_number) for r in got] == [
        ("include", "a/b.h", None, None, 1), ("include", "c.h", None, None, 2), ("define", "N", "5", "const", 4), ("define", "M", "-7", "const", 5), ("define", "T", "abc", "comment", 6),
        ("define", "F", "a+b", "macro", 7), ("define", "G", "", "macro", 9), ("define", "E", "", "const", 10), ("define", "V", "some text", "macro", 11),
    ]
    assert {r.id for r in got} == {1}


def test_scripts(spark):
    text = 'var LIMIT = 10;\nvar q = Sys.CreateObject("Query");\n// function no() {}\nfunction InitForm(a, b) {\n  if (a) { q.ExecQuery("select 1"); }\n  q.ExecProc("P_Run");\n}\nfunction other() {\n}\n'
    rows = extract.scripts(spark.createDataFrame([(text,)], "text string")).collect()
    by = {(r.kind, r.name): r for r in rows}
    assert len(rows) == 6
    f = by["function", "InitForm"]
    assert (f.value, f.scenario_type, f.object, f.line_start, f.line_end) == ("function InitForm(a, b)", "instrument_model", "Query", 4, 7)
    assert (by["function", "other"].scenario_type, by["function", "other"].object) == ("utility", None)
    assert by["exec_query", None].value == "select 1" and by["exec_proc", "P_Run"].line_start == 6 and by["constant", "LIMIT"].value == "10"


PGN = """[Event "One"]
[EventDate "2020"]
[White "Ann"]
[Black "Bo"]

1. e4 {good (or not)} e5 2. Nf3! (2. f4 exf4 (2... d5) 3. Nf3) 2... Nc6 $1 3. O-O Qh4+ 1-0

[Event "Empty"]
[White "X"]
*

[Event "Two"]
1.d4 d5 2.e8=Q d1Q 1/2-1/2
"""


def test_games(spark):
    got = extract.games(spark.createDataFrame([(PGN,)], "text string")).orderBy("ordinal")
    one, two = got.collect()
    assert (one.white, one.black, one.result) == ("Ann", "Bo", "1-0")
    assert [(m.san, m.annotation) for m in one.moves] == [("e4", 0), ("e5", 0), ("Nf3", 1), ("Nc6", 0), ("O-O", 0), ("Qh4+", 0)]
    assert [m.san for m in two.moves] == ["d4", "d5", "e8=Q", "d1Q"] and two.result == "1/2-1/2" and two.white == ""
    assert [m["san"] for m in extract.game_rows(PGN, compat=True)[0]["moves"]] == ["e4", "e5", "Nc6", "O-O", "Qh4+"]
    text = got.select(extract.move_text("moves.san").alias("t")).first().t
    assert text == "1.e4 e5 2.Nf3 Nc6 3.O-O Qh4+"


def test_envelopes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").orderBy("k")
    got = envelope.success(df, "symbol", 100, {"name": "a", "type": ""})
    assert got == {"success": True, "format_version": "1.0", "command": "symbol", "count": 2, "items": [{"k": 1, "v": "a"}, {"k": 2, "v": None}], "meta": {"limit": 100, "filters": {"name": "a"}}}
    assert envelope.success(df.where("false"), "symbol", 5)["items"] == []
    assert envelope.failure(envelope.Unconfigured("none"), "c")["error"] == {"code": "config_error", "message": "none"} and envelope.error_code(OSError()) == "internal_error"
    with pytest.raises(Exception) as wrong:
        df.select("no_such_column")
    assert envelope.error_code(wrong.value) == "query_failed"
    from quarry.operators import predicates

    with pytest.raises(ValueError) as empty:
        predicates.filtered(df, equal={"a": ""}, require=True)
    assert envelope.error_code(empty.value) == "invalid_arguments"
    envelope.ndjson(df, str(tmp_path / "out"))
    assert sorted(json.loads(r.value)["k"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [1, 2]


def test_incremental(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def run():
        batch = lambda df: extract.headers(df.select("path", files.decode("content", F.lit("CP866")).alias("text")))
        incremental.process_new(incremental.new_files(spark, source, "*.h"), batch, target, state).awaitTermination()
        return sorted(r.name for r in spark.read.parquet(target).collect())

    (tmp_path / "in" / "a.h").write_text("#define A 1\n")
    assert run() == ["A"] == run()
    (tmp_path / "in" / "b.h").write_text("#define B 1\n")
    assert run() == ["A", "B"]


def test_rows_of_one_task_are_dealt_out(spark):
    df = spark.range(400).coalesce(1).select("id", F.lit("exec Log1").alias("text"))
    found = sqltext.scripts(df).where("kind = 'call'").select("id", F.spark_partition_id().alias("task"))
    assert found.select("id").distinct().count() == 400 and found.select("task").distinct().count() > 3
    many = df.repartition(40)
    assert extract.dealt(many) is many

"""Copy-on-write tables: versions, touched buckets, deaths on the way, and what is built on them (index, edge table, streamed counters)."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.sources import edge_table, index
from quarry.sources.store import Change, Conflict, Store, Table
from quarry.streaming import counters

THINGS = {"things": Table("k long, v string", "k")}


def things(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def held(store, version=None):
    return sorted((r.k, r.v) for r in store.read("things", version).collect())


def test_versions_and_touched_buckets(spark, tmp_path):
    s = Store(spark, str(tmp_path), THINGS, 16)
    assert held(s) == [] and s.version() == 0
    s.upsert("things", things(spark, [(i, "a") for i in range(200)]))
    first = s.manifest()
    assert s.upsert("things", things(spark, [(3, "b"), (3, "c"), (500, "n")]))["things"] <= 2
    assert held(s) == sorted([(i, "a") for i in range(200) if i != 3] + [(3, "b"), (3, "c"), (500, "n")])
    assert held(s, 1) == [(i, "a") for i in range(200)]  # readers of the version before
    live, old = s.manifest()["tables"]["things"]["live"], first["tables"]["things"]["live"]
    assert sum(live[b] != old[b] for b in live) <= 2 and len(live) == 16
    s.commit({"things": Change(gone=things(spark, [(i, "") for i in range(0, 200)]).select("k"))})
    assert held(s) == [(500, "n")]
    assert s.commit({"things": Change()}) == {"things": 0}
    again = Store(spark, str(tmp_path))
    assert held(again) == [(500, "n")] and again.vacuum() >= 2 and held(again) == [(500, "n")]
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none"))


def test_null_keys_are_a_key(spark, tmp_path):
    s = Store(spark, str(tmp_path), THINGS, 4)
    s.upsert("things", things(spark, [(None, "a"), (1, "b")]))
    s.upsert("things", things(spark, [(None, "c")]))
    assert sorted((r.v for r in s.read("things").collect())) == ["b", "c"]


def test_a_commit_that_dies_or_loses_leaves_the_version_before(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path), THINGS, 4)
    s.upsert("things", things(spark, [(1, "a")]))
    with monkeypatch.context() as m:
        m.setattr(Store, "_put", lambda *_: (_ for _ in ()).throw(OSError("killed")))  # rows are written, the manifest is not
        with pytest.raises(OSError):
            s.upsert("things", things(spark, [(1, "b"), (2, "b")]))
    assert held(s) == [(1, "a")] and s.version() == 1
    with pytest.raises(Exception):
        s.upsert("things", things(spark, [(2, "x")]).withColumn("v", F.raise_error(F.lit("bad row"))))
    assert held(s) == [(1, "a")]
    stale = s.manifest()
    s.upsert("things", things(spark, [(1, "c")]))
    with pytest.raises(Conflict):
        s._put(stale | {"version": stale["version"] + 1})
    with pytest.raises(Conflict):  # changes made from a version that is no longer the newest
        s.commit({"things": Change(rows=things(spark, [(1, "d")]))}, since=stale["version"])
    assert held(s) == [(1, "c")] and not [f for f in os.listdir(tmp_path / "manifests") if f.startswith(".") and not f.endswith(".crc")]
    assert s.vacuum() >= 1 and held(s) == [(1, "c")]


def test_index_follows_its_files(spark, tmp_path, monkeypatch):
    files = lambda rows: spark.createDataFrame(rows, "file_id long, text string")
    seen = []

    def watched(df):
        seen.append(sorted(r.file_id for r in df.collect()))
        return index.symbols(df)

    now = {i: f"Alpha {i}\nBeta Gamma\nAlpha Delta{i}" for i in range(50)}
    one = index.open_index(spark, str(tmp_path / "a"), {"symbols": index.SYMBOLS}, 8)
    assert index.update(one, files(list(now.items()) + [(99, None)]), {"symbols": watched})["added"] == 51
    now = {i: t for i, t in now.items() if i % 10} | {i: "Zeta\nEta" for i in range(0, 50, 5) if i % 10} | {60: "New Name"}
    assert index.update(one, files(list(now.items()) + [(99, None)]), {"symbols": watched}) == {"added": 1, "updated": 5, "deleted": 5, "unchanged": 41}
    assert seen[1] == [5, 15, 25, 35, 45, 60]  # only new and changed files are read for rows
    whole = index.open_index(spark, str(tmp_path / "b"), {"symbols": index.SYMBOLS}, 8)
    index.update(whole, files(list(now.items()) + [(99, None)]), {"symbols": index.symbols})
    rows = lambda s, n: sorted(map(tuple, s.read(n).collect()))
    assert rows(one, "symbols") == rows(whole, "symbols") and rows(one, "files") == rows(whole, "files")
    version = one.version()
    assert index.update(one, files(list(now.items()) + [(99, None)]), {"symbols": watched})["unchanged"] == 47 and one.version() == version
    with monkeypatch.context() as m:  # a run killed after its rows were written
        m.setattr(Store, "_put", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            index.update(one, files([(1, "Other")]), {"symbols": index.symbols})
    assert rows(one, "symbols") == rows(whole, "symbols")


def test_one_kind_of_edges_is_rebuilt(spark, tmp_path):
    path = str(tmp_path / "edges")
    edge = lambda s, t, kind: ("api_contract", s, "api_contract", t, "x", 1, kind)
    edge_table.save(spark.createDataFrame([edge(1, 2, "calls"), edge(8, 9, "subscribes_to_event"), edge(3, 4, "calls")], edge_table.COLUMNS), path)
    calls = sorted(os.listdir(f"{path}/relation_type=calls"))
    contracts = spark.createDataFrame(
        [(1, "Paid", "event", "m1", None, None), (2, "PAID", "Event", "m2", None, None), (3, "Paid", "event", None, None, None), (4, "Sent", "service", "m1", None, None),
         (10, "a", "callback_event", None, " paid ", "M1"), (11, "b", "Callback_Event", None, "Paid", " m9 "), (12, "c", "callback_event", None, "Sent", None), (13, "d", "callback_event", None, "  ", "m1"), (14, "e", "callback_event", None, "paid", None), (15, "f", "callback_event", None, None, None)],
        "id long, contract_name string, contract_kind string, owner_module string, used_object_name string, used_module_sys_name string",
    )
    for _ in range(2):
        assert edge_table.rebuild_subscriptions(contracts, path) == 3
        got = sorted((r.relation_type, r.source_id, r.target_id) for r in edge_table.load(spark, path).collect())
        assert got == [("calls", 1, 2), ("calls", 3, 4), ("subscribes_to_event", 10, 1), ("subscribes_to_event", 11, 3), ("subscribes_to_event", 14, 3)]
    assert sorted(os.listdir(f"{path}/relation_type=calls")) == calls  # not written again
    assert edge_table.rebuild_subscriptions(contracts.limit(0), path) == 0
    assert sorted(r.relation_type for r in edge_table.load(spark, path).collect()) == ["calls", "calls"]


# --- streamed counters --------------------------------------------------------------------------

NAME = "concat_ws(':', event_type, user_id)"
COLUMNS = ["name", *counters.ADDED, "rating", "annotation", "code"]


def test_stream_equals_batch_and_takes_nothing_twice(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    inbox, path = str(tmp_path / "in"), str(tmp_path / "store")
    parts = [events.where(F.col("event_id") % 5 == i).coalesce(1) for i in range(5)]
    store = Store(spark, path, counters.TABLES, 4)
    rows = lambda: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in store.read("counters").select(*COLUMNS).collect())
    run = lambda stream="events": counters.follow(spark, inbox, events.schema, store, str(tmp_path / stream), F.expr(NAME), stream, files_a_batch=1).awaitTermination()
    for p in parts[:3]:
        p.write.mode("append").parquet(inbox)
    run()
    half = rows()
    for p in parts[3:]:
        p.write.mode("append").parquet(inbox)
    run()  # goes on from its checkpoint
    batch = counters.batch_counts(events, F.expr(NAME)).collect()
    assert [r[:6] for r in rows()] == sorted((r.name, r.games_count, r.wins, r.draws, r.losses, round(r.rating, 9)) for r in batch) and rows() != half
    # what a key got first stays: the first file's annotation, though later files hold earlier events
    first = {r.name: (r.annotation, r.code) for r in counters.batch_counts(parts[0], F.expr(NAME)).collect()}
    assert all(r[6:] == first[r[0]] for r in rows() if r[0] in first) or store.read("taken").count() == 5
    full, version = rows(), store.version()
    assert store.read("taken").count() == 5 and store.mark("events") == 4
    parts[1].write.mode("append").parquet(inbox)  # delivered again under another name
    run()
    assert rows() == full and store.version() == version + 1
    run("again")  # a lost checkpoint: everything comes anew
    assert rows() == full
    assert counters.take(store, events.withColumn("__file", F.lit("f")), 4, "events", F.expr(NAME)) == {}  # a batch that was committed


def test_first_values_and_weighted_means(spark):
    from quarry.operators.lookup import accumulate

    old = spark.createDataFrame([("a", 2, 1.0, None, "x"), ("b", 1, None, "o", "y")], "k string, n int, r double, note string, code string")
    new = spark.createDataFrame([("a", 2, 2.0, "z", "q"), ("a", 0, 9.0, "y", "p"), ("b", 3, 4.0, "n", None), (None, 1, 1.0, None, None)], "k string, n int, r double, note string, code string")
    got = {r.k: tuple(r)[1:] for r in accumulate(old, new, ["k"], ["n"], {"r": "n"}, ["note", "code"]).collect()}
    assert got == {"a": (4, 1.5, "y", "x"), "b": (4, 4.0, "o", "y"), None: (1, 1.0, None, None)}


def test_games_by_id(spark, tmp_path):
    from quarry.operators import games

    kept = games.open_games(spark, str(tmp_path), 4)
    made = games.save(kept, spark.createDataFrame([("Ann", "Bo"), ("Cy", "Di")], "white_player string, black_player string"))
    ids = [r.id for r in made.collect()]
    assert len(set(ids)) == 2 and {r.white_player for r in games.get(kept, made).collect()} == {"Ann", "Cy"}
    one = spark.createDataFrame([(ids[0], "1-0", None), ("none", "0-1", True)], "id string, result string, processed boolean")
    assert games.change(kept, one) == 1
    row = games.get(kept, one).first()
    assert (row.id, row.result, row.processed) == (ids[0], "1-0", False) and row.updated_at > row.created_at and kept.read("games").count() == 2
    games.delete(kept, one)
    assert [r.id for r in kept.read("games").collect()] == [ids[1]]


def test_include_patterns():
    from quarry.sources.files import include_patterns

    assert include_patterns([" *.SQL", "*.sql", ".pas", "*.exe", "src/*", ""]) == ["*.sql", ".pas"]
    assert include_patterns(["*.exe"], [".h", ".a"]) == [".h", ".a"]


def test_ratio(spark):
    from quarry.operators import huffman

    df = spark.createDataFrame([(1, 3), (3, 3), (5, 0)], "a long, b long")
    assert [r.x for r in df.select(huffman.ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [33, 100, None]

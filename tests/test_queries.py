"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from quarry.plans import named_queries
from quarry.plans import queries as plans
from quarry.sources.tables import NAMES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


def rows(found):
    return sorted(tuple((v is None, str(round(v, 6) if isinstance(v, float) else v)) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({plans.SQL[name]})").fetchall()
    assert rows(df.select(*names).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(named_queries.SQL))
def test_named_matches_sql(spark, duck, name):
    df = named_queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({named_queries.SQL[name]})").fetchall()
    assert rows(df.select(*names).collect()) == rows(want) and want


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries())


def test_extractor_queries(spark):
    run = lambda name: plans.QUERIES[name](spark, SF).collect()
    assert {(r.name, r.value) for r in run("select_into_types")} == {("DealID", "DSIDENTIFIER"), ("Total", "DSMONEY"), ("Brief", "DSBRIEFNAME")}
    assert {(r.source, r.target, r.relation_type) for r in run("sql_edges")} == {
        ("CloseDeals", "LogClosed", "calls_procedure"), ("CloseDeals", "pClosed", "selects_from"), ("CloseDeals", "tDeal", "selects_from"), ("CloseDeals", "tClient", "selects_from"),
        ("CloseDeals", "tDeal", "updates"), ("LogClosed", "tLog", "inserts_into"),
    }
    assert {(r.kind, r.name) for r in run("sql_extract") if r.kind in ("procedure", "index", "call")} == {("procedure", "CloseDeals"), ("procedure", "LogClosed"), ("index", "XPKtDeal"), ("call", "LogClosed")}
    assert {(r.kind, r.name) for r in run("pas_extract") if r.kind in ("unit", "class", "field")} == {("unit", "Deals"), ("class", "TDeals"), ("field", "FCount")}
    assert {(r.target, r.relation_type) for r in run("pas_edges")} == {("tDeal", "references_table")}

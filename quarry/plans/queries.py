"""The registered queries of the engine's own operators on the driver's tables, each with its SQL.

Every result with a limit is in a total order, so a rerun and another engine give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashes
from ..operators import anchors, continuations, dictionary, edges, games, graph, huffman, intervals, lookup, predicates, prefixes, ratings, running, side_table, sorting, sqltext, text, trigrams, units
from ..sources import edge_table, index, shared, store
from ..sources import tables as T
from ..streaming import counters
from . import samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
R, S, M = T.RELATIONS_SQL, T.SYMBOLS_SQL, T.MOVES_SQL


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- lookups -----------------------------------------------------------------------------------


@query(f"with {S} select symbol_type, entity_type, entity_id, symbol_name from symbols_v where symbol_name = 'ASIA'")
def symbol_exact(spark, d):
    return T.symbols(spark, d).where(predicates.name_lookup(["symbol_name"], " ASIA "))


@query(f"with {S} select symbol_type, entity_type, entity_id, symbol_name from symbols_v where symbol_name ilike '%er#1%' order by symbol_name, symbol_type, entity_id limit 100")
def symbol_like(spark, d):
    return T.symbols(spark, d).where(predicates.name_lookup(["symbol_name"], "er#1", like=True)).orderBy("symbol_name", "symbol_type", "entity_id").limit(100)


@query(f"with {S} select symbol_type, entity_type, entity_id, symbol_name from symbols_v where symbol_name ilike '%a%' and symbol_type = 'nation' order by symbol_name, entity_id limit 100")
def symbol_typed(spark, d):
    return predicates.filtered(T.symbols(spark, d), equal={"symbol_type": "nation", "entity_type": ""}, like={"symbol_name": "a"}).orderBy("symbol_name", "entity_id").limit(100)


@query("select s_suppkey, s_name, s_nationkey from supplier where lower(s_name) = lower('SUPPLIER#000000007') or lower(s_name) = lower('supplier#7')")
def lookup_ci(spark, d):
    s = T.read(spark, d, "supplier")
    return s.where(predicates.equals_ci("s_name", "SUPPLIER#000000007") | predicates.equals_ci("s_name", " supplier#7\t")).select("s_suppkey", "s_name", "s_nationkey")


@query("select p_partkey, p_name, p_brand, p_type from part where p_name ilike '%re%' or p_brand ilike '%re%' or p_type ilike '%re%' order by p_name, p_partkey limit 200")
def multi_field_lookup(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return p.where(predicates.name_lookup(["p_name", "p_brand", "p_type"], "re", like=True)).orderBy("p_name", "p_partkey").limit(200)


@query("select doc_id, lang, source from documents where text ilike '%licensed under%' order by doc_id limit 100")
def fragment_search(spark, d):
    return T.read(spark, d, "documents").where(F.col("text").ilike(predicates.pattern("licensed under"))).select("doc_id", "lang", "source").orderBy("doc_id").limit(100)


@query("select page_id, url from pages where url like 'https://%'")
def prefix_match(spark, d):
    return T.read(spark, d, "pages").where(F.col("url").startswith("https://")).select("page_id", "url")


@query("select page_id, url from pages where url like '%5' or url = 'http://a' or url like 'http://a/%'")
def suffix_match(spark, d):
    return T.read(spark, d, "pages").where(F.col("url").endswith("5") | predicates.under_path("url", "http://a")).select("page_id", "url")


@query("select o_orderkey, o_orderstatus, o_orderpriority, o_totalprice from orders where o_orderstatus = 'F' and o_orderpriority ilike '%urgent%' order by o_totalprice desc, o_orderkey limit 50")
def dynamic_filters(spark, d):
    o = predicates.filtered(T.read(spark, d, "orders"), equal={"o_orderstatus": "F", "o_custkey": None}, like={"o_orderpriority": "urgent"}, require=True)
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("select exists(select 1 from orders where o_totalprice > 100000) as has_large, exists(select 1 from orders where o_totalprice < 0) as has_negative")
def exists_scalar(spark, d):
    return T.read(spark, d, "orders").agg(F.coalesce(F.bool_or(F.col("o_totalprice") > 100000), F.lit(False)).alias("has_large"), F.coalesce(F.bool_or(F.col("o_totalprice") < 0), F.lit(False)).alias("has_negative"))


@query(f"with {R}, {S} select source_type, source_id, target_type, target_id, relation_type, line_number from relations_v r where exists (select 1 from symbols_v s where s.symbol_type = r.target_type and s.entity_id = r.target_id and s.symbol_type = 'nation' and s.symbol_name ilike '%1%')")
def semi_by_name(spark, d):
    s = T.symbols(spark, d).where((F.col("symbol_type") == "nation") & F.col("symbol_name").ilike("%1%"))
    return graph.of_symbols(T.relations(spark, d), s, "target").select("source_type", "source_id", "target_type", "target_id", "relation_type", "line_number")


@query(f"with {R}, {S} select relation_type, count(*) as n from relations_v r where exists (select 1 from symbols_v s where s.symbol_type = r.source_type and s.entity_id = r.source_id and s.symbol_name ilike '%12%') group by relation_type")
def or_exists_by_type(spark, d):
    s = T.symbols(spark, d).where(F.col("symbol_name").ilike("%12%"))
    return graph.of_symbols(T.relations(spark, d), s, "source").groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))


# --- aggregates --------------------------------------------------------------------------------


@query("select l_returnflag, l_linestatus, min(l_orderkey) as first_id, count(*) as usages, count(distinct l_suppkey) as suppliers from lineitem group by all order by usages desc, l_returnflag, l_linestatus limit 100")
def usage_groups(spark, d):
    return T.read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.min("l_orderkey").alias("first_id"), F.count(F.lit(1)).alias("usages"), F.countDistinct("l_suppkey").alias("suppliers")).orderBy(F.desc("usages"), "l_returnflag", "l_linestatus").limit(100)


@query("select count(*) as total, count(*) filter (upper(event_type) = 'VIEW') as views, count(*) filter (upper(event_type) = 'CLICK') as clicks, count(*) filter (upper(event_type) = 'ERROR') as errors from events")
def filtered_counts(spark, d):
    kind = F.upper("event_type")
    return T.read(spark, d, "events").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(kind == k).alias(n) for k, n in (("VIEW", "views"), ("CLICK", "clicks"), ("ERROR", "errors"))])


@query(" union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in T.NAMES))
def table_counts(spark, d):
    out = None
    for n in T.NAMES:
        one = T.read(spark, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select count(distinct o_custkey) as customers, count(distinct nullif(o_orderpriority, '')) as priorities, coalesce(sum(o_custkey), 0)::bigint as key_sum from orders")
def distinct_count(spark, d):
    return T.read(spark, d, "orders").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct(predicates.null_if_empty("o_orderpriority")).alias("priorities"), F.coalesce(F.sum("o_custkey"), F.lit(0)).alias("key_sum"))


@query("select p_brand, count(l_partkey) as uses, coalesce(round(avg(l_quantity), 6), 0) as avg_quantity, coalesce(sum(l_linenumber), 0)::bigint as lines from part left join lineitem on l_partkey = p_partkey and l_quantity > 49 group by p_brand")
def dim_preserving_agg(spark, d):
    l = T.read(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey", "l_quantity", "l_linenumber")
    p = T.read(spark, d, "part").select("p_partkey", "p_brand")
    return p.join(l, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("p_brand").agg(F.count("l_partkey").alias("uses"), F.coalesce(F.round(F.avg("l_quantity"), 6), F.lit(0.0)).alias("avg_quantity"), F.coalesce(F.sum("l_linenumber"), F.lit(0)).alias("lines"))


@query("select c_custkey, c_name, o_orderkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 400000 order by c_custkey, o_orderkey nulls first limit 500")
def optional_child_left_join(spark, d):
    o = T.read(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey", "o_orderkey")
    return T.read(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "o_orderkey").orderBy("c_custkey", F.col("o_orderkey").asc_nulls_first()).limit(500)


@query(f"with {R} select relation_type, source_type, target_type, count(*) as n, count(distinct source_id) as sources, count(distinct target_id) as targets from relations_v group by all")
def summary_counts(spark, d):
    return T.relations(spark, d).groupBy("relation_type", "source_type", "target_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"), F.countDistinct("target_id").alias("targets"))


@query("select event_type, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as k_sum, max(cast(json_extract_string(props, '$.k') as bigint)) as k_max from events group by event_type")
def json_props(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return T.read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


# --- graph -------------------------------------------------------------------------------------


@query(f"""with {R}, {S}, picked as (select * from relations_v where relation_type = 'placed_by' order by source_id desc, target_id limit 100)
select p.source_type, p.source_id, coalesce(a.symbol_name, p.source_type || ':' || p.source_id) as source_name, p.target_type, p.target_id, coalesce(b.symbol_name, p.target_type || ':' || p.target_id) as target_name, p.relation_type, p.line_number
from picked p left join symbols_v a on a.symbol_type = p.source_type and a.entity_id = p.source_id left join symbols_v b on b.symbol_type = p.target_type and b.entity_id = p.target_id""")
def polymorphic_edge_details(spark, d):
    picked = T.relations(spark, d).where("relation_type = 'placed_by'").orderBy(F.desc("source_id"), "target_id").limit(100)
    return graph.edge_details(picked, T.symbols(spark, d)).select("source_type", "source_id", "source_name", "target_type", "target_id", "target_name", "relation_type", "line_number")


@query(f"""with {R}, {S}, last as (select distinct l_partkey as part_id, l_suppkey as supplier_id from lineitem where l_suppkey = 3), first as (select source_id, target_id, line_number from relations_v where relation_type = 'contains_part' and target_type = 'part')
select f.source_id, a.symbol_name as source_name, b.symbol_name as mid_name, c.symbol_name as end_name, f.line_number
from first f join last l on l.part_id = f.target_id join (select * from symbols_v where symbol_type = 'order') a on a.entity_id = f.source_id join (select * from symbols_v where symbol_type = 'part') b on b.entity_id = l.part_id
join (select * from symbols_v where symbol_type = 'supplier' and entity_id = 3) c on c.entity_id = l.supplier_id""")
def path_join_5way(spark, d):
    s = T.symbols(spark, d)
    return graph.path(T.relations(spark, d), s, ("contains_part", "supplied_by"), s.where("symbol_type = 'supplier' and entity_id = 3"))


def _reach_sql(target: str, direct: str, onward: str) -> str:
    return f"""with {R}, {S}, wanted as (select * from symbols_v where {target})
select * from (select r.source_id, s.symbol_name as caller_name, r.source_type as caller_type, r.line_number, false as is_indirect, '' as via, r.relation_type
 from relations_v r join wanted t on r.target_type = t.symbol_type and r.target_id = t.entity_id join symbols_v s on r.source_type = s.symbol_type and r.source_id = s.entity_id where r.relation_type = '{direct}'
 union select u.source_id, s.symbol_name, u.source_type, u.line_number, true, m.symbol_name, concat(u.relation_type, '->', q.relation_type)
 from wanted t join relations_v q on q.target_type = t.symbol_type and q.target_id = t.entity_id join symbols_v m on q.source_type = m.symbol_type and q.source_id = m.entity_id
 join relations_v u on u.target_type = m.symbol_type and u.target_id = m.entity_id join symbols_v s on u.source_type = s.symbol_type and u.source_id = s.entity_id
 where q.relation_type = '{direct}' and u.relation_type = '{onward}') x order by is_indirect, caller_type, caller_name, source_id, via limit 100"""


def _reach(spark, d, target: str, direct: str, onward: str) -> DataFrame:
    s = T.symbols(spark, d)
    return graph.reaching(T.relations(spark, d), s, s.where(target), [direct], [onward]).orderBy("is_indirect", "caller_type", "caller_name", "source_id", "via").limit(100)


@query(_reach_sql("symbol_type = 'region' and symbol_name ilike '%A%'", "part_of", "located_in"))
def callers_two_hop(spark, d):
    return _reach(spark, d, "symbol_type = 'region' and symbol_name ilike '%A%'", "part_of", "located_in")


@query(_reach_sql("symbol_type = 'nation' and symbol_name ilike '%1%'", "located_in", "placed_by"))
def impl_two_hop(spark, d):
    return _reach(spark, d, "symbol_type = 'nation' and symbol_name ilike '%1%'", "located_in", "placed_by")


def _publishers_sql() -> str:
    """The two branches and, without a hop, the customers that are located in a wanted nation: another type, taken only where its end is one."""
    two = _reach_sql("symbol_type in ('supplier', 'nation') and entity_id < 4", "supplied_by", "contains_part")
    third = """ union select r.source_id, s.symbol_name, r.source_type, r.line_number, false, '', r.relation_type from relations_v r join wanted t on r.target_type = t.symbol_type and r.target_id = t.entity_id
 join symbols_v s on r.source_type = s.symbol_type and r.source_id = s.entity_id where r.relation_type = 'located_in' and r.source_type = 'customer' and t.symbol_type = 'nation') x order"""
    return two.replace(") x order", third).replace("limit 100", "limit 300")


@query(_publishers_sql())
def publishers_three_branch(spark, d):
    s = T.symbols(spark, d)
    wanted = s.where("symbol_type in ('supplier', 'nation') and entity_id < 4")
    found = graph.reaching(T.relations(spark, d), s, wanted, ["supplied_by"], ["contains_part"], [("customer", "located_in", "nation")])
    return found.orderBy("is_indirect", "caller_type", "caller_name", "source_id", "via").limit(300)


@query(f"""with {R}, {S}, w as (select * from symbols_v where symbol_type in ('nation', 'supplier')),
e as (select w.symbol_type, w.entity_id, r.target_type nt, r.target_id ni, 0 i, 1 o from relations_v r join w on r.source_type = w.symbol_type and r.source_id = w.entity_id
union all select w.symbol_type, w.entity_id, r.source_type, r.source_id, 1, 0 from relations_v r join w on r.target_type = w.symbol_type and r.target_id = w.entity_id)
select w.symbol_type, w.entity_type, w.entity_id, w.symbol_name, coalesce(sum(i), 0)::bigint as incoming, coalesce(sum(o), 0)::bigint as outgoing, count(distinct (nt, ni)) filter (nt is not null) as neighbours
from w left join e using (symbol_type, entity_id) group by w.symbol_type, w.entity_type, w.entity_id, w.symbol_name""")
def inspect_neighbors(spark, d):
    s = T.symbols(spark, d)
    return graph.neighbours(T.relations(spark, d), s, s.where("symbol_type in ('nation', 'supplier')")).select("symbol_type", "entity_type", "entity_id", "symbol_name", "incoming", "outgoing", "neighbours")


@query(f"""with {S} select symbol_type, entity_id, symbol_name, (case when lower(symbol_name) = 'china' then 10 else 0 end + case when symbol_type = 'nation' then 5 else 0 end + case when entity_type = 'geo' then 3 else 0 end) as score
from symbols_v where symbol_name ilike '%in%' order by score desc, symbol_name, entity_id, symbol_type limit 50""")
def relevance_rank(spark, d):
    s = T.symbols(spark, d).where(F.col("symbol_name").ilike("%in%")).withColumn("score", graph.relevance("china", "nation", "geo"))
    return s.select("symbol_type", "entity_id", "symbol_name", "score").orderBy(F.desc("score"), "symbol_name", "entity_id", "symbol_type").limit(50)


@query("select 'customer' as source, c_custkey as id, c_name as name, c_mktsegment as segment, c_acctbal as balance from customer where c_name ilike '%1%' union all select 'supplier', s_suppkey, s_name, '', s_acctbal from supplier where s_name ilike '%1%'")
def union_all_tagged(spark, d):
    c = T.read(spark, d, "customer").where("c_name ilike '%1%'").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    s = T.read(spark, d, "supplier").where("s_name ilike '%1%'").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True).withColumn("segment", F.coalesce("segment", F.lit("")))


@query("select o_orderkey, o_orderstatus, lines from orders left join (select l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' order by l_linenumber, l_partkey, l_suppkey) as lines from lineitem group by l_orderkey) on l_orderkey = o_orderkey")
def nested_children(spark, d):
    kids = lookup.children_of(T.read(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], [], "c")
    o = T.read(spark, d, "orders").join(kids, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.select("o_orderkey", "o_orderstatus", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_suppkey"])), ",").alias("lines"))


# --- latest, ranges, snapshots, changes ------------------------------------------------------------


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1")
def latest_per_key(spark, d):
    return lookup.latest(T.read(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], F.desc("turn"))


@query("select event_id, user_id, event_type from events order by ts desc, event_id desc limit 1")
def last_run(spark, d):
    return T.read(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id", "event_type")


@query("""with r as (select user_id, event_id as range_id, event_id as lo, event_id + 2000 as hi from events where event_type = 'signup'), p as (select user_id, event_id as at from events where event_type = 'purchase')
select p.user_id, p.at, max(r.range_id) as range_id from p left join r on r.user_id = p.user_id and r.lo <= p.at and r.hi >= p.at group by p.user_id, p.at""")
def innermost_range(spark, d):
    e = T.read(spark, d, "events")
    r = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("range_id"), F.col("event_id").alias("lo"), (F.col("event_id") + 2000).alias("hi"))
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("at"))
    return intervals.enclosing(p, r, "user_id", "at", "lo", "hi", "range_id", ["at"]).select("user_id", "at", "range_id")


_DIFF = """with a as (select doc_id, md5(text) as h from documents where doc_id % 7 <> 0), b as (select doc_id, case when doc_id % 11 = 0 then md5(text || 'x') else md5(text) end as h from documents where doc_id % 5 <> 0)
select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'added' when b.doc_id is null then 'deleted' when a.h = b.h then 'unchanged' else 'updated' end as status from a full join b on a.doc_id = b.doc_id"""


def _diff(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "text")
    a = docs.where("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("h"))
    b = docs.where("doc_id % 5 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("h"))
    return lookup.snapshot_diff(a, b, "doc_id", "h")


@query(_DIFF)
def snapshot_diff(spark, d):
    return _diff(spark, d)


@query(f"select doc_id from ({_DIFF}) where status = 'deleted'")
def anti_deleted(spark, d):
    return _diff(spark, d).where("status = 'deleted'").select("doc_id")


@query("""with n as (select p_partkey, p_brand, p_size from part), a as (select p_brand, p_size, max(p_partkey) as id from part where p_partkey % 3 = 0 group by all), b as (select p_brand, max(p_partkey) as id from part where p_partkey % 2 = 0 group by all)
select n.p_partkey, coalesce(a.id, b.id) as id from n left join a using (p_brand, p_size) left join b using (p_brand)""")
def fallback_resolution(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    ids = p.withColumn("id", F.col("p_partkey"))
    return lookup.resolve(p, (ids.where("id % 3 = 0"), ["p_brand", "p_size"]), (ids.where("id % 2 = 0"), ["p_brand"])).select("p_partkey", "id")


@query("select doc_id, item_id from documents, benchmark where contains(lower(documents.text), lower(benchmark.text))")
def containment_theta(spark, d):
    return anchors.containing(T.read(spark, d, "documents"), T.read(spark, d, "benchmark"), "doc_id", "item_id")


@query("""select l_orderkey, sum(n)::bigint as lines, sum(q)::bigint as quantity from (select l_orderkey, 1 as n, cast(l_quantity as bigint) as q from lineitem where l_linenumber <= 3 union all select l_orderkey, 1, cast(l_quantity as bigint) from lineitem where l_linenumber > 2) group by l_orderkey""")
def upsert_merge(spark, d):
    l = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1).alias("lines"), F.col("l_quantity").cast("long").alias("quantity"))
    return lookup.accumulate(l.where("l_linenumber <= 3").drop("l_linenumber"), l.where("l_linenumber > 2").drop("l_linenumber"), ["l_orderkey"], ["lines", "quantity"])


@query("""with old as (select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1), few as (select * from old where o_custkey % 2 = 0)
select * from few union all select o_custkey, o_orderkey from (select o_custkey, o_orderkey from orders where o_custkey not in (select o_custkey from few) qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)""")
def insert_ignore(spark, d):
    o = T.read(spark, d, "orders").select("o_custkey", "o_orderkey")
    old = lookup.latest(o.where("o_custkey % 2 = 0"), ["o_custkey"], F.asc("o_orderkey"))
    return lookup.insert_ignore(old, o, ["o_custkey"], F.desc("o_orderkey"))


@query("select s_suppkey, case when s_suppkey % 4 = 0 then upper(s_name) || '!' else s_name end as s_name, s_acctbal from supplier")
def update_by_key(spark, d):
    s = T.read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.where("s_suppkey % 4 = 0").select("s_suppkey", F.concat(F.upper("s_name"), F.lit("!")).alias("s_name"))
    return lookup.update(s, new, ["s_suppkey"])


@query("select l_orderkey, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'F') group by l_orderkey")
def cascade_delete(spark, d):
    kept = T.read(spark, d, "orders").where("o_orderstatus <> 'F'")
    return lookup.cascade(kept, T.read(spark, d, "lineitem").select("l_orderkey"), "o_orderkey", "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


# --- stores that change ------------------------------------------------------------------------------


def _indexed(spark, d) -> tuple:
    """The index of documents after two runs: a fifth had other texts in the first one, a tenth is gone in the second, a tenth new."""
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    kept = index.open_index(spark, shared.fresh(spark, "index"), {"symbols": index.SYMBOLS}, 32)
    first = docs.where("file_id % 10 <> 7").withColumn("text", F.when(F.col("file_id") % 5 == 0, F.concat(F.lit("Former Draft\n"), "text")).otherwise(F.col("text")))
    run = {"symbols": index.symbols}
    return kept, [index.update(kept, df, run) for df in (first, docs.where("file_id % 10 <> 3"))]


@query("""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where doc_id % 10 <> 3), names as (select doc_id, n, unnest(regexp_extract_all(line, '[A-Z][a-z]+')) as s from lines)
select doc_id as file_id, s as symbol_name, min(n)::integer as line_number from names group by doc_id, s""")
def index_update(spark, d):
    return _indexed(spark, d)[0].read("symbols")


@query("""with s as (select doc_id % 10 as m, doc_id % 5 as v, strlen(text) as n from documents) select 1 as run, 'added' as status, count(*) as files from s where m <> 7 union all select 2, 'added', count(*) from s where m = 7
union all select 2, 'deleted', count(*) from s where m = 3 union all select 2, 'updated', count(*) from s where v = 0 union all select 2, 'unchanged', count(*) from s where v <> 0 and m not in (3, 7)
union all select unnest([1, 1, 1]), unnest(['deleted', 'updated', 'unchanged']), 0""")
def index_update_status(spark, d):
    runs = _indexed(spark, d)[1]
    return spark.createDataFrame([(i, s, n) for i, run in enumerate(runs, 1) for s, n in run.items()], "run int, status string, files long")


#: Contracts as a view over parts.
_CONTRACTS = "select p_partkey as id, p_name as contract_name, case when p_partkey % 3 = 0 then 'Event' else 'callback_event' end as contract_kind, case when p_size % 5 = 0 then '' else p_brand end as owner_module, concat(' ', upper(p_name)) as used_object_name, case when p_size % 4 = 0 then ' ' else p_brand end as used_module_sys_name"


@query(f"""with c as ({_CONTRACTS} from part), e as (select id, lower(contract_name) as n, lower(owner_module) as m from c where contract_kind = 'Event'), cb as (select id, lower(trim(used_object_name)) as n, lower(trim(used_module_sys_name)) as m from c where contract_kind <> 'Event'),
a as (select n, m, max(id) as id from e where m <> '' group by n, m), b as (select n, max(id) as id from e group by n)
select 'subscribes_to_event' as relation_type, cb.id as source_id, coalesce(a.id, b.id) as target_id from cb left join a using (n, m) left join b using (n) where coalesce(a.id, b.id) is not null
union all select 'located_in', s_suppkey, s_nationkey::bigint from supplier""")
def event_subscriptions(spark, d):
    """Subscriptions rebuilt in a stored edge table, over ones that hold no more; other kinds stay."""
    path = shared.fresh(spark, "edges")
    s = T.read(spark, d, "supplier")
    edge = lambda kind: s.select(F.lit("supplier").alias("source_type"), F.col("s_suppkey").alias("source_id"), F.lit("nation").alias("target_type"), F.col("s_nationkey").cast("long").alias("target_id"), F.lit("x").alias("confidence"), F.lit(0).alias("line_number"), F.lit(kind).alias("relation_type"))
    edge_table.save(edge("located_in").union(edge(edge_table.SUBSCRIBES)), path)
    edge_table.rebuild_subscriptions(spark.sql(f"{_CONTRACTS} from {{part}}", part=T.read(spark, d, "part")), path)
    return edge_table.load(spark, path).select("relation_type", "source_id", "target_id")


@query("select 'g' || o_orderkey as id, 'c' || o_custkey as white_player, o_orderpriority as black_player, case when o_orderkey % 4 = 0 then '1-0' else o_orderstatus end as result, o_orderkey % 4 = 0 as processed from orders where o_orderkey % 7 <> 0")
def game_changes(spark, d):
    """Orders as games: saved, a quarter changed, a seventh removed, by three tables of changes."""
    kept = games.open_games(spark, shared.fresh(spark, "games"), 16)
    o = T.read(spark, d, "orders").withColumn("id", F.concat(F.lit("g"), "o_orderkey"))
    games.save(kept, o.select("id", F.concat(F.lit("c"), "o_custkey").alias("white_player"), F.col("o_orderpriority").alias("black_player"), F.col("o_orderstatus").alias("result")), "id")
    games.change(kept, o.where("o_orderkey % 4 = 0").select("id", F.lit("1-0").alias("result"), F.lit(True).alias("processed")))
    games.delete(kept, o.where("o_orderkey % 7 = 0"))
    return kept.read("games").select("id", "white_player", "black_player", "result", "processed")


#: A games base as views over events, users and parts.
_BASE = {
    "positions": "select event_id as position_hash from {events}",
    "moves": "select event_id as id, value as rating, cast(user_id % 5 as int) as games_count, case when user_id % 11 = 0 then '' when user_id % 13 <> 0 then concat('B', cast(user_id % 40 as string)) end as eco_code from {events}",
    "games": "select cast(o_orderkey as string) as id from {orders}",
    "eco_codes": "select concat('B', cast(p_partkey as string)) as code, p_name as name from {part}",
}


def _base(spark, d) -> dict[str, DataFrame]:
    return {n: spark.sql(q, **{t: T.read(spark, d, t) for t in ("events", "orders", "part") if f"{{{t}}}" in q}) for n, q in _BASE.items()}


_BASE_SQL = ", ".join(f"{n} as ({q.replace('{', '').replace('}', '')})" for n, q in _BASE.items())


@query(f"with {_BASE_SQL} select (select count(*) from positions) as positions_count, (select count(*) from moves) as moves_count, (select count(*) from games) as games_count, (select count(distinct eco_code) from moves where eco_code <> '') as eco_codes_count")
def game_stats(spark, d):
    return games.stats(_base(spark, d))


@query(f"with {_BASE_SQL} select code, name, count(m.id) as total_games, round(coalesce(avg(m.rating), 0), 6) as avg_rating, coalesce(sum(m.games_count), 0)::bigint as total_positions from eco_codes e left join moves m on m.eco_code = e.code group by code, name")
def eco_stats(spark, d):
    return games.eco_stats(_base(spark, d)).withColumn("avg_rating", F.round("avg_rating", 6))


@query("""select event_type || ':' || user_id as name, count(*) as games_count, count(*) filter (value >= 66) as wins, count(*) filter (value >= 33 and value < 66) as draws, count(*) filter (value < 33) as losses, round(avg(value), 6) as rating,
arg_min(event_type, (ts, event_id)) as annotation, strftime(min(ts), '%Y-%m-%d') as code from events group by event_type, user_id""")
def stream_counters(spark, d):
    """Events taken as a stream of files into stored counters."""
    kept = store.Store(spark, shared.fresh(spark, "counters"), counters.TABLES, 16)
    schema = T.read(spark, d, "events").schema
    files, at = shared.hadoop(spark, f"{d.rstrip('/')}/events.parquet")
    folder, glob = (at.toString(), "*.parquet") if files.getFileStatus(at).isDirectory() else (d, "events.parquet")
    counters.follow(spark, folder, schema, kept, shared.fresh(spark, "stream"), F.concat_ws(":", "event_type", "user_id"), glob=glob).awaitTermination()
    return kept.read("counters").select("name", *counters.ADDED, F.round("rating", 6).alias("rating"), "annotation", "code")


# --- ratings and continuations -------------------------------------------------------------------

_RATED = f"""{M}, tot as (select *, sum(games_count) over (partition by parent)::bigint as total from moves_v),
rated as (select *, round(least(3.0, greatest(0.1, 1.0 + case when wins+draws+losses > 0 then case when (wins + draws/2.0)/(wins+draws+losses) > 0.5 then 0.8*((wins + draws/2.0)/(wins+draws+losses) - 0.5) else -0.6*(0.5 - (wins + draws/2.0)/(wins+draws+losses)) end else 0.0 end
 + case when total > 0 and games_count::double/total > 0.1 then 0.5*(games_count::double/total - 0.1) when total > 0 and games_count::double/total < 0.01 then -0.1 else 0.0 end)) * 100) / 100 as rating from tot)"""


@query(f"with {_RATED} select parent, child, games_count, wins, draws, losses, total, rating::double as rating from rated")
def move_rating(spark, d):
    return ratings.rated(T.moves(spark, d))


@query(f"""with {_RATED} select parent, child, case when abs(rating - 1.0) > 0.01 then rating else 1.0 end::double as rating, case when games_count < 3 then 0.3 when games_count < 5 then 0.6 when games_count < 10 then 0.8 else 1.0 end::double as confidence,
round(wins::double/games_count * 100)/100 as win_rate, round(draws::double/games_count * 100)/100 as draw_rate, round(losses::double/games_count * 100)/100 as loss_rate from rated""")
def rating_update(spark, d):
    r = ratings.rated(T.moves(spark, d))
    rate = lambda c: ratings.round2(F.col(c) / F.col("games_count")).alias(c.rstrip("s").replace("losse", "loss") + "_rate")
    return r.select("parent", "child", F.when(F.abs(F.col("rating") - 1.0) > 0.01, F.col("rating")).otherwise(1.0).alias("rating"), ratings.confidence(F.col("games_count")).alias("confidence"), rate("wins"), rate("draws"), rate("losses"))


@query("select event_id, user_id, (count(*) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)) as before from events")
def running_total_before(spark, d):
    return running.before(T.read(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "before")


def _best_sql(depth: int) -> str:
    ctes = ["l1 as (select parent, child, rating as value, rating, games_count, child as line from rated)"]
    for k in range(2, depth + 1):
        ctes.append(f"b{k} as (select parent, value as below, line as rest from l{k-1} qualify row_number() over (partition by parent order by value desc, rating desc, games_count desc, child desc) = 1)")
        ctes.append(f"l{k} as (select r.parent, r.child, round((r.rating + coalesce(b.below, 0.0)) * 100) / 100 as value, r.rating, r.games_count, r.child || coalesce(' ' || b.rest, '') as line from rated r left join b{k} b on b.parent = r.child)")
    return f"with {_RATED}, {', '.join(ctes)} select parent, child, value::double as value, line from l{depth}"


@query(_best_sql(3))
def best_continuation_d3(spark, d):
    return ratings.best_continuation(ratings.rated(T.moves(spark, d)), 3).select("parent", "child", "value", F.array_join("line", " ").alias("line"))


#: States of users' event streams: kind, side to move, kind before, value band, and an hour that similar states may differ in.
_STATES = """s as (select *, row_number() over (partition by user_id order by ts, event_id) as n from events),
st as (select user_id, n, value, event_type || ' ' || case when n % 2 = 1 then 'white' else 'black' end || ' ' || coalesce(lag(event_type) over (partition by user_id order by n), '-') || ' ' || cast(least(2, cast(floor(value / 34) as integer)) as varchar) || ' ' || cast(hour(ts) as varchar) as state, case when n % 2 = 1 then 'white' else 'black' end as color from s),
steps as (select state as parent, color, lead(state) over (partition by user_id order by n) as child, value from st),
moves_v as (select parent, color, child, count(*) games_count, count(*) filter (value >= 66) wins, count(*) filter (value >= 33 and value < 66) draws, count(*) filter (value < 33) losses from steps where child is not null group by parent, color, child)"""


def _search_sql(count: int, depth: int) -> str:
    order = "rating desc, games_count desc, origin, child"
    ctes = [
        "own as materialized (select parent as state, color, parent as origin, child, rating, games_count, array_to_string(string_split(parent, ' ')[1:4], ' ') as key from rated)",
        f"few as (select state, key, color from own group by all having count(*) < {count})",
        f"pairs as (select f.state, f.color, o.origin, o.child, o.rating, o.games_count from few f join own o on o.key = f.key and o.color = f.color and o.origin <> f.state qualify row_number() over (partition by f.state, f.color order by o.rating desc, o.games_count desc, o.origin, o.child) <= {3 * count})",
        "cand as materialized (select state, color, origin, child, rating, games_count from own union all select * from pairs)",
        "l1 as (select *, rating as value, child as line from cand)",
    ]
    for k in range(2, depth + 1):
        ctes.append(f"b{k} as (select state, color, value as below, line as rest from l{k - 1} qualify row_number() over (partition by state, color order by value desc, {order.replace('origin, child', 'child, origin')}) = 1)")
        ctes.append(f"l{k} as materialized (select c.*, round((c.rating + coalesce(b.below, 0.0)) * 100) / 100 as value, c.child || coalesce(' > ' || b.rest, '') as line from cand c left join b{k} b on b.state = c.child and b.color <> c.color)")
    return f"with {_STATES}, {_RATED[_RATED.index('tot as'):]}, {', '.join(ctes)} select state, color, origin, child, games_count, value::double as value, line from l{depth}"


def _state_moves(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("n")
    e = T.read(spark, d, "events").select("user_id", "ts", "value", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))
    color = F.when(F.col("n") % 2 == 1, "white").otherwise("black")
    state = F.concat_ws(" ", "event_type", color, F.coalesce(F.lag("event_type").over(w), F.lit("-")), F.least(F.lit(2), F.floor(F.col("value") / 34).cast("int")), F.hour("ts"))
    steps = e.select("user_id", "n", "value", color.alias("color"), state.alias("parent")).withColumn("child", F.lead("parent").over(w)).where("child is not null")
    v = F.col("value")
    moves = steps.groupBy("parent", "color", "child").agg(F.count(F.lit(1)).alias("games_count"), F.count_if(v >= 66).alias("wins"), F.count_if((v >= 33) & (v < 66)).alias("draws"), F.count_if(v < 33).alias("losses"))
    return ratings.rated(moves).withColumnRenamed("parent", "state")


@query(_search_sql(3, 3))
def continuation_search(spark, d):
    """Lines of three moves from every state, at least three moves wanted of each."""
    found = continuations.search(_state_moves(spark, d), 3, 3)
    return found.select("state", "color", F.col("from").alias("origin"), "child", "games_count", "value", F.array_join("line", " > ").alias("line"))


@query(f"with {_STATES}, {_RATED[_RATED.index('tot as'):]}, own as (select parent as state, color, parent as origin, child, rating, games_count, array_to_string(string_split(parent, ' ')[1:4], ' ') as key from rated), few as (select state, key, color from own group by all having count(*) < 2) select f.state, o.origin as similar_state, o.child, o.games_count from few f join own o on o.key = f.key and o.color = f.color and o.origin <> f.state qualify row_number() over (partition by f.state order by o.rating desc, o.games_count desc, o.origin, o.child) <= 6")
def similar_position_moves(spark, d):
    """The moves that states with fewer than two take from states alike."""
    found = continuations.candidates(_state_moves(spark, d), 2).where(F.col("state") != F.col("from"))
    return found.select("state", F.col("from").alias("similar_state"), "child", "games_count")


#: Lines are users' events by week, the book those of every tenth user; prefixes as text, whole.
_LINES = "select user_id * 1000 + week(ts) as id, user_id, list(event_type order by ts, event_id) as moves from events group by user_id, week(ts)"


@query(f"""with seqs as ({_LINES}), book as (select lpad(cast(id as varchar), 12, '0') as code, moves from seqs where user_id % 10 = 0),
bp as (select code, k, array_to_string(moves[1:k], ' ') as prefix from (select code, moves, unnest(range(1, len(moves) + 1)) as k from book)), known as (select prefix, count(*) as n, min(code) as code from bp group by prefix),
sp as (select id, k, array_to_string(moves[1:k], ' ') as prefix from (select id, moves, unnest(range(1, len(moves) + 1)) as k from seqs)), j as (select id, k, n, code from sp left join known using (prefix)),
stop as (select id, min(k) filter (n is null) as stop from j group by id), fit as (select j.* from j join stop using (id) where stop.stop is null or j.k < stop.stop),
best as (select id, arg_min(code, k) filter (n = 1) as one, arg_max(code, k) filter (n > 1) as many from fit group by id)
select s.id, coalesce(b.one, b.many, 'A00') as code from seqs s left join best b using (id)""")
def eco_longest_unique_prefix(spark, d):
    e = T.read(spark, d, "events")
    seq = e.groupBy("user_id", F.weekofyear("ts").alias("week")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    seq = seq.select((F.col("user_id") * 1000 + F.col("week")).alias("id"), "user_id", F.transform("e", lambda x: x["event_type"]).alias("moves"))
    book = seq.where("user_id % 10 = 0").select(F.lpad(F.col("id").cast("string"), 12, "0").alias("code"), "moves")
    return prefixes.longest_unique_prefix(seq.select("id", "moves"), book)


@query("""with seqs as (select user_id as id, list(event_type order by ts, event_id) as moves from events group by user_id), book as (select lpad(cast(id as varchar), 8, '0') as code, moves from seqs where id % 10 = 0),
bp as (select code, k, md5(array_to_string(moves[1:k], ' ')) as prefix from (select code, moves, unnest(range(1, len(moves) + 1)) as k from book)) select k, count(*) as nodes, max(n) as most, min(code) as first_code from (select k, prefix, count(*) as n, min(code) as code from bp group by k, prefix) group by k""")
def prefix_tree_levels(spark, d):
    """The tree of every tenth user's whole sequence: nodes of each level, the entries of its largest, its lowest code."""
    e = T.read(spark, d, "events").where("user_id % 10 = 0")
    seq = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    nodes = prefixes.tree(seq.select(F.lpad(F.col("user_id").cast("string"), 8, "0").alias("code"), F.transform("e", lambda x: x["event_type"]).alias("moves")))
    return nodes.groupBy("k").agg(F.count(F.lit(1)).alias("nodes"), F.max("n").alias("most"), F.min("code").alias("first_code"))


# --- text, dictionaries, order, coding -------------------------------------------------------------


@query("select doc_id, md5(text) as md5, sha256(trim(text)) as sha, strlen(text) as bytes, length(text) as chars from documents")
def text_hash(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2(F.trim("text"), 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"), F.char_length("text").cast("long").alias("chars"))


@query("select event_type, cast(list_reduce(list_prepend(0::hugeint, list_transform(string_split(event_type, ''), lambda c: ascii(c)::hugeint)), lambda h, c: (h * 31 + c) % 18446744073709551616::hugeint) as varchar) as hash from (select distinct event_type from events)")
def move_poly_hash(spark, d):
    return T.read(spark, d, "events").select("event_type").distinct().select("event_type", hashes.polynomial("event_type").cast("string").alias("hash"))


@query("select word, bytes from (select distinct word, strlen(word)::integer as bytes from (select unnest(regexp_extract_all(text, '\\p{L}+')) as word from documents)) order by bytes desc, word limit 10")
def longest_words(spark, d):
    return text.longest_words(T.read(spark, d, "documents"), "text", 10)


PATTERNS = ["the", "tion", "éc", "anan", "is it"]
_PATTERN_LIST = ", ".join(f"('{p}')" for p in PATTERNS)


#: Occurrences, overlapping ones too, by pieces of 100 characters that reach into the next piece.
_HITS = f"""with p(pattern) as (values {_PATTERN_LIST}), pieces as (select doc_id, text, unnest(range(0, length(text), 100)) as k from documents),
cut as (select doc_id, pattern, strlen(substr(text, 1, k)) as base, substr(text, k + 1, 99 + length(pattern)) as c from pieces, p),
hits as (select doc_id, pattern, base, c, unnest(list_filter(range(1, 101), lambda i: substr(c, i, length(pattern)) = pattern)) as i from cut where contains(c, pattern))"""


@query(f"{_HITS} select doc_id, pattern, count(*) as n, min(base + strlen(substr(c, 1, i - 1)))::bigint as first_offset, sum(base + strlen(substr(c, 1, i - 1)))::bigint as offset_sum from hits group by doc_id, pattern")
def substring_offsets(spark, d):
    found = text.offsets(T.read(spark, d, "documents"), PATTERNS, ["doc_id"])
    add = F.aggregate("offsets", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.groupBy("doc_id", "pattern").agg(F.sum(F.size("offsets")).alias("n"), F.min(F.array_min("offsets")).alias("first_offset"), F.sum(add).alias("offset_sum"))


@query(SQL["substring_offsets"])
def kmp_offsets(spark, d):
    """The same places pattern by pattern."""
    docs = T.read(spark, d, "documents")
    add = F.aggregate("offsets", F.lit(0).cast("long"), lambda a, x: a + x)
    found = reduce(DataFrame.union, [text.offsets(docs, [p], ["doc_id"]) for p in PATTERNS])
    return found.groupBy("doc_id", "pattern").agg(F.sum(F.size("offsets")).alias("n"), F.min(F.array_min("offsets")).alias("first_offset"), F.sum(add).alias("offset_sum"))


@query(f"with p(pattern) as (values {_PATTERN_LIST}), pieces as (select doc_id, text, unnest(range(0, length(text), 100)) as k from documents), cut as (select doc_id, pattern, k, substr(text, k + 1, 99 + length(pattern)) as c from pieces, p), hits as (select doc_id, pattern, k, unnest(list_filter(range(1, 101), lambda i: substr(c, i, length(pattern)) = pattern)) as i from cut where contains(c, pattern)) select doc_id, pattern, count(*) as n, min(k + i - 1)::bigint as first_place, sum(k + i - 1)::bigint as place_sum from hits group by doc_id, pattern")
def dfa_offsets(spark, d):
    """All patterns in one pass, by their anchors; places in characters."""
    found = anchors.hits(T.read(spark, d, "documents"), spark.createDataFrame([(p,) for p in PATTERNS], "p string"), "doc_id", "p")
    return found.groupBy(F.col("id").alias("doc_id"), "pattern").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_place"), F.sum("at").alias("place_sum"))


@query("""with p as (select distinct w as pattern, length(w) as m from (select unnest(regexp_split_to_array(lower(text), '\\s+')) as w from benchmark) where w <> ''), lens as materialized (select distinct m from p), t as (select lower(text) as t from documents),
pieces as (select t, unnest(range(0, length(t), 100)) as k from t), c as (select substr(t, k + 1, 100 + (select max(m) from p)) as c, least(100, length(t) - k) as n from pieces),
subs as (select m, unnest(list_transform(range(1, n + 1), lambda i: substr(c, i, m))) as s from c, lens), found as (select pattern, count(*) as n from subs join p on s = pattern and subs.m = p.m group by pattern) select pattern, coalesce(n, 0)::bigint as n from p left join found using (pattern)""")
def benchmark_word_counts(spark, d):
    """How often documents have each word of the benchmark, overlapping places and places inside other words too."""
    words = T.read(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("pattern")).where("pattern != ''").distinct()
    found = anchors.counts(T.read(spark, d, "documents").select(F.lower("text").alias("text")), words, "pattern")
    return words.join(found, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


@query("select doc_id, lang, source from documents where text ilike '%licensed_under%'")
def fragment_search_indexed(spark, d):
    """The substring search by the index, its documents added in two batches."""
    docs = T.read(spark, d, "documents")
    kept = trigrams.open_index(spark, shared.fresh(spark, "trigrams"), buckets=16)
    for part in (0, 1):
        trigrams.add(kept, docs.where(F.col("doc_id") % 2 == part))
    return docs.select("doc_id", "lang", "source").join(trigrams.search(kept, "Licensed_under").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


@query("select 'events' as source, event_id::varchar as item, case when event_type = 'error' then 'event of kind error at ' || user_id else 'value over 99: ' || event_type end as message from events where event_type = 'error' or value > 99")
def error_table(spark, d):
    """Events that fail a check, from the one pass that also writes the good ones."""
    e = T.read(spark, d, "events")
    bad = F.when(F.from_json("props", "k bigint")["k"].isNull(), "props without k").when(F.col("event_type") == "error", F.concat(F.lit("event of kind error at "), "user_id")).when(F.col("value") > 99, F.concat(F.lit("value over 99: "), "event_type"))
    path = shared.fresh(spark, "checked-events")
    side_table.split(e, path, bad, F.lit("events"), F.col("event_id"))
    return side_table.errors(spark, path, e.schema)


@query(f"{_HITS} select pattern, count(i)::bigint as n from p left join hits using (pattern) group by pattern")
def multi_pattern_counts(spark, d):
    sums = T.read(spark, d, "documents").agg(*[F.coalesce(F.sum(text.occurrences("text", p)), F.lit(0)).alias(f"p{i}") for i, p in enumerate(PATTERNS)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"p{i}").alias("n")) for i, p in enumerate(PATTERNS)])).alias("x")).select("x.*")


@query("select p_name, max(p_partkey) as last_key, arg_max(p_brand, p_partkey) as p_brand from part group by p_name")
def dict_last_wins(spark, d):
    p = T.read(spark, d, "part").withColumn("last_key", F.col("p_partkey"))
    return dictionary.build(p, "p_name", "p_partkey", ["last_key", "p_brand"])


@query("with d as (select p_name, arg_min(p_brand, p_partkey) as p_brand from part group by p_name), probes as (select distinct p_type as p_name from part union select distinct p_name from part) select p_name, p_brand from probes left join d using (p_name)")
def dict_first_wins(spark, d):
    p = T.read(spark, d, "part")
    probes = p.select(F.col("p_type").alias("p_name")).union(p.select("p_name")).distinct()
    return dictionary.find(probes, dictionary.build(p, "p_name", "p_partkey", ["p_brand"], "first"), "p_name")


@query("select cast(floor((p_size - 1) * 10.0 / 50) as integer) as bucket, count(*) as n, min(p_size) as low, max(p_size) as high from part group by 1")
def bucket_map(spark, d):
    return T.read(spark, d, "part").withColumn("bucket", dictionary.bucket_of("p_size", 1, 50, 10)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))


@query("select p_name, max(p_partkey) as last_key from part where p_name like 's%' group by p_name")
def trie_prefix(spark, d):
    p = T.read(spark, d, "part").withColumn("last_key", F.col("p_partkey"))
    return dictionary.with_prefix(dictionary.build(p, "p_name", "p_partkey", ["last_key"]), "p_name", "s")


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) as place from orders")
def sort_total(spark, d):
    return sorting.placed(T.read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("select o_orderkey, " + ", ".join(f"(o_orderkey // {256**i} % 256)::integer as d{i}" for i in range(7)) + " from orders")
def sort_radix_digits(spark, d):
    """Order by the digits of the whole key, the most significant first."""
    return T.read(spark, d, "orders").select("o_orderkey", *sorting.digits("o_orderkey", 7, 256)).orderBy(*[f"d{i}" for i in reversed(range(7))])


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem")
def sort_range_partitioned(spark, d):
    return sorting.ranged(T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 8, "l_extendedprice", "l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber, l_extendedprice, l_partkey from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 10")
def top_k(spark, d):
    return T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(10)


_HIST = "with h as (select unnest(regexp_extract_all(hex(encode(text)), '..')) as h from documents) select ('0x' || h)::integer as byte, count(*) as n from h group by h"


@query(_HIST)
def byte_histogram(spark, d):
    return huffman.histogram(T.read(spark, d, "documents"), F.col("text").cast("binary"))


@query(f"with f as ({_HIST}), t as (select max(n) as top from f) select byte, n, case when top > 255 then greatest(1, n * 255 // top) else n end::bigint as weight from f, t")
def freq_scaled(spark, d):
    return huffman.scaled(byte_histogram(spark, d))


@query()
def huffman_codes(spark, d):
    hist = freq_scaled(spark, d)

    def run(frames):
        import pandas as pd

        rows = pd.concat(list(frames), ignore_index=True)  # at most 256 rows
        code = huffman.codes(dict(sorted(zip(rows["byte"], rows["weight"])))) if len(rows) else {}
        yield pd.DataFrame({"byte": list(code), "code": list(code.values())})

    return hist.select("byte", "weight").coalesce(1).mapInPandas(run, "byte int, code string")


@query("select page_id, strlen(html)::bigint as bytes, true as restored from pages")
def huffman_roundtrip(spark, d):
    p = T.read(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("b"))
    a = huffman.archives(p, "page_id", F.col("b"))
    return a.join(p.select(F.col("page_id").alias("id"), F.octet_length("b").cast("long").alias("bytes")), "id").select(F.col("id").alias("page_id"), "bytes", "restored")


@query("select p_partkey, case when p_size % 3 = 0 then '[Log' || p_partkey || ']' when p_size % 3 = 1 then '[Log' || p_partkey || ', Pay' || p_size || ']' else '[]' end as targets from part")
def exec_targets(spark, d):
    """Procedures that SQL text calls, the text made from parts: one or two calls (another database, a result, a comment), or none."""
    n, m = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    one = F.concat(F.lit("select 1\nexec Log"), n, F.lit(" @A = 1 -- exec Old\n"))
    sql = F.when(F.col("p_size") % 3 == 0, one).when(F.col("p_size") % 3 == 1, F.concat(one, F.lit("execute @r = dbo.Pay"), m, F.lit(" 2"))).otherwise(F.lit("update tDeal set execution = 1"))
    found = sqltext.scripts(T.read(spark, d, "part").select("p_partkey", sql.alias("text"))).where("kind = 'call'").groupBy("p_partkey").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return T.read(spark, d, "part").select("p_partkey").join(found, "p_partkey", "left").select("p_partkey", F.concat(F.lit("["), F.coalesce(F.array_join("names", ", "), F.lit("")), F.lit("]")).alias("targets"))


# --- extractors, over our own small files --------------------------------------------------------


def _sql_files(spark) -> DataFrame:
    return spark.createDataFrame([("deals.sql", samples.SQL), ("log.sql", samples.CALLED)], "path string, text string")


@query()
def sql_extract(spark, d):
    return sqltext.scripts(_sql_files(spark))


@query()
def select_into_types(spark, d):
    found = sqltext.scripts(_sql_files(spark)).where("kind = 'column_definition'")
    return sqltext.typed(found.where("context = 'select_into'"), found.where("context != 'select_into'"), F.desc("path"), F.desc("line_start"))


@query()
def sql_edges(spark, d):
    return sqltext.procedure_edges(sqltext.scripts(_sql_files(spark)), "path", F.desc("path"))


@query()
def pas_extract(spark, d):
    return units.units(spark.createDataFrame([("deals.pas", samples.UNIT)], "path string, text string"))


@query()
def pas_edges(spark, d):
    pieces = pas_extract(spark, d).where("kind = 'fragment'").select("path", F.col("value").alias("text"), "line_start")
    procedures = sqltext.scripts(_sql_files(spark)).where("kind = 'procedure'").select("path", "name")
    return edges.fragment_edges(pieces, procedures, F.desc("path"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

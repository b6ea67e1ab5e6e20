"""The named queries registered on the driver's tables, each with its SQL.

``VIEWS`` reads the plain tables as a catalog: the same text runs in Spark and in
the comparing engine.  Every file id is that of a supplier, so sizes grow with
the scale.  Nested results are written out flat, as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linking, named
from ..sources import tables as T
from ..sources.catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LINES = "(select l_orderkey * 10 + l_linenumber as id, min(l_suppkey) as s, min(l_partkey) as p, max(l_linenumber) as n, min(l_returnflag) as f from {lineitem} group by l_orderkey, l_linenumber) x"
_T = "'t' || cast({0} as string)"

#: A catalog over the plain tables; {name} stands for a table.
VIEWS = {
    "scan_runs": "select cast(r_regionkey as bigint) as id, '/src' as root_path, case when r_regionkey = 4 then 'running' else 'completed' end as status, r_regionkey * 2 as errors_count from {region}",
    "files": "select s_suppkey as id, '/src/' || s_name || '.sql' as path, s_name || '.sql' as rel_path, case when s_suppkey % 3 = 0 then 'SQL' when s_suppkey % 3 = 1 then 'pas' else 'h' end as extension from {supplier}",
    "symbols": "select p_partkey as id, p_partkey % 10 as file_id, p_name as symbol_name, case when p_size % 2 = 0 then 'method' else 'table' end as symbol_type, case when p_size % 2 = 0 then 'pas_method' else 'query_fragment' end as entity_type, p_partkey as entity_id, p_size as line_number, p_brand as signature from {part}",
    "sql_procedures": "select c_custkey as id, c_custkey % 10 as file_id, c_name as proc_name, c_nationkey as line_start, c_nationkey + 9 as line_end from {customer}",
    "sql_tables": f"select id, s as file_id, {_T.format('p % 50')} as table_name, f as context, n as line_number from {_LINES}",
    "sql_columns": f"select p_partkey as id, p_partkey % 10 as file_id, {_T.format('p_partkey % 50')} as table_name, p_name as column_name from {{part}}",
    "sql_column_definitions": f"select p_partkey as id, p_partkey % 10 as file_id, {_T.format('p_partkey % 50')} as table_name, p_name as column_name, p_type as data_type, p_brand as definition_kind, p_size as line_number, p_size % 7 as column_order from {{part}}",
    "sql_index_definitions": f"select s_suppkey as id, s_suppkey as file_id, {_T.format('s_nationkey')} as table_name, 'Ix' || s_name as index_name, cast(null as string) as index_fields, 'plain' as index_type, s_nationkey % 2 = 0 as is_unique, 'create' as definition_kind, s_nationkey as line_number from {{supplier}}",
    "sql_index_definition_fields": "select p_partkey as id, p_partkey % 20 as table_index_id, p_brand as field_name, p_size as field_order, p_size + 1 as line_number from {part}",
    "relations": (
        "select id, 'sql_procedure' as source_type, p % 100 as source_id, 'sql_table' as target_type, id as target_id, case when n = 1 then 'selects_from' when n = 2 then 'updates' when n = 3 then 'inserts_into' else 'references_table' end as relation_type, 'regex' as confidence, n as line_number from " + _LINES
        + " union all select 1000000000000 + o_orderkey, 'sql_procedure', o_custkey, 'sql_procedure', o_orderkey % 40, case when o_orderstatus = 'O' then 'calls_procedure' when o_orderstatus = 'F' then 'dispatches_to_subscriber' else 'dispatches_to' end, 'regex', 1 from {orders}"
        + " union all select 2000000000000 + c_custkey, 'sql_procedure', c_custkey, 'api_contract', cast(c_nationkey as bigint), case when c_custkey % 3 = 0 then 'implements_contract' when c_custkey % 3 = 1 then 'publishes_event' else 'executes_contract' end, 'xml', 2 from {customer}"
        + " union all select 3000000000000 + n_nationkey, 'api_contract', cast(n_nationkey as bigint), 'api_contract', cast(n_regionkey as bigint), 'subscribes_to_event', 'xml', 3 from {nation}"
        + " union all select 4000000000000 + p_partkey, 'pas_method', p_partkey, 'query_fragment', p_partkey, case when p_partkey % 2 = 0 then 'executes_query' else 'builds_query' end, 'regex', p_size from {part}"
        + " union all select 5000000000000 + id, 'query_fragment', p, 'sql_table', id, 'references_table', 'regex', n from " + _LINES + " where n = 1"
        + " union all select 6000000000000 + p_partkey, 'query_fragment', p_partkey, 'sql_procedure', p_partkey % 40, 'calls_procedure', 'regex', p_size from {part}"
    ),
    "pas_units": "select s_suppkey as id, s_suppkey as file_id, s_name as unit_name from {supplier}",
    "pas_classes": "select cast(n_nationkey as bigint) as id, cast(n_regionkey as bigint) as unit_id, 'T' || n_name as class_name from {nation}",
    "pas_methods": "select p_partkey as id, p_partkey % 30 as class_id, p_partkey % 10 as unit_id, p_name as method_name, p_size as line_number from {part}",
    "pas_fields": "select c_custkey as id, c_name as field_name, c_mktsegment as field_type, c_custkey as dfm_component_id from {customer} where c_custkey % 2 = 0",
    "query_fragments": "select p_partkey as id, p_partkey % 10 as file_id, 'pas_method' as parent_type, p_partkey as parent_id, case when p_size % 3 = 0 then '' else p_brand end as component_name, case when p_size % 2 = 0 then '' else p_type end as component_type, 'select * from ' || p_name as query_text, p_type as context, p_size as line_number from {part}",
    "dfm_forms": "select cast(n_nationkey as bigint) as id, cast(n_nationkey % 10 as bigint) as file_id, n_name as form_name, 'T' || n_name as form_class, cast(null as string) as caption, n_regionkey as line_start, n_regionkey + 5 as line_end from {nation}",
    "dfm_components": "select c_custkey as id, c_custkey % 10 as file_id, cast(c_nationkey as bigint) as form_id, c_name as component_name, c_mktsegment as component_type, cast(null as string) as parent_name, c_mktsegment as caption, c_nationkey as line_start, c_nationkey + 1 as line_end from {customer}",
    "report_forms": "select cast(n_nationkey as bigint) as id, cast(n_nationkey % 10 as bigint) as file_id, 'rep_' || n_name as report_name, 'tpr' as report_type, n_name as form_name, cast(null as string) as form_class, n_regionkey as line_start, n_regionkey + 7 as line_end from {nation}",
    "report_fields": "select p_partkey as id, p_partkey % 25 as report_form_id, p_name as field_name, p_type as source_name, cast(null as string) as format_mask, p_size as line_number, p_brand as raw_text from {part}",
    "report_params": "select c_custkey as id, cast(c_nationkey as bigint) as report_form_id, c_name as param_name, 'param' as param_kind, c_mktsegment as lookup_table, cast(null as boolean) as required, c_nationkey as line_number, c_name as raw_text from {customer}",
    "vb_functions": "select s_suppkey as id, cast(s_nationkey as bigint) as report_form_id, 'fn_' || s_name as function_name, 'sub' as function_type, s_nationkey as line_start, s_nationkey + 2 as line_end from {supplier}",
    "js_functions": "select s_suppkey as id, s_suppkey as file_id, 'on' || s_name as function_name, cast(null as string) as signature, s_nationkey as line_start, s_nationkey + 3 as line_end, 'deal' as scenario_type from {supplier}",
    "smf_instruments": "select s_suppkey as id, s_suppkey as file_id, s_name as instrument_name, 'b' || cast(s_nationkey as string) as brief, cast(s_nationkey as bigint) as deal_object_id, case when s_nationkey % 2 = 0 then 'mass' else 'single' end as scenario_type from {supplier}",
    "api_contracts": "select cast(n_nationkey as bigint) as id, cast(n_nationkey % 10 as bigint) as file_id, 'bo' || cast(n_regionkey as string) as business_object, n_name as contract_name, case when n_nationkey < 5 then 'event' else 'callback_event' end as contract_kind, n_nationkey as line_start from {nation}",
    "api_contract_params": "select c_custkey as id, cast(c_nationkey as bigint) as contract_id, case when c_custkey % 2 = 0 then 'in' else 'out' end as direction, c_mktsegment as param_name, cast(null as string) as type_name, c_custkey % 5 = 0 as required, cast(c_custkey % 9 as int) as param_order, c_nationkey as line_number from {customer}",
    "api_contract_tables": "select s_suppkey as id, cast(s_nationkey as bigint) as contract_id, 'in' as direction, 'pT' || cast(s_nationkey as string) as table_name, cast(s_suppkey % 3 as int) as param_order, s_nationkey as line_number from {supplier}",
    "api_contract_table_fields": "select p_partkey as id, p_partkey % 10 as contract_table_id, p_name as field_name, p_type as type_name, p_size % 2 = 0 as required, p_size as param_order, p_size as line_number from {part}",
    "api_business_object_tables": "select cast(n_nationkey as bigint) as id, cast(n_nationkey % 10 as bigint) as file_id, 'bo' || cast(n_regionkey as string) as business_object, 'pT' || cast(n_nationkey as string) as table_name, n_nationkey as line_number from {nation}",
    "api_business_object_table_fields": "select p_partkey as id, p_partkey % 25 as business_table_id, p_brand as field_name, p_type as type_name, p_size as param_order, p_size as line_number from {part}",
    "api_business_object_table_indexes": "select s_suppkey as id, cast(s_nationkey as bigint) as business_table_id, 'Ax' || s_name as index_name, 'a,b' as index_fields, s_nationkey % 3 as index_type, s_nationkey % 2 = 0 as is_clustered, s_nationkey as line_number from {supplier}",
    "api_business_object_table_index_fields": "select p_partkey as id, p_partkey % 10 as table_index_id, p_type as field_name, p_size as field_order, p_size as line_number from {part}",
    "games": "select cast(o_orderkey as string) as id, 'c' || cast(o_custkey as string) as white_player, o_orderpriority as black_player, o_orderstatus as result, substring(o_orderpriority, 1, 1) as eco_code, o_orderdate as created_at from {orders}",
    "moves": "select l_partkey as parent_hash, l_suppkey as child_hash, l_linenumber as move_number, cast(count(*) as int) as games_count from {lineitem} group by l_partkey, l_suppkey, l_linenumber",
    "eco_codes": "select 'C' || cast(p_partkey as string) as code, p_type as name, p_name || ' ' || p_type || ' ' || p_brand as moves, substring(p_brand, 1, 1) as family from {part}",
    "processed_files": "select s_name as filename, cast(s_suppkey as int) as games_count, s_nationkey as positions_count, timestamp '2024-01-01 00:00:00' as processed_at from {supplier}",
}


class _Tables(dict):
    def __missing__(self, name: str) -> str:
        return name


def catalog(spark: SparkSession, d: str) -> Catalog:
    plain = {n: T.read(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    made = {}
    for name, text in VIEWS.items():
        table = spark.sql(text, **{n: df for n, df in plain.items() if f"{{{n}}}" in text})
        made[name] = table
    return Catalog(spark, made)


def query(sql: str):
    """Registers a query; its SQL gets the views it names."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(catalog(spark, d))
        used = [n for n in VIEWS if f"v_{n}" in sql or f"v_{n}" in _VERTICES and "vertex" in sql]
        views = [f"v_{n} as ({VIEWS[n].format_map(_Tables())})" for n in used] + [f"vertex as ({_VERTICES})"] * ("vertex" in sql)
        SQL[f.__name__] = f"with {', '.join(views)} {sql}"
        return f

    return register


_VERTICES = " union all ".join(
    [f"select '{k}' as type, t.id, t.{n} as name, f.rel_path as file from v_{t} t left join v_files f on f.id = t.file_id" for k, (t, n, _, via) in named.VERTICES.items() if n and not via]
    + [f"select '{k}', t.id, t.{n}, f.rel_path from v_{t} t left join v_{via[0]} u on u.id = t.{via[1]} left join v_files f on f.id = u.file_id" for k, (t, n, _, via) in named.VERTICES.items() if n and via]
    + ["select 'query_fragment', t.id, coalesce(nullif(trim(component_name), ''), nullif(trim(component_type), ''), 'query_fragment'), f.rel_path from v_query_fragments t left join v_files f on f.id = t.file_id"]
)


def _flat(df: DataFrame, column: str, *fields: str) -> DataFrame:
    """An array (of structs) as text: fields joined by :, elements by ;."""
    one = (lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])) if fields else (lambda x: x.cast("string"))
    return df.withColumn(column, F.array_join(F.transform(column, one), ";"))


def _edge_sql(where: str, limit: int, source: str, target: str) -> str:
    """The limited edges first, then their ends: those of the named types, others as type:id."""
    return f""", picked as materialized (select * from v_relations r where {where} order by id desc limit {limit})
select r.id, r.relation_type, r.line_number, r.source_type || ':' || r.source_id || ':' || coalesce(a.name, r.source_type || ':' || r.source_id) || ':' || coalesce(a.file, '') as source,
r.target_type || ':' || r.target_id || ':' || coalesce(b.name, r.target_type || ':' || r.target_id) || ':' || coalesce(b.file, '') as target
from picked r left join ({source}) a on a.type = r.source_type and a.id = r.source_id left join ({target}) b on b.type = r.target_type and b.id = r.target_id"""


_PROCEDURES = "select 'sql_procedure' as type, t.id, t.proc_name as name, f.rel_path as file from v_sql_procedures t left join v_files f on f.id = t.file_id"
_CALLERS = _PROCEDURES + " union all select 'query_fragment', t.id, coalesce(nullif(trim(component_name), ''), nullif(trim(component_type), ''), 'query_fragment'), f.rel_path from v_query_fragments t left join v_files f on f.id = t.file_id"
_USED = _PROCEDURES + "".join(f" union all select '{k}', t.id, t.{n}, f.rel_path from v_{t} t left join v_files f on f.id = t.file_id" for k, t, n in (("sql_table", "sql_tables", "table_name"), ("api_contract", "api_contracts", "contract_name")))


def _edge_rows(df: DataFrame) -> DataFrame:
    end = lambda s: F.concat_ws(":", f"{s}.type", F.col(f"{s}.id").cast("string"), f"{s}.name", f"{s}.file").alias(s)
    return df.select("id", "relation_type", "line_number", end("source"), end("target"))


@query("select s.id, s.file_id, s.entity_id, symbol_name as name, symbol_type as type, entity_type, rel_path as file, line_number, signature from v_symbols s join v_files f on f.id = s.file_id where symbol_name ilike '%widget%' and symbol_type = 'method' order by symbol_name, s.id limit 100")
def named_symbol(c):
    return named.symbol(c, " widget", "method", like=True)


@query("select s.id, s.file_id, s.entity_id, symbol_name as name, symbol_type as type, entity_type, rel_path as file, line_number, signature from v_symbols s join v_files f on f.id = s.file_id where symbol_name ilike '%#12%' or signature ilike '%#12%' order by symbol_name, s.id limit 100")
def named_content(c):
    return named.content(c, "#12")


@query("select id, path, rel_path, extension from v_files where path = 'Supplier#000000007.sql' or rel_path = 'Supplier#000000007.sql' order by id desc limit 1")
def named_file_by_path(c):
    return named.file_by_path(c, "Supplier#000000007.sql").select("id", "path", "rel_path", "extension")


@query(_edge_sql(f"target_type = 'sql_procedure' and relation_type = 'calls_procedure' and exists (select 1 from ({_CALLERS}) v where v.type = r.source_type and v.id = r.source_id and v.name ilike '%0001%')", 50, _CALLERS, _PROCEDURES))
def named_relations(c):
    return _edge_rows(named.relations(c, source_name="0001", target_type="sql_procedure", relation_type="calls_procedure", limit=50))


@query(_edge_sql("source_type = 'sql_procedure' and source_id = 7", 100, _PROCEDURES, _USED))
def named_relations_of(c):
    return _edge_rows(named.relations_of(c, "sql_procedure", 7))


@query("""select s.id, symbol_name as name, case when lower(symbol_name) = 'cold widget' then 10 else 0 end + case when symbol_type = 'method' then 5 else 0 end as score,
(select count(*) from v_relations r where r.target_type = s.entity_type and r.target_id = s.entity_id and s.entity_id > 0) as incoming, (select count(*) from v_relations r where r.source_type = s.entity_type and r.source_id = s.entity_id and s.entity_id > 0) as outgoing,
(select count(distinct x) from (select r.source_type || r.source_id as x from v_relations r where r.target_type = s.entity_type and r.target_id = s.entity_id and s.entity_id > 0 union all select r.target_type || r.target_id from v_relations r where r.source_type = s.entity_type and r.source_id = s.entity_id and s.entity_id > 0)) as neighbors
from v_symbols s join v_files f on f.id = s.file_id where symbol_name ilike '%cold widget%' order by score desc, symbol_name, s.id limit 20""")
def named_inspect(c):
    found = named.inspect(c, "Cold widget", "method", limit=20)
    return found.select("symbol.id", "symbol.name", "score", *[F.size(x).cast("long").alias(x) for x in ("incoming", "outgoing", "neighbors")])


_FILES_OF = "(select string_agg(file_id || '', ';' order by file_id) from (select distinct file_id from v_sql_tables x where x.table_name = u.table_name and file_id in (select id from v_files) order by file_id limit 20))"


@query(f"""select id, table_name, context, usages, {_FILES_OF} as file_ids, coalesce((select string_agg(column_name, ';' order by column_name) from (select distinct column_name from v_sql_columns x where x.table_name = u.table_name order by column_name limit 50)), '') as columns,
coalesce((select string_agg(proc_name, ';' order by proc_name) from (select distinct proc_name from v_relations r join v_sql_procedures p on p.id = r.source_id join v_sql_tables t on t.id = r.target_id where t.table_name = u.table_name and r.source_type = 'sql_procedure' and r.target_type = 'sql_table' order by proc_name limit 20)), '') as procedures
from (select min(id) as id, table_name, context, count(*) as usages from v_sql_tables where table_name ilike '%t4%' group by table_name, context order by usages desc, table_name, context limit 8) u""")
def named_table(c):
    out = named.table(c, "t4", like=True, limit=8).drop("files")
    return _flat(_flat(_flat(out, "file_ids"), "columns"), "procedures")


@query("select table_name, column_name, data_type, definition_kind, rel_path as file, file_id, line_number, column_order from v_sql_column_definitions d join v_files f on f.id = d.file_id where table_name = 't7' order by table_name, column_order, line_number, d.id limit 40")
def named_table_schema(c):
    return named.table_schema(c, "t7", 40)


@query("""select i.id, table_name, index_name, coalesce(index_fields, '') as index_fields, index_type, is_unique, rel_path as file, coalesce((select string_agg(field_name || ':' || field_order, ';' order by field_order, x.id) from v_sql_index_definition_fields x where x.table_index_id = i.id), '') as fields
from v_sql_index_definitions i join v_files f on f.id = i.file_id where index_name ilike '%ix%' or table_name ilike '%ix%' order by table_name, index_name, i.id desc limit 30""")
def named_table_index(c):
    return _flat(named.table_index(c, "ix", like=True, limit=30), "fields", "field_name", "field_order").drop("definition_kind", "file_id", "line_number")


@query("select p.id, file_id, proc_name, rel_path as file, line_start, line_end, 0 as params from v_sql_procedures p left join v_files f on f.id = p.file_id where proc_name = 'Customer#000000042' order by p.id desc limit 1")
def named_procedure(c):
    return named.procedure(c, "Customer#000000042").withColumn("params", F.size("params")).drop("body_hash")


_CALLERS_SQL = """with_targets as (select id from v_sql_procedures where proc_name ilike '%00000000%')
select caller_id, caller_name, caller_type, coalesce(file, '') as file, line_number, coalesce(call_context, '') as call_context, is_indirect, via_procedure, relation_type from (
select r.source_id as caller_id, v.name as caller_name, r.source_type as caller_type, v.file, r.line_number, q.context as call_context, false as is_indirect, '' as via_procedure, r.relation_type
from v_relations r join with_targets t on t.id = r.target_id left join vertex v on v.type = r.source_type and v.id = r.source_id left join v_query_fragments q on r.source_type = 'query_fragment' and q.id = r.source_id
where r.target_type = 'sql_procedure' and r.relation_type in ('calls_procedure', 'dispatches_to_subscriber')
union select u.source_id, a.name, 'sql_procedure', a.file, u.line_number, null, true, m.name, u.relation_type || '->' || r.relation_type
from v_relations r join with_targets t on t.id = r.target_id join vertex m on m.type = 'sql_procedure' and m.id = r.source_id join v_relations u on u.target_type = 'sql_procedure' and u.target_id = m.id join vertex a on a.type = 'sql_procedure' and a.id = u.source_id
where r.source_type = 'sql_procedure' and r.target_type = 'sql_procedure' and u.source_type = 'sql_procedure' and a.file is not null and r.relation_type in ('calls_procedure', 'dispatches_to_subscriber') and u.relation_type in ('dispatches_to', 'dispatches_to_subscriber', 'calls_procedure')) x
order by is_indirect, caller_type, caller_name, caller_id, line_number, via_procedure, relation_type limit 400"""


@query(", " + _CALLERS_SQL)
def named_callers(c):
    return named.callers(c, "00000000", 400)


@query("""select m.id, m.unit_id, method_name, class_name, unit_name, rel_path as file, m.line_number, table_name as table_usage from v_relations a join v_relations b on b.source_type = 'query_fragment' and b.source_id = a.target_id join v_sql_tables t on t.id = b.target_id join v_pas_methods m on m.id = a.source_id
join v_pas_units u on u.id = m.unit_id join v_files f on f.id = u.file_id left join v_pas_classes k on k.id = m.class_id where a.source_type = 'pas_method' and a.target_type = 'query_fragment' and a.relation_type in ('executes_query', 'builds_query') and b.target_type = 'sql_table' and b.relation_type = 'references_table' and lower(table_name) = 't11'
order by unit_name, method_name, m.line_number, m.id, table_usage limit 100""")
def named_methods(c):
    return named.methods(c, "T11")


@query("select d.id, file_id, form_name, form_class, '' as caption, rel_path as file, line_start, line_end from v_dfm_forms d join v_files f on f.id = d.file_id where form_name ilike '%_1%' or form_class ilike '%_1%' order by form_name, line_start, d.id limit 100")
def named_form(c):
    return named.form(c, "_1", like=True)


@query("""select d.id, d.file_id, form_id, form_name, form_class, component_name, component_type, '' as parent_name, d.caption, coalesce(field_name, '') as pas_field_name, coalesce(field_type, '') as pas_field_type, rel_path as file, d.line_start, d.line_end
from v_dfm_components d join v_dfm_forms m on m.id = d.form_id join v_files f on f.id = d.file_id left join v_pas_fields p on p.dfm_component_id = d.id where component_name = 'MACHINERY' or component_type = 'MACHINERY' or d.caption = 'MACHINERY' or form_name = 'MACHINERY' or form_class = 'MACHINERY'
order by form_name, d.line_start, d.id, pas_field_name limit 60""")
def named_form_component(c):
    return named.form_component(c, "MACHINERY", limit=60)


@query("select q.id, file_id, parent_type, parent_id, component_name, component_type, query_text, context, rel_path as file, line_number, 0 as tables from v_query_fragments q join v_files f on f.id = q.file_id where query_text ilike '%from cold%' order by file_id, line_number, q.id limit 100")
def named_sql_fragment(c):
    return named.sql_fragment(c, "from cold").withColumn("tables", F.size("tables_referenced")).drop("tables_referenced")


@query("select r.id, file_id, report_name, report_type, form_name, '' as form_class, rel_path as file, line_start, line_end from v_report_forms r join v_files f on f.id = r.file_id where report_name ilike '%2%' or form_name ilike '%2%' order by report_name, line_start, r.id limit 100")
def named_report_form(c):
    return named.report_form(c, "2", like=True)


@query("select p.id, report_form_id, field_name, source_name, '' as format_mask, report_name, report_type, rel_path as file, p.line_number, raw_text from v_report_fields p join v_report_forms r on r.id = p.report_form_id join v_files f on f.id = r.file_id where field_name ilike '%ECO%' or source_name ilike '%ECO%' or report_name ilike '%ECO%' or raw_text ilike '%ECO%' order by report_name, p.line_number, p.id limit 100")
def named_report_field(c):
    return named.report_field(c, "ECO", like=True).drop("options")


@query("select p.id, report_form_id, param_name, param_kind, lookup_table, false as required, report_name, rel_path as file, p.line_number, raw_text from v_report_params p join v_report_forms r on r.id = p.report_form_id join v_files f on f.id = r.file_id where param_name ilike '%furn%' or lookup_table ilike '%furn%' or raw_text ilike '%furn%' order by report_name, p.line_number, p.id limit 100")
def named_report_param(c):
    return named.report_param(c, "furn", like=True).select("id", "report_form_id", "param_name", "param_kind", "lookup_table", "required", "report_name", "file", "line_number", "raw_text")


@query("select v.id, report_form_id, function_name, function_type, '' as signature, report_name, rel_path as file, v.line_start, v.line_end from v_vb_functions v join v_report_forms r on r.id = v.report_form_id join v_files f on f.id = r.file_id where function_name ilike '%fn%1%' order by function_name, v.line_start, v.id limit 100")
def named_vb_function(c):
    return named.vb_function(c, "fn%1", like=True)


@query("select j.id, file_id, function_name, rel_path as file, line_start as line_number, line_end, '' as signature, scenario_type from v_js_functions j join v_files f on f.id = j.file_id where function_name ilike '%onsupp%' order by line_start, j.id limit 25")
def named_js_function(c):
    return named.js_function(c, "onsupp", like=True, limit=25)


@query("select s.id, file_id, instrument_name, brief, rel_path as file, deal_object_id, 0::bigint as ds_module_id, '' as start_state, scenario_type from v_smf_instruments s join v_files f on f.id = s.file_id where instrument_name = 'b15' or brief = 'b15' or rel_path = 'b15' order by instrument_name, s.id limit 100")
def named_smf_instrument(c):
    return named.smf_instrument(c, "b15").drop("states", "actions", "accounts")


@query("select s.id, file_id, instrument_name, brief, rel_path as file, deal_object_id, 0::bigint as ds_module_id, '' as start_state, scenario_type from v_smf_instruments s join v_files f on f.id = s.file_id where scenario_type = 'mass' order by instrument_name, s.id limit 100")
def named_smf_type(c):
    return named.smf_type(c, "mass").drop("states", "actions", "accounts")


@query("""select c.id, file_id, business_object, contract_name, contract_kind, rel_path as file, line_start, coalesce((select string_agg(id || ':' || direction || ':' || param_name || ':' || required, ';' order by direction, param_order, id) from v_api_contract_params p where p.contract_id = c.id), '') as params,
coalesce((select string_agg(id || ':' || table_name || ':' || (select count(*) from v_api_contract_table_fields x where x.contract_table_id = t.id), ';' order by direction, param_order, id) from v_api_contract_tables t where t.contract_id = c.id), '') as tables
from v_api_contracts c join v_files f on f.id = c.file_id where contract_name ilike '%nation_1%' order by contract_name, c.id desc limit 100""")
def named_api_contract(c):
    out = named.api_contract(c, "nation_1", like=True).withColumn("tables", F.transform("tables", lambda t: F.struct(t["id"].alias("id"), t["table_name"].alias("table_name"), F.size(t["fields"]).alias("n"))))
    return _flat(_flat(out, "params", "id", "direction", "param_name", "required"), "tables", "id", "table_name", "n").select("id", "file_id", "business_object", "contract_name", "contract_kind", "file", "line_start", "params", "tables")


@query("""select id, contract_id, business_object, contract_name, table_name, coalesce(file, '') as file, source, coalesce(fields, '') as fields from (
select t.id, contract_id, coalesce(business_object, '') as business_object, coalesce(contract_name, '') as contract_name, table_name, rel_path as file, 'contract' as source, (select string_agg(field_name || ':' || type_name || ':' || required, ';' order by param_order, id) from v_api_contract_table_fields x where x.contract_table_id = t.id) as fields
from v_api_contract_tables t left join v_api_contracts c on c.id = t.contract_id left join v_files f on f.id = c.file_id where table_name ilike '%pt1%'
union all select b.id, null, business_object, '', table_name, rel_path, 'business_object', (select string_agg(field_name || ':' || type_name || ':false', ';' order by param_order, id) from v_api_business_object_table_fields x where x.business_table_id = b.id) from v_api_business_object_tables b left join v_files f on f.id = b.file_id where table_name ilike '%pt1%')
order by table_name, id desc, source limit 12""")
def named_api_table(c):
    return _flat(named.api_table(c, "pT1", like=True, limit=12), "fields", "field_name", "type_name", "required").select("id", "contract_id", "business_object", "contract_name", "table_name", "file", "source", "fields")


@query("""select i.id, business_table_id, business_object, table_name, index_name, index_fields, index_type, is_clustered, rel_path as file, i.line_number, coalesce((select string_agg(field_name || ':' || field_order, ';' order by field_order, x.id) from v_api_business_object_table_index_fields x where x.table_index_id = i.id), '') as fields
from v_api_business_object_table_indexes i join v_api_business_object_tables t on t.id = i.business_table_id join v_files f on f.id = t.file_id where lower(index_name) = 'pt15' or lower(table_name) = 'pt15' order by table_name, index_name, i.id desc limit 100""")
def named_api_table_index(c):
    return _flat(named.api_table_index(c, "PT15"), "fields", "field_name", "field_order")


@query("select p.id, contract_id, business_object, contract_name, contract_kind, direction, param_name, '' as type_name, required, rel_path as file, p.line_number from v_api_contract_params p left join v_api_contracts c on c.id = p.contract_id left join v_files f on f.id = c.file_id where param_name = 'FURNITURE' order by param_name, p.id desc limit 60")
def named_api_param(c):
    return named.api_param(c, "FURNITURE", limit=60).drop("description")


def _related_sql(kind: str, extra: str = "", limit: int = 100, contract_kind: str = "") -> str:
    return f"""select * from (select c.id as contract_id, contract_name{contract_kind}, p.id as procedure_id, p.proc_name as procedure_name, rel_path as file, relation_type, false as is_indirect, '' as via_procedure
from v_relations r join v_api_contracts c on c.id = r.target_id join v_sql_procedures p on p.id = r.source_id join v_files f on f.id = p.file_id where r.target_type = 'api_contract' and r.source_type = 'sql_procedure' and relation_type = '{kind}' and contract_name ilike '%nation_2%'
union select c.id, contract_name{contract_kind}, q.id, q.proc_name, rel_path, r.relation_type || '->' || n.relation_type, true, p.proc_name from v_relations r join v_api_contracts c on c.id = r.target_id join v_sql_procedures p on p.id = r.source_id
join v_relations n on n.source_type = 'sql_procedure' and n.source_id = p.id and n.target_type = 'sql_procedure' join v_sql_procedures q on q.id = n.target_id join v_files f on f.id = q.file_id
where r.target_type = 'api_contract' and r.source_type = 'sql_procedure' and r.relation_type = '{kind}' and n.relation_type in ('dispatches_to', 'dispatches_to_subscriber', 'calls_procedure') and contract_name ilike '%nation_2%'{extra}) x
order by contract_name, is_indirect, procedure_name, contract_id, procedure_id, relation_type, via_procedure limit {limit}"""


@query(_related_sql("implements_contract", contract_kind=", contract_kind"))
def named_api_impl(c):
    return named.api_impl(c, "nation_2")


@query(_related_sql("executes_contract"))
def named_api_consumers(c):
    return named.api_consumers(c, "nation_2")


@query(_related_sql("publishes_event", """
union select e.id, e.contract_name, b.id, b.contract_name, rel_path, r.relation_type, false, '' from v_relations r join v_api_contracts b on b.id = r.source_id join v_api_contracts e on e.id = r.target_id join v_files f on f.id = b.file_id
where r.source_type = 'api_contract' and r.target_type = 'api_contract' and r.relation_type = 'subscribes_to_event' and lower(b.contract_kind) = 'callback_event' and lower(e.contract_kind) = 'event' and e.contract_name ilike '%nation_2%'"""))
def named_api_publishers(c):
    return named.api_publishers(c, "nation_2")


@query("""select (select count(*) from v_files) as total, (select count(*) from v_files where lower(extension) = 'sql') as sql, (select count(*) from v_files where lower(extension) = 'pas') as pas, (select count(*) from v_sql_procedures) as procedures, (select count(*) from v_sql_tables) as tables,
(select count(*) from v_relations) as relations, 0::bigint as defines, (select max(id) from v_scan_runs) as run_id, (select status from v_scan_runs order by id desc limit 1) as status""")
def named_stats(c):
    return named.stats(c).select("files.total", "files.sql", "files.pas", "entities.procedures", "entities.tables", "entities.relations", "entities.defines", "last_scan.run_id", "last_scan.status")


@query("select name, case when name <> 'index' or exists (select 1 from v_scan_runs where status = 'completed') then 'ok' else 'missing' end as status, '' as message from (values ('config'), ('database'), ('schema'), ('index')) t(name)")
def named_health(c):
    return named.health(c)


@query("select id, white_player, black_player, result, eco_code from v_games where white_player ilike '%c1%' and result = 'F' and eco_code = '3' order by created_at desc, id limit 50")
def named_games(c):
    return named.games(c, white="c1", result="F", eco="3", limit=50).select("id", "white_player", "black_player", "result", "eco_code")


@query("select parent_hash, child_hash, move_number, games_count from v_moves where parent_hash = 5")
def named_transitions(c):
    return named.transitions(c, 5).select("parent_hash", "child_hash", "move_number", "games_count")


@query("select code, name, moves, family from v_eco_codes where starts_with(moves, 'cold')")
def named_eco_prefix(c):
    return named.eco(c, moves="cold")


@query("select 0 as turn, moves as line from v_eco_codes where code = 'C3' union all select 1, array_to_string(w[1:len(w) - 1], ' ') from (select string_split(moves, ' ') as w from v_eco_codes where code = 'C3') where len(w) >= 2 union all select 2, array_to_string(w[1:len(w) - 2], ' ') from (select string_split(moves, ' ') as w from v_eco_codes where code = 'C3') where len(w) >= 4")
def named_typical_lines(c):
    return named.typical_lines(c, "C3")


@query("select count(*) as files, sum(games_count)::bigint as games, sum(positions_count)::bigint as positions, bool_or(filename = 'Supplier#000000003') as there from v_processed_files")
def named_processed(c):
    return named.processed_stats(c).crossJoin(named.was_processed(c, "Supplier#000000003"))  # a row each


# --- links and small shapes -----------------------------------------------------------------------------


@query("select k.id, class_name, (select max(d.id) from v_dfm_forms d where lower(d.form_class) = lower(k.class_name)) as dfm_form_id from v_pas_classes k")
def linked_class_forms(c):
    return linking.class_forms(c["pas_classes"], c["dfm_forms"]).select("id", "class_name", "dfm_form_id")


@query("select m.id, m.method_name, coalesce(m.class_id, (select max(k.id) from v_pas_classes k where lower(k.class_name) = lower('tnation_' || (m.id % 40)))) as class_id from (select id, method_name, case when id % 2 = 0 then class_id end as class_id from v_pas_methods) m")
def linked_methods(c):
    loose = c["pas_methods"].withColumn("class_id", F.when(F.col("id") % 2 == 0, F.col("class_id"))).withColumn("owner", F.concat(F.lit("tNation_"), (F.col("id") % 40).cast("string")))
    return linking.member_classes(loose, c["pas_classes"], "owner").select("id", "method_name", "class_id")


@query("""select f.id, f.field_name, (select max(d.id) from v_dfm_components d join v_dfm_forms m on m.id = d.form_id where m.form_class = 'TNATION_' || ((f.id % 50) // 2) and d.form_id = (select max(x.id) from v_dfm_forms x where x.form_class = m.form_class) and lower(d.component_name) = lower(f.field_name)) as dfm_component_id from v_pas_fields f""")
def linked_field_components(c):
    classes = linking.class_forms(c["pas_classes"], c["dfm_forms"])
    fields = c["pas_fields"].withColumn("dfm_component_id", F.lit(None).cast("long")).withColumn("class_id", F.expr("(id % 50) div 2"))
    return linking.field_components(fields, classes, c["dfm_components"]).select("id", "field_name", "dfm_component_id")


@query("""select p_partkey as file_row, 'inc/' || case when p_size % 2 = 0 then 'Supplier#' || lpad(cast(p_partkey % 30 as string), 9, '0') || '.sql' else 'none.h' end as include_path, case when p_size % 2 = 0 then (select max(id) from v_files f where f.rel_path = 'Supplier#' || lpad(cast(p_partkey % 30 as string), 9, '0') || '.sql' and lower(f.extension) = 'h') end as resolved_file_id from part""".replace("from part", "from v_sql_columns join part on part.p_partkey = v_sql_columns.id"))
def resolved_includes(c):
    """No file lies where the includes say, so headers are found by name."""
    parts = c["pas_methods"].select("id", F.col("line_number").alias("size"))
    name = F.when(F.col("size") % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 30).cast("string"), 9, "0"), F.lit(".sql"))).otherwise("none.h")
    rows = parts.select((F.col("id") % 10).alias("file_id"), F.concat(F.lit("inc/"), name).alias("include_path"), F.col("id").cast("int").alias("line_number"))
    return linking.includes(rows, c["files"]).select(F.col("line_number").cast("long").alias("file_row"), "include_path", "resolved_file_id")


@query("select table_name, string_agg(v, ';' order by p) as values from (select table_name, lower(trim(column_name)) as k, min(id) as p, arg_min(trim(column_name), id) as v from v_sql_columns group by 1, 2) group by table_name")
def unique_in_order(c):
    return _flat(linking.unique_in_order(c["sql_columns"], ["table_name"], "column_name", "id"), "values")


@query("""select context as step, sum(n)::bigint as n, sum(t)::double as total, (sum(t) / sum(n))::double as mean, min(lo)::double as least, max(hi)::double as most, ((max(t) / avg(t) - 1) * 100)::double as imbalance
from (select context, file_id % 4 as w, count(*) as n, sum(line_number)::double as t, min(line_number) as lo, max(line_number) as hi from v_sql_tables group by 1, 2) group by context""")
def timing_statistics(c):
    rows = c["sql_tables"].select(F.col("context").alias("step"), (F.col("file_id") % 4).alias("worker"), F.col("line_number").cast("double").alias("seconds"))
    return linking.timings(rows, "step", "worker", "seconds")


@query("select code, name, moves, family from v_eco_codes where false union all select 'B' || id, 'Opening ' || form_name, 'e4 ' || lower(form_class) || ' Nf3', 'B' from v_dfm_forms")
def eco_book(c):
    """Openings of files made from forms, each with an entry twice: the first counts."""
    entry = lambda name: F.concat(F.lit('[Event "x"]\n[Site "B'), "id", F.lit(f'"]\n[White "{name} '), "form_name", F.lit('"]\n\n1. e4 '), F.lower("form_class"), F.lit("\n2.Nf3\n\n"))
    text = c["dfm_forms"].select(F.concat(F.lit("f"), "id").alias("path"), F.concat(entry("Opening"), entry("Again")).alias("text"))
    return linking.eco_book(text)


@query("select table_name, id from v_sql_columns where id in (select id from v_sql_columns where id % 3 <> 0) and table_name not in (select table_name from v_sql_columns where id % 40 = 39)")
def without_failed_groups(c):
    rows = c["sql_columns"].where("id % 3 <> 0 or id % 40 = 39")
    return linking.without_failed(rows, "table_name", "id % 40 = 39").select("table_name", "id")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

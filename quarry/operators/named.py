"""The named queries over a catalog: name, like and limit in, a DataFrame with the contract's columns out.

Names are trimmed and compared as they are, or with ``like`` looked for within,
without regard to case; the queries by table name compare without regard to
case.  Orders end in a unique key, so a limit is the same in every run.  Nested
children are gathered for the limited rows only.  A null becomes what the
contract has for none: the empty text, 0 or false.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, predicates
from .predicates import name_lookup, trimmed

Tables = Mapping[str, DataFrame]

# Kinds of vertices, their tables, names and (for those without a file of their own) the table that has it.
VERTICES = {
    "sql_procedure": ("sql_procedures", "proc_name", "line_start", None), "sql_table": ("sql_tables", "table_name", "line_number", None),
    "pas_method": ("pas_methods", "method_name", "line_number", ("pas_units", "unit_id")), "js_function": ("js_functions", "function_name", "line_start", None),
    "api_contract": ("api_contracts", "contract_name", "line_start", None), "report_form": ("report_forms", "report_name", "line_start", None),
    "report_field": ("report_fields", "field_name", "line_number", ("report_forms", "report_form_id")), "report_param": ("report_params", "param_name", "line_number", ("report_forms", "report_form_id")),
    "vb_function": ("vb_functions", "function_name", "line_start", ("report_forms", "report_form_id")), "query_fragment": ("query_fragments", None, "line_number", None),
    "smf_instrument": ("smf_instruments", "instrument_name", None, None),
}
# Kinds of edges.
TABLE_USES = ["selects_from", "inserts_into", "updates", "deletes_from", "references_table"]
CALLS = ["calls_procedure", "dispatches_to_subscriber"]
CHAINS = ["dispatches_to", "dispatches_to_subscriber", "calls_procedure"]
CALLERS = ["sql_procedure", "pas_method", "js_function", "report_form", "vb_function", "query_fragment"]


def _none(c: str, empty) -> Column:
    return F.coalesce(F.col(c), F.lit(empty)).alias(c)


def _texts(*names: str) -> list[Column]:
    return [_none(n, "") for n in names]


def _files(c: Tables) -> DataFrame:
    return c["files"].select(F.col("id").alias("file_id"), F.col("rel_path").alias("file"))


def _in_file(df: DataFrame, c: Tables, how: str = "inner") -> DataFrame:
    return df.join(_files(c), "file_id", how)


def _top(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """The first rows in order; all of them where the limit is left out or not positive."""
    return df.orderBy(*order).limit(limit) if limit and limit > 0 else df.orderBy(*order)


def _ci(columns: list[str], value: str, like: bool) -> Column:
    return name_lookup(columns, value, like=True) if like else reduce(lambda a, b: a | b, [predicates.equals_ci(x, value) for x in columns])


def _nested(rows: DataFrame, children: DataFrame, foreign: str, order: list[str], fields: list[Column], name: str, ident: str = "id") -> DataFrame:
    """Rows with an ordered array of their children's structs; empty if none."""
    mine = children.join(rows.select(F.col(ident).alias(foreign)).distinct(), foreign, "left_semi")
    each = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("row"))
    per = mine.groupBy(F.col(foreign).alias(ident)).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["row"]).alias(name))
    return rows.join(per, ident, "left").withColumn(name, F.coalesce(F.col(name), F.array()))


def vertices(c: Tables, types: list[str] | None = None) -> DataFrame:
    """(type, id, name, file_id, file, line_number) of every vertex; a filter on the type, or ``types``, leaves out whole tables."""
    parts = []
    for kind in types or VERTICES:
        table, name, line, via = VERTICES[kind]
        t = c[table]
        label = F.col(name) if name else F.coalesce(predicates.null_if_empty("component_name"), predicates.null_if_empty("component_type"), F.lit(kind))
        at = F.col(line) if line else F.lit(0)
        if via:
            t = t.join(c[via[0]].select(F.col("id").alias(via[1]), "file_id"), via[1], "left")
        parts.append(t.select(F.lit(kind).alias("type"), "id", label.alias("name"), "file_id", at.cast("int").alias("line_number")))
    return _in_file(reduce(DataFrame.unionByName, parts), c, "left").select("type", "id", "name", "file_id", "file", "line_number")


# --- symbols, files, edges ------------------------------------------------------------------------


def _symbols(c: Tables) -> DataFrame:
    named = _in_file(c["symbols"], c)
    return named.select("id", "file_id", "entity_id", F.col("symbol_name").alias("name"), F.col("symbol_type").alias("type"), "entity_type", "file", "line_number", "signature")


def symbol(c: Tables, name: str, type_: str = "", like: bool = False, limit: int | None = 100) -> DataFrame:
    found = _symbols(c).where(name_lookup(["name"], name, like))
    return _top(predicates.filtered(found, equal={"type": type_}), limit, "name", "id")


def content(c: Tables, text: str, limit: int | None = 100) -> DataFrame:
    """Symbols whose name or signature contains the text."""
    return _top(_symbols(c).where(name_lookup(["name", "signature"], text, like=True)), limit, "name", "id")


def file_by_path(c: Tables, path: str) -> DataFrame:
    """The file with this path or relative path; the newest if several have it."""
    return _top(c["files"].where((F.col("path") == path) | (F.col("rel_path") == path)), 1, F.desc("id"))


def _ends(edges: DataFrame, c: Tables) -> DataFrame:
    """Edges with both ends as structs; an end that is no known vertex is named type:id."""
    kinds = vertices(c)
    for side in ("source", "target"):
        ref = kinds.select(F.col("type").alias(f"{side}_type"), F.col("id").alias(f"{side}_id"), F.struct("name", "file", "file_id", "line_number").alias("v"))
        out = edges.join(ref, [f"{side}_type", f"{side}_id"], "left")
        name = F.coalesce(F.col("v.name"), F.concat_ws(":", f"{side}_type", f"{side}_id"))
        end = F.struct(F.col(f"{side}_id").alias("id"), F.col(f"{side}_type").alias("type"), name.alias("name"), F.coalesce("v.file", F.lit("")).alias("file"), F.coalesce("v.file_id", F.lit(0)).alias("file_id"), F.coalesce("v.line_number", F.lit(0)).alias("line_number"))
        edges = out.withColumn(side, end).drop("v")
    return edges.select("id", "relation_type", *_texts("confidence"), _none("line_number", 0), "source", "target")


def relations_of(c: Tables, source_type: str = "", source_id: int = 0, target_type: str = "", target_id: int = 0, relation_type: str = "", limit: int | None = 100) -> DataFrame:
    """Edges by the ids of their ends; at least one filter is required, and an id needs its type."""
    if (source_id and not source_type) or (target_id and not target_type):
        raise ValueError("an id needs its type")
    equal = {"source_type": source_type, "source_id": source_id or None, "target_type": target_type, "target_id": target_id or None, "relation_type": relation_type}
    return _ends(_top(predicates.filtered(c["relations"], equal=equal, require=True), limit, F.desc("id")), c).orderBy(F.desc("id"))


def relations(c: Tables, source_type: str = "", source_name: str = "", target_type: str = "", target_name: str = "", relation_type: str = "", limit: int | None = 100) -> DataFrame:
    """Edges by the types and (parts of the) names of their ends; one semi-join a named end, whatever its type."""
    for type_, name in ((source_type, source_name), (target_type, target_name)):
        if name.strip() and type_ and type_ not in VERTICES:
            raise ValueError(f"{type_} has no names to search")
    if not any(x.strip() for x in (source_type, source_name, target_type, target_name, relation_type)):
        raise ValueError("at least one filter is required")
    found = predicates.filtered(c["relations"], equal={"source_type": source_type, "target_type": target_type, "relation_type": relation_type})
    for side, type_, name in (("source", source_type, source_name), ("target", target_type, target_name)):
        if name.strip():
            ends = vertices(c, [type_] if type_ else None).where(F.col("name").ilike(predicates.pattern(name)))
            found = found.join(ends.select(F.col("type").alias(f"{side}_type"), F.col("id").alias(f"{side}_id")).distinct(), [f"{side}_type", f"{side}_id"], "left_semi")
    return _ends(_top(found, limit, F.desc("id")), c).orderBy(F.desc("id"))


def inspect(c: Tables, name: str, type_: str = "", entity_type: str = "", limit: int | None = 100) -> DataFrame:
    """(symbol, incoming, outgoing, neighbors) of each symbol that contains the name, best match first; at most ``limit`` newest edges a symbol and side."""
    found = _symbols(c).where(F.col("name").ilike(predicates.pattern(name)))
    score = graph.relevance(name.strip(), type_, entity_type)
    ranked = found.withColumn("symbol_name", F.col("name")).withColumn("symbol_type", F.col("type")).withColumn("score", score).drop("symbol_name", "symbol_type")
    best = _top(ranked, limit, F.desc("score"), "name", "id")
    ends = best.where("entity_id > 0").select(F.col("entity_type").alias("type"), F.col("entity_id").alias("eid"))
    edges = []
    for side, other, out in (("target", "source", "incoming"), ("source", "target", "outgoing")):
        mine = c["relations"].join(ends.distinct(), (F.col(f"{side}_type") == F.col("type")) & (F.col(f"{side}_id") == F.col("eid")), "left_semi")
        turn = F.row_number().over(Window.partitionBy(f"{side}_type", f"{side}_id").orderBy(F.desc("id")))
        few = _ends(mine.withColumn("turn", turn).where(F.col("turn") <= limit).drop("turn"), c)
        edges.append(few.select(F.col(f"{side}.type").alias("entity_type"), F.col(f"{side}.id").alias("entity_id"), F.lit(out).alias("way"), F.col(other).alias("n"), F.struct(*few.columns).alias("r")))
    of = lambda way: F.array_sort(F.collect_list(F.when(F.col("way") == way, F.col("r"))), lambda a, b: F.when(a["id"] > b["id"], -1).when(a["id"] < b["id"], 1).otherwise(0)).alias(way)
    per = edges[0].unionByName(edges[1]).groupBy("entity_type", "entity_id").agg(of("incoming"), of("outgoing"), F.array_sort(F.collect_set("n")).alias("neighbors"))
    out = best.join(per, ["entity_type", "entity_id"], "left")
    return out.select(F.struct(*[x for x in best.columns if x != "score"]).alias("symbol"), *[F.coalesce(x, F.array()).alias(x) for x in ("incoming", "outgoing", "neighbors")], "score").orderBy(F.desc("score"), "symbol.name", "symbol.id")


# --- tables, procedures, methods --------------------------------------------------------------------


def _first(df: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` distinct rows of each group, in order."""
    rows = df.distinct().withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return rows.where(F.col("turn") <= limit)


def table(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    """Uses by name and context, with up to 20 files, 50 columns and 20 procedures of the table."""
    uses = c["sql_tables"].where(_ci(["table_name"], name, like)).groupBy("table_name", "context").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("usages"))
    best = _top(uses, limit, F.desc("usages"), "table_name", "context")
    names = best.select("table_name").distinct()
    places = c["sql_tables"].join(names, "table_name", "left_semi")
    files = _first(_in_file(places, c).select("table_name", "file_id", "file"), "table_name", ["file_id"], 20).groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("file_id", "file"))).alias("f"))
    columns = _first(c["sql_columns"].join(names, "table_name", "left_semi").select("table_name", "column_name"), "table_name", ["column_name"], 50).groupBy("table_name").agg(F.array_sort(F.collect_list("column_name")).alias("columns"))
    edges = c["relations"].where((F.col("source_type") == "sql_procedure") & (F.col("target_type") == "sql_table") & F.col("relation_type").isin(TABLE_USES)).select("source_id", "target_id")
    used = edges.join(places.select(F.col("id").alias("target_id"), "table_name"), "target_id").join(c["sql_procedures"].select(F.col("id").alias("source_id"), "proc_name"), "source_id")
    procedures = _first(used.select("table_name", "proc_name"), "table_name", ["proc_name"], 20).groupBy("table_name").agg(F.array_sort(F.collect_list("proc_name")).alias("procedures"))
    out = best.join(files, "table_name", "left").join(columns, "table_name", "left").join(procedures, "table_name", "left")
    some = lambda e, n: F.coalesce(e, F.array()).alias(n)
    return out.select("id", some(F.col("f.file_id"), "file_ids"), "table_name", "context", some(F.col("f.file"), "files"), "usages", some(F.col("columns"), "columns"), some(F.col("procedures"), "procedures")).orderBy(F.desc("usages"), "table_name", "context")


def table_schema(c: Tables, name: str, limit: int | None = 100) -> DataFrame:
    rows = _in_file(c["sql_column_definitions"].where(F.col("table_name") == name), c)
    return _top(rows, limit, "table_name", "column_order", "line_number", "id").select("table_name", "column_name", "data_type", "definition_kind", "file", "file_id", "line_number", "column_order")


def table_index(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    rows = _in_file(c["sql_index_definitions"].where(_ci(["index_name", "table_name"], name, like)), c)
    rows = _top(rows, limit, "table_name", "index_name", F.desc("id")).select("id", "table_name", "index_name", *_texts("index_fields", "index_type"), "is_unique", "definition_kind", "file", "file_id", "line_number")
    return _nested(rows, c["sql_index_definition_fields"], "table_index_id", ["field_order", "id"], [F.col(x) for x in ("field_name", "field_order", "line_number")], "fields").orderBy("table_name", "index_name", F.desc("id"))


def procedure(c: Tables, name: str) -> DataFrame:
    """The newest procedure of this very name."""
    rows = _in_file(_top(c["sql_procedures"].where(F.col("proc_name") == name), 1, F.desc("id")), c, "left")
    return rows.select("id", "file_id", "proc_name", F.coalesce("parameters", F.array()).alias("params"), *_texts("file"), "line_start", "line_end", *_texts("body_hash"))


def callers(c: Tables, name: str, limit: int | None = 100) -> DataFrame:
    """What calls procedures that contain the name, directly or through one procedure more."""
    edges = c["relations"].where(F.col("target_type") == "sql_procedure")
    procs = vertices(c, ["sql_procedure"])
    wanted = procs.where(F.col("name").ilike(predicates.pattern(name))).select(F.col("id").alias("target_id"))
    down = edges.where(F.col("relation_type").isin(CALLS)).join(wanted, "target_id", "left_semi")
    who = vertices(c, CALLERS).select(F.col("type").alias("source_type"), F.col("id").alias("source_id"), F.col("name").alias("caller_name"), "file")
    context = c["query_fragments"].select(F.lit("query_fragment").alias("source_type"), F.col("id").alias("source_id"), F.col("context").alias("call_context"))
    near = down.where(F.col("source_type").isin(CALLERS)).join(who, ["source_type", "source_id"], "left").join(context, ["source_type", "source_id"], "left")
    near = near.select(F.col("source_id").alias("caller_id"), F.coalesce("caller_name", F.lit("unknown")).alias("caller_name"), F.col("source_type").alias("caller_type"), "file", "line_number", "call_context", F.lit(False).alias("is_indirect"), F.lit("").alias("via_procedure"), "relation_type")
    mid = procs.select(F.col("id").alias("mid"), F.col("name").alias("via_procedure"))
    hops = down.where("source_type = 'sql_procedure'").select(F.col("source_id").alias("mid"), F.col("relation_type").alias("then")).distinct().join(mid, "mid")
    up = edges.where((F.col("source_type") == "sql_procedure") & F.col("relation_type").isin(CHAINS)).select(F.col("target_id").alias("mid"), "source_id", "line_number", "relation_type")
    top = procs.where("file is not null").select(F.col("id").alias("source_id"), F.col("name").alias("caller_name"), "file")
    far = up.join(hops, "mid").join(top, "source_id").select(
        F.col("source_id").alias("caller_id"), "caller_name", F.lit("sql_procedure").alias("caller_type"), "file", "line_number", F.lit(None).cast("string").alias("call_context"), F.lit(True).alias("is_indirect"), "via_procedure",
        F.concat_ws("->", "relation_type", "then").alias("relation_type"),
    )
    out = near.unionByName(far).distinct()
    return _top(out, limit, "is_indirect", "caller_type", "caller_name", "caller_id", "line_number", "via_procedure", "relation_type").select("caller_id", "caller_name", "caller_type", *_texts("file"), "line_number", *_texts("call_context"), "is_indirect", "via_procedure", "relation_type")


def methods(c: Tables, table_name: str, limit: int | None = 100) -> DataFrame:
    """Methods that run or build a query that refers to the table; a method without a class has a null class."""
    used = c["sql_tables"].where(predicates.equals_ci("table_name", table_name)).select(F.col("id").alias("target_id"), F.col("table_name").alias("table_usage"))
    edge = lambda s, t, kinds: c["relations"].where((F.col("source_type") == s) & (F.col("target_type") == t) & F.col("relation_type").isin(kinds)).select("source_id", "target_id")
    pieces = edge("query_fragment", "sql_table", ["references_table"]).join(used, "target_id").select(F.col("source_id").alias("fragment"), "table_usage")
    pieces = pieces.join(c["query_fragments"].select(F.col("id").alias("fragment")), "fragment", "left_semi")
    run = edge("pas_method", "query_fragment", ["executes_query", "builds_query"]).select(F.col("source_id").alias("id"), F.col("target_id").alias("fragment"))
    units = _in_file(c["pas_units"].select(F.col("id").alias("unit_id"), "unit_name", "file_id"), c).drop("file_id")
    classes = c["pas_classes"].select(F.col("id").alias("class_id"), "class_name")
    out = c["pas_methods"].join(run.join(pieces, "fragment"), "id").join(units, "unit_id").join(classes, "class_id", "left")
    return _top(out.select("id", "unit_id", "method_name", "class_name", "unit_name", "file", "line_number", "table_usage"), limit, "unit_name", "method_name", "line_number", "id", "table_usage")


# --- forms, fragments, reports, scripts, instruments --------------------------------------------------


def form(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    rows = _in_file(c["dfm_forms"].where(name_lookup(["form_name", "form_class", "caption"], name, like)), c)
    return _top(rows, limit, "form_name", "line_start", "id").select("id", "file_id", "form_name", "form_class", *_texts("caption"), "file", "line_start", "line_end")


def form_component(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    """Components with the field of the class that holds them, a row a field."""
    forms = c["dfm_forms"].select(F.col("id").alias("form_id"), "form_name", "form_class")
    fields = c["pas_fields"].select(F.col("dfm_component_id").alias("id"), F.col("field_name").alias("pas_field_name"), F.col("field_type").alias("pas_field_type"))
    rows = _in_file(c["dfm_components"].join(forms, "form_id"), c).where(name_lookup(["component_name", "component_type", "caption", "form_name", "form_class"], name, like)).join(fields, "id", "left")
    rows = rows.select("id", "file_id", "form_id", "form_name", "form_class", "component_name", "component_type", *_texts("parent_name", "caption", "pas_field_name", "pas_field_type"), "file", "line_start", "line_end")
    return _top(rows, limit, "form_name", "line_start", "id", "pas_field_name")


def sql_fragment(c: Tables, text: str, limit: int | None = 100) -> DataFrame:
    rows = _in_file(c["query_fragments"].where(F.col("query_text").ilike(predicates.pattern(text))), c)
    out = rows.select("id", "file_id", "parent_type", "parent_id", *_texts("component_name", "component_type"), "query_text", F.coalesce("tables_referenced", F.array()).alias("tables_referenced"), *_texts("context"), "file", "line_number")
    return _top(out, limit, "file_id", "line_number", "id")


def report_form(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    rows = _in_file(c["report_forms"].where(name_lookup(["report_name", "form_name"], name, like)), c)
    return _top(rows, limit, "report_name", "line_start", "id").select("id", "file_id", "report_name", "report_type", *_texts("form_name", "form_class"), "file", "line_start", "line_end")


def _in_report(c: Tables, table_: str) -> DataFrame:
    forms = _in_file(c["report_forms"].select(F.col("id").alias("report_form_id"), "report_name", "report_type", "file_id"), c).drop("file_id")
    return c[table_].join(forms, "report_form_id")


def report_field(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    rows = _in_report(c, "report_fields").where(name_lookup(["field_name", "source_name", "report_name", "raw_text"], name, like))
    out = rows.select("id", "report_form_id", "field_name", *_texts("source_name", "format_mask"), F.coalesce("options", F.array()).alias("options"), "report_name", "report_type", "file", "line_number", *_texts("raw_text"))
    return _top(out, limit, "report_name", "line_number", "id")


def report_param(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    rows = _in_report(c, "report_params").where(name_lookup(["param_name", "lookup_table", "lookup_column", "raw_text"], name, like))
    texts = _texts("component_type", "data_type", "lookup_form", "lookup_table", "lookup_column", "key_column", "default_value")
    out = rows.select("id", "report_form_id", "param_name", "param_kind", *texts, _none("required", False), "report_name", "report_type", "file", "line_number", *_texts("raw_text"))
    return _top(out, limit, "report_name", "line_number", "id")


def vb_function(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    rows = _in_report(c, "vb_functions").where(name_lookup(["function_name"], name, like))
    return _top(rows, limit, "function_name", "line_start", "id").select("id", "report_form_id", "function_name", "function_type", *_texts("signature"), "report_name", "file", "line_start", "line_end")


def js_function(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    rows = _in_file(c["js_functions"].where(name_lookup(["function_name"], name, like)), c)
    return _top(rows, limit, "line_start", "id").select("id", "file_id", "function_name", "file", F.col("line_start").alias("line_number"), "line_end", *_texts("signature", "scenario_type"))


def _instruments(rows: DataFrame, limit: int) -> DataFrame:
    lists = [F.coalesce(x, F.array()).alias(x) for x in ("states", "actions", "accounts")]
    out = rows.select("id", "file_id", "instrument_name", *_texts("brief"), "file", _none("deal_object_id", 0), _none("ds_module_id", 0), *_texts("start_state"), "scenario_type", *lists)
    return _top(out, limit, "instrument_name", "id")


def smf_instrument(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    return _instruments(_in_file(c["smf_instruments"], c).where(name_lookup(["instrument_name", "brief", "file"], name, like)), limit)


def smf_type(c: Tables, type_: str, limit: int | None = 100) -> DataFrame:
    return _instruments(_in_file(c["smf_instruments"].where(F.col("scenario_type") == type_), c), limit)


# --- interfaces ---------------------------------------------------------------------------------------

_FIELD = lambda required: [F.col("field_name"), F.coalesce("type_name", F.lit("")).alias("type_name"), required.alias("required"), F.coalesce("description", F.lit("")).alias("description"), F.col("line_number")]
_CONTRACT = ["business_object", "contract_name", "contract_kind"]


def api_contract(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    """Contracts with their parameters and tables (with fields), by direction and order."""
    rows = _in_file(c["api_contracts"].where(name_lookup(["contract_name"], name, like)), c)
    rows = _top(rows, limit, "contract_name", F.desc("id")).select("id", "file_id", *_texts("business_object"), "contract_name", "contract_kind", _none("object_type_id", 0), *_texts("owner_module", "used_object_name", "used_module_sys_name", "short_description", "full_description"), "file", "line_start", "line_end")
    params = [F.col("id"), F.col("direction"), F.col("param_name"), F.coalesce("type_name", F.lit("")).alias("type_name"), F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("description", F.lit("")).alias("description"), F.col("line_number")]
    out = _nested(rows, c["api_contract_params"], "contract_id", ["direction", "param_order", "id"], params, "params")
    mine = c["api_contract_tables"].join(rows.select(F.col("id").alias("contract_id")), "contract_id", "left_semi")
    tables = _nested(mine, c["api_contract_table_fields"], "contract_table_id", ["param_order", "id"], _FIELD(F.coalesce("required", F.lit(False))), "fields")
    kids = [F.col("id"), F.col("direction"), F.col("table_name"), F.coalesce("description", F.lit("")).alias("description"), F.col("line_number"), F.col("fields")]
    return _nested(out, tables, "contract_id", ["direction", "param_order", "id"], kids, "tables").orderBy("contract_name", F.desc("id"))


def api_table(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    """Tables of contracts and of business objects, tagged, with their fields."""
    owners = c["api_contracts"].select(F.col("id").alias("contract_id"), *_CONTRACT, "file_id")
    own = c["api_contract_tables"].where(name_lookup(["table_name"], name, like)).join(owners, "contract_id", "left").withColumn("source", F.lit("contract"))
    objects = c["api_business_object_tables"].where(name_lookup(["table_name"], name, like)).withColumn("source", F.lit("business_object"))
    both = _in_file(own.unionByName(objects, allowMissingColumns=True), c, "left")
    rows = both.select("id", "contract_id", *_texts(*_CONTRACT, "direction"), "table_name", *_texts("description", "file"), "line_number", "source")
    best = _top(rows, limit, "table_name", F.desc("id"), "source")
    a = c["api_contract_table_fields"].select(F.concat(F.lit("contract:"), "contract_table_id").alias("of"), "id", "param_order", *_FIELD(F.coalesce("required", F.lit(False))))
    b = c["api_business_object_table_fields"].select(F.concat(F.lit("business_object:"), "business_table_id").alias("of"), "id", "param_order", *_FIELD(F.lit(False)))
    keyed = best.withColumn("key", F.concat_ws(":", "source", "id"))
    fields = [F.col(x) for x in ("field_name", "type_name", "required", "description", "line_number")]
    return _nested(keyed, a.unionByName(b), "of", ["param_order", "id"], fields, "fields", "key").drop("key").orderBy("table_name", F.desc("id"), "source")


def api_table_index(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    owners = _in_file(c["api_business_object_tables"].select(F.col("id").alias("business_table_id"), "business_object", "table_name", "file_id"), c).drop("file_id")
    rows = c["api_business_object_table_indexes"].join(owners, "business_table_id").where(_ci(["index_name", "table_name"], name, like))
    best = _top(rows, limit, "table_name", "index_name", F.desc("id")).select("id", "business_table_id", "business_object", "table_name", "index_name", *_texts("index_fields"), "index_type", "is_clustered", "file", "line_number")
    return _nested(best, c["api_business_object_table_index_fields"], "table_index_id", ["field_order", "id"], [F.col(x) for x in ("field_name", "field_order", "line_number")], "fields").orderBy("table_name", "index_name", F.desc("id"))


def api_param(c: Tables, name: str, like: bool = False, limit: int | None = 100) -> DataFrame:
    owners = c["api_contracts"].select(F.col("id").alias("contract_id"), *_CONTRACT, "file_id")
    rows = _in_file(c["api_contract_params"].where(name_lookup(["param_name"], name, like)).join(owners, "contract_id", "left"), c, "left")
    out = rows.select("id", "contract_id", *_texts(*_CONTRACT), "direction", "param_name", *_texts("type_name"), _none("required", False), *_texts("description", "file"), "line_number")
    return _top(out, limit, "param_name", F.desc("id"))


def _related(c: Tables, name: str, kind: str) -> DataFrame:
    """Procedures with an edge of this kind to contracts that contain the name, and those such a procedure leads on to."""
    contracts = c["api_contracts"].where(F.col("contract_name").ilike(predicates.pattern(name))).select(F.col("id").alias("contract_id"), "contract_name", "contract_kind")
    procs = _in_file(c["sql_procedures"].select(F.col("id").alias("procedure_id"), F.col("proc_name").alias("procedure_name"), "file_id"), c, "left").drop("file_id")
    from_procs = c["relations"].where("source_type = 'sql_procedure'")
    direct = from_procs.where((F.col("target_type") == "api_contract") & (F.col("relation_type") == kind)).select(F.col("source_id").alias("procedure_id"), F.col("target_id").alias("contract_id"), "relation_type").join(contracts, "contract_id").join(procs, "procedure_id")
    near = direct.where("file is not null").withColumn("is_indirect", F.lit(False)).withColumn("via_procedure", F.lit(""))
    chain = from_procs.where((F.col("target_type") == "sql_procedure") & F.col("relation_type").isin(CHAINS)).select(F.col("source_id").alias("via"), F.col("target_id").alias("procedure_id"), F.col("relation_type").alias("then"))
    start = direct.select(F.col("procedure_id").alias("via"), F.col("procedure_name").alias("via_procedure"), "contract_id", "contract_name", "contract_kind", "relation_type")
    far = chain.join(start, "via").join(procs.where("file is not null"), "procedure_id").withColumn("is_indirect", F.lit(True)).withColumn("relation_type", F.concat_ws("->", "relation_type", "then"))
    columns = ["contract_id", "contract_name", "contract_kind", "procedure_id", "procedure_name", "file", "relation_type", "is_indirect", "via_procedure"]
    return near.select(*columns).unionByName(far.select(*columns)).distinct()


def _related_top(rows: DataFrame, limit: int) -> DataFrame:
    return _top(rows, limit, "contract_name", "is_indirect", "procedure_name", "contract_id", "procedure_id", "relation_type", "via_procedure")


def api_impl(c: Tables, name: str, limit: int | None = 100) -> DataFrame:
    return _related_top(_related(c, name, "implements_contract"), limit)


def api_consumers(c: Tables, name: str, limit: int | None = 100) -> DataFrame:
    return _related_top(_related(c, name, "executes_contract").drop("contract_kind"), limit)


def api_publishers(c: Tables, name: str, limit: int | None = 100) -> DataFrame:
    """Publishing procedures, direct and onward, and the callback contracts that subscribe to the event."""
    ends = c["api_contracts"].select("id", "contract_name", F.lower("contract_kind").alias("kind"), "file_id")
    events = ends.where(F.col("contract_name").ilike(predicates.pattern(name)) & (F.col("kind") == "event")).select(F.col("id").alias("contract_id"), "contract_name")
    back = _in_file(ends.where("kind = 'callback_event'"), c).select(F.col("id").alias("procedure_id"), F.col("contract_name").alias("procedure_name"), "file")
    subscribed = c["relations"].where("relation_type = 'subscribes_to_event' and source_type = 'api_contract' and target_type = 'api_contract'").select(F.col("source_id").alias("procedure_id"), F.col("target_id").alias("contract_id"), "relation_type")
    third = subscribed.join(events, "contract_id").join(back, "procedure_id").withColumn("is_indirect", F.lit(False)).withColumn("via_procedure", F.lit(""))
    rows = _related(c, name, "publishes_event").drop("contract_kind")
    return _related_top(rows.unionByName(third.select(*rows.columns)).distinct(), limit)


# --- counts and state -----------------------------------------------------------------------------------

# The extensions and tables that the statistics count.
EXTENSIONS = ["sql", "h", "pas", "inc", "js", "xml", "smf", "dfm", "tpr", "rpt"]
COUNTED = {
    "procedures": "sql_procedures", "tables": "sql_tables", "columns": "sql_columns", "units": "pas_units", "classes": "pas_classes", "methods": "pas_methods", "pas_fields": "pas_fields", "js_functions": "js_functions",
    "smf_instruments": "smf_instruments", "forms": "dfm_forms", "defines": "h_files_defines", "report_forms": "report_forms", "report_fields": "report_fields", "report_params": "report_params", "vb_functions": "vb_functions",
    "api_business_objects": "api_business_objects", "api_contracts": "api_contracts", "api_contract_params": "api_contract_params", "api_contract_tables": "api_contract_tables", "api_contract_fields": "api_contract_table_fields",
    "api_business_params": "api_business_object_params", "api_business_tables": "api_business_object_tables", "query_fragments": "query_fragments", "relations": "relations", "sql_table_indexes": "sql_index_definitions",
    "api_table_indexes": "api_business_object_table_indexes",
}


def stats(c: Tables) -> DataFrame:
    """One row: files in all and by extension, entities by table, the last scan."""
    ext = F.lower("extension")
    files = c["files"].agg(F.count(F.lit(1)).alias("total"), *[F.count_if(ext == e).alias(e) for e in EXTENSIONS]).select(F.struct("*").alias("files"))
    counts = reduce(DataFrame.unionByName, [c[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k, t in COUNTED.items()])
    entities = counts.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in COUNTED]).select(F.struct("*").alias("entities"))
    last = c["scan_runs"].agg(F.max_by(F.struct(F.col("id").alias("run_id"), F.col("started_at").alias("started"), F.col("finished_at").alias("finished"), "status", F.col("errors_count").alias("errors")), "id").alias("last_scan"))
    return files.crossJoin(entities).crossJoin(last)  # a row each


def health(c: Tables) -> DataFrame:
    """(name, status, message) of the four checks: settings, tables, their columns, a finished scan."""
    from ..sources.catalog import SCHEMAS, schema

    def there(name: str) -> bool:
        want = {p.split()[0] for p in schema(name).replace("struct<", "struct ").split(", ")} if name in SCHEMAS else set()
        return want <= set(c[name].columns)

    spark = c["files"].sparkSession
    bad = sorted(n for n in c if not there(n))
    done = c["scan_runs"].agg(F.coalesce(F.bool_or(F.col("status") == "completed"), F.lit(False)).alias("done"))
    fixed = spark.createDataFrame([("config", "ok", ""), ("database", "ok", ""), ("schema", "ok" if not bad else "missing", ", ".join(bad))], "name string, status string, message string")
    index = done.select(F.lit("index").alias("name"), F.when(F.col("done"), "ok").otherwise("missing").alias("status"), F.when(F.col("done"), "").otherwise("no finished scan").alias("message"))
    return fixed.unionByName(index)


# --- games -------------------------------------------------------------------------------------------------


def games(c: Tables, white: str = "", black: str = "", result: str = "", eco: str = "", limit: int | None = 100) -> DataFrame:
    found = predicates.filtered(c["games"], equal={"result": result, "eco_code": eco}, like={"white_player": white, "black_player": black})
    return _top(found, limit, F.desc("created_at"), "id")


def transitions(c: Tables, parent_hash: int) -> DataFrame:
    """Moves from a position, the most played first."""
    return c["moves"].where(F.col("parent_hash") == parent_hash).orderBy(F.desc("games_count"), "child_hash", "move_number")


def eco(c: Tables, code: str | None = None, moves: str | None = None) -> DataFrame:
    """Openings in order of code: all, one, or those whose moves begin so."""
    rows = c["eco_codes"]
    if code is not None:
        rows = rows.where(F.col("code") == code)
    if moves is not None:
        rows = rows.where(F.col("moves").startswith(trimmed(F.lit(moves))))
    return rows.orderBy("code")


def typical_lines(c: Tables, code: str) -> DataFrame:
    """(turn, line): an opening's moves, and without the last one (of two or more) and the last two (of four or more)."""
    words = c["eco_codes"].where(F.col("code") == code).select("moves", F.filter(F.split("moves", r"\s+"), lambda w: w != "").alias("w"))
    cut = lambda least, n: F.when(F.size("w") >= least, F.array_join(F.slice("w", 1, F.greatest(F.size("w") - n, F.lit(0))), " "))
    return words.select(F.posexplode(F.array("moves", cut(2, 1), cut(4, 2))).alias("turn", "line")).where("line is not null")


def processed(c: Tables) -> DataFrame:
    """Imported files, the newest first."""
    return c["processed_files"].orderBy(F.desc("processed_at"), "filename")


def processed_stats(c: Tables) -> DataFrame:
    p = c["processed_files"]
    return p.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("games_count"), F.lit(0)).alias("games"), F.coalesce(F.sum("positions_count"), F.lit(0)).alias("positions"))


def was_processed(c: Tables, filename: str) -> DataFrame:
    return c["processed_files"].agg(F.coalesce(F.bool_or(F.col("filename") == filename), F.lit(False)).alias("there"))

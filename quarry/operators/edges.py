"""Interface macros of SQL files, edges between what the extractors find, and the extractor of each language.

Everything here is a projection or a join by key; rows of one file meet only that
file's rows.  Names match without regard to case; an edge is given once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract, forms, jobs, sqltext, units
from .lookup import latest

# The macros, what declares a procedure, lines in which a call hands on the process, what may hold a query, and the kinds of contract each macro is looked for among, the first first.
MACROS = {"create_proc": "API_CREATE_PROC", "init_event": "API_INIT_EVENT", "exec_contract": "API_EXEC"}
NAME = "[A-Za-z_][A-Za-z0-9_]*"
DECLARATIONS = (r"__BEGIN_PROCEDURE__\s*\(\s*", r"create\s+procedure\s+", r"create\s+proc\s+")
NO_SUBSCRIBER = "getapiprocessid"
HANDED_ON = 6
PARENTS = ("pas_method", "sql_procedure", "js_function", "smf_instrument", "dfm_form", "report_form", "vb_function")
CONTRACTS = [
    ("create_proc", "service", "implements_contract"), ("create_proc", "callback_event", "implements_contract"), ("init_event", "event", "publishes_event"),
    ("exec_contract", "used_service", "executes_contract"), ("exec_contract", "service", "executes_contract"),
]
EXTRACTORS = {
    "SQL": sqltext.scripts, "T01": sqltext.scripts, "H": extract.headers, "JS": extract.scripts, "PAS": units.units, "INC": units.units, "DFM": forms.forms,
    "TPR": forms.sectioned_reports, "RPT": forms.object_reports, "SMF": jobs.jobs, "XML": forms.interfaces,
}


def by_language(files: DataFrame, language_col: str = "language") -> dict[str, DataFrame]:
    """The extracted rows of each language's files; ``files`` has path and text.  Languages without an extractor have none."""
    return {language: run(files.where(F.upper(language_col) == language)) for language, run in EXTRACTORS.items()}


def macros(df: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, owner, kind, name, line_number): the first macro of each kind in each line.

    The owner is the file's first declared procedure, else its base name.  A call
    that hands on the process is ``dispatches_to``, in files that end in .t01 only.
    A null text has no rows.
    """
    path, text = F.col(path_col), F.col(text_col)
    first = F.array_min(F.array_compact(F.array(*[F.when(F.regexp_instr(text, F.lit(f"(?i){d}{NAME}")) > 0, F.struct(F.regexp_instr(text, F.lit(f"(?i){d}{NAME}")).alias("at"), F.regexp_extract(text, f"(?i){d}({NAME})", 1).alias("name"))) for d in DECLARATIONS])))
    owner = F.coalesce(first["name"], forms.base_name(path))
    lines = df.where(text.rlike(r"(?i)API_|@processid")).select(path.alias("path"), owner.alias("owner"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    begins = lambda c: F.regexp_extract(F.btrim(c), f"^{NAME}", 0)  # noqa: E731  the name that a piece begins with, or nothing

    def argument(kind: str) -> Column:
        """The contract among a macro's arguments: the second of a call with two names, else the first; one that is declared stands alone."""
        inside = F.regexp_extract("line", rf"(?i){MACROS[kind]}\s*\(([^()]*)(\)?)", 1)
        closed = F.regexp_extract("line", rf"(?i){MACROS[kind]}\s*\(([^()]*)(\)?)", 2) != ""
        parts = F.split(inside, ",")
        if kind == "create_proc":
            return F.when(closed & (begins(inside) == F.btrim(inside)), begins(inside)).otherwise("")
        one, two = begins(parts[0]), begins(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        return F.when((two != "") & (one == F.btrim(parts[0])), two).otherwise(one) if kind == "exec_contract" else one

    def found(kind: str, name: Column, holds: Column | None = None) -> Column:
        return F.when((name != "") if holds is None else (name != "") & holds, F.struct(F.lit(kind).alias("kind"), name.alias("name")))

    called = begins(F.regexp_replace(F.regexp_extract("line", r"(?i)exec\s+(.*)", 1), r"^@\w+\s*=", ""))
    handed = F.lower("path").endswith(".t01") & F.lower("line").contains("@processid") & (F.lower(called) != NO_SUBSCRIBER)
    marks = [found(kind, argument(kind)) for kind in MACROS] + [found("dispatches_to", called, handed)]
    each = lines.select("path", "owner", (F.col("at") + 1).alias("line_number"), F.explode(F.array_compact(F.array(*marks))).alias("m"))
    return each.select("path", "owner", "m.kind", "m.name", "line_number")


def macro_edges(found: DataFrame, procedures: DataFrame, contracts: DataFrame, *order: Column) -> DataFrame:
    """(source_file, source, target_type, target_kind, target, relation_type, line_number) of macros whose owner is a procedure of their file.

    ``procedures`` has path and name; ``contracts`` name and kind.  Of contracts of
    one name and kind, and of procedures of one name, ``order`` gives the one that counts.
    """
    own = procedures.select("path", F.col("name").alias("source"), F.lower("name").alias("__o")).dropDuplicates(["path", "__o"])
    sources = found.withColumn("__o", F.lower("owner")).join(own, ["path", "__o"]).withColumn("__n", F.lower("name")).select(F.col("path").alias("source_file"), "source", "kind", "__n", "line_number")
    choices = found.sparkSession.createDataFrame([(a, b, c, i) for i, (a, b, c) in enumerate(CONTRACTS)], "kind string, target_kind string, relation_type string, place int")
    known = latest(contracts.withColumn("__n", F.lower("name")), ["__n", "kind"], *order).select("__n", F.col("kind").alias("target_kind"), F.col("name").alias("target"))
    met = sources.join(F.broadcast(choices), "kind").join(known, ["__n", "target_kind"])  # choices: the five rows above
    best = met.groupBy("source_file", "source", "kind", "__n", "line_number").agg(F.min(F.struct("place", "target_kind", "target", "relation_type")).alias("b"))
    to_contract = best.select("source_file", "source", F.lit("api_contract").alias("target_type"), "b.target_kind", "b.target", "b.relation_type", "line_number")
    by_name = latest(procedures.withColumn("__n", F.lower("name")), ["__n"], *order).select("__n", F.col("name").alias("target"))
    sent = sources.where("kind = 'dispatches_to'").join(by_name, "__n")
    to_procedure = sent.select("source_file", "source", F.lit("sql_procedure").alias("target_type"), F.lit("procedure").alias("target_kind"), "target", F.lit("dispatches_to").alias("relation_type"), "line_number")
    return to_contract.union(to_procedure).distinct()


def report_edges(found: DataFrame, path_col: str = "path") -> DataFrame:
    """(file, source_type, source, target_type, target, relation_type, line_number) within each report.

    A form has its fields and parameters; a query uses the parameters whose names
    its text holds, in longer words too; a routine runs the queries whose
    component its text names in that way.
    """
    r = found.withColumn("file", F.col(path_col))
    name = F.coalesce("name", forms.base_name(path_col))
    shape = ["file", "source_type", "source", "target_type", "target", "relation_type", "line_number"]
    heads = r.where("kind = 'form'").select("file", name.alias("source"))
    held = r.where("kind in ('field', 'param')").select(
        "file", F.concat(F.lit("report_"), "kind").alias("target_type"), F.col("name").alias("target"), F.concat(F.lit("has_"), "kind").alias("relation_type"), F.col("line_start").alias("line_number")
    )
    has = heads.join(held, "file").withColumn("source_type", F.lit("report_form")).select(*shape)
    queries = r.where("kind = 'fragment'").select("file", F.col("name").alias("query"), F.lower("text").alias("sql"), F.col("line_start").alias("line_number"))
    params = r.where("kind = 'param' and trim(name) != ''").select("file", F.col("name").alias("target"), F.lower(F.trim("name")).alias("p"))
    uses = queries.join(params, "file").where(F.expr("contains(sql, p)"))
    uses = uses.select("file", F.lit("query_fragment").alias("source_type"), F.col("query").alias("source"), F.lit("report_param").alias("target_type"), "target", F.lit("uses_param").alias("relation_type"), "line_number")
    routines = r.where("kind = 'function'").select("file", F.col("name").alias("source"), F.lower("text").alias("body"))
    runs = routines.join(queries.where("trim(query) != ''"), "file").where(F.expr("contains(body, lower(trim(query)))"))
    runs = runs.select("file", F.lit("vb_function").alias("source_type"), "source", F.lit("query_fragment").alias("target_type"), F.col("query").alias("target"), F.lit("executes_query").alias("relation_type"), "line_number")
    return has.union(uses).union(runs).distinct()


def fragment_edges(fragments: DataFrame, procedures: DataFrame, *order: Column) -> DataFrame:
    """(file, query_line, target_type, target, relation_type, line_number) of pieces of SQL in other files.

    ``fragments`` has path, text and line_start.  A piece refers to the tables it
    names and calls the procedures it executes, of those known the one that ``order`` gives.
    """
    found = sqltext.scripts(fragments.select("path", F.col("line_start").alias("query_line"), "text"))
    line = F.expr("line_start + coalesce(query_line, 1) - 1").alias("line_number")
    tables = found.where("kind = 'table'").select(F.col("path").alias("file"), "query_line", F.lit("sql_table").alias("target_type"), F.col("name").alias("target"), F.lit("references_table").alias("relation_type"), line)
    by_name = latest(procedures.withColumn("__n", F.lower("name")), ["__n"], *order).select("__n", F.col("name").alias("target"))
    calls = found.where("kind = 'call'").withColumn("__n", F.lower("name")).join(by_name, "__n")
    calls = calls.select(F.col("path").alias("file"), "query_line", F.lit("sql_procedure").alias("target_type"), "target", F.lit("calls_procedure").alias("relation_type"), line)
    return tables.union(calls).distinct()


def subscriber_edges(files: DataFrame, found: DataFrame, *order: Column) -> DataFrame:
    """(source_file, source, target, relation_type, line_number) of calls in .t01 files that hand on the process within ``HANDED_ON`` lines.

    ``files`` has path and text, ``found`` the rows of ``sqltext.scripts`` with path;
    of procedures of one name ``order`` gives the one that counts.
    """
    lines = files.where(F.lower("path").endswith(".t01")).select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    bound = lines.where("lower(line) like '%@processid%' and lower(line) like '%@globalprocessid%'").select(F.col("path").alias("__p"), (F.col("at") + 1).alias("__at"))
    calls = found.where("kind = 'call' and owner != ''")
    sent = calls.join(bound, (F.col("path") == F.col("__p")) & F.col("__at").between(F.col("line_start"), F.col("line_start") + HANDED_ON - 1), "left_semi")
    by_name = latest(found.where("kind = 'procedure'").withColumn("__n", F.lower("name")), ["__n"], *order).select("__n", F.col("name").alias("target"))
    met = sent.withColumn("__n", F.lower("name")).join(by_name, "__n")
    return met.select(F.col("path").alias("source_file"), F.col("owner").alias("source"), "target", F.lit("dispatches_to_subscriber").alias("relation_type"), F.col("line_start").alias("line_number")).distinct()


def parent_edges(fragments: DataFrame, parent_type: str, parent_col: str) -> DataFrame:
    """(file, source_type, source, target_type, relation_type, line_number) from what holds a piece of SQL to the piece: a projection.

    ``fragments`` has path, context and line_start; a piece without a parent has no
    edge.  A method builds the query that stands in it; anything else executes it.
    """
    relation = F.when((F.lit(parent_type) == "pas_method") & (F.lower(F.trim("context")) == "method"), "builds_query").otherwise("executes_query")
    held = fragments.where((F.col(parent_col) != "") & (F.lit(parent_type).isin(*PARENTS)))
    return held.select(F.col("path").alias("file"), F.lit(parent_type).alias("source_type"), F.col(parent_col).alias("source"), F.lit("query_fragment").alias("target_type"), relation.alias("relation_type"), F.col("line_start").alias("line_number")).distinct()

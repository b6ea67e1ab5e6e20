"""Macros, edges and the extractor of each language on small own inputs."""

from pyspark.sql import functions as F

from quarry.operators import edges, forms, sqltext

SQL = "create proc Pay\nas\nAPI_CREATE_PROC(BillPay)\nAPI_INIT_EVENT(Paid, 1)\nAPI_EXEC(x, Check) API_EXEC(Other)\nexec @RetVal = Sub @ProcessID = @GlobalProcessID\n"
PROCEDURES = [("a.t01", "Pay"), ("b.sql", "PAY"), ("c.sql", "Sub")]
CONTRACTS = [("billpay", "callback_event"), ("Paid", "event"), ("Check", "service"), ("Check", "used_service"), ("Other", "service")]


def test_macros(spark):
    files = spark.createDataFrame([("d/a.t01", SQL), ("b.sql", SQL), ("x/loose.sql", "API_INIT_EVENT(Paid)"), ("n.sql", None)], "path string, text string")
    got = {(r.path, r.owner, r.kind, r.name, r.line_number) for r in edges.macros(files).collect()}
    common = {("create_proc", "BillPay", 3), ("init_event", "Paid", 4), ("exec_contract", "Check", 5)}
    assert got == {("b.sql", "Pay", *x) for x in common} | {("d/a.t01", "Pay", *x) for x in common | {("dispatches_to", "Sub", 6)}} | {("x/loose.sql", "loose", "init_event", "Paid", 1)}


def test_macro_edges(spark):
    found = edges.macros(spark.createDataFrame([("a.t01", SQL), ("x.sql", "API_INIT_EVENT(Paid)")], "path string, text string"))
    got = edges.macro_edges(found, spark.createDataFrame(PROCEDURES, "path string, name string"), spark.createDataFrame(CONTRACTS, "name string, kind string"), F.desc("name")).collect()
    assert {(r.source_file, r.source, r.target_kind, r.target, r.relation_type, r.line_number) for r in got} == {
        ("a.t01", "Pay", "callback_event", "billpay", "implements_contract", 3), ("a.t01", "Pay", "event", "Paid", "publishes_event", 4),
        ("a.t01", "Pay", "used_service", "Check", "executes_contract", 5), ("a.t01", "Pay", "procedure", "Sub", "dispatches_to", 6),
    } and len(got) == 4


TPR = "[Fields]\n@Sum@ = Field{src}\n%Date!=Param{1, date}\n%Da!=Param{1, date}\n%Dx!=Param{1, date}\n@Main@ = SQL{\nselect 1 where d = %Date!\n}"
RPT = "object R: TReport\n  Script.Strings = (\n    'Sub One()'\n    'h.Run'\n    'End Sub'\n  )\n  object H: TDsHugeBox\n    Lines.Strings = (\n      'select 1 from t')\n  end\nend\n"


def test_report_edges(spark):
    found = forms.sectioned_reports(spark.createDataFrame([("p/a.tpr", TPR)], "path string, text string")).union(forms.object_reports(spark.createDataFrame([("p/b.rpt", RPT)], "path string, text string")))
    got = {(r.file, r.source_type, r.source, r.target, r.relation_type) for r in edges.report_edges(found).collect()}
    assert got == {
        ("p/a.tpr", "report_form", "a", "Sum", "has_field"), ("p/a.tpr", "report_form", "a", "Date", "has_param"), ("p/a.tpr", "report_form", "a", "Da", "has_param"), ("p/a.tpr", "report_form", "a", "Dx", "has_param"),
        ("p/a.tpr", "query_fragment", "Main", "Date", "uses_param"), ("p/a.tpr", "query_fragment", "Main", "Da", "uses_param"), ("p/b.rpt", "vb_function", "One", "H", "executes_query"),
    }


def test_fragment_edges(spark):
    pieces = spark.createDataFrame([("f.pas", 10, "select 1\nfrom tA"), ("f.pas", 20, "exec pay 1"), ("f.pas", 30, "exec Nobody"), ("g.pas", None, None)], "path string, line_start int, text string")
    got = edges.fragment_edges(pieces, spark.createDataFrame(PROCEDURES, "path string, name string"), F.desc("path"))
    assert {tuple(r) for r in got.collect()} == {("f.pas", 10, "sql_table", "tA", "references_table", 11), ("f.pas", 20, "sql_procedure", "PAY", "calls_procedure", 20)}


def test_every_language(spark):
    files = spark.createDataFrame([("a.sql", "SQL", "select 1 from t"), ("b.h", "h", "#define A 1"), ("c.pas", "PAS", "unit U;"), ("d.x", "UNKNOWN", "select"), ("e.js", "JS", None)], "path string, language string, text string")
    found = edges.by_language(files)
    assert {k: sorted(r.kind for r in v.collect()) for k, v in found.items() if k in ("SQL", "H", "PAS", "JS")} == {"SQL": ["fragment", "table"], "H": ["define"], "PAS": ["unit"], "JS": []}
    assert set(found) == set(edges.EXTRACTORS) and all("path" in v.columns for v in found.values())


def test_subscriber_and_parent_edges(spark):
    text = "create proc Pay\nas\nbegin\nexec Sub\n  @ProcessID = @GlobalProcessID\nend\n\n\n\nexec Sub 1\n"
    files = spark.createDataFrame([("a.t01", text), ("a.sql", text), ("c.sql", "create proc SUB\nas\nselect 1 from t"), ("n.t01", None)], "path string, text string")
    found = sqltext.scripts(files)
    assert [tuple(r) for r in edges.subscriber_edges(files, found, F.desc("path")).collect()] == [("a.t01", "Pay", "SUB", "dispatches_to_subscriber", 4)]
    pieces = spark.createDataFrame([("u.pas", "Load", "method", 5), ("u.pas", "Load", "property", 6), ("u.pas", None, "method", 7)], "path string, method_name string, context string, line_start int")
    assert {(r.source, r.relation_type, r.line_number) for r in edges.parent_edges(pieces, "pas_method", "method_name").collect()} == {("Load", "builds_query", 5), ("Load", "executes_query", 6)}
    assert edges.parent_edges(pieces, "other", "method_name").count() == 0

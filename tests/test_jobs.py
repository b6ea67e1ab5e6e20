"""Job documents on small own inputs."""

from quarry.operators import jobs

JOB = """<?xml version="1.0"?>
<job><description> Loans </description><include><inc-file>a.js</inc-file></include><prequery>select 1 from tX</prequery>
<script><![CDATA[
const MODULE = SHARED_MODULE;
function CreateInstrument() {
  with (Instrument) {
    Name = "Loan";
    DealObjectID = 77;
  }
  Instrument.ModuleID = MODULE;
  Instrument.StartState = "OPEN";
  CreateStateWithSysName("Open", "OPEN");
  State.StateType = PROP_STATETYPE_START;
  CreateStateWithSysName("Open", "OPEN");
  CreateState("Old");
  CreateConsumerTransitionWithSysName("Pay", "PAY", "x", "y");
  Tran.PropVal = CONSUMER_ACTION_PAY;
  Tran.Priority = 3;
  AddClose(Instrument, "CLOSED");
  TypeAccLinkCreate(RESDEP_MAIN, __ACCMASK408__);
}
]]></script><include-server><inc-file>b.js</inc-file></include-server></job>"""
A = "var SHARED_MODULE = 5;\nfunction AddClose(i, s) {\n  if (s) { Transition.Into(\"DONE\"); }\n  Transition.Priority = 9;\n}\n"
B = "SHARED_MODULE = 6\n"


def test_jobs(spark):
    found = jobs.jobs(spark.createDataFrame([("j.smf", JOB), ("n.smf", None), ("e.smf", "<job><script>var x;</script></job>")], "path string, text string"))
    library = jobs.libraries(spark.createDataFrame([("a.js", A), ("b.js", B), ("c.js", "SHARED_MODULE = 7")], "file string, text string"))
    rows = sorted(jobs.resolved(found, library).collect(), key=lambda r: r.ordinal)
    assert {r.path for r in rows} == {"j.smf"} and len(rows) == found.count()
    of = lambda kind: [r for r in rows if r.kind == kind]
    i = of("instrument")[0]
    assert (i.name, i.type, i.start_state, i.deal_object_id, i.module_id) == ("Loan", "instrument_model", "OPEN", 77, 6)
    assert [(r.name, r.sys_name, r.type) for r in of("state")] == [("Open", "OPEN", "PROP_STATETYPE_START"), ("Old", "Old", None)]
    assert [(r.name, r.sys_name, r.goes_into, r.prop_val, r.priority) for r in of("action")] == [("Pay", "PAY", None, "CONSUMER_ACTION_PAY", "3"), ("AddClose", "CLOSED", "DONE", None, "9"), ("TypeAccLinkCreate", "__ACCMASK408__", None, None, None)]
    assert [(r.type, r.name) for r in of("account")] == [("RESDEP_MAIN", "408")] and [r.name for r in of("include")] == ["a.js", "b.js"]
    assert of("prequery")[0].value == "select 1 from tX" and of("description")[0].value == "Loans" and [r.name for r in of("function")] == ["CreateInstrument"]


def test_no_xml():
    rows = jobs.job_rows("<job><script>Instrument.Name = \"A & B\"; CreateTransition(\"Go\");\n.Into(\"X\")</script>")
    assert [(r["kind"], r["name"], r["goes_into"]) for r in rows] == [("instrument", "A & B", None), ("action", "Go", "X")]
    assert jobs.job_rows("<job><script>var x;</script></job>") == []


def test_constants_of_constants_to_the_end(spark):
    script = "\n".join(["Instrument.Name = \"A\";", "Instrument.DealObjectID = C0;", "Instrument.DsModuleID = D0;", *[f"var C{i} = C{i + 1};" for i in range(9)], "var C9 = 77;", "var D0 = D1;", "var D1 = D2;", "var D2 = D0;"])
    found = jobs.jobs(spark.createDataFrame([("a.smf", f"<job><script>{script}</script></job>")], "path string, text string"))
    none = jobs.libraries(spark.createDataFrame([], "file string, text string"))
    got = [r for r in jobs.resolved(found, none).collect() if r.kind == "instrument"]
    assert [(r.deal_object_id, r.module_id) for r in got] == [(77, 0)]

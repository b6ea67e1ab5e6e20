"""SQL scripts, SELECT INTO types and procedure edges on small own inputs."""

import hashlib

from pyspark.sql import functions as F

from quarry.operators import sqltext

INTO = """select i.InstitutionID,
       i.Brief,
       case
         when exists(select 1
                       from tUser u
                      where u.InstUserID = i.InstitutionID
                    ) then 3
         else 4
       end as PropDealPart,
       i.Name,
       isnull(trim(i.Name1), "") as Name1,
       i.MainMember as Resident,
       ia.InDateTime
  into tConsInstitutionSync
  from tInstAttr ia
 inner join tInstitution i
    on i.InstitutionID = ia.InstitutionID
"""


def test_select_into():
    rows = [r for r in sqltext.sql_rows(INTO) if r["kind"] == "column_definition"]
    assert {r["owner"] for r in rows} == {"tConsInstitutionSync"} and {r["value"] for r in rows} == {"DSUNKNOWN"}
    assert [(r["name"], r["source_table"], r["source_column"], r["line_start"], r["position"]) for r in rows] == [
        ("InstitutionID", "tInstitution", "InstitutionID", 1, 1), ("Brief", "tInstitution", "Brief", 2, 2), ("PropDealPart", None, None, 3, 3), ("Name", "tInstitution", "Name", 10, 4),
        ("Name1", "tInstitution", "Name1", 11, 5), ("Resident", "tInstitution", "MainMember", 12, 6), ("InDateTime", "tInstAttr", "InDateTime", 13, 7),
    ]
    target, parts, names = sqltext.select_into(INTO)
    assert target == "tConsInstitutionSync" and len(parts) == 7 and (names["i"], names["ia"]) == ("tInstitution", "tInstAttr")
    assert sqltext.source_column("case when i.Flag = 1 then i.Name else i.Name1 end as Result") is None
    assert sqltext.output_name("i.Name      ,") == "Name" and sqltext.select_into("select a from b") is None


SCRIPT = """#include <base.h>
#define LIMIT 10
create proc DoWork
  @Id DSIDENTIFIER,
  @Sum DSMONEY output
as
begin
  -- select * from tHidden
  insert into pRows (A, B)
  select x.A, 'from tString'
    from tOne x,
         tTwo y

  update tThree set C = 1, D = f(2, 3);
  exec @r = dbo.Other @Id
  M_LOG_TABLE(tLog)
  delete #gone
end
X_ANYMODE(DoWork)
GO
create table tNew
(
  Id   DSIDENTIFIER not null,
  Rate numeric(10, 2),
  constraint pk primary key (Id)
)
GO
alter table tNew add Note DSCOMMENT null
M_ADD_FIELD('tNew', 'Flag DSTINYINT')
create unique index XNew
  on tNew
  (Id, [Rate])
M_CRT_INDEX('UNIQUE','XMacro','tNew','Id')
"""


def by_kind(text):
    out = {}
    for r in sqltext.sql_rows(text):
        out.setdefault(r["kind"], []).append(r)
    return out


def test_script():
    got = by_kind(SCRIPT)
    p = got["procedure"][0]
    body = "\n".join(x.strip() for x in SCRIPT.split("\n")[2:19])
    assert (p["name"], p["line_start"], p["line_end"], p["value"]) == ("DoWork", 3, 19, hashlib.sha256(body.encode()).hexdigest())
    assert [(r["name"], r["value"], r["context"]) for r in got["param"]] == [("Id", "DSIDENTIFIER", "in"), ("Sum", "DSMONEY", "out")]
    assert [(r["name"], r["context"], r["is_temporary"], r["line_start"]) for r in got["table"]] == [
        ("pRows", "insert", True, 9), ("tOne", "select", False, 11), ("tTwo", "select", False, 12), ("tThree", "update", False, 14), ("tLog", "log", False, 16), ("#gone", "delete", True, 17), ("tNew", "create", False, 21),
    ]
    assert [(r["name"], r["owner"], r["line_start"]) for r in got["column"]] == [("A", "pRows", 9), ("B", "pRows", 9), ("A", "tOne", 10), ("C", "tThree", 14), ("D", "tThree", 14)]
    assert [(r["name"], r["owner"]) for r in got["call"]] == [("Other", "DoWork")]
    assert [(r["name"], r["value"], r["context"], r["position"], r["line_start"]) for r in got["column_definition"]] == [
        ("Id", "DSIDENTIFIER", "create_table", 1, 23), ("Rate", "numeric(10", "create_table", 2, 24), ("Note", "DSCOMMENT", "alter_add", 0, 28), ("Flag", "DSTINYINT", "macro_add_field", 0, 29),
    ]
    assert [(r["name"], r["context"], r["value"], r["line_start"]) for r in got["index"]] == [("XNew", "create_index", "unique", 30), ("XMacro", "macro_create_index", "UNIQUE", 33)]
    assert [(r["name"], r["owner"], r["position"]) for r in got["index_field"]] == [("Id", "XNew", 1), ("Rate", "XNew", 2), ("Id", "XMacro", 1)]
    assert got["include"][0]["name"] == "base.h" and got["define"][0]["value"] == "10"
    first = got["fragment"][0]
    assert first["context"] == "sql_procedure_statement" and first["line_start"] == 9 and first["value"].startswith("insert into pRows")


def test_odd(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (4, "__BEGIN_PROCEDURE__(P)\nselect 1 from t")], "id int, text string")
    rows = sqltext.scripts(df).collect()
    assert {r.id for r in rows} == {4} and {(r.kind, r.name, r.line_end) for r in rows} == {("procedure", "P", 2), ("fragment", "P", 2), ("table", "t", 2)}
    inner = spark.createDataFrame([(7, "select 1\nfrom tA"), (None, "select 1 from tB")], "line_start int, text string")
    assert {(r.name, r.line_start) for r in sqltext.fragment_tables(inner).collect()} == {("tA", 8), ("tB", 1)}


def test_types(spark):
    found = sqltext.scripts(spark.createDataFrame([("a.sql", INTO)], "path string, text string")).where("kind = 'column_definition'")
    known = spark.createDataFrame([("TINSTITUTION", "brief", "DSOLD", 1), ("tInstitution", "Brief", "DSBRIEF", 2), ("tInstitution", "Name", "", 3)], "owner string, name string, value string, id int")
    got = {r.name: r.value for r in sqltext.typed(found, known, F.desc("id")).collect()}
    assert len(got) == 7 and got["Brief"] == "DSBRIEF" and got["Name"] == "DSUNKNOWN"


def test_edges(spark):
    files = [("a.sql", SCRIPT), ("b.sql", "create proc Other\nas\nselect 1 from tSix\nX_ANYMODE(Other)"), ("c.sql", "create proc OTHER\nas\nexec Nobody\nX_ANYMODE(OTHER)"), ("d.sql", None)]
    found = sqltext.scripts(spark.createDataFrame(files, "path string, text string"))
    edges = sqltext.procedure_edges(found, "path", F.desc("path"))
    got = {(r.source_file, r.source, r.target_file, r.target, r.relation_type, r.line_number) for r in edges.collect()}
    assert ("a.sql", "DoWork", "c.sql", "OTHER", "calls_procedure", 15) in got and ("b.sql", "Other", "b.sql", "tSix", "selects_from", 3) in got
    assert {x[3] for x in got if x[0] == "a.sql"} == {"OTHER", "pRows", "tOne", "tTwo", "tThree", "tLog", "#gone"} and not any(x[3] == "Nobody" for x in got)

"""Forms, reports, interface documents and answer summaries on small own inputs."""

from quarry.operators import envelope, forms

FORM = """object Main: TMain
  Caption = 'It''s'#32'me'
  { Caption = 'no' }
  object Grid: TGrid
    Name = 'Grid1'
    Columns = <
      item
        Name = 'Col'
        Filter = 'select a from t_orders'
      end
      item
      end>
    object Q: TQuery
      SQL.Strings = (
        'select *'
        'from t_items where x = ''y''')
    end
  end
  Hint = 'plain words'
end
object Second: TOther
end
"""


def test_forms(spark):
    rows = forms.forms(spark.createDataFrame([(1, FORM), (2, None), (3, "")], "id int, text string")).collect()
    assert {r.id for r in rows} == {1}
    got = [(r.kind, r.name, r.type, r.parent, r.line_start, r.line_end) for r in sorted(rows, key=lambda r: r.ordinal)]
    assert got == [
        ("query", "Col", "StrArrayItem", None, 9, 9), ("query", "Q", "TQuery", None, 14, 16), ("component", "Q", "TQuery", "Grid1", 13, 17),
        ("component", "Grid1", "TGrid", "Main", 4, 18), ("form", "Main", "TMain", None, 1, 20),
    ]
    by = {(r.kind, r.name): r for r in rows}
    assert by["form", "Main"].caption == "It's me" and by["query", "Q"].text == "select *\nfrom t_items where x = 'y'" and by["query", "Q"].form == "Main"


def test_unended_form():
    assert [(r["kind"], r["name"], r["line_end"]) for r in forms.form_rows("inherited A: TA\n  object B: TB\n  Caption = 'x'\n")] == [("form", "A", 3)]
    assert forms.form_rows("words only\n") == []


def test_sql_tables(spark):
    rows = forms.tables(spark.createDataFrame([("select 1 from tOrders a join #tmp1 b, x; delete from torders; insert into pRes select * from where",)], "text string")).collect()
    assert [(r.name, r.is_temporary, r.column_number) for r in rows] == [("tOrders", False, 15), ("#tmp1", True, 30), ("pRes", True, 75)]


TPR = """[Fields]
@Sum@ = Field{src, 0.00, , right, bold}
[Other]
@Late@ = Field{no}
%Date!=Param{1, date, 3, tab, col, key, 6, 7, 8, today}
@Main@ = SQL{
#include <inc.sql>
select 1
}
@Open@ = SQL{
select 2"""


def test_sectioned_reports(spark):
    rows = forms.sectioned_reports(spark.createDataFrame([(TPR,)], "text string")).orderBy("ordinal").collect()
    assert [(r.kind, r.name, r.line_start, r.line_end) for r in rows] == [
        ("form", None, 1, 11), ("field", "Sum", 2, 2), ("param", "Date", 5, 5), ("fragment", "Main", 6, 9), ("include", "inc.sql", 6, 6), ("fragment", "Open", 10, 11),
    ]
    assert (rows[1].source, rows[1].mask, rows[1].options) == ("src", "0.00", ["right", "bold"])
    assert (rows[2].data_type, rows[2].lookup_table, rows[2].lookup_column, rows[2].key_column, rows[2].default_value) == ("date", "tab", "col", "key", "today")
    assert rows[5].text == "select 2"


RPT = """object R: TReport
  Script.Strings = (
    'Sub One()'
    '  x = ''a'''
    'End Sub'
    'Function Two(n)'
    ')'
  )
  object D: TComboBox
    Required = True
    Mask = '00''0'
    DataType = 'int'
  end
  object H: TDsHugeBox
    Lines.Strings = (
      'select 1'
      'from t')
  end
end
"""


def test_object_reports(spark):
    rows = forms.object_reports(spark.createDataFrame([(RPT,)], "text string")).orderBy("ordinal").collect()
    assert [(r.kind, r.name, r.type, r.line_start, r.line_end) for r in rows] == [
        ("form", "R", "TReport", 1, 19), ("function", "One", "sub", 3, 5), ("function", "Two", "function", 6, 7), ("param", "D", "TComboBox", 9, 9), ("fragment", "H", "TDsHugeBox", 15, 17),
    ]
    assert rows[1].text == "Sub One()\n  x = 'a'\nEnd Sub" and (rows[3].required, rows[3].default_value, rows[3].data_type) == (True, "00'0", "int")
    assert (rows[4].text, rows[4].context) == ("select 1\nfrom t", "rpt_named_sql")
    names = spark.createDataFrame([("a/b.c/Rep.v1.rpt",), ("x",)], "path string").select(forms.base_name("path")).collect()
    assert [r[0] for r in names] == ["Rep.v1", "x"]


SERVICE = """<?xml version="1.0" encoding="windows-1251"?>
<Object><ObjectName> Pay </ObjectName><ObjectTypeID>3</ObjectTypeID><FullDescription>Оплата</FullDescription>
<InputParams><Param><ParamOrder>1</ParamOrder><ParamName>Sum</ParamName><TypeName>money</TypeName><Required>1</Required></Param></InputParams>
<OutputTables><Table><ParamName>T</ParamName><Fields><Param><ParamName>F</ParamName></Param></Fields></Table></OutputTables>
<ReturnValues><ReturnValue><Value>0</Value><ReturnType>2</ReturnType></ReturnValue></ReturnValues>
<Contexts><Context><ContextName>C</ContextName><ContextOrder>x</ContextOrder></Context></Contexts></Object>"""
STANDALONE = "<Table><ParamName>T</ParamName><Indexses><Index><IndexName>I</IndexName><IsClustered>1</IsClustered><FieldList><Field><FieldName>a</FieldName></Field><Field><FieldName>b</FieldName></Field></FieldList></Index></Indexses></Table>"


def test_interfaces(spark):
    data = [
        ("m/Core/DSArchitectData/BObject/Bill/Service/Pay.xml", SERVICE), ("m/Core/DSArchitectData/BObject/Bill/Table/T.xml", STANDALONE), ("m/other/Pay.xml", SERVICE),
        ("m/Core/DSArchitectData/x.xml", "<message/>"), ("m/Core/DSArchitectData/y.xml", "<Object>"), ("m/Core/DSArchitectData/UsedService/z.xml", None),
    ]
    rows = forms.interfaces(spark.createDataFrame(data, "path string, text string")).orderBy("path", "ordinal").collect()
    assert [(r.kind, r.name) for r in rows] == [
        ("business_object", "Bill"), ("contract", "Pay"), ("param", "Sum"), ("table", "T"), ("table_field", "F"), ("return_value", "0"), ("context", "C"),
        ("object_table", "T"), ("object_table_index", "I"), ("object_table_index_field", "a"), ("object_table_index_field", "b"), ("error", None),
    ]
    contract, param, table = rows[1:4]
    assert (contract.type_name, contract.module, contract.description, contract.attributes["ObjectTypeID"]) == ("service", "Core", "Оплата", "3")
    assert (param.direction, param.type_name, param.required, param.position) == ("input", "money", True, 1) and table.direction == "output"
    assert rows[6].position == 0 and rows[8].attributes["IsClustered"] == "true" and [r.position for r in rows[9:11]] == [0, 1]


def test_summary(spark):
    df = spark.createDataFrame([("proc", "calls", "a", "f1", "table"), ("proc", "", "b", "f1", None), (None, "reads", "a", "f2", "table")], "type string, relation_type string, source_name string, source_file string, target_type string")
    got = envelope.summary(df).first().asDict()
    assert got == {"count": 3, "kinds": {"proc": 2}, "relation_types": {"calls": 1, "reads": 1}, "source_types": None, "target_types": {"table": 2}, "files": 2, "distinct_targets": 2}
    assert envelope.summary(df.where("false")).first().asDict() == {"count": 0, "kinds": None, "relation_types": None, "source_types": None, "target_types": None, "files": 0, "distinct_targets": 0}
    assert envelope.summary(spark.range(4)).first()["count"] == 4

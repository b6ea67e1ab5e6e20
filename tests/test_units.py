"""Pascal units on small own inputs."""

from quarry.operators import units

TWO = """unit AdmCmd;

interface

uses SysUtils, Classes;

type
  TAdmCmd = class
  private
    FName, FBrief: string;
  public
    procedure Execute;
    property Q: string read FQ; { 'select a from tNo' }
  end; { TAdmCmd }

  TForward = class;

  TChangePasswordAdmCmd = class(TAdmCmd)
  public
    function GetParamValues(const A: Integer;
      B: string): Boolean;
  end; { TChangePasswordAdmCmd }

procedure Free;

implementation

uses DB in 'DB.pas';

const
  QR_TEXT =
      '#M_FORCEPLAN '
    + 'select ID '
    + '  from tConfigParam '
    + ' where SysName = ''x''';

procedure TAdmCmd.Execute;
  procedure Nested;
  begin
  end;
var
  R: record A: Integer; end;
begin
  if True then begin Qr.SQL.Text := QR_TEXT; end;
end;

function TChangePasswordAdmCmd.GetParamValues(const A: Integer; B: string): Boolean;
begin
  Qr.SQL.Add('update tOne');
  Qr.SQL.Add('set a = 1');
  Qr.ExecSQL;
  s := 'delete from #tmp';
  Show('plain words');
  Run('select 1 from tTwo');
end;

end.
"""


def test_units(spark):
    rows = units.units(spark.createDataFrame([(1, TWO), (2, None), (3, "")], "id int, text string")).collect()
    assert {r.id for r in rows} == {1}
    of = lambda kind: [r for r in sorted(rows, key=lambda r: r.ordinal) if r.kind == kind]
    assert [(r.name, r.line_end) for r in of("unit")] == [("AdmCmd", len(TWO.split("\n")))]
    assert [(r.name, r.context) for r in of("uses")] == [("SysUtils", "interface"), ("Classes", "interface"), ("DB", "implementation")]
    assert [(r.name, r.type, r.line_start, r.line_end) for r in of("class")] == [("TAdmCmd", "", 8, 14), ("TForward", "", 16, 16), ("TChangePasswordAdmCmd", "TAdmCmd", 18, 22)]
    assert [(r.name, r.type, r.visibility) for r in of("field")] == [("FName", "string", "private"), ("FBrief", "string", "private")]
    assert [(r.class_name, r.name, r.context, r.line_start) for r in of("method")] == [
        ("TAdmCmd", "Execute", "class", 12), ("TChangePasswordAdmCmd", "GetParamValues", "class", 20), ("TAdmCmd", "Execute", "implementation", 37), ("TChangePasswordAdmCmd", "GetParamValues", "implementation", 47),
    ]
    assert of("method")[1].value == "function GetParamValues(const A: Integer; B: string): Boolean;"
    assert [(r.method_name, r.value, r.line_start) for r in of("fragment")] == [
        ("Execute", "#M_FORCEPLAN select ID   from tConfigParam  where SysName = 'x'", 44), ("GetParamValues", "update tOne\nset a = 1", 49),
        ("GetParamValues", "delete from #tmp", 52), ("GetParamValues", "select 1 from tTwo", 54),
    ]
    assert [(r.name, r.is_temporary) for r in of("table")] == [("tConfigParam", False), ("tOne", False), ("#tmp", True), ("tTwo", False)]


def test_unended():
    rows = units.unit_rows("implementation\nprocedure P;\nbegin\n  Q.Query := 'exec Proc';\n  { open comment")
    assert [(r["kind"], r["value"]) for r in rows if r["kind"] == "fragment"] == [("fragment", "exec Proc")]
    assert units.unit_rows("words only") == []

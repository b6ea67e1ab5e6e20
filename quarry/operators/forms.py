"""Extractors for form, report and interface documents: forms with their component trees, two report layouts, interface XML.

Each is a function of a text (interfaces also need its path), applied in Arrow
batches and exploded by ``extract``.  Line numbers start at 1; a null or empty
text gives no rows.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import extract, extract_by_path
from .words import Words, first_name, included, quoted

FORM = "struct<kind:string,name:string,type:string,form:string,parent:string,caption:string,text:string,line_start:int,line_end:int>"
REPORT = (
    "struct<kind:string,name:string,type:string,source:string,mask:string,options:array<string>,data_type:string,lookup_form:string,lookup_table:string,"
    "lookup_column:string,key_column:string,default_value:string,required:boolean,text:string,context:string,line_start:int,line_end:int>"
)
INTERFACE = (
    "struct<kind:string,business_object:string,module:string,name:string,parent:string,direction:string,type_name:string,ws_name:string,rus_name:string,"
    "description:string,position:int,required:boolean,attributes:map<string,string>>"
)
TABLE = "struct<name:string,is_temporary:boolean,column_number:int>"

_ID = r"[A-Za-z_#][A-Za-z0-9_#]*"

# Words that stand in SQL alone, in pairs, before a name; words before a table's name; words that are no table's name (the set is prescribed).
ALONE = {"where", "having", "union"}
PAIRS = {("insert", "into"), ("delete", "from"), ("group", "by"), ("order", "by"), ("create", "table"), ("alter", "table"), ("drop", "table")}
NAMED = {"from", "join", "exec", "execute"}
TABLE_FOLLOWS = {"from", "join", "into", "update"}
NO_TABLE = set(
    "a all and as b begin by c case d declare delete distinct e else end exec for from group having if in inner insert into is join left like not null on or"
    " order outer return right select set t table temp then tmp union update values when where while".split()
)


def _is_name(word: str) -> bool:
    return word[0].isalpha() or word[0] in "_#"


def reads_like_sql(text: str) -> bool:
    """Whether some statement or clause of SQL stands in the text."""
    words = [w.text.lower() for w in Words(text)] + [" ", " "]
    for i, (a, b, c) in enumerate(zip(words, words[1:], words[2:])):
        if a in ALONE or (a, b) in PAIRS or (a in NAMED and _is_name(b)) or (a == "update" and _is_name(b) and c == "set"):
            return True
        if (a == "declare" and b[0] == "@") or (a == "select" and "from" in words[i:]):
            return True
    return False


def sql_tables(text: str) -> list[dict]:
    """Tables that a piece of SQL names, each once, without regard to case; the column counts bytes from 1."""
    text, found = text.replace("''", "'"), {}
    words = Words(text)
    for before, word in zip(words, words[1:]):
        name = re.match(_ID, word.text, re.A)
        if before.text.lower() in TABLE_FOLLOWS and name and name[0].lower() not in NO_TABLE:
            found.setdefault(name[0].lower(), dict(name=name[0], is_temporary=name[0][0] in "pP#", column_number=len(text[: word.at].encode()) + 1))
    return list(found.values())


def tables(df: DataFrame, text_col: str = "text") -> DataFrame:
    return extract(df, text_col, sql_tables, TABLE)


# --- forms -------------------------------------------------------------------------------------

# The lines of a form.
_OBJECT = re.compile(rf"(?:object|inherited)\s+({_ID.replace('#', '')})\s*:\s*({_ID.replace('#', '')})", re.I | re.A)
_OPENS = re.compile(r"[A-Za-z_][\w.]*\s*=\s*<$", re.A)
_LIST = re.compile(r"(?:Lines(?:\.Strings)?|SQL\.Strings)\s*=\s*\(", re.I)
_PROPERTY = re.compile(r"([A-Za-z_][\w.]*)\s*=\s*(.+)$", re.A | re.S)
_PART = re.compile(r"'((?:[^']|'')*)'?|#(\d*)|([^'#]+)")


def literal(raw: str) -> str:
    """A property's string: quoted pieces, and characters by number as ``#NNN``."""
    out = []
    for quoted, code, other in _PART.findall(raw.strip()):
        out.append(quoted.replace("''", "'") or (chr(int(code)) if code and 0 < int(code) < 0x110000 else "") or other)
    return "".join(out).strip()


def form_rows(text: str) -> list[dict]:
    """The form (first root), its components as they end, and the queries among string lists and properties.

    Lines with ``{…}`` are comments.  A collection's items are of type
    StrArrayItem and have the name that they give, else their object's.  A form
    that does not end ends with the text.
    """
    rows: list[dict] = []
    frames: list[dict] = []  # kind: object, collection or item
    pending: dict | None = None  # a string list being read
    roots = number = 0

    def row(kind, name, type_, start, end, **more):
        rows.append(dict(dict(form=None, parent=None, caption=None, text=None), kind=kind, name=name, type=type_, line_start=start, line_end=end, **more))

    def objects() -> list[dict]:
        return [f for f in frames if f["kind"] == "object"]

    def query(sql: str, start: int, end: int, owner: tuple[str, str]) -> None:
        if sql and reads_like_sql(sql):
            around = objects()
            row("query", *owner, start, end, form=around[0]["name"] if around else None, text=sql)

    def owner() -> tuple[str, str]:
        inner = frames[-1] if frames and frames[-1]["kind"] == "item" else None
        around = objects()
        last = around[-1] if around else dict(name="", type="")
        return (inner["name"] or last["name"], "StrArrayItem") if inner else (last["name"], last["type"])

    def close_list(at: int) -> None:
        nonlocal pending
        if pending:
            query("\n".join(pending["lines"]).strip(), pending["start"], at, pending["owner"])
        pending = None

    def end(at: int) -> None:
        close_list(at)
        if not frames or frames[-1]["kind"] == "collection":
            return
        f = frames.pop()
        if f["kind"] == "object" and f["root"] == 1:
            around = objects()
            if around:
                row("component", f["name"], f["type"], f["start"], at, form=around[0]["name"], parent=f["parent"], caption=f["caption"])
            else:
                row("form", f["name"], f["type"], f["start"], at, form=f["name"], caption=f["caption"])

    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        low = line.lower()
        if not line or re.search(r"\{[^}]*\}", line):
            continue
        if m := _OBJECT.match(line):
            around = objects()
            roots += not around
            frames.append(dict(kind="object", name=m[1], type=m[2], parent=around[-1]["name"] if around else "", caption="", start=number, root=roots))
        elif _OPENS.match(line):
            frames.append(dict(kind="collection"))
        elif pending is None and low == "item" and frames and frames[-1]["kind"] == "collection":
            frames.append(dict(kind="item", name=""))
        elif low in ("end", "end>", ">"):
            if low != ">":
                end(number)
            if low != "end":
                while frames and frames[-1]["kind"] == "item":
                    frames.pop()
                if frames and frames[-1]["kind"] == "collection":
                    frames.pop()
        elif pending is not None:
            strings, rest = quoted(line)
            pending["lines"] += [s for s in strings if s]
            if ")" in rest:
                close_list(number)
        elif _LIST.match(line):
            pending = dict(lines=[], start=number, owner=owner())
        elif m := _PROPERTY.match(line):
            name, value = m[1].lower(), m[2].strip()
            holder = frames[-1] if frames else {}
            if name == "name" and (n := re.match(r"""['"]([^'"]+)['"]""", value)):
                if "name" in holder:
                    holder["name"] = n[1]
            elif name == "caption":
                if holder.get("kind") == "object":
                    holder["caption"] = literal(value)
            elif name != "name" and "'" in value:
                query(literal(value), number, number, owner())
    close_list(number)
    around = objects()
    if around and around[0]["root"] == 1:
        f = around[0]
        row("form", f["name"], f["type"], f["start"], number, form=f["name"], caption=f["caption"])
    return rows


def forms(df: DataFrame, text_col: str = "text") -> DataFrame:
    return extract(df, text_col, form_rows, FORM)


# --- reports -----------------------------------------------------------------------------------

# The forms of a report's lines, and which place of a parameter's list holds what.
PLACES = {"data_type": 1, "lookup_table": 3, "lookup_column": 4, "key_column": 5, "default_value": 9}
CONTROLS = {"dsdatetimepicker", "dsformlookup", "tcheckbox", "tmaskedit", "tcombobox"}
SETTINGS = {"LookupForm": "lookup_form", "FieldName": "lookup_column", "DataType": "data_type", "PortName.DataType": "data_type", "Mask": "default_value"}
ROUTINES = ("sub", "function")


def _setting(line: str) -> tuple[str, str] | None:
    """(name, value) of ``name = value``, the name with dots."""
    name, equals, value = line.partition("=")
    name = name.strip()
    return (name, value.strip()) if equals and name and all(c.isascii() and (c.isalnum() or c in "._") for c in name) else None


def _control(line: str) -> tuple[str, str] | None:
    """(name, class) of ``object name: class``."""
    word, _, rest = line.strip().partition(" ")
    name, colon, kind = rest.partition(":")
    found = first_name(name), first_name(kind)
    return found if word.lower() == "object" and colon and all(found) and found[0] == name.strip() else None


def _routine(line: str) -> tuple[str, str] | None:
    """(kind, name) of the line that begins a routine."""
    word, _, rest = line.strip().replace("\t", " ").partition(" ")
    name = first_name(rest)
    return (word.lower(), name) if word.lower() in ROUTINES and name else None


def _report_row(kind: str, name: str | None, start: int, end: int | None = None, **more) -> dict:
    keys = "type source mask options data_type lookup_form lookup_table lookup_column key_column default_value required text context".split()
    return dict.fromkeys(keys) | dict(kind=kind, name=name, line_start=start, line_end=end or start) | more


def _entry(line: str) -> tuple[str, str, str, str] | None:
    """(mark, name, kind, what the brace holds so far) of a line ``@name@ = Kind{...`` or ``%name!=Kind{...``."""
    mark = line.strip()
    close = mark.find({"@": "@", "%": "!"}.get(mark[:1], "\0"), 1)
    if close < 2:
        return None
    equals, kind = mark[close + 1 :].lstrip()[:1], mark[close + 1 :].lstrip()[1:].lstrip()
    kind, brace, body = kind.partition("{")
    return (mark[0], mark[1:close].strip(), kind.strip(), body) if equals == "=" and brace else None


def _places(body: str) -> list[str]:
    return [p.strip() for p in body.split(",") if p.strip()]


def sectioned_report_rows(text: str) -> list[dict]:
    """Fields, parameters, SQL blocks and their includes of a report in sections; blanks in a list of places do not count."""
    lines = text.splitlines()
    rows, in_fields, at = [_report_row("form", None, 1, len(lines), type="tpr")], False, 0
    while at < len(lines):
        line, number = lines[at], at + 1
        at += 1
        mark = line.strip()
        if mark.startswith("[") and mark.endswith("]"):
            in_fields = mark.lower() == "[fields]"
        elif mark == "&&":
            in_fields = False
        sign, name, kind, body = _entry(line) or ("", "", "", "")
        whole = body.endswith("}")
        if sign == "@" and kind == "SQL" and not body.strip():
            end = next((i for i in range(at, len(lines)) if lines[i].strip() == "}"), len(lines))
            rows.append(_report_row("fragment", name, number, min(end + 1, len(lines)), type="TPR_SQL_BLOCK", text="\n".join(lines[at:end]).strip(), context="tpr_sql_block"))
            rows += [_report_row("include", i.strip(), number + k) for k, part in enumerate(lines[at:end]) for i in included(part)]
            at = end + 1
        elif in_fields and sign == "@" and kind == "Field" and whole:
            parts = _places(body[:-1])
            rows.append(_report_row("field", name, number, source=next(iter(parts), None), mask=next(iter(parts[1:]), None), options=parts[2:], text=mark))
        elif sign == "%" and kind == "Param" and whole:
            parts = _places(body[:-1])
            rows.append(_report_row("param", name, number, type="tpr_param", text=mark, **{k: parts[i] for k, i in PLACES.items() if i < len(parts)}))
    return rows


def _routines(script: list[str], first: int) -> Iterator[dict]:
    starts = [(i, m) for i, line in enumerate(script) if (m := _routine(line))]
    for (i, m), stop in zip(starts, [i for i, _ in starts[1:]] + [len(script)]):
        yield _report_row("function", m[1], first + i, first + stop - 1, type=m[0], source=script[i].strip(), text="\n".join(script[i:stop]))


def object_report_rows(text: str) -> list[dict]:
    """The form, parameter controls with their settings, routines and SQL lists of a report made of objects.

    A routine's lines count the script's strings from the line after its start;
    each routine has one row.
    """
    lines = text.splitlines()
    form = _report_row("form", None, 1, len(lines), context="rpt")
    rows, name, kind, param = [form], "", "", None
    reading, strings, start = None, [], 0

    def close(at: int) -> None:
        nonlocal reading
        if reading == "script":
            rows.extend(_routines(strings, start + 1))
        elif reading == "list" and (sql := "\n".join(strings).strip()):
            rows.append(_report_row("fragment", name, start, at, type=kind, text=sql, context="rpt_named_sql" if kind == "TDsHugeBox" else "rpt_textbox_sql"))
        reading = None

    for number, line in enumerate(lines, 1):
        mark = line.strip()
        low = mark.lower()
        if m := _control(line):
            close(number)
            name, kind = m
            if form["name"] is None:
                form.update(name=name, type=kind)
            if kind.lower() in CONTROLS:
                param = _report_row("param", name, number, type=kind, required=False, text=mark, context="rpt_control")
                rows.append(param)
        elif low == "end":
            close(number)
        elif reading:
            more, rest = quoted(line)
            strings += more
            if ")" in rest:
                close(number)
        elif m := re.search(r"(script|lines|sql)\.strings = \(", low):
            reading, strings, start = "script" if m[1] == "script" else "list", [], number
        elif param and (m := _setting(line)):
            key, value = m
            if key == "Required":
                param["required"] = value.lower() == "true"
            elif key in SETTINGS:
                param[SETTINGS[key]] = value.strip("'").replace("''", "'")
    close(len(lines))
    return rows


def sectioned_reports(df: DataFrame, text_col: str = "text") -> DataFrame:
    return extract(df, text_col, sectioned_report_rows, REPORT)


def object_reports(df: DataFrame, text_col: str = "text") -> DataFrame:
    return extract(df, text_col, object_report_rows, REPORT)


def base_name(path: Column | str) -> Column:
    """A report's name: its file's, without folders and the last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


# --- interface documents -----------------------------------------------------------------------

# Folders and their kinds, root elements without rows, elements of each part.
FOLDER = "/DSArchitectData/"
KINDS = {"Service": "service", "Event": "event", "Table": "api_table", "Param": "api_param"}
OTHER_KINDS = {"UsedService": "used_service", "CallbackEvent": "callback_event"}
NO_ROWS = {"message", "fasdocument"}
CHARSETS = {"windows-1251", "cp1251", "windows1251", "utf-8", "utf8", ""}
CONTRACT = "ObjectTypeID ObjectNameID APIVersion ArchApproval Implemented InternalUse Deprecated IsExternal UsedObjectName UsedModuleSysName ShortDescription".split()


def classify(path: str) -> tuple[str, str]:
    """(kind, business object) by the folders of a path."""
    parts = path.replace("\\", "/").split("/")
    for part, name, kind in zip(parts, [*parts[1:], ""], [*parts[2:], "", ""]):
        if part == "BObject" and kind in KINDS:
            return KINDS[kind], name
        if part in OTHER_KINDS:
            return OTHER_KINDS[part], ""
    return "xml", ""


def interface_rows(path: str, text: str) -> list[dict]:
    """Contracts with parameters, tables, fields, return values and contexts, or a table or parameter that stands alone.

    Paths outside the interface folder have no rows; a text that is no XML, of
    another root element or in an unknown charset has one row of kind ``error``.
    """
    path = path.replace("\\", "/")
    if FOLDER not in path or not text.strip():
        return []
    kind, owner = classify(path)
    module = path[: path.index(FOLDER)].strip("/").rpartition("/")[2]
    rows: list[dict] = []

    def row(kind_, name, **more):
        empty = dict.fromkeys("parent direction type_name ws_name rus_name description position required attributes".split())
        rows.append(empty | dict(kind=kind_, business_object=owner, module=module, name=name) | more)

    def value(e: ET.Element, tag: str) -> str:
        return (e.findtext(f"{{*}}{tag}") or "").strip()

    def number(e: ET.Element, tag: str) -> int:
        return int(v) if re.fullmatch(r"[+-]?\d+", v := value(e, tag), re.A) else 0

    def named(e: ET.Element, **more) -> dict:
        return dict(type_name=value(e, "TypeName"), ws_name=value(e, "WsParamName"), rus_name=value(e, "RusName"), description=value(e, "Description")) | more

    def error(message: str) -> list[dict]:
        rows.clear()
        row("error", None, description=message)
        return rows

    declared = re.match(r"""\s*<\?xml[^>]*encoding\s*=\s*["']([^"']*)""", text)
    if declared and declared[1].strip().lower() not in CHARSETS:
        return error(f"unsupported charset {declared[1]}")
    try:
        root = ET.fromstring(re.sub(r"^\s*(?:﻿)?\s*<\?xml.*?\?>", "", text, flags=re.S))
    except ET.ParseError as e:
        return error(str(e))
    tag = root.tag.rpartition("}")[2]
    if tag.lower() in NO_ROWS:
        return []
    alone = "/BObject/" in path and next((t for t in ("Table", "Param") if f"/{t}/" in path), None)
    if tag != (alone or "Object"):
        return error(f"unexpected element {tag}")

    def members(part: str, e: ET.Element = root) -> list[ET.Element]:
        return e.findall("/".join(f"{{*}}{p}" for p in part.split("/")))

    name = value(root, "ParamName")
    if alone == "Param":
        row("object_param", name, **named(root), attributes={"PrmSubObject": value(root, "PrmSubObject")})
    elif alone == "Table":
        row("object_table", name, **named(root))
        for f in members("Fields/Field"):
            row("object_table_field", value(f, "ParamName"), parent=name, **named(f), position=number(f, "ParamOrder"))
        for i in members("Indexses/Index"):
            index = value(i, "IndexName")
            row("object_table_index", index, parent=name, attributes={"IndexFields": value(i, "IndexFields"), "IndexType": str(number(i, "IndexType")), "IsClustered": str(number(i, "IsClustered") != 0).lower()})
            for k, f in enumerate(members("FieldList/Field", i)):
                row("object_table_index_field", value(f, "FieldName"), parent=index, position=k, attributes={"Table": name})
    else:
        if owner:
            row("business_object", owner)
        contract = value(root, "ObjectName")
        row("contract", contract, type_name=kind, description=value(root, "FullDescription"), attributes={k: value(root, k) for k in CONTRACT})
        for direction in ("Input", "Output"):
            way = dict(direction=direction.lower())
            for p in members(f"{direction}Params/Param"):
                more = {"PrmSubObject": value(p, "PrmSubObject"), "IsVirtualLink": str(number(p, "IsVirtualLink") != 0).lower()}
                row("param", value(p, "ParamName"), parent=contract, **named(p), **way, position=number(p, "ParamOrder"), required=number(p, "Required") != 0, attributes=more)
            for t in members(f"{direction}Tables/Table"):
                row("table", value(t, "ParamName"), parent=contract, **named(t), **way, position=number(t, "ParamOrder"), required=number(t, "Required") != 0)
                for f in members("Fields/Param", t):
                    row("table_field", value(f, "ParamName"), parent=value(t, "ParamName"), **named(f), **way, position=number(f, "ParamOrder"), required=number(f, "Required") != 0)
        for r in members("ReturnValues/ReturnValue"):
            row("return_value", value(r, "Value"), parent=contract, description=value(r, "Description"), attributes={"ReturnType": str(number(r, "ReturnType"))})
        for c in members("Contexts/Context"):
            more = {"ContextValue": value(c, "ContextValue"), "IsVirtualLink": str(number(c, "IsVirtualLink") != 0).lower()}
            row("context", value(c, "ContextName"), parent=contract, **named(c), position=number(c, "ContextOrder"), attributes=more)
    return rows


def interfaces(df: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    return extract_by_path(df, path_col, text_col, interface_rows, INTERFACE)

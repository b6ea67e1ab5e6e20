"""Pascal units: the unit with what it uses, classes, methods, fields, and the SQL that method bodies build, with its tables.

``unit_rows`` is a function of a text, applied in Arrow batches and exploded by
``extract``.  Line numbers start at 1; a null or empty text gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .extract import extract
from .forms import reads_like_sql, sql_tables

UNIT = (
    "struct<kind:string,name:string,class_name:string,method_name:string,type:string,value:string,visibility:string,context:string,is_temporary:boolean,"
    "line_start:int,line_end:int>"
)

# The words and forms of a unit.
_COMMENT = re.compile(r"'(?:[^'\n]|'')*'|\{.*?(?:\}|\Z)|\(\*.*?(?:\*\)|\Z)|//[^\n]*", re.S)
_STRING = re.compile(r"'(?:[^'\n]|'')*'")
_SECTION = re.compile(r"^\s*(interface|implementation|initialization|finalization)\s*$", re.I | re.M)
_HEAD = re.compile(r"^\s*unit\s+([\w.]+)\s*;", re.I | re.M)
_USES = re.compile(r"^\s*uses\b([^;]*);", re.I | re.M)
_CLASS = re.compile(r"\s*(\w+)\s*(?:<[^=]*>)?\s*=\s*(?:packed\s+)?(class|object|record)\b(?!\s+of\b)\s*(?:\(([^)]*)\))?\s*(;?)", re.I)
_VISIBLE = re.compile(r"\s*(?:strict\s+)?(private|protected|public|published)\b", re.I)
_ROUTINE = re.compile(r"\s*(?:class\s+)?(procedure|function|constructor|destructor)\s+([\w.]+)", re.I)
_FIELD = re.compile(r"\s*(\w+(?:\s*,\s*\w+)*)\s*:\s*([^;=]+?)\s*(?:;|$)")
_NO_FIELD = re.compile(r"\s*(?:property|case|const|type|var)\b", re.I)
_BLOCK = re.compile(r"\b(begin|case|try|asm|record|end)\b", re.I)
_PIECE = r"(?:'(?:[^'\n]|'')*'|#\d+|[A-Za-z_]\w*)"
_EXPRESSION = re.compile(rf"{_PIECE}(?:\s*\+\s*{_PIECE}|(?<=')\s*#\d+|(?<=\d)\s*'(?:[^'\n]|'')*')*", re.A)
_PIECES = re.compile(r"'((?:[^'\n]|'')*)'|#(\d+)|([A-Za-z_]\w*)", re.A)
_ASSIGNED = re.compile(rf"([A-Za-z_][\w.\[\]]*)\s*:=\s*({_EXPRESSION.pattern})\s*$", re.A)
_CONSTANT = re.compile(rf"^\s*(\w+)\s*(?::\s*\w+\s*)?=\s*({_EXPRESSION.pattern})\s*;", re.M | re.A)
_TARGET = re.compile(r"\.(?:SQL(?:\.Text)?|Query)$", re.I)
_ADDED = re.compile(rf"([A-Za-z_][\w.\[\]]*)\.SQL\.Add\s*\(\s*({_EXPRESSION.pattern})\s*\)", re.I | re.A)
_DONE = re.compile(r"([A-Za-z_][\w.\[\]]*?)\.(?:SQL\.Clear|Open|ExecSQL|Prepare)\b", re.I | re.A)
_CALLED = re.compile(rf"\b(?:ExecSQL|Open)\s*\(\s*({_EXPRESSION.pattern})", re.I | re.A)
_LITERALS = re.compile(r"'(?:[^'\n]|'')*'(?:\s*\+\s*'(?:[^'\n]|'')*')*")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def folded(expression: str, known: dict[str, str]) -> str | None:
    """The string of literals, characters by number and known names joined by +; None where nothing is known."""
    out, any_known = [], False
    for quoted, code, name in _PIECES.findall(expression):
        if name:
            value = known.get(name.lower())
        else:
            value = chr(int(code)) if code and int(code) < 0x110000 else quoted.replace("''", "'")
        any_known |= value is not None
        out.append(value or "")
    return "".join(out) if any_known else None


def _statements(code: str, bare: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(position, statement) between semicolons and block words outside strings."""
    at = start
    for m in re.compile(r";|\b(?:begin|then|else|do|try|finally|except|end|repeat|of)\b", re.I).finditer(bare, start, end):
        yield at, code[at : m.start()]
        at = m.end()
    yield at, code[at:end]


def unit_rows(text: str) -> list[dict]:
    """Rows of every kind, in order of their lines.

    A method in a class and its implementation are two rows (context class and
    implementation); free routines of the interface are left out, nested ones
    too.  In one method a query is given once, at the line where it ends up in
    an owner: assigned, added up or passed.
    """
    code = _COMMENT.sub(lambda m: m[0] if m[0][0] == "'" else _blank(m), text)
    bare = _STRING.sub(_blank, code)
    lines = bare.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    rows: list[dict] = []

    def line_of(at: int) -> int:
        return min(bisect_right(starts, at), len(lines))

    def row(kind: str, name: str, start: int, end: int | None = None, **more) -> None:
        empty = dict.fromkeys("class_name method_name type value visibility context is_temporary".split())
        rows.append(empty | dict(kind=kind, name=name, line_start=start, line_end=end or start) | more)

    marks = [(m.start(), m[1].lower()) for m in _SECTION.finditer(bare)]

    def section(at: int) -> str:
        return next((name for start, name in reversed(marks) if start <= at), "")

    for m in list(_HEAD.finditer(bare))[:1]:
        row("unit", m[1], line_of(m.start(1)), len(lines))
    for m in _USES.finditer(bare):
        for part in m[1].split(","):
            if part.split():
                row("uses", part.split()[0], line_of(m.start(1)), context=section(m.start(1)))

    def closed(at: int) -> int:
        """Position after the semicolon outside brackets that ends what begins at ``at``."""
        depth = 0
        for m in re.compile(r"[();]").finditer(bare, at):
            depth += (m[0] == "(") - (m[0] == ")")
            if m[0] == ";" and depth <= 0:
                return m.end()
        return len(bare)

    def signature(at: int) -> str:
        return " ".join(code[at : closed(at)].split())

    known = {m[1].lower(): v for m in _CONSTANT.finditer(code) if (v := folded(m[2], {})) is not None and "'" in m[2]}
    open_class: dict | None = None
    inner = declared = 0  # records inside a class; where its last method's declaration ends
    routines: list[dict] = []
    bodies: list[dict] = []
    for number, line in enumerate(lines, 1):
        at = starts[number - 1]
        if open_class is None and not routines:
            if m := _CLASS.match(line):
                made = dict(name=m[1], parent=(m[3] or "").split(",")[0].strip(), start=number, visibility="public")
                if m[4] or re.search(r"\bend\s*;", line[m.end() :], re.I):
                    row("class", m[1], number, type=made["parent"])
                else:
                    open_class, inner = made, 0
                continue
        if open_class is not None:
            if at < declared:
                continue
            if m := _VISIBLE.match(line):
                open_class["visibility"] = m[1].lower()
                line = " " * m.end() + line[m.end() :]
            if re.match(r"\s*end\b", line, re.I):
                if inner:
                    inner -= 1
                    continue
                row("class", open_class["name"], open_class["start"], number, type=open_class["parent"])
                open_class = None
            elif m := _ROUTINE.match(line):
                declared = closed(at + m.start(1))
                row("method", m[2], number, class_name=open_class["name"], type=m[1].lower(), value=signature(at + m.start(1)), visibility=open_class["visibility"], context="class")
            elif re.match(r"\s*property\b", line, re.I):
                for s in _LITERALS.findall(code[at : starts[number] - 1]):
                    if reads_like_sql(sql := folded(s, {}) or ""):
                        row("fragment", "", number, class_name=open_class["name"], value=sql, context="property")
            elif not _NO_FIELD.match(line) and (m := _FIELD.match(line)):
                for name in m[1].split(","):
                    row("field", name.strip(), number, class_name=open_class["name"], type=m[2].strip(), visibility=open_class["visibility"])
                inner += bool(re.search(r"\brecord\b", m[2], re.I))
            continue
        if m := _ROUTINE.match(line):
            if section(at) == "interface" or re.search(r"\b(?:forward|external)\b", line, re.I):
                continue
            routines.append(dict(name=m[2], type=m[1].lower(), start=number, at=at + m.start(1), depth=0, started=False))
            line = " " * m.end() + line[m.end() :]
        for m in _BLOCK.finditer(line):
            if not routines:
                break
            top, word = routines[-1], m[1].lower()
            top["depth"] += -1 if word == "end" else 1
            top["started"] |= word in ("begin", "asm")
            if top["started"] and top["depth"] <= 0:
                routines.pop()
                if not routines:
                    bodies.append(top | dict(end=number, end_at=at + m.start()))
    if routines:
        bodies.append(routines[0] | dict(end=len(lines), end_at=len(text)))
    if open_class is not None:
        row("class", open_class["name"], open_class["start"], len(lines), type=open_class["parent"])

    for body in bodies:
        owner, _, name = body["name"].rpartition(".")
        row("method", name, body["start"], body["end"], class_name=owner or None, type=body["type"], value=signature(body["at"]), context="implementation")
        strings, given, built = dict(known), [], {}

        def query(sql: str | None, number: int, sure: bool) -> None:
            sql = (sql or "").strip()
            if sql and (sure or reads_like_sql(sql)) and not any(sql in g for g in given):
                given.append(sql)
                row("fragment", "", number, class_name=owner or None, method_name=name, value=sql, context="method")

        def flush(*but: str) -> None:
            for holder in [h for h in built if h not in but]:
                parts, number = built.pop(holder)
                query("\n".join(parts), number, True)

        for at, part in _statements(code, bare, body["at"], body["end_at"]):
            number = line_of(at + len(part) - len(part.lstrip()))
            part = part.strip()
            if m := _ADDED.search(part):
                flush(m[1].lower())
                built.setdefault(m[1].lower(), ([], number))[0].append(folded(m[2], strings) or "")
                continue
            if _DONE.search(part):
                flush()
            if m := _ASSIGNED.match(part):
                value = folded(m[2], strings)
                if _TARGET.search(m[1]):
                    query(value, number, True)
                elif value is not None:
                    strings[m[1].lower()] = value
                    if "'" in m[2]:
                        query(value, number, False)
                continue
            if m := _CALLED.search(part):
                query(folded(m[1], strings), number, False)
            for m in _LITERALS.finditer(part):
                query(folded(m[0], {}), number + part[: m.start()].count("\n"), False)
        flush()

    for r in [r for r in rows if r["kind"] == "fragment"]:
        for t in sql_tables(r["value"]):
            row("table", t["name"], r["line_start"], class_name=r["class_name"], method_name=r["method_name"], context="pas_embedded", is_temporary=t["is_temporary"])
    return sorted(rows, key=lambda r: r["line_start"])


def units(df: DataFrame, text_col: str = "text") -> DataFrame:
    return extract(df, text_col, unit_rows, UNIT)

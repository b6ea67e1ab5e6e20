"""SQL scripts: procedures, tables, columns, definitions, indexes, calls and statements, the types of SELECT INTO, and edges between them.

``sql_rows`` is a function of a text, applied in Arrow batches and exploded by
``extract``; types and edges are joins over its rows.  Line numbers start at 1,
columns count bytes from 1; a null or empty text gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import extract
from .lookup import latest
from .words import END, Word, Words, first_name, included

SQL = (
    "struct<kind:string,name:string,owner:string,context:string,value:string,position:int,is_temporary:boolean,source_table:string,source_column:string,"
    "line_start:int,line_end:int,column_number:int>"
)

# Names, markers of procedures, statements and macros, and what is no name.
_ID, _WORD = r"[A-Za-z_#][A-Za-z0-9_#]*", r"[A-Za-z_][A-Za-z0-9_]*"
_HIDDEN = re.compile(r"'(?:[^'\n]|'')*'|\"[^\"\n]*\"|--[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
BEGINS, OPENS, CLOSES = "__begin_procedure__", "dcl_proc_begin", ("__end_procedure__", "x_anymode")
PARAMETER_TYPES = "DS"
LEADS = ("select", "insert", "update", "delete")
NAMED_AFTER = ("from", "join", "into", "update")
#: Macros whose first argument is a table, and how they use it.
TABLE_MACROS = {"m_delete_ptable": "delete", "m_delete_ptable_index": "delete", "m_log_table": "log", "select_temp": "temp"}
TEMPORARY_PREFIX = "papi_"
_ALIAS = re.compile(rf"\b(?:FROM|JOIN|UPDATE)\s+({_ID})(?:\s+(?:AS\s+)?({_WORD}))?|,\s*({_ID})\s+({_WORD})\s*(?=[,\n]|$)", re.I)
_QUALIFIED = re.compile(rf"\b({_WORD})\.({_WORD})")
_INSERT_LIST = re.compile(rf"^\s*insert\s+(?:into\s+)?({_ID})\s*\(([^()]*)\)", re.I)
_UPDATE_SET = re.compile(rf"^\s*update\s+({_ID})\s+set\s+(.*)$", re.I)
_CREATE_BODY = re.compile(rf"\bcreate\s+table\s+({_ID})\s*\(", re.I)
_ALTER = re.compile(rf"^\s*alter\s+table\s+({_ID})\s+add\s+(.+?)\s*;?\s*$", re.I)
_ADD_FIELD = re.compile(r"\bM_ADD_FIELD\s*\(\s*'([^']+)'\s*,\s*'([^']+)'\s*\)", re.I)
_INDEX = re.compile(rf"\bcreate\s+(unique\s+)?index\s+({_ID})\s+on\s+({_ID})\s*\(([^)]*)\)", re.I)
_ADD_INDEX = re.compile(r"\bM_CRT_INDEX\s*\(\s*'([^']*)'\s*,\s*'([^']+)'\s*,\s*'([^']+)'\s*,\s*'([^']*)'\s*\)", re.I)
_PART = re.compile(r"[(),]|\b(?:select|into|from)\b", re.I)
NO_COLUMN = {"constraint", "primary", "unique", "foreign", "check", "index"}
NO_NAME = set(
    "select from where join inner left right full outer cross on and or not in is null case when then else end as group order by having union set values into insert update delete"
    " create table exec execute if begin while declare return top distinct with exists like between go".split()
)
#: The relation of a procedure to a table by the table's context.
RELATIONS = {"select": "selects_from", "insert": "inserts_into", "update": "updates", "delete": "deletes_from"}
OTHER_RELATION = "references_table"


def _table(word: Word) -> bool:
    """Whether a word can name a table: a name, after marks of a temporary one."""
    return first_name(word.text.lstrip("#")) != "" and word.text[0] != "@"


def _low(words: Words, i: int) -> str:
    return words.look(i).text.lower()


def _marked(words: Words) -> str | None:
    """The procedure that a marker on the line begins."""
    return next((words[i + 2].text for i in range(len(words)) if _low(words, i) == BEGINS and words.reads(i + 1, "(") and words.look(i + 2).name), None)


def _opened(words: Words) -> str | None:
    """The procedure that a declaration on the line opens."""
    for i in range(len(words)):
        made = _low(words, i) == "create" and _low(words, i + 1) in ("proc", "procedure")
        if made or _low(words, i) == OPENS:
            at = i + 2 if made or words.reads(i + 1, "(") else i + 1
            if words.look(at).name:
                return words[at].text
    return None


def _closed(words: Words) -> bool:
    return any(_low(words, i) in CLOSES and words.reads(i + 1, "(") and words.look(i + 2).name and words.reads(i + 3, ")") for i in range(len(words)))


def _parameters(words: Words) -> Iterator[tuple[str, str]]:
    for word, kind in zip(words, words[1:]):
        if word.text[0] == "@" and first_name(word.text[1:]) and kind.text.startswith(PARAMETER_TYPES):
            yield word.text[1:], kind.text


def _called(words: Words) -> str | None:
    """The procedure that the line executes: after a result it is given to, an owner and in square brackets, where they stand."""
    for i in range(len(words)):
        if _low(words, i) in ("exec", "execute"):
            rest = [w for w in words[i + 1 :] if w.text not in "[]"]
            if rest[1:2] and rest[0].text[0] == "@" and rest[1].text == "=":
                del rest[:2]
            if rest[2:3] and rest[0].name and rest[1].text == ".":
                del rest[:2]
            if rest and rest[0].name:
                return rest[0].text
    return None


def _used(words: Words) -> Iterator[tuple[str, Word]]:
    """(use, table) of statements and macros: the first of each kind on the line."""
    n = range(len(words))
    create = (words[i + 2] for i in n if _low(words, i) == "create" and _low(words, i + 1) == "table" and _table(words.look(i + 2)))
    select = next((i for i in n if _low(words, i) == "select"), len(words))
    into = [words[i + 1] for i in n if i > select and _low(words, i) == "into" and _table(words.look(i + 1))]
    at = 2 if _low(words, 1) == "into" else 1
    first = {"insert": words.look(at), "delete": words.look(1)}.get(_low(words, 0), END)
    macros: dict[str, tuple[str, Word]] = {}
    for i in n:
        if _low(words, i) in TABLE_MACROS and words.reads(i + 1, "(") and _table(words.look(i + 2)):
            macros.setdefault(_low(words, i), (TABLE_MACROS[_low(words, i)], words[i + 2]))
    yield from (("create", w) for w in [next(create, END)] if w is not END)
    yield from (("select", w) for w in into[-1:])
    yield from ((_low(words, 0), w) for w in [first] if _table(w))
    yield from macros.values()


def _named(words: Words) -> list[Word]:
    return [words[i + 1] for i in range(len(words)) if _low(words, i) in NAMED_AFTER and _table(words.look(i + 1))]


def _goes_on(words: Words) -> Word | None:
    """The table with which a list goes on from the line before."""
    i = int(words.reads(0, ","))
    return words[i] if _table(words.look(i)) and words.look(i + 1).text not in (".", "(", "=") else None


def _list_open(words: Words) -> bool:
    """Whether the line ends in a list of tables: the last one, its alias and a comma, or less."""
    last = next((i for i in reversed(range(len(words))) if _low(words, i) == "from"), None)
    rest = [w for w in words[last + 1 :]] if last is not None else []
    return bool(rest) and _table(rest[0]) and [w.text for w in rest[1:]] in ([], [","], *([w.text for w in rest[1:2]] + tail for tail in ([], [","]) if rest[1:2] and _table(rest[1])))


def masked(text: str) -> str:
    """The text with blanks for strings and comments, at the same positions."""
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _is_temporary(table: str) -> bool:
    return table[:1] in "pP#"


def _pieces(text: str, flat: str, start: int, end: int) -> list[tuple[int, str]]:
    """(position, piece) of a list between commas outside brackets."""
    out, depth, at = [], 0, start
    for i in range(start, end):
        c = flat[i]
        depth += (c == "(") - (c == ")")
        if c == "," and depth <= 0:
            out.append((at, text[at:i]))
            at = i + 1
    return [*out, (at, text[at:end])]


def _bracket_end(flat: str, start: int) -> int:
    """Position of the bracket that closes the one before ``start``, else the end."""
    depth = 1
    for m in re.compile("[()]").finditer(flat, start):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.start()
    return len(flat)


def aliases(flat: str) -> dict[str, str]:
    """Lower-case alias, or table, to table."""
    out: dict[str, str] = {}
    for m in _ALIAS.finditer(flat):
        table, alias = m[1] or m[3], m[2] or m[4]
        if table.lower() not in NO_NAME:
            out.setdefault(table.lower(), table)
            if alias and alias.lower() not in NO_NAME:
                out[alias.lower()] = table
    return out


def output_name(expression: str) -> str | None:
    """A projection's name: its alias, else its last word, else what follows the last dot."""
    expression = expression.strip().rstrip(",").strip()
    if m := re.search(r"\bas\s+\[?([A-Za-z_]\w*)\]?$", expression, re.I | re.A):
        name = m[1]
    else:
        name = expression.split()[-1] if expression.split() else ""
        name = name.rpartition(".")[2].strip("[]")
    return name if re.fullmatch(_WORD, name) and name.lower() not in NO_NAME else None


def source_column(expression: str) -> tuple[str, str] | None:
    """(qualifier, column) of a plain ``a.b``, or the first inside ISNULL or COALESCE; other expressions have none."""
    bare = re.sub(r"\s+(?:as\s+)?\[?[A-Za-z_]\w*\]?\s*,?\s*$", "", expression.strip(), flags=re.I | re.A).strip().rstrip(",").strip()
    if m := _QUALIFIED.fullmatch(bare):
        return m[1], m[2]
    if re.match(r"(?:isnull|coalesce)\s*\(", bare, re.I) and (m := _QUALIFIED.search(masked(bare))):
        return m[1], m[2]
    return None


def select_into(query: str) -> tuple[str, list[tuple[int, str]], dict[str, str]] | None:
    """Target, projections with their positions, and aliases of a SELECT INTO; None for other statements."""
    flat = masked(query)
    depth, start = 0, None
    for m in _PART.finditer(flat):
        word = m[0].lower()
        if word in "()":
            depth = max(0, depth + (1 if word == "(" else -1))
        elif depth or word == ",":
            continue
        elif word == "select" and start is None:
            start = m.end() + len(re.match(r"(?:\s+distinct\b)?(?:\s+top\s+\d+)?", flat[m.end() :], re.I)[0])
        elif start is not None and word == "from":
            return None
        elif start is not None and word == "into":
            target = re.compile(rf"\s+({_ID})").match(flat, m.end())
            return (target[1], _pieces(query, flat, start, m.start()), aliases(flat[m.end() :])) if target else None
    return None


def sql_rows(text: str) -> list[dict]:
    """Rows of every kind, in order of their lines.

    Strings and comments name no tables or columns.  Mentions of a table in one
    context count once in ten lines, but for CREATE, SELECT_TEMP and lists that
    go on.  A column whose qualifier no table of its statement has is left out.
    """
    flat = masked(text)
    lines, bare = text.split("\n"), flat.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    rows: list[dict] = []

    def row(kind: str, name: str, start: int, end: int | None = None, **more) -> None:
        empty = dict.fromkeys("owner context value position is_temporary source_table source_column column_number".split())
        rows.append(empty | dict(kind=kind, name=name, line_start=start, line_end=end or start) | more)

    def line_of(at: int) -> int:
        return min(bisect_right(starts, at), len(lines))

    # --- procedures and the statements inside and outside them ---
    procedure: dict | None = None
    owner_at: list[str] = []
    statement: list[str] = []
    began, context, in_list = 0, "", False
    seen: set[tuple] = set()

    def end_procedure(last: int) -> None:
        nonlocal procedure
        if procedure:
            body = "\n".join(x.strip() for x in lines[procedure["start"] - 1 : last])
            row("procedure", procedure["name"], procedure["start"], last, value=hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest())
        procedure = None

    def flush(last: int) -> None:
        nonlocal context, in_list
        query = "\n".join(statement)
        if query.strip():
            name = procedure["name"] if procedure else "sql_script"
            row("fragment", name, began, last, value=query.strip(), context="sql_procedure_statement" if procedure else "sql_statement")
            shown = masked(query)
            known = aliases(shown)
            for i, line in enumerate(shown.split("\n")):
                for m in _QUALIFIED.finditer(line):
                    if table := known.get(m[1].lower()):
                        row("column", m[2], began + i, owner=table, context=context or "unknown", column_number=len(line[: m.start(2)].encode()) + 1)
            if found := select_into(query):
                target, parts, names = found
                given: set[str] = set()
                for at, part in parts:
                    name = output_name(part)
                    if name and name.lower() not in given:
                        given.add(name.lower())
                        source = source_column(part)
                        table = names.get(source[0].lower()) if source else None
                        lead = len(part) - len(part.lstrip())
                        row("column_definition", name, began + query[: at + lead].count("\n"), owner=target, context="select_into", value="DSUNKNOWN", position=len(given),
                            source_table=table, source_column=source[1] if table else None)
        statement.clear()
        context, in_list = "", False

    def mention(table: str, how: str, number: int, at: int, once: bool = True) -> None:
        key = (table.lower(), how, (number - 1) // 10)
        if table.lower() not in NO_NAME and not (once and key in seen):
            seen.add(key)
            row("table", table, number, owner=procedure["name"] if procedure else "", context=how, is_temporary=_is_temporary(table), column_number=len(lines[number - 1][:at].encode()) + 1)

    for number, (line, shown) in enumerate(zip(lines, bare), 1):
        mark = line.strip()
        low = shown.strip().lower()
        words = Words(shown)
        directive = mark.split(None, 2)
        closes, begins = _closed(words), _marked(words) or _opened(words)
        if files := included(line):
            flush(number - 1)
            row("include", files[0].strip(), number)
        elif directive[:1] and directive[0].lower() == "#define" and len(directive) > 2 and first_name(directive[1]) == directive[1]:
            flush(number - 1)
            row("define", directive[1], number, value=directive[2].strip())
        elif closes:
            flush(number - 1)
            end_procedure(number)
        elif begins:
            if not procedure:
                flush(number - 1)
                procedure = dict(name=begins, start=number, signature=_marked(words) is None, params=set())
        elif low == "go":
            flush(number - 1)
        elif not mark:
            if procedure and not procedure["signature"]:
                flush(number - 1)
        owner_at.append(procedure["name"] if procedure else "")
        if procedure and procedure["signature"]:
            for name, kind in _parameters(words):
                if name.lower() not in procedure["params"]:
                    procedure["params"].add(name.lower())
                    row("param", name, number, owner=procedure["name"], value=kind, context="out" if re.search(r"\boutput\b", low) else "in", position=len(procedure["params"]))
            if re.search(r"(?:^|\s)(?:as|begin)$", low):
                procedure["signature"] = False
            continue
        if not low or low in ("go", "begin", "end", "as") or _low(words, 0) in ("#include", "#define") or closes or begins:
            continue
        if (lead := _low(words, 0)) in LEADS:
            context = context if lead == "select" and context == "insert" else lead
            in_list = False
        if not statement:
            began = number
        statement.append(line)

        here: set[str] = set()
        for how, word in _used(words):
            mention(word.text, "select" if how == "temp" else how, number, word.at, how not in ("create", "temp"))
            here.add(word.text.lower())
        found = _named(words)
        for word in found:
            if context and word.text.lower() not in here:
                here.add(word.text.lower())
                mention(word.text, "select" if context == "insert" and not re.search(r"\binsert\s+into\b", low) else context, number, word.at)
        if found:
            in_list = _list_open(words)
        elif in_list and (word := _goes_on(words)) and word.text.lower() not in NO_NAME:
            here.add(word.text.lower())
            mention(word.text, "select" if context == "insert" else context or "unknown", number, word.at, once=False)
        else:
            in_list = False
        for word in words:
            if (word.text[0] == "#" and _table(word) or word.text.lower().startswith(TEMPORARY_PREFIX)) and word.text.lower() not in here:
                here.add(word.text.lower())
                mention(word.text, context or "unknown", number, word.at)

        if m := _INSERT_LIST.match(shown):
            for name in (p.strip() for p in m[2].split(",")):
                if re.fullmatch(_WORD, name):
                    row("column", name, number, owner=m[1], context="insert")
        if m := _UPDATE_SET.match(shown):
            for _, part in _pieces(m[2], m[2], 0, len(m[2])):
                if n := re.match(rf"\s*({_WORD})\s*=", part):
                    row("column", n[1], number, owner=m[1], context="update")
        if called := _called(words):
            row("call", called, number, owner=owner_at[-1])
        if low.endswith(";"):
            flush(number)
    flush(len(lines))
    end_procedure(len(lines))

    # --- definitions and indexes, wherever they stand ---
    def definition(table: str, part: str, how: str, number: int, position: int) -> bool:
        words = part.split()
        if len(words) < 2 or words[0].lower() in NO_COLUMN:
            return False
        row("column_definition", words[0].strip("[]\""), number, owner=table, context=how, value=words[1].rstrip(",;"), position=position)
        return True

    for m in _CREATE_BODY.finditer(flat):
        position = 1
        for at, part in _pieces(flat, flat, m.end(), _bracket_end(flat, m.end())):
            position += definition(m[1], part, "create_table", line_of(at + len(part) - len(part.lstrip())), position)
    for number, (line, shown) in enumerate(zip(lines, bare), 1):
        if m := _ALTER.match(shown):
            definition(m[1], m[2], "alter_add", number, 0)
        if not mark_is_comment(line):
            for m in _ADD_FIELD.finditer(line):
                definition(m[1], m[2], "macro_add_field", number, 0)
            for m in _ADD_INDEX.finditer(line):
                index(row, m[2], m[3], "macro_create_index", m[1], m[4], number)
    for m in _INDEX.finditer(flat):
        index(row, m[2], m[3], "create_index", "unique" if m[1] else "", m[4], line_of(m.start()))
    return sorted(rows, key=lambda r: r["line_start"])


def mark_is_comment(line: str) -> bool:
    return line.lstrip().startswith("--")


def index(row, name: str, table: str, how: str, kind: str, fields: str, number: int) -> None:
    row("index", name, number, owner=table, context=how, value=kind)
    names = [p for p in (f.strip().strip("'\"[]").strip() for f in fields.split(",")) if p]
    for k, field in enumerate(names, 1):
        row("index_field", field, number, owner=name, context=how, position=k)


def scripts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return extract(df, text_col, sql_rows, SQL)


def fragment_tables(fragments: DataFrame, text_col: str = "text", line_col: str = "line_start") -> DataFrame:
    """The tables in pieces of SQL that stand in other files, at the lines of those files."""
    kept = fragments.withColumnRenamed(line_col, "fragment_line")
    found = scripts(kept, text_col).where("kind = 'table'")
    return found.withColumn("line_start", F.expr("line_start + coalesce(fragment_line, 1) - 1")).withColumn("line_end", F.expr("line_end + coalesce(fragment_line, 1) - 1"))


def typed(definitions: DataFrame, known: DataFrame, *order) -> DataFrame:
    """SELECT INTO definitions with the type of their source: its latest known one, by ``order``; ``DSUNKNOWN`` stays where there is none.

    ``known`` has owner, name and value; names match without regard to case.
    The join is left, by key, so a definition is never lost or doubled.
    """
    types = known.where("value is not null and trim(value) != '' and value != 'DSUNKNOWN'").withColumns({"__t": F.lower("owner"), "__c": F.lower("name")})
    types = latest(types, ["__t", "__c"], *order).select("__t", "__c", F.col("value").alias("__type"))
    joined = definitions.join(types, (F.lower("source_table") == F.col("__t")) & (F.lower("source_column") == F.col("__c")), "left")
    return joined.withColumn("value", F.when(F.col("context") == "select_into", F.coalesce("__type", "value")).otherwise(F.col("value"))).drop("__t", "__c", "__type")


def procedure_edges(found: DataFrame, file: str = "path", *order) -> DataFrame:
    """Edges of procedures: to those they call, the latest of that name by ``order``, and to the tables between their lines.

    ``found`` has ``scripts``' rows of many files, with the column ``file``.  Each edge
    is (source_file, source, target_type, target_file, target, relation_type, line_number), once.
    """
    procedures = found.where("kind = 'procedure'")
    by_name = latest(procedures.withColumn("__n", F.lower("name")), ["__n"], *order)
    own = procedures.select(F.col(file).alias("source_file"), F.col("name").alias("source"), "line_start", "line_end")
    callers = own.select("source_file", "source", F.lower("source").alias("__o")).dropDuplicates(["source_file", "__o"])
    calls = found.where("kind = 'call' and owner != ''").select(F.col(file).alias("source_file"), F.lower("owner").alias("__o"), F.lower("name").alias("__n"), F.col("line_start").alias("line_number"))
    called = calls.join(callers, ["source_file", "__o"]).join(by_name.select("__n", F.col(file).alias("target_file"), F.col("name").alias("target")), "__n")
    called = called.select("source_file", "source", F.lit("sql_procedure").alias("target_type"), "target_file", "target", F.lit("calls_procedure").alias("relation_type"), "line_number")
    tables = found.where("kind = 'table'").select(F.col(file).alias("source_file"), F.col("name").alias("target"), "context", F.col("line_start").alias("line_number"))
    relation = F.coalesce(F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])[F.col("context")], F.lit(OTHER_RELATION))
    used = own.join(tables, "source_file").where("line_number between line_start and line_end")
    used = used.select("source_file", "source", F.lit("sql_table").alias("target_type"), F.col("source_file").alias("target_file"), "target", relation.alias("relation_type"), "line_number")
    return called.union(used).distinct()

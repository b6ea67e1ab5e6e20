"""Extractors: one text gives many rows.  Each is a plain function of a text, applied in Arrow batches and exploded.

Line numbers start at 1.  A null or empty text gives no rows; other columns of
the input stay beside the extracted ones.  A table that Spark reads in fewer tasks
than the session has cores is dealt out first: parsing takes far longer than
reading, so a small file of many short texts must not be one task.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .words import Words, included

HEADER = "struct<kind:string,name:string,value:string,define_type:string,line_number:int>"
SCRIPT = "struct<kind:string,name:string,object:string,value:string,scenario_type:string,line_start:int,line_end:int>"
GAME = "struct<white:string,black:string,result:string,moves:array<struct<san:string,annotation:int>>>"


def rows_function(parse: Callable[[str], list[dict]], row: str):
    """``parse`` as a function of a column of texts that gives an array of rows, for DataFrames and (registered) for SQL."""

    @pandas_udf(f"array<{row}>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([parse(t) if t else [] for t in texts], dtype=object)

    return run


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a scan over more tasks, where it has fewer than the session runs at once; what comes from a shuffle is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    scan = not df.isStreaming and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    return df.repartition(2 * cores) if scan and df.rdd.getNumPartitions() < cores else df


def extract(df: DataFrame, text_col: str, parse: Callable[[str], list[dict]], row: str) -> DataFrame:
    """The rows that ``parse`` finds in each text, with the input's columns but the text; ``ordinal`` counts them."""
    kept = [c for c in df.columns if c != text_col]
    found = dealt(df).select(*[F.col(f"`{c}`") for c in kept], F.posexplode(rows_function(parse, row)(F.col(text_col))).alias("ordinal", "__row"))
    return found.select(*[F.col(f"`{c}`") for c in kept], "ordinal", "__row.*")


def extract_by_path(df: DataFrame, path_col: str, text_col: str, parse: Callable[[str, str], list[dict]], row: str) -> DataFrame:
    """As ``extract``, for a ``parse`` that also needs the path; a null path counts as empty."""

    @pandas_udf(f"array<{row}>")
    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([parse(p or "", t) if t else [] for p, t in zip(paths, texts)], dtype=object)

    kept = [c for c in df.columns if c != text_col]
    found = dealt(df).select(*[F.col(f"`{c}`") for c in kept], F.posexplode(run(F.col(path_col), F.col(text_col))).alias("ordinal", "__row"))
    return found.select(*[F.col(f"`{c}`") for c in kept], "ordinal", "__row.*")


# --- C headers ---------------------------------------------------------------------------------

# The forms of a directive.
_NAME = r"^#define\s+([A-Za-z_]\w*)"
_CALL = re.compile(_NAME + r"\s*\([^)]*\)(?:\s+(.+))?$", re.A | re.S)
_PLAIN = re.compile(_NAME + r"(?:\s+(.*))?$", re.A | re.S)
_NUMBER = re.compile(r"(?:(\d+)|([+-]?\d+)\s*(?:/\*.*\*/|--.*))$", re.A | re.S)


def header_rows(text: str) -> list[dict]:
    """Includes and defines of a header; a line that ends in a backslash goes on in the next."""
    rows, logical = [], []
    for number, line in enumerate(text.splitlines(), 1):
        going = bool(logical) and logical[-1][2]
        more = line.rstrip().endswith("\\")
        part = line.rstrip()[:-1] if more else line
        if going:
            first, before, _ = logical[-1]
            logical[-1] = (first, f"{before}\n{part}", more)
        else:
            logical.append((number, part, more))
    for number, line, _ in logical:
        line = line.strip()
        if line.startswith(("--", "/*", "*")):
            continue
        if line.startswith("#include") and (files := included(line)):
            rows.append(dict(kind="include", name=files[0], value=None, define_type=None, line_number=number))
        elif m := _CALL.match(line):
            rows.append(dict(kind="define", name=m[1], value=(m[2] or "").strip(), define_type="macro", line_number=number))
        elif m := _PLAIN.match(line):
            value, kind = (m[2] or "").strip(), "macro"
            if not value:
                kind = "const"
            elif n := _NUMBER.match(value):
                value, kind = n[1] or n[2], "const"
            elif "--" in value:
                value, kind = value.partition("--")[0].strip(), "comment"
            rows.append(dict(kind="define", name=m[1], value=value, define_type=kind, line_number=number))
    return rows


# --- scripts -----------------------------------------------------------------------------------

# The functions of a scenario, and the calls that a script is searched for.
CREATES, RUNS_PROCEDURE, RUNS_QUERY = "CreateObject", "ExecProc", "ExecQuery"
SCENARIOS = {
    "BeforeQuery": "mass_operation", "AfterProcess": "mass_operation", "StepBack": "mass_operation",
    "CreateInstrument": "instrument_model", "PostLoadInstrument": "instrument_model", "InitForm": "instrument_model",
}


def _scenario(text: str) -> Callable[[str], str]:
    if "StepForward" in text and "MassAccrualStarter" in text:
        return lambda name: "mass_operation"
    if "CreateInstrument" in text:
        return lambda name: "instrument_model"
    return lambda name: SCENARIOS.get(name, "utility")


def _closing(text: str, start: int) -> int:
    """Position of the brace that closes the first one opened at or after ``start``; else of the last brace, else ``start``."""
    depth, last = 0, start
    for m in re.compile("[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        last = m.start()
        if depth <= 0 and m[0] == "}":
            break
    return last


def script_rows(text: str) -> list[dict]:
    """Functions, created objects, procedure and query calls, and constants of a script.

    Block comments go first, so lines are counted without them; comment lines are skipped.
    """
    text = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    code = re.sub(r"(?m)^[^\S\n]*//.*$", lambda m: " " * len(m[0]), text)  # keeps positions
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda at: bisect_right(starts, at)
    named = _scenario(text)

    def row(kind, at, name, end=None, **more):
        return dict(dict(object=None, value=None, scenario_type=None), kind=kind, name=name, line_start=line(at), line_end=line(at if end is None else end), **more)

    found = Words(code)
    made, rows = [], []
    for i, owner, function, args in found.calls():
        first = args[0][0].string if args and args[0] else None
        if not owner or not first:
            continue
        if function == CREATES and owner == "Sys" and len(args) == 1 and found.reads(i - 1, "=") and found.look(i - 2).name:
            made.append((found[i - 2].at, found[i - 2].text, first))
        elif function == RUNS_PROCEDURE and re.fullmatch(r"\w+", first):
            rows.append(row("exec_proc", found[i].at, first, object=owner))
        elif function == RUNS_QUERY:
            rows.append(row("exec_query", found[i].at, None, object=owner, value=first.replace("\\n", "\n")))
    for i, word in enumerate(found):
        name, value = found.look(i + 1), found.look(i + 3)
        if word.text == "var" and name.name and name.text == name.text.upper() and found.reads(i + 2, "=") and (value.text.isdigit() or value.string is not None):
            rows.append(row("constant", word.at, name.text, value=value.text.strip('"')))
        if word.text == "function" and name.name and (args := found.arguments(i + 2)) is not None:
            end = _closing(code, word.at)
            body = code[starts[line(word.at) - 1] : end + 1]
            own = {(n, k) for at, n, k in made if word.at <= at <= end}
            used = (kind for _, n, kind in made if (n, kind) not in own and re.search(rf"\b{re.escape(n)}\.\w+\s*\S", body, re.A))
            opened = found[i + 2].at
            rows.append(row("function", word.at, name.text, end, value=f"function {name.text}{code[opened : code.index(')', opened) + 1]}", scenario_type=named(name.text), object=next(used, None)))
    rows += [row("object", at, n, object=kind) for at, n, kind in made]
    return sorted(rows, key=lambda r: r["line_start"])


# --- games -------------------------------------------------------------------------------------

# The results of a game, the form of a move, the weights of the marks.
RESULTS = ("1-0", "0-1", "1/2-1/2")
_SAN = re.compile(r"(?:[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=?[KQRBN])?|O-O(?:-O)?)(?:\+\+)?[+#]?")
MARKS = {"": 0, "!": 1, "!!": 2, "!!!": 3, "?!": -1, "?": -1, "??": -2, "???": -2}
_PIECE = re.compile(r"[(){}]|[^\s(){}]+")


def _main_line(body: str) -> str:
    """Move text outside brackets, variations and comments, in one pass; what an unclosed bracket opens goes too."""
    out, variation, comment = [], 0, 0
    for m in _PIECE.finditer(re.sub(r"\[[^\]]*\]", " ", body)):
        mark = m[0]
        if mark in "{}":
            comment = max(0, comment + (1 if mark == "{" else -1))
        elif comment:
            continue
        elif mark in "()":
            variation = max(0, variation + (1 if mark == "(" else -1))
        elif not variation:
            out.append(mark)
    return " ".join(out)


def _tag(line: str) -> tuple[str, str] | None:
    """Name and value of a line ``[Name "value"]``."""
    line = line.strip()
    name, space, value = line[1:-1].partition(" ")
    value = value.strip()
    if line[:1] == "[" and line[-1:] == "]" and space and name.isalnum() and len(value) > 1 and value[0] == value[-1] == '"':
        return name, value[1:-1]
    return None


def _games(text: str) -> Iterator[tuple[dict[str, str], str]]:
    """Tags and move text of each game; a game begins at its Event."""
    tags: dict[str, str] | None = None
    body: list[str] = []
    for line in text.splitlines():
        tag = _tag(line)
        if tag and tag[0] == "Event":
            if tags is not None:
                yield tags, "\n".join(body)
            tags, body = {}, []
        elif tags is not None and tag:
            tags.setdefault(*tag)
        elif tags is not None:
            body.append(line)
    if tags is not None:
        yield tags, "\n".join(body)


def game_rows(text: str, compat: bool = False) -> list[dict]:
    """Games with players, result (of the tag, else of the move text) and main line; games without moves are left out.

    Marks such as ``!?`` give a move's annotation; with ``compat`` a marked move
    is dropped, as a plain move pattern would.
    """
    games = []
    for tags, body in _games(text):
        moves = []
        for token in re.sub(r"\b\d+\.+|\$\d+", " ", _main_line(body)).split():
            san = token.rstrip("!?")
            if _SAN.fullmatch(san) and not (compat and san != token):
                moves.append(dict(san=san, annotation=MARKS.get(token[len(san) :], 0)))
        if moves:
            result = next((r for r in [tags.get("Result"), *body.split()] if r in RESULTS), "")
            games.append(dict(white=tags.get("White", ""), black=tags.get("Black", ""), result=result, moves=moves))
    return games


def headers(df: DataFrame, text_col: str = "text") -> DataFrame:
    return extract(df, text_col, header_rows, HEADER)


def scripts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return extract(df, text_col, script_rows, SCRIPT)


def games(df: DataFrame, text_col: str = "text", compat: bool = False) -> DataFrame:
    return extract(df, text_col, lambda t: game_rows(t, compat), GAME)


def move_text(moves: str) -> Column:
    """``1.e4 e5 2.Nf3`` of an array of moves in standard notation."""
    return F.expr(f"array_join(transform({moves}, (m, i) -> if(i % 2 = 0, concat(cast(i div 2 + 1 as string), '.', m), m)), ' ')")

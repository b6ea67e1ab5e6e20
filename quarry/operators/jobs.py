"""Job documents: a script in XML with its instrument, states, actions, accounts, query, includes and functions.

``job_rows`` is a function of a text, applied in Arrow batches and exploded by
``extract``.  What a script only names (constants, helper functions) may stand in
its include files, so ``resolved`` finds it by joins, not by reading files in a
task.  Lines are those of the script, from 1; a null or empty text gives no rows.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extract import extract, script_rows
from .words import END, Word, Words

JOB = (
    "struct<kind:string,name:string,sys_name:string,type:string,value:string,brief:string,object_ref:string,module_ref:string,start_state:string,goes_into:string,"
    "prop_val:string,priority:string,check_service:string,position:int,line_start:int,line_end:int>"
)

# The calls and settings of a script, and how many lines after a call hold its settings.
OWNERS = ("Instrument", "MassAccrualInstrument")
SETTINGS = {"name": ("Name",), "brief": ("Brief",), "object_ref": ("InterfaceObjectID", "DealObjectID"), "module_ref": ("DsModuleID", "ModuleID"), "start_state": ("StartState",)}
NAMED_STATES, STATES, STATE_TYPE, STATE_TYPES = ("CreateStateWithSysName", "CreateStateWithSysname"), ("CreateState",), "StateType", "PROP_STATETYPE_"
NAMED_ACTIONS, ACTIONS = ("CreateConsumerTransitionWithSysName",), ("CreateTransition", "CreateConsumerTransition")
#: An action's settings: the name that is set, and what a value that is no number begins with.
ACTION_SETTINGS = {"prop_val": ("PropVal", "CONSUMER_ACTION_"), "priority": ("Priority", None), "check_service": ("CheckService", "CHECKSERVICE_")}
INTO = "Into"
LINKS_ACCOUNT, ACCOUNT_KIND, ACCOUNT_MASK = "TypeAccLinkCreate", "RESDEP_", "__ACCMASK"
AFTER_STATE, AFTER_ACTION, AFTER_OLD_ACTION = 10, 15, 20
SCENARIO = {"CreateInstrument": "instrument_model", "CreateMassAccrualInstrument": "mass_operation"}


def _set(words: Words) -> Iterator[tuple[str | None, str, Word]]:
    """(owner or null, name, value) of every ``name = value`` and ``owner.name = value``."""
    for i, word in enumerate(words):
        if word.text == "=" and words.look(i - 1).name and words.look(i + 1) is not END:
            owner = words.look(i - 3) if words.reads(i - 2, ".") else END
            yield owner.text if owner.name else None, words[i - 1].text, words[i + 1]


def _number(word: Word, begins: str | None) -> bool:
    return word.text.isdigit() or bool(begins) and word.text.startswith(begins)


def _action_settings(words: Words) -> dict[str, list[str]]:
    """Every value of an action's settings in a piece of script, in order."""
    found: dict[str, list[str]] = {k: [] for k in ("goes_into", *ACTION_SETTINGS)}
    for _, name, value in _set(words):
        for k, (wanted, begins) in ACTION_SETTINGS.items():
            if name == wanted and _number(value, begins):
                found[k].append(value.text)
    found["goes_into"] = [args[0][0].string for _, _, function, args in words.calls() if function == INTO and len(args) == 1 and len(args[0]) == 1 and args[0][0].string]
    return found


def _functions(words: Words) -> Iterator[tuple[Word, str, int]]:
    """(first word, name, place after the opening brace) of ``function name(...) {``."""
    for i, word in enumerate(words):
        if word.text == "function" and words.look(i + 1).name and words.reads(i + 2, "("):
            close = next((k for k in range(i + 3, len(words)) if words[k].text == ")"), None)
            if close and words.reads(close + 1, "{"):
                yield word, words[i + 1].text, words[close + 1].at + 1


def _row(kind: str, name: str | None, start: int, end: int | None = None, **more) -> dict:
    keys = "sys_name type value brief object_ref module_ref start_state goes_into prop_val priority check_service position".split()
    return dict.fromkeys(keys) | dict(kind=kind, name=name, line_start=start, line_end=end or start) | more


def _constants(script: str) -> Iterator[tuple[str, str, int]]:
    """(name, value, line) of lines ``name = value``, with or without var or const: a number or another name."""
    for number, line in enumerate(script.split("\n"), 1):
        words = [w.text for w in Words(line.partition("//")[0])]
        if words[:1] and words[0].lower() in ("var", "const"):
            del words[0]
        if words[-1:] == [";"]:
            words.pop()
        if len(words) == 3 and words[1] == "=" and Word(words[0], 0).name and (words[2].isdigit() or Word(words[2], 0).name):
            yield words[0], words[2], number


def _block(script: str, start: int) -> str:
    """What stands between the brace before ``start`` and the one that closes it; empty if none does."""
    depth = 1
    for m in re.compile("[{}]").finditer(script, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return script[start : m.start()]
    return ""


def parts(text: str) -> dict:
    """Script, description, query and include files of a document; of one that is no XML, the tags' contents."""
    try:
        root = ET.fromstring(re.sub(r"^\s*﻿?\s*<\?xml.*?\?>", "", text, flags=re.S | re.I))
        files = [e.text or "" for tag in ("include", "include-server") for e in root.findall(f"{tag}/inc-file")]
        found = {tag: root.findtext(tag) or "" for tag in ("description", "prequery", "script")}
    except ET.ParseError:
        inside = {tag: re.search(rf"<{tag}>(.*?)</{tag}>", text, re.S) for tag in ("description", "prequery", "script")}
        found = {tag: m[1] if m else "" for tag, m in inside.items()}
        files = re.findall(r"<inc-file>([^<]+)</inc-file>", text)
        found["script"] = re.sub(r"^\s*<!\[CDATA\[|\]\]>\s*$", "", found["script"]) or text
    return found | {"files": [f.strip() for f in files if f.strip()]}


def library_rows(script: str) -> list[dict]:
    """Constants, and functions with the action's settings in their bodies."""

    def line(at: int) -> int:
        return script.count("\n", 0, at) + 1

    rows = [_row("constant", name, number, value=value) for name, value, number in _constants(script)]
    for word, name, begin in _functions(Words(script)):
        found = {k: v[0] for k, v in _action_settings(Words(_block(script, begin))).items() if v}
        if found:
            rows.append(_row("helper", name, line(word.at), **found))
    return rows


def job_rows(text: str) -> list[dict]:
    """Rows of every kind; a state or action counts once for its name and system name.

    There is no instrument where a script sets up none.  An action that a helper
    makes has the helper's name, and its target as system name, kind
    ``helper_action`` until ``resolved`` gives it the helper's settings; any call
    ``f(x, y);`` that begins a line counts as a helper's, a link to an account too.
    """
    doc = parts(text)
    script = doc["script"]
    lines = script.split("\n")

    def line(at: int) -> int:
        return script.count("\n", 0, at) + 1

    found = Words(script)
    opened = next((found[i + 4].at + 1 for i in range(len(found)) if found.reads(i, "with", "(", "Instrument", ")", "{")), None)
    legacy = Words(_block(script, opened)) if opened else Words("")

    def setting(kind: str) -> str | None:
        """The first value that fits: of the instrument's own setting, else of one in its block."""
        fits = lambda w: w.string if kind in ("name", "brief") else w.string or (w.name and w.text) if kind == "start_state" else (w.name or w.text.isdigit()) and w.text
        own = (fits(v) for owner, name, v in _set(found) if owner in OWNERS and name in SETTINGS[kind])
        inside = (fits(v) for _, name, v in _set(legacy) if name in SETTINGS[kind])
        return next((v for v in (*own, *inside) if v), None)

    rows: list[dict] = []
    seen: set[tuple] = set()

    def once(kind: str, name: str, sys_name: str, at: int, **more) -> None:
        if (kind[-6:], name, sys_name) not in seen:
            seen.add((kind[-6:], name, sys_name))
            rows.append(_row(kind, name, line(at), sys_name=sys_name, **more))

    def called(functions: tuple[str, ...], count: int, strings: bool = True) -> Iterator[tuple[int, list[str]]]:
        """(position, arguments) of calls with so many arguments of one word each: strings, or names too."""
        for i, owner, function, args in found.calls():
            if function in functions and len(args) == count and all(len(a) == 1 and (a[0].string or a[0].name and not strings) for a in args):
                yield found[i + 2 * (owner is not None)].at, [a[0].string or a[0].text for a in args]

    def after(at: int, many: int) -> Words:
        return Words("\n".join(lines[line(at) - 1 :][:many]))

    for at, (name, sys_name) in called(NAMED_STATES, 2, False):
        kinds = (v.text for _, key, v in _set(after(at, AFTER_STATE)) if key == STATE_TYPE and v.text.startswith(STATE_TYPES))
        once("state", name, sys_name, at, type=next(kinds, None))
    for at, (name,) in called(STATES, 1):
        once("state", name, name, at)
    for functions, count, many, settings in ((NAMED_ACTIONS, 4, AFTER_ACTION, tuple(ACTION_SETTINGS)), (ACTIONS, 1, AFTER_OLD_ACTION, ("goes_into", *ACTION_SETTINGS))):
        for at, names in called(functions, count):
            values = _action_settings(after(at, many))
            once("action", names[0], names[count > 1], at, **{k: values[k][-1] for k in settings if values[k]})
    accounts = []
    for i, owner, function, args in found.calls():
        at, single = found[i].at, [a[0] for a in args if len(a) == 1]
        if not owner and len(args) == len(single) == 2 and single[0].name and (single[1].name or single[1].string) and not script[script.rfind("\n", 0, at) + 1 : at].strip():
            if re.match(r"\s*;", script[script.index(")", single[1].at + len(single[1].text)) + 1 :]):
                once("helper_action", function, single[1].string or single[1].text, at)
        if function == LINKS_ACCOUNT and len(args) > 1 and args[0] and args[1] and args[0][0].text.startswith(ACCOUNT_KIND) and args[1][0].text.startswith(ACCOUNT_MASK):
            accounts.append(_row("account", args[1][0].text.removeprefix(ACCOUNT_MASK).strip("_"), line(at), type=args[0][0].text))
    rows += accounts

    settings = {k: setting(k) for k in SETTINGS}
    scenario = next((kind for name, kind in SCENARIO.items() if any(found.reads(i, "function", name, "(") for i in range(len(found)))), None)
    if rows or scenario or any(settings.values()):
        rows.insert(0, _row("instrument", settings.pop("name"), 1, len(lines), type=scenario, **settings))
    rows += [_row("include", name, 1, position=k) for k, name in enumerate(doc["files"], 1)]
    if doc["description"].strip():
        rows.append(_row("description", None, 1, value=doc["description"].strip()))
    if doc["prequery"].strip():
        rows.append(_row("prequery", None, 1, value=doc["prequery"].strip()))
    rows += [_row("function", r["name"], r["line_start"], r["line_end"], value=r["value"], type=r["scenario_type"]) for r in script_rows(script) if r["kind"] == "function"]
    return rows + library_rows(script)


def jobs(df: DataFrame, text_col: str = "text") -> DataFrame:
    return extract(df, text_col, job_rows, JOB)


def libraries(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Constants and helpers of include files."""
    return extract(df, text_col, library_rows, JOB)


def resolved(found: DataFrame, library: DataFrame, path: str = "path") -> DataFrame:
    """Instruments with ``deal_object_id`` and ``module_id`` (a number, a constant's, or 0), and helpers' actions with their settings.

    ``library`` has the rows of include files with the column ``file`` that includes name.  A
    constant is looked for in the job first and then in its include files, of which
    the last counts; a helper in the job, then the first file.  Constants of constants are
    followed to the end (one that leads back to itself is 0).  All are left joins on (job, name), so no row is lost or doubled.
    """
    included = found.where("kind = 'include'").select(F.col(path).alias("__job"), F.col("name").alias("file"), F.col("position").alias("__place"))
    settings = ["goes_into", "prop_val", "priority", "check_service"]
    columns = ["kind", "name", "value", "line_start", *settings]
    own = found.where("kind in ('constant', 'helper')").select(F.col(path).alias("__job"), F.lit(0).alias("__place"), *columns)
    others = library.where("kind in ('constant', 'helper')").join(included, "file").select("__job", "__place", *columns)
    there = own.union(others)

    def first(kind: str, *order) -> DataFrame:
        w = Window.partitionBy("__job", "name").orderBy(*order)
        return there.where(F.col("kind") == kind).withColumn("__rank", F.row_number().over(w)).where("__rank = 1")

    constants = first("constant", F.col("__place") > 0, F.desc("__place"), F.desc("line_start")).select("__job", F.col("name").alias("__name"), F.col("value").alias("__value"))
    # a constant's number: each step replaces values by what they name, doubling the distance, until none is left to follow
    steps = constants
    for _ in range(constants.count().bit_length() + 1):  # a chain is no longer than there are constants; what is left then is a circle
        ahead = steps.select(F.col("__job").alias("__j"), F.col("__name").alias("__n"), F.col("__value").alias("__v"))
        more = steps.join(ahead, (F.col("__job") == F.col("__j")) & (F.col("__value") == F.col("__n")))
        if more.where("__v != __n and __v != __name").isEmpty():
            break
        steps = steps.join(ahead, (F.col("__job") == F.col("__j")) & (F.col("__value") == F.col("__n")), "left").select("__job", "__name", F.when(F.coalesce("__v", "__value") == F.col("__name"), "").otherwise(F.coalesce("__v", "__value")).alias("__value"))
    constants = steps
    out = found
    for ref, name in (("object_ref", "deal_object_id"), ("module_ref", "module_id")):
        out = out.withColumn("__now", F.col(ref)).join(constants, (F.col(path) == F.col("__job")) & (F.col("__now") == F.col("__name")), "left")
        out = out.withColumn("__now", F.coalesce("__value", "__now")).drop("__job", "__name", "__value")
        number = F.when(F.col("__now").rlike(r"^\d+$"), F.expr("try_cast(__now as bigint)"))
        out = out.withColumn(name, F.when(F.col("kind") == "instrument", F.coalesce(number, F.lit(0)))).drop("__now")
    helpers = first("helper", "__place", "line_start").select(F.col("__job"), F.col("name").alias("__name"), F.lit("helper_action").alias("__kind"), *[F.col(c).alias(f"__{c}") for c in settings])
    out = out.join(helpers, (F.col(path) == F.col("__job")) & (F.col("name") == F.col("__name")) & (F.col("kind") == F.col("__kind")), "left")
    out = out.withColumns({c: F.coalesce(c, f"__{c}") for c in settings}).withColumn("kind", F.when(F.col("kind") == "helper_action", "action").otherwise(F.col("kind")))
    return out.drop("__job", "__name", "__kind", *[f"__{c}" for c in settings])

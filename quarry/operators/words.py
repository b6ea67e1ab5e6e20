"""A small reader of words, strings and calls that the extractors share; it knows no language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_PARTS = re.compile(r'"[^"]*"|[@#]*\w+|\S', re.A)


class Word(NamedTuple):
    text: str
    at: int

    @property
    def name(self) -> bool:
        return self.text[0].isalpha() or self.text[0] == "_"

    @property
    def string(self) -> str | None:
        """What stands between double quotes, if it is such a string."""
        return self.text[1:-1] if self.text[0] == '"' and len(self.text) > 1 else None


END = Word(" ", -1)


class Words(list):
    """The words, strings and marks of a text in order; beyond the end there is ``END``."""

    def __init__(self, text: str):
        super().__init__(Word(m[0], m.start()) for m in _PARTS.finditer(text))

    def look(self, i: int) -> Word:
        return self[i] if 0 <= i < len(self) else END

    def reads(self, i: int, *marks: str) -> bool:
        """Whether these very words stand from place i on."""
        return all(self.look(i + k).text == mark for k, mark in enumerate(marks))

    def arguments(self, i: int) -> list[list[Word]] | None:
        """The arguments of the bracket that opens at place i, split at its own commas; null if it does not close."""
        if not self.reads(i, "("):
            return None
        out, depth = [[]], 0
        for word in self[i:]:
            depth += (word.text in "([{") - (word.text in ")]}")
            if not depth:
                return out if out != [[]] else []
            if word.text == "," and depth == 1:
                out.append([])
            elif not (word.text == "(" and depth == 1 and out == [[]]):
                out[-1].append(word)
        return None

    def calls(self) -> Iterator[tuple[int, str | None, str, list[list[Word]]]]:
        """(place of the first word, owner or null, function, arguments) of every call ``owner.function(...)`` or ``function(...)``."""
        for i, word in enumerate(self):
            if word.name and self.reads(i + 1, "("):
                owned = self.reads(i - 1, ".") and i > 1 and self[i - 2].name
                args = self.arguments(i + 1)
                if args is not None:
                    yield (i - 2, self[i - 2].text, word.text, args) if owned else (i, None, word.text, args)


def quoted(line: str) -> tuple[list[str], str]:
    """The strings in single quotes of a line (a doubled quote is a quote), and the line without them; an unclosed one stays."""
    found, rest, at = [], [], 0
    while (start := line.find("'", at)) >= 0:
        end = line.find("'", start + 1)
        while end >= 0 and line[end + 1 : end + 2] == "'":
            end = line.find("'", end + 2)
        if end < 0:
            break
        found.append(line[start + 1 : end].replace("''", "'"))
        rest.append(line[at:start])
        at = end + 1
    return found, "".join([*rest, line[at:]])


def first_name(text: str) -> str:
    """The name that a text begins with, after white space; empty if it begins with none."""
    text = text.lstrip()
    end = next((i for i, c in enumerate(text) if not (c.isascii() and (c.isalnum() or c == "_"))), len(text))
    return text[:end] if end and not text[0].isdigit() else ""


def included(line: str) -> list[str]:
    """The files that a line includes: what stands between quotes or pointed brackets after the directive, in any case."""
    out, low, at = [], line.lower(), 0
    while (at := low.find("#include", at)) >= 0:
        at += len("#include")
        rest = line[at:].lstrip()
        ends = [i for i in (rest.find(">", 1), rest.find('"', 1)) if i > 1]
        if rest[:1] in ("<", '"') and ends:
            out.append(rest[1 : min(ends)])
    return out

"""A scanner for LaTeX that finds statements and section titles.

Rules: ``%`` hides the rest of a line; ``\\verb`` and verbatim environments are opaque;
``\\end`` closes the nearest open environment of its name with all that is open within;
an environment that is never closed counts as if its ``\\begin`` weren't there.
Statements and titles are seen at the top or within other environments only, not in
groups, arguments, math or statements.  A statement's label is its first ``\\label`` that
is in no group, math or environment within it.  Its body is the source from ``\\begin``
to ``\\end``.

Time and memory are linear in the source: brackets are matched once for all of it, open
environments are found by their names, and tokens are read in two passes and never kept.
``latex_events`` is the scanner as a table function.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import functions as F

from ..schema import ENVIRONMENTS, SECTIONS

TOKEN = re.compile(
    r"%[^\n]*"
    r"|\\verb\*?(?P<bar>[^a-zA-Z\s*])"
    r"|\\(?P<edge>begin|end)\s*\{(?P<env>[^{}]*)\}"
    r"|\\(?P<macro>[a-zA-Z]+)"
    r"|\\(?P<sign>.)"
    r"|(?P<plain>\$\$|\$|[{}])",
    re.S,
)
BRACKET = re.compile(r"\\.|([\[\]{}])", re.S)
WORD = re.compile(r"\\[a-zA-Z]+|\\.|.", re.S)
SPACE = re.compile(r"\s*")
OPAQUE = ("verbatim", "verbatim*", "Verbatim", "lstlisting", "minted", "comment")
STATEMENT, SECTION = frozenset(ENVIRONMENTS), frozenset(SECTIONS)
OPENER = {"]": "[", "}": "{"}
CLOSER = {"[": "\\]", "(": "\\)"}


class Source:
    """A source, and what is found in it once."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def groups(self) -> dict[str, tuple[array, array]]:
        """Of [ and { the places of those that are closed, in order, and where their groups end."""
        open_: dict[str, list[int]] = {"[": [], "{": []}
        found: dict[str, list[tuple[int, int]]] = {"[": [], "{": []}
        for m in BRACKET.finditer(self.text):
            if c := m[1]:
                if c in open_:
                    open_[c].append(m.start())
                elif open_[OPENER[c]]:
                    found[OPENER[c]].append((open_[OPENER[c]].pop(), m.end()))
        out = {}
        for c, pairs in found.items():
            pairs.sort()
            out[c] = array("q", (a for a, _ in pairs)), array("q", (b for _, b in pairs))
        return out

    def group(self, at: int) -> int:
        """The end of the group that opens at ``at``, or -1."""
        starts, ends = self.groups[self.text[at]]
        k = bisect_left(starts, at)
        return ends[k] if k < len(starts) and starts[k] == at else -1

    def skip(self, at: int) -> int:
        return SPACE.match(self.text, at).end()

    def starts(self, c: str, at: int) -> bool:
        return self.text.startswith(c, at)

    def tokens(self) -> Iterator[re.Match]:
        text, at = self.text, 0
        lone: set[str] = set()  # bars after which none follows
        while m := TOKEN.search(text, at):
            at = m.end()
            if bar := m["bar"]:
                end = -1 if bar in lone else text.find(bar, at)
                if end < 0:
                    lone.add(bar)
                    m = TOKEN.match(text, m.start(), m.start() + 5)  # the macro alone
                    at = m.end()
                else:
                    at = end + 1
            elif m["edge"] == "begin" and m["env"] in OPAQUE:
                end = text.find(f"\\end{{{m['env']}}}", at)
                at = len(text) if end < 0 else end + len(m["env"]) + 6
                continue
            yield m

    def closed(self) -> set[int]:
        """Where the environments begin that have an end."""
        out: set[int] = set()
        waiting: list[tuple[str, int]] = []
        by_name: dict[str, int] = defaultdict(int)
        for m in self.tokens():
            if m["edge"] == "begin":
                waiting.append((m["env"], m.start()))
                by_name[m["env"]] += 1
            elif m["edge"] == "end" and by_name[m["env"]]:
                while True:
                    name, at = waiting.pop()
                    by_name[name] -= 1
                    if name == m["env"]:
                        out.add(at)
                        break
        return out

    def title(self, at: int) -> tuple[str, int]:
        """The first argument of a section macro whose name ends at ``at``: a star, else
        ``[...]``, else ``{...}``, else one token; braces and blanks are stripped."""
        first, i = None, self.skip(at)
        if self.starts("*", i):
            first, i = "*", self.skip(i + 1)
        if self.starts("[", i) and (end := self.group(i)) > 0:
            first, i = first if first is not None else self.text[i:end], self.skip(end)
        if self.starts("{", i):
            if (end := self.group(i)) > 0:
                first, i = first if first is not None else self.text[i:end], end
        elif first is None and i < len(self.text):
            m = WORD.match(self.text, i)
            first, i = m[0], m.end()
        return (first or "").strip("{} "), i


def events(source: str) -> Iterator[tuple[int, str, str, str, str, str]]:
    """(pos, kind, name, title, label, body); kind is ``section`` or ``block``."""
    src = Source(source)
    closed = src.closed()
    stack: list[tuple[str, str, int]] = []  # (env, group or math; name or closer; start)
    open_: dict[str, int] = defaultdict(int)  # environments on the stack
    blind = 0  # groups, math and statements that are open
    label: str | None = None
    until = 0
    for m in src.tokens():
        if m.start() < until:
            continue
        if m["edge"] == "begin":
            if m.start() in closed:
                stack.append(("env", m["env"], m.start()))
                open_[m["env"]] += 1
                if m["env"] in STATEMENT:
                    if not blind:
                        label = None
                    blind += 1
        elif m["edge"] == "end":
            if not open_[m["env"]]:
                continue
            while True:
                kind, name, start = stack.pop()
                blind -= kind != "env" or name in STATEMENT
                if kind == "env":
                    open_[name] -= 1
                    if name == m["env"]:
                        break
            if name in STATEMENT and not blind:
                yield start, "block", name, "", label or "", source[start : m.end()]
        elif (name := m["macro"]) is not None:
            if name in SECTION and not blind:
                title, until = src.title(m.end())
                yield m.start(), "section", name, title, "", ""
            elif name == "label" and label is None and blind == 1 and stack and stack[-1][0] == "env" and stack[-1][1] in STATEMENT:
                i = src.skip(m.end())
                if src.starts("{", i) and (end := src.group(i)) > 0:
                    label, until = source[i:end].strip("{} "), end
        else:
            mark = m["plain"] or (m["sign"] and "\\" + m["sign"])
            if mark == "{":
                stack.append(("group", "", m.start()))
                blind += 1
            elif mark == "}":
                if stack and stack[-1][0] == "group":
                    stack.pop()
                    blind -= 1
            elif mark in ("$", "$$", "\\[", "\\(", "\\]", "\\)"):
                if stack and stack[-1][0] == "math" and stack[-1][1] == mark:
                    stack.pop()
                    blind -= 1
                elif mark not in ("\\]", "\\)"):
                    stack.append(("math", CLOSER.get(mark[1:], mark), m.start()))
                    blind += 1


#: What went wrong with a source that can't be scanned is an event too.
BAD = (ValueError, IndexError, RecursionError, MemoryError)


@F.udtf(returnType="nth int, pos long, kind string, name string, title string, label string, body string")
class latex_events:
    """The events of a text, numbered from 1: ``docs, LATERAL latex_events(text)``.  A null text has
    none; one that can't be scanned has one of kind ``error``, with what went wrong as its title."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            found = list(events(text)) if text else []
        except BAD as e:
            found = [(0, "error", type(e).__name__, str(e), "", "")]
        for i, e in enumerate(found, 1):
            yield (i, *e)

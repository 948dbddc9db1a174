"""Visible text of HTML pages, laid out as a reader sees it.

A tree builder reads tags and text, adds the end tags that HTML lets authors leave out
(p, li, dt, dd, tr, td, th, option, thead, tbody, ...), closes what an end tag leaves
open, and ignores end tags without a start.  Then a renderer walks the tree with an
explicit stack:

* not shown: head and its contents, script, style, template, noscript and other elements
  without text of their own; a closed dialog; comments, declarations, processing
  instructions; elements with ``display: none`` or the attribute ``hidden``, and text whose
  nearest ``visibility`` is hidden or collapse (a child may be visible again).  Styles are
  those of the attribute and of style elements, there by selectors of a tag, classes and an
  id without combinators; outside @media, or in one for all or screen.  ``aria-hidden`` hides
  from no reader's eyes.  The text of svg and math, of object and of details is shown.
* runs of white space in text are one space; ``pre`` and ``textarea`` keep theirs.
* blocks start new lines; paragraphs, headings, lists, tables, quotes are set off by an
  empty line; ``br`` breaks the line; ``hr`` is a line of dashes.
* list items begin with ``- `` or their number, indented by the depth of the list.
* a table's rows are lines of `` | ``-joined cells padded to their column's width.  A cell is
  laid out like a page of its own (paragraphs, lists, tables within) and may have several
  lines; cells may span columns and rows.  Lines of over CELL_WIDTH characters are wrapped at
  spaces, save in a row's last cell, which nothing is aligned to.  ``img`` gives its alt text,
  buttons and fields their value.  Text of a table that is in no cell comes before it.

HTML's own limits hold: colspan 1000, rowspan 65534 (and the rows of its group); numbers of
more than nine digits are taken for absent.  A cell that spans columns, and the gap in a line
that such a cell leaves, is padded to SPAN_WIDTH characters at most: what stands beyond is not
aligned, but no text is left out.  Null html gives null text; empty html gives the
empty text.  Very long pages and deep trees take no recursion, and time in proportion to
their text and tags; only cells that span rows with unlike ends are looked at again in each
of their rows.  Repeated rows are rendered alike; an empty table gives an empty result.  A
caller's columns come back unchanged, whatever their names: a result whose name is taken is
named with an underscore after it.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, per_batch, read, row_of, unfolded

TOKEN = re.compile(
    r"<!---?>|<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?=[^a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)",
    re.S,
)
#: What precedes an attribute, its name, and the sign that a value follows.
NAME = re.compile(r"[\s/]*(?:(>)|(=?[^\s/>=]*))(\s*=\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")
BLANK = re.compile(r"[ \t\n\r\f]+")
#: Characters of a line in a cell that another cell is aligned after; most that a span is padded to.
CELL_WIDTH, SPAN_WIDTH = 80, 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
KEPT = frozenset("pre textarea xmp listing".split())
HIDDEN = frozenset(
    "head script style template noscript title meta link base iframe noembed noframes audio video canvas datalist area param source track defs desc metadata annotation annotation-xml".split()
)
#: Blocks that are set off by an empty line, and those that only start a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre listing xmp blockquote figure fieldset hr".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary tr caption thead tbody tfoot svg".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CELL = ("td", "th")
GROUP = ("thead", "tbody", "tfoot")
LISTS = ("ul", "ol", "menu")
#: An end tag, or an implied one, doesn't reach beyond these.
SCOPE = ("td", "th", "caption", "table", "object", "marquee", "template")
#: What an item's start tag doesn't reach beyond: HTML's special elements, save address, div and p.
SPECIAL = frozenset(
    "applet article aside blockquote body button caption center dd details dir dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li listing main marquee menu nav object ol pre search section select summary table tbody td template tfoot th thead tr ul xmp".split()
)
#: A start tag of the key ends the nearest open element of the value, if none of the bounds is nearer.
IMPLIED: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "li": (("li",), tuple(SPECIAL - {"li"})),
    "dt": (("dt", "dd"), tuple(SPECIAL - {"dt", "dd"})),
    "dd": (("dt", "dd"), tuple(SPECIAL - {"dt", "dd"})),
    "option": (("option",), ("select", "datalist", *SCOPE)),
    "optgroup": (("optgroup", "option"), ("select", *SCOPE)),
    "td": (CELL, ("tr", "table")),
    "th": (CELL, ("tr", "table")),
    "tr": (("tr",), ("table",)),
    **dict.fromkeys(GROUP, ((*GROUP, "caption", "colgroup"), ("table",))),
    "body": (("head",), ()),
}
#: Start tags that end an open paragraph, and what keeps an outer paragraph out of reach.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dt dd listing main menu nav ol p pre search section summary table ul xmp".split()
)
P_BOUNDS = ("button", "html", "body", *SCOPE)
#: What may stand in a head; anything else ends it.
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
#: Of end tags other than SCOPE's.
BOUNDS = {"li": (*LISTS, *SCOPE), "p": P_BOUNDS, "table": ()} | dict.fromkeys((*CELL, "tr", *GROUP, "caption"), ("table",))
#: Fields whose value isn't text on the page.
NO_VALUE = frozenset("hidden password checkbox radio range color file image".split())


class Node:
    __slots__ = ("attrs", "kids", "name", "none", "unseen", "lines")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.kids = name, attrs, []
        self.none = self.unseen = False  # display: none; visibility: hidden
        self.lines: list[str] | None = None  # of a table, when it is laid out


class Tree:
    """``at`` has the places of each name's open elements, so that the nearest is known."""

    def __init__(self) -> None:
        self.root = Node("#root", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.open[-1].kids.append(node)
        self.at.setdefault(node.name, []).append(len(self.open))
        self.open.append(node)

    def nearest(self, names: tuple[str, ...]) -> int:
        return max((places[-1] for n in names if (places := self.at.get(n))), default=0)

    def close(self, names: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """Ends the nearest open element of ``names`` and all within, unless a bound is nearer."""
        place = self.nearest(names)
        if place and place >= self.nearest(bounds):
            while len(self.open) > place:
                self.at[self.open.pop().name].pop()

    def text(self, data: str) -> None:
        if data:
            if self.open[-1].name == "head" and not data.isspace():
                self.close(("head",), ())
            self.open[-1].kids.append(data)

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if self.open[-1].name == "head" and name not in HEAD_ONLY:
            self.close(("head",), ())
        if name in ENDS_P:
            self.close(("p",), P_BOUNDS)
        if name in IMPLIED:
            self.close(*IMPLIED[name])
        elif name in HEADINGS and self.open[-1].name in HEADINGS:
            self.close(HEADINGS, ())
        if name == "tr" and self.open[-1].name == "table":
            self.push(Node("tbody", {}))
        if name in CELL and self.open[-1].name in ("table", *GROUP):
            self.push(Node("tr", {}))
        if name in ("html", "body") and self.at.get(name):
            return
        node = Node(name, attrs)
        if name in VOID:
            self.open[-1].kids.append(node)
        else:
            self.push(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
        elif name in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif name not in ("html", "body"):
            self.close((name,), BOUNDS.get(name) if name in BOUNDS else tuple(b for b in SCOPE if b != name))


class Source:
    """A page's characters; attributes are read as HTML does: quotes count after ``=`` only."""

    def __init__(self, source: str):
        self.s, self.done = source, set()  # quotes that no longer occur

    def quote(self, at: int) -> int:
        """The end of a quoted value that opens at ``at``, or -1."""
        mark = self.s[at]
        if mark in self.done:
            return -1
        end = self.s.find(mark, at + 1)
        if end < 0:
            self.done.add(mark)
        return end

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Those from ``at`` on, and where the tag ends."""
        s, n, out = self.s, len(self.s), {}
        while at < n:
            m = NAME.match(s, at)
            if m[1]:
                return out, m.end(1)
            if m.end() == at:
                at += 1
                continue
            at, value = m.end(), ""
            if m[3]:
                if at < n and s[at] in "\"'" and (end := self.quote(at)) >= 0:
                    value, at = s[at + 1 : end], end + 1
                else:
                    v = UNQUOTED.match(s, at)
                    value, at = v[0], v.end()
            if m[2]:
                out.setdefault(m[2].lower(), plain(value))
        return out, n


def plain(data: str) -> str:
    return entities.unescape(data) if "&" in data else data


def parse(source: str) -> Node:
    tree, page, at, n = Tree(), Source(source), 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            tree.text(plain(source[at:]))
            break
        if m.start() > at:
            tree.text(plain(source[at : m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"]:
                tree.text(m["cdata"])
            continue
        name = name.lower()
        attrs: dict[str, str] = {}
        if source[at : at + 1] == ">":
            at += 1
        else:
            attrs, at = page.attributes(at)
        if m["end"]:
            tree.end(name)
            continue
        tree.start(name, attrs)
        if name in RAW or name in RCDATA:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            stop = end.start() if end else n
            body = source[at:stop]
            tree.text(plain(body) if name in RCDATA else body)
            tree.close((name,), ())
            at = end.end() if end else n
    return tree.root


DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMPOUND = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)", re.I)


class Styles:
    """What style elements say of display and visibility."""

    def __init__(self) -> None:
        #: By the selector's id, else its first class, else its tag: (tag, ids and classes, property) -> (rank, value).
        self.by: dict[str, dict[tuple[str, frozenset, str], tuple[tuple, str]]] = {}
        self.n = 0

    def add(self, sheet: str) -> None:
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)
        blocks: list[bool] = []  # of open at-rules: do they apply
        at = 0
        for m in re.finditer(r"[{}]", sheet):
            if m.start() < at:
                continue
            if m[0] == "}":
                if blocks:
                    blocks.pop()
                at = m.end()
                continue
            head = sheet[at : m.start()].rsplit(";", 1)[-1].strip()
            at = m.end()
            if head.startswith("@"):
                blocks.append(re.fullmatch(r"@(?:layer\b.*|media\s+(?:only\s+)?(?:all|screen))", head, re.I | re.S) is not None)
                continue
            end = sheet.find("}", at)
            end = len(sheet) if end < 0 else end
            if all(blocks):
                self.rule(head, sheet[at:end])
            at = end + 1

    def rule(self, head: str, body: str) -> None:
        said = [(p.lower(), v.lower(), bool(i)) for p, v, i in DECLARED.findall(body)]
        for selector in head.split(",") if said else ():
            m = COMPOUND.fullmatch(selector.strip())
            if not m or not m[0]:
                continue
            tag, marks = (m[1] or "*").lower(), re.findall(r"[.#][\w-]+", m[2])
            ids = [x for x in marks if x[0] == "#"]
            key = (ids or marks or [tag])[0]
            for p, v, important in said:
                self.n += 1
                rank = (important, len(ids), len(marks) - len(ids), tag != "*", self.n)
                # of rules with one selector the last counts, or the last important one
                held, what = self.by.setdefault(key, {}), (tag, frozenset(marks), p)
                if what not in held or held[what][0] < rank:
                    held[what] = (rank, v)

    def of(self, node: Node) -> dict[str, tuple[tuple, str]]:
        own = {f".{c}" for c in node.attrs.get("class", "").split()}
        if x := node.attrs.get("id"):
            own.add(f"#{x.strip()}")
        out: dict[str, tuple[tuple, str]] = {}
        for key in ("*", node.name, *own):
            for (tag, marks, p), (rank, v) in self.by.get(key, {}).items():
                if tag in ("*", node.name) and marks <= own and (p not in out or out[p][0] < rank):
                    out[p] = (rank, v)
        return out


def settle(root: Node) -> list[Node]:
    """Sets what each element's styles say; the tables that are shown, outer ones first."""
    styles, tables, todo = Styles(), [], [root]
    while todo:
        x = todo.pop()
        for k in x.kids:
            if not isinstance(k, str):
                if k.name == "style":
                    styles.add("".join(t for t in k.kids if isinstance(t, str)))
                elif k.kids:
                    todo.append(k)
    todo = [root]
    while todo:
        x = todo.pop()
        for k in x.kids:
            if isinstance(k, str):
                continue
            name, a = k.name, k.attrs
            k.none, k.unseen = name in HIDDEN, x.unseen
            if not k.none and (a or styles.n):
                said = styles.of(k) if styles.n else {}
                for p, v, important in DECLARED.findall(a["style"]) if "style" in a else ():
                    rank, p = (bool(important), 1 << 30), p.lower()
                    if p not in said or said[p][0][: len(rank)] < rank or said[p][0][0] == rank[0]:
                        said[p] = ((*rank, 0, False, 0), v.lower())
                if "display" in said:
                    k.none = said["display"][1] == "none"
                else:
                    k.none = "hidden" in a or (name == "dialog" and "open" not in a)
                if "visibility" in said and said["visibility"][1] != "inherit":
                    k.unseen = said["visibility"][1] in ("hidden", "collapse")
            elif name == "dialog":
                k.none = True
            if not k.none:
                if name == "table":
                    tables.append(k)
                todo.append(k)
    # by a walk in which a table always comes after those around it
    return tables


class Page:
    """Lines of text; ``gap`` is 1 if a new line is due, 2 if an empty line too."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space, self.indent, self.mark = 0, False, "", ""

    def flush(self) -> None:
        text = "".join(self.line).rstrip(" ")
        if text:
            self.lines.append(text)
        self.line, self.space = [], False

    def due(self, gap: int) -> None:
        if self.line:
            self.flush()
        if self.lines:
            self.gap = max(self.gap, gap)

    def begin(self) -> None:
        if not self.line:
            if self.gap == 2 and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.gap = 0
            self.line.append(self.mark or self.indent)
            self.mark = ""

    def words(self, data: str) -> None:
        text = BLANK.sub(" ", data)
        if text == " ":
            self.space = bool(self.line)
            return
        lead = text[0] == " "
        body = text.strip(" ")
        if not body:
            return
        fresh = not self.line
        self.begin()
        if not fresh and (self.space or lead):
            self.line.append(" ")
        self.line.append(body)
        self.space = text[-1] == " "

    def kept(self, data: str) -> None:
        for i, part in enumerate(data.split("\n")):
            if i:
                if self.line:
                    self.flush()
                else:
                    self.lines.append("")
            if part:
                self.begin()
                self.line.append(part)

    def done(self) -> list[str]:
        self.flush()
        a, b = 0, len(self.lines)
        while a < b and not self.lines[a]:
            a += 1
        while b > a and not self.lines[b - 1]:
            b -= 1
        return self.lines[a:b]


def wrapped(lines: list[str]) -> list[str]:
    """Lines of at most CELL_WIDTH characters where spaces allow it."""
    out = []
    for line in lines:
        at, n = 0, len(line)
        while n - at > CELL_WIDTH:
            cut = line.rfind(" ", at + 1, at + CELL_WIDTH + 1)
            if cut < 0 and (cut := line.find(" ", at + CELL_WIDTH)) < 0:
                break
            out.append(line[at:cut])
            at = cut + 1
        out.append(line[at:])
    return out


def number(value: str, least: int, most: int) -> int:
    value = value.strip()
    return min(most, int(value)) if value.isdecimal() and len(value) < 10 and int(value) >= least else 1


class Cell:
    __slots__ = ("at", "span", "first", "last", "lines", "done")

    def __init__(self, at: int, span: int, first: int, last: int, lines: list[str]):
        self.at, self.span, self.first, self.last, self.lines, self.done = at, span, first, last, lines, 0


class Columns:
    """Where columns begin: each is as wide as its widest line, and `` | `` stands between."""

    def __init__(self, width: dict[int, int]):
        self.of = width
        self.keys, self.sums, total = sorted(width), [0], 0
        for k in self.keys:
            total += width[k]
            self.sums.append(total)

    def begin(self, column: int) -> int:
        return self.sums[bisect_left(self.keys, column)] + 3 * column

    def room(self, c: Cell) -> int:
        if c.span == 1:
            return self.of.get(c.at, 0)
        return min(SPAN_WIDTH, self.begin(c.at + c.span) - 3 - self.begin(c.at))


def placed(groups: list[list[Node]], loose: Node) -> list[list[Cell]]:
    """The cells of each row at their columns; what is in no cell goes to ``loose``."""
    rows: list[list[Cell]] = []
    for group in groups:
        taken: list[list[int]] = []  # [first column, column after, last row] of cells from above, in order
        last = len(rows) + len(group) - 1
        for r in group:
            row, at, here, new = [], 0, len(rows), []
            taken = [t for t in taken if t[2] >= here]
            k = 0
            loose.kids.append(" ")
            for c in r.kids:
                if isinstance(c, str) or c.name not in CELL:
                    loose.kids.append(c)
                    continue
                if c.none:
                    continue
                while k < len(taken) and taken[k][0] <= at:
                    at = max(at, taken[k][1])
                    k += 1
                span, deep = number(c.attrs.get("colspan", ""), 1, 1000), number(c.attrs.get("rowspan", ""), 0, 65534)
                end = last if deep == 0 else min(last, here + deep - 1)
                row.append(Cell(at, span, here, end, render(c)))
                if end > here:
                    new.append([at, at + span, end])
                at += span
            if new:
                merged: list[list[int]] = []
                for t in sorted([*taken, *new]):
                    if merged and merged[-1][1] >= t[0] and merged[-1][2] == t[2]:
                        merged[-1][1] = max(merged[-1][1], t[1])
                    else:
                        merged.append(t)
                taken = merged
            rows.append(row)
    return rows


def table_lines(table: Node) -> list[str]:
    """The table's lines.  Tables within it are laid out already."""
    groups: dict[str, list[list[Node]]] = {"thead": [], "tbody": [], "tfoot": []}
    before, loose = [], Node("#part", {})
    loose.unseen = table.unseen
    for kid in table.kids:
        if isinstance(kid, str) or kid.name not in (*GROUP, "tr", "caption"):
            loose.kids.append(kid)
        elif kid.none:
            continue
        elif kid.name == "caption":
            before += render(kid)
        elif kid.name == "tr":
            groups["tbody"].append([kid])
        else:
            own = []
            for r in kid.kids:
                if isinstance(r, str) or r.name != "tr":
                    loose.kids.append(r)
                elif not r.none:
                    own.append(r)
            groups[kid.name].append(own)
    rows = placed([*groups["thead"], *groups["tbody"], *groups["tfoot"]], loose)
    # lines that another cell may follow are wrapped and give their column its width
    most = max((row[-1].at for row in rows if row), default=0)
    width: dict[int, int] = {}
    deep: list[tuple[int, int]] = []  # (-column, last row) of cells that go on below
    for i, row in enumerate(rows):
        while deep and deep[0][1] < i:
            heappop(deep)
        right = max(row[-1].at if row else -1, -deep[0][0] if deep else -1)
        for c in row:
            if c.at < right or (c.last > i and c.at < most):
                c.lines = wrapped(c.lines)
                if c.span == 1:
                    width[c.at] = max(width.get(c.at, 0), min(CELL_WIDTH, max(map(len, c.lines), default=0)))
            if c.last > i:
                heappush(deep, (-c.at, c.last))
    columns, lines = Columns(width), []
    held: list[Cell] = []  # cells that go on in the next row and have lines left
    for i, row in enumerate(rows):
        cells = sorted([*held, *row], key=lambda c: c.at)
        height = max((len(c.lines) - c.done for c in cells if c.last == i), default=0)
        height = max(height, int(any(c.lines for c in row)))
        for k in range(height):
            line, end = "", 0  # end: the column after the last that is written
            for n, c in enumerate(cells):
                if n or c.at:
                    gap = columns.begin(c.at) - columns.begin(end) - (0 if end else 3)  # of places left empty
                    line += " " * min(SPAN_WIDTH, gap) + " | "
                text = c.lines[c.done + k] if c.done + k < len(c.lines) else ""
                line += text.ljust(columns.room(c))
                end = c.at + c.span
            lines.append(line.rstrip())
        for c in cells:
            c.done += height
        held = [c for c in cells if c.last > i and c.done < len(c.lines)]
    return [*render(loose), *before, *lines]


def render(root: Node) -> list[str]:
    page = Page()
    lists: list[list] = []  # of open lists: is it numbered, the next number
    # what is to be done: a node to enter, or a call for its end
    unseen, pre = root.unseen, 0
    todo: list = [*reversed(root.kids)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if not unseen:
                page.kept(x) if pre else page.words(x)
            continue
        if isinstance(x, tuple):
            node, unseen = x
            name = node.name
            if name in LISTS:
                lists.pop()
                page.indent = "  " * len(lists)
            elif name in KEPT:
                pre -= 1
            elif name == "li":
                page.flush()
                page.mark, page.indent = "", "  " * max(0, len(lists) - 1)
            elif name == "blockquote":
                page.indent = page.indent[2:]
            if name in BLOCK:
                page.due(2 if name in SPACED and not (lists and name in ("ul", "ol", "p")) else 1)
            continue
        if x.none:
            continue
        name = x.name
        if name == "br":
            if page.line:
                page.flush()
            elif page.lines and not page.gap:
                page.lines.append("")
            continue
        if name == "wbr":
            continue
        if name == "img":
            if not x.unseen and (alt := x.attrs.get("alt", "")):
                page.words(f" {alt} ")
            continue
        if name == "hr":
            page.due(1)
            page.begin()
            page.line.append("---")
            page.due(1)
            continue
        if name == "table" and x.lines is not None:
            page.due(2)
            for line in x.lines:
                page.begin()
                page.line.append(line)
                page.flush()
            x.lines = None
            page.due(2)
            continue
        if name in CELL or name in ("input", "button", "select"):
            page.space = bool(page.line)
        if name == "input":
            if not x.unseen and x.attrs.get("type", "").strip().lower() not in NO_VALUE and (value := x.attrs.get("value", "")):
                page.words(f" {value} ")
            continue
        if name in BLOCK:
            page.due(2 if name in SPACED and not (lists and name in ("ul", "ol", "p")) else 1)
        if name in LISTS:
            start = x.attrs.get("start", "1").strip()
            lists.append([name == "ol", int(start) if start.lstrip("-").isdecimal() and len(start) < 10 else 1])
        elif name == "li":
            depth = "  " * max(0, len(lists) - 1)
            if lists and lists[-1][0]:
                value = x.attrs.get("value", "").strip()
                if value.lstrip("-").isdecimal() and len(value) < 10:
                    lists[-1][1] = int(value)
                page.mark = f"{depth}{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                page.mark = f"{depth}- "
            page.indent = depth + "  "
        elif name == "dd":
            page.mark = page.indent + "  "
        elif name in KEPT:
            pre += 1
            # a line feed right after the tag isn't shown
            if x.kids and isinstance(x.kids[0], str) and x.kids[0][:1] == "\n":
                x.kids[0] = x.kids[0][1:]
        elif name == "blockquote":
            page.indent += "  "
        todo.append((x, unseen))
        todo.extend(reversed(x.kids))
        unseen = x.unseen
    return page.done()


def extract(source: str | None) -> str | None:
    if source is None:
        return None
    root = parse(source)
    for table in reversed(settle(root)):
        table.lines = table_lines(table)
    return "\n".join(render(root))


MADE = ["text", "n_lines"]


def visible(pages: DataFrame, keep: list[str] | None = None, html: str = "html") -> DataFrame:
    """``keep`` (all columns by default) plus ``text`` and ``n_lines``."""
    keep = pages.columns if keep is None else keep
    source = pages.select(row_of(keep), F.col(html).alias("html"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(s) for s in batch.column("html").to_pylist()]
        lines = [None if t is None else t.count("\n") + 1 if t else 0 for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=[ROW, *MADE])

    return unfolded(source.mapInArrow(per_batch(work, 500), source.select(ROW).schema.add("text", "string").add("n_lines", "long")), keep, MADE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(read(spark, sf_dir, "pages"), ["page_id"])

"""HTML extraction by layout-aware rendering.

A tokenizer reads tags, comments, declarations, raw-text elements and
character references. A tree builder inserts what tags imply: paragraphs,
list items, table parts and options are closed by what cannot be inside them,
and end tags close everything open within. Elements that are not displayed
(script, style, template, head, hidden or display:none, closed dialogs, what
closed details hold beside their summary, ...) are left out with all they
contain. Visibility is inherited: what is within visibility:hidden does not show,
but for parts that are visible again; their places in lists and tables stay.

The page's own style sheets decide by selectors of a type, classes and an id, or
of several of these together, by importance, specificity and order; style attributes
come after them. Selectors with spaces, signs, pseudo-classes or attributes, and sheets
and @media blocks for anything but all or screen, have no effect; @layer is read through.

The renderer then writes every visible text: blocks on lines of their own, with
blank lines around paragraphs and headings, list items with bullets or numbers
(start, value, reversed) and indented by depth, preformatted text as it is, the
values of buttons and text fields, and tables with the cells of a column aligned;
colspan and rowspan move cells to the columns that browsers give them.

Elements nest as deep as the page says: open elements and renderings wait in
lists, not on Python's stack. Only widths are bounded, so that texts are not
much longer than pages: indentation grows to `MAX_INDENT` columns, cells of more
than `MAX_COLUMN` characters do not widen their column, and tables within
`MAX_NESTED` others have their cells one below the other.

Reading takes time in proportion to the page whatever it holds: quotes from
which no tag's end follows are remembered, and open elements are found by name.
Rules of sheets cost an element those that name its id, a class or its type.

Defined results: null and empty pages give an empty text; broken markup never
fails; repeated rows get equal results; texts are whole; only the named columns
are read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = frozenset("head script style template noscript iframe object embed audio video canvas datalist noembed noframes title meta link".split())
#: Not displayed within svg and math.
FOREIGN_INVISIBLE = {"svg": frozenset("desc metadata".split()), "math": frozenset("annotation annotation-xml".split())}
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption optgroup option search".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure article section".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot li caption option optgroup dd dt legend summary".split())
#: Elements that show or break lines without content.
ALONE = frozenset("br hr img input text".split())
#: What a start tag closes, and the elements beyond which it does not look.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select", "datalist")),
    "body": (("head",), ("html",)),
}
#: What a start tag opens before itself where its parent is one of these.
OPENS = {
    "td": (("table", "tbody"), ("tbody", "tr"), ("thead", "tr"), ("tfoot", "tr")),
    "th": (("table", "tbody"), ("tbody", "tr"), ("thead", "tr"), ("tfoot", "tr")),
    "tr": (("table", "tbody"),),
}
SECTIONS = frozenset("tbody thead tfoot".split())
#: End tags do not close what is open outside these.
WALL = frozenset("table td th caption body html".split())
#: Start tags of blocks do not close a paragraph outside these.
P_WALL = WALL | frozenset("button object".split())
#: Columns of indentation, characters of a cell that widen its column, and tables around a table that is still aligned, at most.
MAX_INDENT, MAX_COLUMN, MAX_NESTED = 200, 1000, 20
#: Types of input whose value shows.
SHOWN_INPUT = frozenset("text search url tel email number submit reset button date time month week datetime-local".split())
#: Fixed value of the HTML standard: columns that a cell spans at most.
MAX_ACROSS = 1000

LETTER = re.compile(r"[A-Za-z]")
NAME_END = re.compile(r"[\s/>]")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'][^\s=/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'][^\s]*)))?")
HIDING = re.compile(r"hidden|style|type", re.I)
ALT = re.compile(r"\salt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPAN = re.compile(r"\s(col|row)span\s*=\s*[\"']?\s*(\d{1,9})", re.I)
WHOLE = re.compile(r"\s*([+-]?\d{1,9})")
SPACE = re.compile(r"[ \t\r\n\f]+")
STYLE_TAG = re.compile(r"<style", re.I)
DECIDING = re.compile(r"display|visibility", re.I)
NOT_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
QUOTED = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
CSS_MARK = re.compile(r"[{};]")
SELECTOR = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+)*)")


def attributes(attrs: str) -> dict[str, str]:
    """Values by name; of a repeated name the first counts."""
    values: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        values.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return values


def whole(values: dict[str, str], name: str) -> int | None:
    """An attribute as a whole number, if it begins with one."""
    m = WHOLE.match(values.get(name, ""))
    return int(m[1]) if m else None


def declared(text: str) -> list[tuple[str, str, bool]]:
    """(property, value, whether important) of the declarations of display and visibility, in order."""
    out = []
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in ("display", "visibility"):
            value, mark, important = value.strip().lower().partition("!")
            out.append((name, value.strip(), bool(mark) and important.strip() == "important"))
    return out


def on_screen(media: str) -> bool:
    """Whether a list of media, without conditions, holds all or screen."""
    return not media.strip() or any(m.strip().lower() in ("all", "screen", "only all", "only screen") for m in media.split(","))


def rules(css: str):
    """(selectors, declarations) of the rules of a style sheet that apply to a screen."""
    css = QUOTED.sub('""', NOT_CSS.sub(" ", css))
    inside: list[str | None] = []  # open braces: the selectors of a rule, "" for a block that is read, None for one that is not
    at = 0
    for m in CSS_MARK.finditer(css):
        rule = bool(inside) and bool(inside[-1])
        if m[0] == ";":
            if not rule:
                at = m.end()
        elif m[0] == "{":
            head = css[at : m.start()].strip()
            word = head.split("(")[0].split(None, 1) or [""]
            if rule:  # a rule within: what was declared before it stays
                yield inside[-1], head.rpartition(";")[0]
                inside.append(None)
            elif inside and inside[-1] is None:
                inside.append(None)
            elif head.startswith("@"):
                read = word[0].lower() == "@layer" or word[0].lower() == "@media" and on_screen(head[6:])
                inside.append("" if read else None)
            else:
                inside.append(head or None)
            at = m.end()
        else:
            if rule:
                yield inside[-1], css[at : m.start()]
            if inside:
                inside.pop()
            at = m.end()


class Sheet:
    """Rules of display and visibility, found by the id, a class or the type that they name."""

    def __init__(self, css: list[str]):
        self.found: dict[str, dict[tuple, int]] = {}  # of equal rules the last counts
        self.known: dict[tuple, dict[str, tuple]] = {}
        order = 0
        for text in css:
            for selectors, body in rules(text):
                said = tuple(declared(body))
                for selector in selectors.split(",") if said else ():
                    m = SELECTOR.fullmatch(selector.strip())
                    if not m or not m[0]:
                        continue
                    marks = re.findall(r"[.#][\w-]+", m[2])
                    kind = (m[1] or "*").lower()
                    ids = [x for x in marks if x[0] == "#"]
                    rank = (len(ids), len(marks) - len(ids), int(kind != "*"))
                    order += 1
                    self.found.setdefault(ids[0] if ids else marks[0] if marks else kind, {})[kind, frozenset(marks), rank, said] = order

    def best(self, name: str, values: dict[str, str]) -> dict[str, tuple]:
        """For each property the strongest declaration: (important, in the element, rank, order, value)."""
        own = {"." + c for c in values.get("class", "").split()}
        if values.get("id"):
            own.add("#" + values["id"])
        keys = tuple(sorted(own & self.found.keys()))
        own = own if keys else set()
        known = (name, frozenset(own))
        if known in self.known:
            return dict(self.known[known])
        out: dict[str, tuple] = {}
        for key in ("*", name, *keys):
            for (kind, marks, rank, said), order in self.found.get(key, {}).items():
                if kind in ("*", name) and marks <= own:
                    for i, (what, value, important) in enumerate(said):
                        out[what] = max(out.get(what, ()), (important, False, rank, (order, i), value))
        self.known[known] = out
        return dict(out)


def sheet_of(page: str) -> Sheet | None:
    """The page's style sheets, if they decide what shows."""
    if not (STYLE_TAG.search(page) and DECIDING.search(page)):
        return None
    css, tokens, at, inert = [], Tokens(page), 0, 0
    while token := tokens.next(at):
        _, at, kind, name, attrs = token
        if name in ("template", "noscript"):
            inert += 1 if kind == "tag" else -1 if inert else 0
        elif kind == "tag" and name in RAW:
            end, on = tokens.raw_end(name, at)
            if name == "style" and not inert and DECIDING.search(page, at, end) and on_screen(attributes(attrs).get("media", "")):
                css.append(page[at:end])
            at = on
    return Sheet(css) if css else None


class Node:
    """An element: its children are nodes and strings; `shown` is its visibility, `closed` tells of details that show only their summary."""

    __slots__ = ("attrs", "children", "closed", "name", "shown")

    def __init__(self, name: str, attrs: str = "", shown: bool = True):
        self.name, self.attrs, self.children = name, attrs, []
        self.shown, self.closed = shown, False


def displayed(node: Node, sheet: Sheet | None) -> bool:
    """Whether an element is displayed by its name, attributes and the page's sheets; sets `shown`, which begins as its parent's, and `closed`."""
    name, attrs = node.name, node.attrs
    if name in INVISIBLE:
        return False
    folds = name == "details" or name == "dialog"
    if not (folds or sheet or attrs and HIDING.search(attrs)):
        return True
    values = attributes(attrs) if attrs else {}
    if name == "input" and values.get("type", "").strip().lower() == "hidden":
        return False
    best = sheet.best(name, values) if sheet else {}
    for i, (what, value, important) in enumerate(declared(values["style"]) if "style" in values else ()):
        best[what] = max(best.get(what, ()), (important, True, (), (i,), value))
    if "visibility" in best and best["visibility"][-1] in ("visible", "initial", "hidden", "collapse"):
        node.shown = best["visibility"][-1] in ("visible", "initial")
    node.closed = name == "details" and "open" not in values
    if "display" in best:
        return best["display"][-1] != "none"
    return not ("hidden" in values or name == "dialog" and "open" not in values)


class Tokens:
    """Reads tags off a page, in time proportional to its length whatever it holds."""

    def __init__(self, page: str):
        self.page = page
        self.failed: set[int] = set()  # quotes that open where no tag's end follows
        self.without: dict[str, int] = {}  # from where on marks do not occur
        self.stretch = (0, -1)  # a stretch without marks, and the mark after it
        self.name_end = 0

    def find(self, mark: str, at: int) -> int:
        if at >= self.without.get(mark, at + 1):
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.without[mark] = at
        return found

    def tag_end(self, at: int) -> int:
        """Where the > of a tag stands that is open at `at`, outside of quotes; below zero if there is none."""
        opened: list[int] = []
        first = True
        while self.find(">", at) >= 0:
            if not (first and self.stretch[0] <= at <= self.stretch[1]):
                found = MARK.search(self.page, at).start()
                if first:
                    self.stretch = at, found
            else:
                found = self.stretch[1]
            first = False
            mark = self.page[found]
            if mark == ">":
                return found
            close = -1 if found in self.failed else self.find(mark, found + 1)
            opened.append(found)
            if close < 0:
                break
            at = close + 1
        self.failed.update(opened)
        return -1

    def next(self, at: int):
        """(start, end, kind, name, attributes) of the next markup from `at` on; kind is "tag", "end" or "other"."""
        page = self.page
        while (start := self.find("<", at)) >= 0:
            ahead = page[start + 1 : start + 2]
            if ahead == "!" and page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "other", "", ""
            close = ahead == "/"
            begin = start + 1 + close
            if self.find(">", begin) >= 0 and LETTER.match(page, begin):
                if begin >= self.name_end:  # else within a name that was read before
                    m = NAME_END.search(page, begin)
                    self.name_end = m.start()
                end = self.tag_end(self.name_end)
                if end >= 0:
                    return start, end + 1, "end" if close else "tag", page[begin : self.name_end].lower(), page[self.name_end : end]
            if ahead and ahead in "!?/":
                end = self.find(">", start)
                return start, len(page) if end < 0 else end + 1, "other", "", ""
            at = start + 1
        return None

    def raw_end(self, name: str, at: int) -> tuple[int, int]:
        """Where the content of a raw element ends, and where the page goes on."""
        for m in re.compile(f"</{name}(?=[\\s/>])", re.I).finditer(self.page, at):
            end = self.find(">", m.end())
            return (m.start(), end + 1) if end >= 0 else (len(self.page), len(self.page))
        return len(self.page), len(self.page)


class Stack:
    """The open elements, and the depths at which each name is open."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.depths: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def close_to(self, depth: int) -> None:
        while len(self.nodes) > depth:
            self.depths[self.nodes.pop().name].pop()

    def open(self, name: str) -> bool:
        return bool(self.depths.get(name))

    def deepest(self, names) -> int:
        """The depth of the innermost open element of these names; 0: none."""
        return max((d[-1] for n in names if (d := self.depths.get(n))), default=0)

    def first_within(self, names, depth: int) -> int:
        """The depth of the outermost open element of these names that is deeper than `depth`; 0: none."""
        found = [d[k] for n in names if (d := self.depths.get(n)) and (k := bisect_right(d, depth)) < len(d)]
        return min(found, default=0)


def build(page: str) -> Node:
    """The tree of a page's visible elements."""
    root, sheet = Node("html"), sheet_of(page)
    stack, tokens = Stack(root), Tokens(page)
    nodes = stack.nodes
    at, n = 0, len(page)
    hidden = 0  # depth of the outermost element that does not show, 0: none

    def text(s: str) -> None:
        if s and not hidden and nodes[-1].shown and not nodes[-1].closed:
            nodes[-1].children.append(html.unescape(s) if "&" in s else s)

    def close_to(depth: int) -> None:
        nonlocal hidden
        stack.close_to(depth)
        if hidden > len(nodes):
            hidden = 0

    def add(node: Node) -> bool:
        """Put an element into the innermost open one, if it is displayed there."""
        parent = nodes[-1]
        if hidden or not displayed(node, sheet):
            return False
        if parent.closed and (node.name != "summary" or parent.children):
            return False
        if any(node.name in inner and stack.open(outer) for outer, inner in FOREIGN_INVISIBLE.items()):
            return False
        parent.children.append(node)
        return True

    def push(node: Node, added: bool) -> None:
        nonlocal hidden
        stack.push(node)
        if not added and not hidden:
            hidden = len(nodes)

    while at < n:
        token = tokens.next(at)
        if not token:
            text(page[at:])
            break
        text(page[at : token[0]])
        _, at, kind, name, attrs = token
        if kind == "other":
            continue
        if kind == "end":
            if name == "br":
                add(Node("br"))
            d = stack.deepest((name,))
            walled = name not in WALL and name not in SECTIONS and name != "tr"
            if d and not (walled and stack.deepest(WALL) > d):
                close_to(d)
            continue
        if name in CLOSES_P and stack.open("p"):
            d = stack.deepest(("p",))
            if d > stack.deepest(P_WALL):
                close_to(d)
        if name in IMPLIED:
            ends, stops = IMPLIED[name]
            lowest = stack.first_within(ends, stack.deepest(stops))
            if lowest:
                close_to(lowest)
        for parent, implied in OPENS.get(name, ()):
            if nodes[-1].name == parent:
                part = Node(implied, "", nodes[-1].shown)
                push(part, add(part))
        node = Node(name, attrs, nodes[-1].shown)
        added = add(node)
        if name in VOID or attrs.endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end, on = tokens.raw_end(name, at)
            if added and node.shown:
                node.children.append(html.unescape(page[at:end]))
            at = on
            continue
        push(node, added)
    return root


class Page:
    """Lines of rendered text; `gap` is how many line ends are due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is being written
        self.gap = 0
        self.prefix = ""
        self.indent = ""

    @property
    def line(self) -> bool:
        """Whether a line is being written."""
        return bool(self.parts)

    def end_line(self, gap: int = 1) -> None:
        if self.parts:
            line = "".join(self.parts).rstrip(" ")
            self.parts = []
            if line:
                self.lines.append(line)
        if self.lines:
            self.gap = max(self.gap, gap)

    def write(self, s: str, pre: bool = False) -> None:
        if not pre:
            s = SPACE.sub(" ", s)
            if not self.parts or self.parts[-1].endswith(" "):
                s = s.lstrip(" ")
        if not s:
            return
        if not self.parts:
            self.lines += [""] * (self.gap - 1)
            self.gap = 0
            if self.indent or self.prefix:
                self.parts.append(self.indent + self.prefix)
            self.prefix = ""
        self.parts.append(s)

    def mark(self, s: str) -> None:
        self.prefix = s

    def text(self) -> str:
        self.end_line(0)
        return "\n".join(self.lines)


def parts_of(table: Node) -> tuple[list[Node], list[Node | str]]:
    """The rows of a table and its sections, and all else that lies beside them, in order."""
    rows, others = [], []
    for c in table.children:
        if isinstance(c, Node) and c.name == "tr":
            rows.append(c)
        elif isinstance(c, Node) and c.name in SECTIONS:
            inner = parts_of(c)
            rows += inner[0]
            others += inner[1]
        else:
            others.append(c)
    return rows, others


def render_table(table: Node, page: Page, nested: int):
    """Cells of a column begin at the same place; cells of several lines keep them. What is in no row stands before them."""
    rows, others = parts_of(table)
    for c in others:
        if isinstance(c, Node):
            page.end_line()
            yield render(c, page, nested)
            page.end_line()
        elif c.strip():
            page.write(c)
    if nested >= MAX_NESTED:
        for row in rows:
            yield render(row, page, nested)
        return
    grid: list[list[tuple[int, int, list[str]]]] = []  # of each row: column, columns, lines
    taken: dict[int, int] = {}  # column -> rows that a cell above still covers
    for row in rows:
        cells, column, covered = [], 0, {}
        for c in row.children:
            if isinstance(c, Node):
                inner = Page()
                yield render(c, inner, nested + 1)
                lines = inner.text().split("\n")
                spans = {m[1].lower(): int(m[2]) for m in SPAN.finditer(c.attrs)} if "span" in c.attrs.lower() else {}
                across, down = min(max(spans.get("col", 1), 1), MAX_ACROSS), max(spans.get("row", 1), 1)
            elif c.strip():
                lines, across, down = [SPACE.sub(" ", c).strip()], 1, 1
            else:
                continue
            while column in taken:
                column += 1
            cells.append((column, across, lines))
            if down > 1:
                covered.update((column + k, down) for k in range(across))
            column += across
        taken = {k: v - 1 for k, v in {**taken, **covered}.items() if v > 1}
        if cells:
            grid.append(cells)
    # places for the columns that cells begin in
    used = sorted({c for cells in grid for c, _, _ in cells})
    place = {c: k for k, c in enumerate(used)}
    widths = [0] * len(used)
    wide = []
    for cells in grid:
        for column, across, lines in cells[:-1]:
            k, width = place[column], max((w for w in map(len, lines) if w <= MAX_COLUMN), default=0)
            end = bisect_left(used, column + across) if across > 1 else k + 1
            if end - k == 1:
                widths[k] = max(widths[k], width)
            else:
                wide.append((k, end, width))
    for k, end, width in wide:
        widths[end - 1] += max(0, width - sum(widths[k:end]) - 2 * (end - k - 1))
    starts = [0, *accumulate(w + 2 for w in widths)]
    page.end_line()
    for cells in grid:
        for k in range(max(len(lines) for _, _, lines in cells)):
            parts, length = [], 0
            for column, _, lines in cells:
                if k < len(lines) and lines[k]:
                    gap = max(starts[place[column]] - length, 2 if length else 0)
                    parts += [" " * gap, lines[k]]
                    length += gap + len(lines[k])
            page.write("".join(parts).rstrip(" ") or " ", pre=True)
            page.end_line()


def field(node: Node) -> str:
    """What an input shows: the value of buttons and text fields, the alternative text of an image."""
    values = attributes(node.attrs)
    kind = values.get("type", "text").strip().lower() or "text"
    return values.get("value", "") if kind in SHOWN_INPUT else values.get("alt", "") if kind == "image" else ""


def numbers(node: Node) -> tuple[int, int]:
    """The number of an ordered list's first item, and the step to the next."""
    values = attributes(node.attrs)
    step = -1 if "reversed" in values else 1
    start = whole(values, "start")
    if start is None:
        start = 1 if step > 0 else sum(isinstance(c, Node) and c.name == "li" for c in node.children)
    return start, step


def render(node: Node, page: Page, nested: int, pre: bool = False):
    """Write a node's visible text; yields the renderings of nodes within, each to be finished before it goes on."""
    name = node.name
    if name == "br":
        page.end_line() if page.line else setattr(page, "gap", min(2, page.gap + bool(page.lines)))
        return
    if name == "hr":
        page.end_line(2)
        return
    if name == "img":
        m = ALT.search(node.attrs) if node.shown else None
        if m:
            page.write(html.unescape(m[1] or m[2] or m[3] or ""))
        return
    if name == "input":
        label = field(node) if node.shown else ""
        if label.strip():
            page.write(f" {label} ")
        return
    if name == "table":
        page.end_line(2)
        yield render_table(node, page, nested)
        page.end_line(2)
        return
    block = name in BLOCK or name == "text"  # a text of svg stands alone
    gap = 2 if name in SPACED else 1
    if name in ("ul", "ol") and page.indent:
        gap = 1
    if block and not (name == "p" and page.prefix):
        page.end_line(gap)
    indent = page.indent
    number, step = numbers(node) if name == "ol" else (None, 0)
    if name in ("dd", "blockquote"):
        page.indent = (indent + "    ")[:MAX_INDENT]
    pre = pre or name in ("pre", "textarea", "xmp")
    for c in node.children:
        if isinstance(c, str):
            if pre:
                for i, line in enumerate(c.replace("\r\n", "\n").strip("\n").split("\n")):
                    if i:
                        if page.line:
                            page.end_line()
                        else:
                            page.gap += 1
                    page.write(line, pre=True) if line.strip() else None
            else:
                page.write(c)
        elif c.name == "li":
            mark = "- "
            if number is not None:
                given = whole(attributes(c.attrs), "value") if c.attrs else None
                number = number if given is None else given
                mark, number = f"{number}. ", number + step
            page.end_line()
            page.mark(mark if c.shown else "")
            inner = page.indent
            yield render_item(c, page, nested, len(mark))
            page.indent = inner
        elif c.children or c.name in BLOCK or c.name in ALONE:
            yield render(c, page, nested, pre)
    page.indent = indent
    if block:
        page.end_line(gap)


def render_item(item: Node, page: Page, nested: int, width: int):
    """A list item: its first line bears the mark, later lines are indented as far."""
    outer = page.indent
    for c in item.children:
        if isinstance(c, str):
            page.write(c)
        else:
            yield render(c, page, nested)
        if page.line or not page.prefix:
            page.indent = (outer + " " * width)[:MAX_INDENT]
    if page.prefix:  # an empty item shows its mark
        page.write(" ", pre=True)
    page.end_line()


def finish(rendering) -> None:
    """Run a rendering with those that it waits for."""
    waiting = [rendering]
    while waiting:
        inner = next(waiting[-1], None)
        if inner is None:
            waiting.pop()
        else:
            waiting.append(inner)


def extract(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    out = Page()
    finish(render(build(page), out, 0))
    return out.text()


def visible_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Columns `id_col`, text, for every row."""
    ship(pages.sparkSession)

    def run(batches):
        for b in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract(h) for h in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)

"""Layout-aware text of HTML pages.

A tokenizer and a tree builder with implied end tags read a page; a renderer
walks the tree once and emits all visible text with block spacing, list markers
and aligned table cells. Nothing is scored or cut: boilerplate stays, only what
a browser would not show is left out: also closed dialogs and what stands
inside of progress bars and meters. Lines of a nested table are handed on as
they are where it stands alone in its column, so depth costs no work per line.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object video audio canvas datalist noembed noframes title".split())
#: Descendants of svg and math that are not drawn.
UNDRAWN = frozenset("defs desc metadata symbol clippath annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Types of input fields that show no text of their value.
WORDLESS = frozenset("checkbox color file image hidden password radio range".split())
#: Levels of lists and quotes that are indented; deeper ones keep the indentation of the last of these.
INDENTED = 100
#: A table is aligned as wide as its widest cells, unless that takes more than so many times its text and so many characters;
#: then the widest cells push only their own rows.
PADDING, LEAST_PADDING = 8, 20_000
#: Columns and rows that a cell may span, as browsers have it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Blocks with a blank line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section summary table ul li dd dt".split()
)
#: What a start tag ends if it is open, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Start tags that leave an open head open; any other, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements that an end tag of a formatting element does not close.
SCOPE = frozenset("table td th caption html template button object".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"""
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
SHOWN = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
#: A selector of one element by its tag, classes and id.
SIMPLE = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class Open:
    """The open elements and, for each name, the places at which it is open."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, low: int) -> None:
        while len(self.nodes) > low:
            self.at[self.nodes.pop().tag].pop()

    def last(self, names: set[str] | frozenset[str]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def end(self, names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        """Close the outermost of `names` that is open inside the nearest of `until`."""
        some = [self.at[n] for n in names if self.at.get(n)]
        if some:
            barrier = self.last(until)
            inside = [places[k] for places in some if (k := bisect_right(places, barrier)) < len(places)]
            if inside:
                self.cut(min(inside))

    def end_tag(self, name: str) -> None:
        """Close the innermost element of the name, unless a boundary that its end tag does not cross is nearer."""
        if self.at.get(name):
            stop = self.last(frozenset() if name in BLOCK else SCOPE)
            if name not in ("table", "body", "html"):
                stop = max(stop, self.last({"table"}))
            if self.at[name][-1] >= stop:
                self.cut(self.at[name][-1])


def parse(html: str) -> tuple[Node, list[str]]:
    """The tree of a page and its style sheets. Missing end tags are implied; stray ones are ignored."""
    root, styles, at = Node("#root", {}), [], 0
    stack = Open(root)

    def text(s: str) -> None:
        if s:
            s = unescape(s) if "&" in s else s
            if stack.nodes[-1].tag == "head" and s.strip(" \t\n\r\f"):
                stack.cut(len(stack.nodes) - 1)
            stack.nodes[-1].children.append(s)

    while m := TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m[1]:
            if name == "p" and not stack.at.get("p"):
                stack.nodes[-1].children.append(Node("p", {}))  # a stray </p> is an empty paragraph
            elif name == "br":
                stack.nodes[-1].children.append(Node("br", {}))
            else:
                stack.end_tag(name)
            continue
        if stack.nodes[-1].tag == "head" and name not in IN_HEAD:
            stack.cut(len(stack.nodes) - 1)
        if name in ENDS_P:
            stack.end({"p"}, SCOPE)
        if name in IMPLIED:
            stack.end(*IMPLIED[name])
        node = Node(name, _attributes(m[3]) if m[3].strip(" /\n\t\r") else {})
        stack.nodes[-1].children.append(node)
        if m[3].endswith("/") and (name in ("svg", "math") or stack.at.get("svg") or stack.at.get("math")):
            continue  # foreign elements may be closed by their start tags
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(html, at)
            body = html[at : close.start() if close else len(html)]
            at = close.end() if close else len(html)
            if body:
                node.children.append(unescape(body) if name in ("title", "textarea") else body)
            if name == "style" and not stack.at.get("template") and node.attrs.get("media", "all").strip().lower() in ("", "all", "screen"):
                styles.append(body)
        elif name not in VOID:
            stack.push(node)
    text(html[at:])
    return root, styles


# --- what is seen --------------------------------------------------------------------------------------------------


def _shown(declarations: str) -> dict[str, str]:
    return {m[1].lower(): m[2].lower() for m in SHOWN.finditer(declarations)} if "display" in declarations.lower() or "visibility" in declarations.lower() else {}


class Styles:
    """The rules of style sheets on display and visibility whose selectors name one element; others and at-rules are not followed."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, list[tuple]] = defaultdict(list)
        self.known: dict[tuple, dict[str, str]] = {}  # what the rules say of a tag, class attribute and id
        order = 0
        for sheet in sheets:
            for selectors, body in self._blocks(re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)):
                found = _shown(body)
                for one in selectors.split(",") if found else ():
                    m = SIMPLE.fullmatch(one.strip())
                    if m and (m[1] or m[2]):
                        marks = re.findall(r"[.#][\w-]+", m[2])
                        weight = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), int(m[1] not in (None, "*")))
                        order += 1
                        tag = None if m[1] in (None, "*") else m[1].lower()
                        self.rules[marks[0] if marks else tag or "*"].append((weight, order, tag, frozenset(marks), found))

    @staticmethod
    def _blocks(css: str) -> Iterator[tuple[str, str]]:
        """(selectors, declarations) of the rules outside of at-rules."""
        depth, start, body, head = 0, 0, 0, ""
        for m in re.finditer(r"[{};]", css):
            c, i = m[0], m.start()
            if c == ";":
                start = i + 1 if not depth else start
            elif c == "{":
                if not depth:
                    head, body = css[start:i].strip(), i + 1
                depth += 1
            elif depth:
                depth -= 1
                if not depth:
                    start = i + 1
                    if not head.startswith("@"):
                        yield head, css[body:i]

    def of(self, node: Node) -> dict[str, str]:
        """display and visibility of an element, as far as its rules and its style attribute set them."""
        own: dict[str, str] = {}
        kind = (node.tag, node.attrs.get("class", ""), node.attrs.get("id", ""))
        if kind in self.known:
            own = dict(self.known[kind])
        elif self.rules:
            marks = {f".{c}" for c in node.attrs.get("class", "").split()} | ({"#" + node.attrs["id"]} if node.attrs.get("id") else set())
            hits = [r for key in (*marks, node.tag, "*") for r in self.rules.get(key, ()) if r[2] in (None, node.tag) and r[3] <= marks]
            for *_, found in sorted(hits, key=lambda r: r[:2]):
                own |= found
            self.known[kind] = dict(own)
        return own | _shown(node.attrs["style"]) if "style" in node.attrs else own


# --- rendering -----------------------------------------------------------------------------------------------------


def _joined(a: list[str], b: list[str]) -> list[str]:
    """The lines of a and then of b, in the longer of the two lists, which neither is used after."""
    if len(a) < len(b):
        b[:0] = a
        return b
    a += b
    return a


class Sheet:
    """Lines of text under construction, with the indentation of the levels that are open."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # a collapsed space is due before the next text
        self.blank = False  # a blank line is due before the next line
        self.indent = ""
        self.levels: list[str] = []
        self.fresh: list[tuple[str, str]] = []  # the last levels, which have no line yet: what stands before the first and the other lines

    def inline(self, s: str) -> None:
        body = SPACES.sub(" ", s)
        if body[:1] == " ":
            self.space, body = True, body[1:]
        if not body:
            return
        if self.space and self.now:
            self.now.append(" ")
        self.space = body[-1] == " "
        self.now.append(body[:-1] if self.space else body)

    def line_end(self, force: bool = False) -> None:
        if self.now or force:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            text = "".join(self.now)
            self.lines.append((self.indent + "".join([f for f, _ in self.fresh]) + text).rstrip() if self.fresh or text.strip() else "")
            if self.fresh:
                self.indent += "".join([r for _, r in self.fresh])
                self.fresh = []
        self.now, self.space = [], False

    def blank_line(self) -> None:
        self.line_end()
        if not self.fresh:
            self.blank = True

    def put(self, lines: list[str]) -> None:
        """Lines without trailing spaces, each a line of its own."""
        self.line_end()
        if lines and not (self.indent or self.fresh):
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines = _joined(self.lines, lines)
            return
        for s in lines:
            self.now = [s]
            self.line_end(force=True)

    def push(self, first: str, rest: str) -> None:
        self.line_end()
        rest = rest if len(self.levels) < INDENTED else ""
        self.levels.append(rest)
        self.fresh.append((first, rest))

    def pop(self, keep_mark: bool) -> None:
        """End the last level; one without a line leaves its mark, if that is to be kept."""
        self.line_end()
        rest = self.levels.pop()
        if self.fresh:
            if keep_mark:
                self.line_end(force=True)
            else:
                self.fresh.pop()
                return
        self.indent = self.indent[: len(self.indent) - len(rest)]
        self.blank = False


def _number(text: str | None, default: int, low: int, high: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,18})", text or "")
    return max(low, min(high, int(m[1]))) if m else default


class Table:
    """Rows of cells (lines, columns, rows), and what stands in a table outside of them."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.other = Sheet()

    def _placed(self) -> list[dict[int, list[str]]]:
        """For each row the lines by column; columns that a cell of a row above still spans are stepped over."""
        spans: list[tuple[int, int, int]] = []  # first column, end, first row below
        out = []
        for r, row in enumerate(self.rows):
            spans = sorted(s for s in spans if s[2] > r)
            at, k, cells = 0, 0, {}
            for lines, wide, tall in row:
                while k < len(spans) and spans[k][0] <= at:
                    at = max(at, spans[k][1])
                    k += 1
                cells[at] = lines
                if tall != 1:
                    spans.append((at, at + wide, r + tall if tall else len(self.rows)))
                    spans.sort()
                    k = bisect_right(spans, (at, at + wide, MOST_ROWS * 2 + r))
                at += wide
            out.append(cells)
        return out

    def lines(self) -> list[str]:
        self.other.line_end()
        rows = self._placed()
        columns = sorted({c for row in rows for c, cell in row.items() if cell})
        if len(columns) <= 1:
            for row in rows:
                for cell in row.values():
                    self.other.lines = _joined(self.other.lines, cell)
            return self.other.lines
        place = {c: i for i, c in enumerate(columns)}
        height = sum(max((len(x) for x in row.values()), default=0) for row in rows)
        text = sum(len(x) for row in rows for cell in row.values() for x in cell)
        cap = max((len(x) for row in rows for cell in row.values() for x in cell), default=0)
        while True:
            width = [0] * len(columns)
            for row in rows:
                for c, cell in row.items():
                    if cell:
                        width[place[c]] = max(width[place[c]], max((len(x) for x in cell if len(x) <= cap), default=0))
            if height * sum(width[:-1]) <= PADDING * text + LEAST_PADDING or not cap:
                break
            cap //= 2
        out = self.other.lines
        for row in rows:
            cells = {place[c]: cell for c, cell in row.items() if cell}
            last = max(cells, default=-1)
            for k in range(max((len(c) for c in cells.values()), default=0)):
                out.append("  ".join((cells[i][k] if i in cells and k < len(cells[i]) else "").ljust(width[i]) for i in range(last + 1)).rstrip())
        return out


def _plain(node: Node) -> str:
    found, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            found.append(n)
        else:
            todo += reversed(n.children)
    return SPACES.sub(" ", "".join(found)).strip(" ")


class Page:
    """Walks a tree and writes what it shows. `work` holds (children, how each is taken, what follows them)."""

    def __init__(self, root: Node, styles: list[str]):
        self.styles, self.sheet = Styles(styles), Sheet()
        self.pre = self.unseen = self.in_item = self.foreign = False
        self.list: list | None = None  # ordered, next number
        self.work: list[tuple[Iterator, Callable, Callable | None]] = [(iter(root.children), self.flow, None)]
        while self.work:
            todo, take, after = self.work[-1]
            c = next(todo, None)
            if c is not None:
                take(c)
                continue
            self.work.pop()
            if after:
                after()
        self.sheet.line_end()

    def into(self, children: list, take: Callable, after: Callable | None = None, **changes) -> None:
        """Take the children next, with some of the state changed until they are through."""
        before = {k: getattr(self, k) for k in changes}
        for k, v in changes.items():
            setattr(self, k, v)

        def done() -> None:
            for k, v in before.items():
                setattr(self, k, v)
            if after:
                after()

        self.work.append((iter(children), take, done if before or after else None))

    def seen(self, node: Node) -> dict | None:
        """What an element changes of the state, or None if it is not displayed."""
        a = node.attrs
        if node.tag in HIDDEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
            return None
        closed = node.tag == "dialog" and "open" not in a
        if not self.styles.rules and "style" not in a:
            return None if closed else {}
        own = self.styles.of(node)
        if own.get("display", "none" if closed else "") == "none":
            return None
        if own.get("visibility") in ("hidden", "collapse"):
            return {"unseen": True}
        return {"unseen": False} if own.get("visibility") == "visible" else {}

    def words(self, s: str) -> None:
        if self.unseen:
            return
        if not self.pre:
            self.sheet.inline(s)
            return
        for i, p in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.sheet.line_end(force=True)
            if p:
                self.sheet.now.append(p)

    def flow(self, c: Node | str) -> None:
        if isinstance(c, str):
            self.words(c)
            return
        state = self.seen(c)
        if state is None:
            return
        tag, sheet = c.tag, self.sheet
        unseen = state.get("unseen", self.unseen)
        if tag == "br":
            sheet.line_end(force=True)
        elif tag == "hr":
            sheet.blank_line()
            if not unseen:
                sheet.put(["---"])
            sheet.blank_line()
        elif (field := self.field(c)) is not None:
            if not unseen:
                sheet.inline(field)
        elif self.foreign and tag in UNDRAWN:
            pass
        elif self.foreign and tag == "text":
            sheet.inline(" ")
            self.into(c.children, self.flow, lambda: sheet.inline(" "), **state)
        elif tag in ("svg", "math"):
            self.into(c.children, self.flow, **state, foreign=True)
        elif tag == "table":
            self.table(c, state)
        elif tag in ("ul", "ol", "menu", "dir"):
            around = sheet.line_end if self.in_item else sheet.blank_line
            around()
            numbers = [tag == "ol", _number(c.attrs.get("start"), 1, -(2**31), 2**31 - 1)]
            self.into(c.children, self.flow, around, **state, list=numbers, in_item=False)
        elif tag == "li":
            self.item(c, state, unseen)
        elif tag in BLOCK:
            around = sheet.blank_line if tag in SPACED else sheet.line_end
            around()
            if tag in ("blockquote", "dd"):
                sheet.push("    ", "    ")

                def after() -> None:
                    sheet.pop(False)
                    around()

                self.into(c.children, self.flow, after, **state, in_item=False)
                return
            children = c.children
            if tag == "pre" and children and isinstance(children[0], str):  # a line break right behind the tag is none
                children = [re.sub(r"\A\r?\n", "", children[0]), *children[1:]]
            elif tag == "details" and "open" not in c.attrs:
                children = [x for x in children if not isinstance(x, str) and x.tag == "summary"][:1]
            self.into(children, self.flow, around, **state, pre=self.pre or tag == "pre")
        else:
            self.into(c.children, self.flow, **state)

    def item(self, c: Node, state: dict, unseen: bool) -> None:
        mark, sheet = "* ", self.sheet
        if self.list and self.list[0]:
            self.list[1] = _number(c.attrs.get("value"), self.list[1], -(2**31), 2**31 - 1)
            mark = f"{self.list[1]}. "
            self.list[1] += 1
        sheet.push(" " * len(mark) if unseen else mark, " " * len(mark))
        self.into(c.children, self.flow, lambda: sheet.pop(not unseen), **state, in_item=True, list=None)

    def field(self, c: Node) -> str | None:
        """The text of an image, a bar or a form field that has no shown children, else None."""
        if c.tag in ("progress", "meter"):
            return ""
        if c.tag == "img" or (c.tag == "input" and c.attrs.get("type", "").strip().lower() == "image"):
            return c.attrs.get("alt", "")
        if c.tag == "input":
            shown = c.attrs.get("type", "").strip().lower() not in WORDLESS and c.attrs.get("value")
            return f" {shown} " if shown else ""
        return f" {self.options(c)} " if c.tag == "select" else None

    def options(self, node: Node) -> str:
        """What a select shows: all options of a list box, else the last selected or the first one."""
        options, todo = [], list(reversed(node.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str) or self.seen(c) is None:
                continue
            if c.tag == "option":
                options.append(c)
            else:
                todo += reversed(c.children)
        if "multiple" not in node.attrs and _number(node.attrs.get("size"), 1, 0, 2**31) <= 1:
            options = [o for o in options if "selected" in o.attrs][-1:] or [o for o in options if "disabled" not in o.attrs][:1] or options[:1]
        return " ".join(o.attrs.get("label") or _plain(o) for o in options)

    def table(self, node: Node, state: dict) -> None:
        outer, t = self.sheet, Table()
        outer.blank_line()

        def cell(c: Node, row: list, own: dict) -> None:
            sheet = Sheet()

            def after() -> None:
                sheet.line_end()
                row.append((sheet.lines, _number(c.attrs.get("colspan"), 1, 1, MOST_COLUMNS), _number(c.attrs.get("rowspan"), 1, 0, MOST_ROWS)))

            self.into(c.children, self.flow, after, **own, sheet=sheet, in_item=False, list=None)

        def in_row(row: list) -> Callable:
            def take(c: Node | str) -> None:
                if not isinstance(c, str) and c.tag in ("td", "th"):
                    if (own := self.seen(c)) is not None:
                        cell(c, row, own)
                else:
                    self.into([c], self.flow, sheet=t.other)

            return take

        def in_table(c: Node | str) -> None:
            if isinstance(c, str):
                if c.strip():
                    self.into([c], self.flow, t.other.line_end, sheet=t.other)
                return
            own = self.seen(c)
            if own is None:
                return
            if c.tag in ("tr", "td", "th"):  # a cell outside a row is a row of its own
                t.rows.append([])
                self.into(c.children if c.tag == "tr" else [c], in_row(t.rows[-1]), t.other.line_end, **own)
            elif c.tag in ("tbody", "thead", "tfoot"):
                self.into(c.children, in_table, **own)
            else:
                self.into([c], self.flow, t.other.line_end, sheet=t.other)

        def after() -> None:
            outer.put(t.lines())
            outer.blank_line()

        self.into(node.children, in_table, after, **state, in_item=False, list=None)


def page_text(html: str) -> str:
    """All visible text of a page: lines joined by line feeds, without trailing spaces, at most one blank line in a row."""
    out: list[str] = []
    for s in Page(*parse(html)).sheet.lines:
        s = s.rstrip()
        if s or (out and out[-1]):
            out.append(s)
    return "\n".join(out).strip("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: id, text. Null or empty HTML gives the empty text.

    Repeated rows give repeated results; an empty table gives no rows; other
    columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([page_text(h.as_py() or "") for h in part.column(1)], pa.string())], ["id", "text"])

    picked = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("h"))
    return picked.mapInArrow(work, "id long, text string").withColumnRenamed("id", id_col)

"""All visible text of HTML pages, laid out: blocks, lists and aligned tables.

A forgiving tree builder closes what HTML lets one leave open (a paragraph before
a block, a list item before the next, table rows and cells, the head), drops end tags that
match nothing and closes what is open inside an element that ends. Tags are found
by a scan that passes over each character a few times at most: where a quote or a
tag is never closed, that is remembered and not looked for again.

Not shown are the head, scripts, styles and the like, elements with ``hidden``,
what the page's own styles or inline styles hide, what a closed ``details`` holds
besides its summary, and dialogs that aren't open. Of styles, rules for a tag, id,
classes or these together count, the more specific first; ``visibility`` goes down
to what is inside and can be taken back there, ``display: none`` can't. Rules
inside ``@`` blocks other than ``@media`` for screens, and selectors with more than
one element, are passed over. Formulas, the text of drawings and all options of a
choice are shown, but not their annotations, descriptions and definitions.

Then each block is rendered to lines: white space collapses outside ``pre``,
paragraphs, headings, lists and tables stand apart by an empty line, list items
have their mark and hang from it, and table cells are padded to the width of their
column.

Defined results: a null or empty page has empty text; text without tags is one
paragraph. Elements nested deeper than ``DEEPEST`` are taken as part of the
element at that depth; their text is kept. Columns wider than ``WIDEST`` aren't
padded further. Repeated rows have the same text each; an empty table has no
rows. All columns are kept; one named text is replaced.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST, WIDEST = 150, 80

# Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist meta link".split())
#: Not shown inside drawings and formulas.
FOREIGN = {
    "svg": frozenset("desc defs metadata symbol clippath mask marker pattern filter lineargradient radialgradient".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
#: Inline, but apart from their neighbours.
SPACED = frozenset("select option optgroup text mtr mtd".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary xmp table ul caption tr td th thead tbody tfoot".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre xmp article section figure fieldset".split())
CLOSES_P = BLOCK - frozenset("body html caption tr td th thead tbody tfoot".split())
#: What a start tag closes, if open and not behind the bound.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "table"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"}))),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: What may be in a head; any other start tag and text close it.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
#: An end tag doesn't reach across these.
FENCE = frozenset({"table", "td", "th"})

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_BREAK = "\x00"


class Node:
    __slots__ = ("tag", "attributes", "children", "drawn")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.drawn = tag, attributes, [], True

    def attribute(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for k, v in _ATTRIBUTE.findall(self.attributes):
            if k.lower() == name:
                return html.unescape(v.strip("\"'"))
        return None


class _Tags:
    """(start, end, name, attributes, whether it is an end tag) of each tag of a page; comments and the like have no name."""

    def __init__(self, page: str):
        self._page, self._closed, self._quoted = page, True, {'"': True, "'": True}

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        page = self._page
        while self._closed and (start := page.find("<", at)) >= 0:
            after = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", "", False
            if after and after in "!?":
                end = page.find(">", start)
                if end >= 0:
                    return start, end + 1, "", "", False
                self._closed = False
            elif m := _NAME.match(page, start + 1 + (after == "/")):
                end = page.find(">", m.end()) if after == "/" else self._end(m.end())
                if end >= 0:
                    return start, end + 1, m[0].lower(), page[m.end() : end], after == "/"
                self._closed = False
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """The place of the > that ends a start tag, outside quoted values; -1 if the page has none."""
        page, begin, first = self._page, at, at
        while m := _STOP.search(page, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            if self._quoted[m[0]] and page[first : m.start()].rstrip().endswith("="):
                end = page.find(m[0], at)
                if end < 0:
                    self._quoted[m[0]] = False  # from here on such a quote is an ordinary character
                else:
                    at = first = end + 1
            else:
                first = at
        if any(self._quoted.values()):  # the page's last > stands in quotes, so quotes aren't to be trusted
            self._quoted = dict.fromkeys(self._quoted, False)
            return page.find(">", begin)
        return -1


_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_SHOWN = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)


class Styles:
    """What a page's own styles say of display and visibility."""

    def __init__(self, text: str):
        self._by: dict[str, list[tuple[tuple, str, frozenset, dict]]] = {}
        for n, (selectors, body) in enumerate(self._rules(re.sub(r"/\*.*?(?:\*/|\Z)", "", text, flags=re.S))):
            if not (own := self._declared(body)):
                continue
            for selector in selectors.split(","):
                m = _SELECTOR.fullmatch(selector.strip())
                if not m or not m[0]:
                    continue
                tag, parts = ("" if m[1] in (None, "*") else m[1].lower()), frozenset(re.findall(r"[.#][\w-]+", m[2]))
                rank = sum(x[0] == "#" for x in parts), sum(x[0] == "." for x in parts), bool(tag), n
                key = max(parts) if parts else tag or "*"
                self._by.setdefault(key, []).append((rank, tag, parts, own))

    @staticmethod
    def _rules(text: str) -> list[tuple[str, str]]:
        """Rules outside of @ blocks, and those inside @media for all or screens."""
        out, at = [], 0
        open_: list[tuple[str, int, bool]] = []  # selector or @ rule, where its body begins, whether it is passed over
        for m in re.finditer(r"[{}]", text):
            if m[0] == "{":
                head = text[at : m.start()].rpartition(";")[2].strip()
                media = re.fullmatch(r"@media\s+(?:only\s+)?(?:all|screen)", head, re.I)
                open_.append((head, m.end(), (bool(open_) and open_[-1][2]) or (head.startswith("@") and not media)))
            elif open_:
                head, begin, passed = open_.pop()
                if begin == at and not passed:
                    out.append((head, text[begin : m.start()]))
            at = m.end()
        return out

    @staticmethod
    def _declared(text: str) -> dict[str, tuple[str, bool]]:
        out: dict[str, tuple[str, bool]] = {}
        for name, value, important in _SHOWN.findall(text):
            name = name.lower()
            if important or name not in out or not out[name][1]:
                out[name] = value.lower(), bool(important)
        return out

    def of(self, node: Node) -> dict[str, str]:
        """display and visibility of an element, as far as anything says them."""
        found: list[tuple[tuple, dict]] = []
        low = node.attributes.lower()
        if "hidden" in low and node.attribute("hidden") is not None:
            found.append(((-1,), {"display": ("none", False)}))
        if self._by:
            own = {f".{c}" for c in (node.attribute("class") or "").split()}
            if name := node.attribute("id"):
                own.add(f"#{name}")
            for key in (*own, node.tag, "*"):
                for rank, tag, parts, what in self._by.get(key, ()):
                    if (not tag or tag == node.tag) and parts <= own:
                        found.append((rank, what))
        if "style" in low and (inline := self._declared(node.attribute("style") or "")):
            found.append(((9**9,), inline))
        out: dict[str, tuple] = {}
        for rank, what in found:
            for name, (value, important) in what.items():
                out[name] = max(out.get(name, ((),)), ((important, rank), value))
        return {name: x[1] for name, x in out.items()}


NOTHING = Styles("")


def shown(node: Node, styles: Styles, visible: bool = True) -> None:
    """Takes out of the tree what isn't seen."""
    children: list = node.children
    if node.tag == "details" and node.attribute("open") is None:
        children = [next((c for c in children if isinstance(c, Node) and c.tag == "summary"), "")]
    kept: list = []
    for c in children:
        if isinstance(c, str):
            kept += [c] if visible else []
            continue
        if c.tag in UNSEEN or not c.drawn or (c.tag == "dialog" and c.attribute("open") is None):
            continue
        said = styles.of(c) if c.attributes or styles is not NOTHING else {}
        if said.get("display") == "none":
            continue
        own = {"hidden": False, "collapse": False, "visible": True}.get(said.get("visibility"), visible)
        shown(c, styles, own)
        if own or c.children or c.tag in ("td", "th"):
            kept.append(c)
    node.children = kept


def parse(page: str) -> tuple[Node, Styles]:
    """The tree of a page, and its styles."""
    root = Node("html")
    stack, styles = [root], []
    at, size, tags = 0, len(page), _Tags(page)

    def close(tags: frozenset[str], bound: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in bound:
                break
            if stack[k].tag in tags:
                outer = k
                while outer > 1 and stack[outer - 1].tag in tags:
                    outer -= 1
                del stack[outer:]
                break

    def text(s: str) -> None:
        if stack[-1].tag == "head" and s.strip(" \t\n\r\f"):
            stack.pop()
        stack[-1].children.append(html.unescape(s))

    while at < size:
        found = tags.next(at)
        if not found:
            text(page[at:])
            break
        start, end, tag, attributes, ends = found
        if start > at:
            text(page[at:start])
        at = end
        if ends:
            if tag == "br":
                if stack[-1].tag == "head":
                    stack.pop()
                stack[-1].children.append(Node("br"))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in FENCE and tag not in ("table", "tr", "thead", "tbody", "tfoot"):
                    break
        elif tag:
            if tag == "html":
                continue
            if stack[-1].tag == "head" and tag not in IN_HEAD:
                if tag == "head":
                    continue
                stack.pop()
            if tag in CLOSES_P:
                close(frozenset({"p"}), frozenset({"table", "td", "th", "button"}))
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            node = Node(tag, attributes)
            foreign = next((n.tag for n in reversed(stack) if n.tag in FOREIGN), None)
            node.drawn = foreign is None or tag not in FOREIGN[foreign]
            stack[-1].children.append(node)
            if tag in RAW and not (foreign and attributes.rstrip().endswith("/")):
                last = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
                stop = last.start() if last else size
                if tag == "style":
                    styles.append(page[at:stop])
                if tag in ("textarea", "xmp") and stop > at:
                    node.children.append(html.unescape(page[at:stop]) if tag == "textarea" else page[at:stop])
                at = page.find(">", stop) + 1 or size if last else size
            elif tag not in VOID and not attributes.rstrip().endswith("/") | (len(stack) >= DEEPEST):
                stack.append(node)
    return root, Styles("\n".join(styles)) if styles else NOTHING


class _Lines:
    """Lines of one block; inline text gathers until a block or its end flushes it."""

    def __init__(self):
        self.lines: list[str] = []
        self._text: list[str] = []
        self._gap = False

    def text(self, s: str) -> None:
        self._text.append(s)

    def flush(self) -> None:
        if not self._text:
            return
        whole, self._text = "".join(self._text), []
        rows = [_SPACE.sub(" ", r).strip(" ") for r in whole.split(_BREAK)]
        while rows and not rows[-1]:
            rows.pop()
        self.add(rows)

    def add(self, rows: list[str]) -> None:
        if any(rows):
            if self._gap and self.lines:
                self.lines.append("")
            self.lines += rows
            self._gap = False

    def apart(self) -> None:
        self._gap = True


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,6})", value or "")
    return int(m[1]) if m else default


def _render(node: Node) -> list[str]:
    out = _Lines()
    count = [_number(node.attribute("start"), 1) if node.tag == "ol" else 1]

    def walk(children: list) -> None:
        for c in children:
            if isinstance(c, str):
                out.text(c)
            elif c.tag == "br":
                out.text(_BREAK)
            elif c.tag in BLOCK:
                out.flush()
                if c.tag in APART and not (c.tag in ("ul", "ol", "menu") and node.tag == "li"):
                    out.apart()
                if c.tag in ("pre", "xmp"):
                    out.add(_plain(c).strip("\n").split("\n"))
                elif c.tag == "table":
                    out.add(_table(c))
                elif c.tag == "li":
                    mark = f"{count[0]}. " if node.tag == "ol" else "- "
                    count[0] += 1
                    rows = _render(c)
                    out.add([(mark if k == 0 else " " * len(mark)) + r if r else "" for k, r in enumerate(rows)])
                elif c.tag in ("dd", "blockquote"):
                    out.add([f"    {r}" if r else "" for r in _render(c)])
                else:
                    out.add(_render(c))
                if c.tag in APART and not (c.tag in ("ul", "ol", "menu") and node.tag == "li"):
                    out.apart()
            elif c.tag in SPACED:
                label = c.attribute("label") if c.tag in ("option", "optgroup") else None
                out.text(f" {label or ''} ")
                if not label or c.tag == "optgroup":
                    walk(c.children)
                out.text(" ")
            else:
                walk(c.children)

    walk(node.children)
    out.flush()
    return out.lines


def _plain(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else _plain(c) for c in node.children)


def _table(table: Node) -> list[str]:
    rows, other = [], []

    def gather(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                if c.strip():
                    other.append(c.strip())
            elif c.tag in ("thead", "tbody", "tfoot"):
                gather(c)
            elif c.tag == "tr":
                rows.append([x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")])
                other.extend(t for x in c.children for t in ([x.strip()] if isinstance(x, str) else _render(x) if x.tag not in ("td", "th") else []) if t)
            elif c.tag in ("td", "th"):
                rows.append([c])
            else:
                other.extend(_render(c))

    gather(table)
    grid, down = [], {}  # down: columns taken by cells of rows above, and for how many rows more
    for cells in rows:
        line, col, taken = {}, 0, {c for c, n in down.items() if n > 0}
        down = {c: n - 1 for c, n in down.items() if n > 1}
        for cell in cells:
            while col in taken:
                col += 1
            across, below = min(max(1, _number(cell.attribute("colspan"), 1)), 1000), _number(cell.attribute("rowspan"), 1)
            line[col] = (_render(cell), across)
            if below > 1:
                down.update(dict.fromkeys(range(col, col + across), min(below, 65_535) - 1))
            col += across
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for col, (text, across) in line.items():
            if across == 1:
                widths[col] = max(widths.get(col, 0), *(min(len(r) , WIDEST) for r in text), 0) if text else widths.get(col, 0)
    columns = max((col + a for line in grid for col, (_, a) in line.items()), default=0)
    out = list(other)
    for line in grid:
        for k in range(max((len(text) for text, _ in line.values()), default=0)):
            row, at = "", 0
            for col in range(columns):
                if col in line:
                    text, across = line[col]
                    row += (text[k] if k < len(text) else "").ljust(sum(widths.get(c, 0) for c in range(col, col + across)) + 2 * (across - 1)) + "  "
                    at = col + across
                elif col >= at:
                    row += " " * (widths.get(col, 0) + 2)
            out.append(row.rstrip())
    return out


def visible_text(page: str | None) -> str:
    if not page:
        return ""
    root, styles = parse(page.replace("\r\n", "\n").replace(_BREAK, ""))
    shown(root, styles)
    return "\n".join(_render(root)).strip("\n")


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text, laid out. A map over the rows: no shuffle."""

    @F.arrow_udf("string")
    def rendered(column: pa.Array) -> pa.Array:
        return pa.array([visible_text(x.as_py()) for x in column], pa.string())

    return pages.withColumn("text", rendered(F.col(f"`{html_col}`").cast("string")))

"""Layout-aware text of HTML pages: a tree builder and a renderer.

The builder follows the usual implied tags (html, head, body, tbody, tr; closing
of p, li, dt, dd, option, rows and cells), raw-text elements, void elements,
misnested inline tags, and text fostered out of tables. The renderer emits all
visible text in document order: blocks start new lines, paragraphs and the like
are spaced by blank lines, white space collapses outside preformatted text,
lists carry bullets or numbers, and table cells are aligned in columns with row
and column spans. Hidden are: elements that are never displayed, the ``hidden``
attribute, closed dialogs, inline ``display: none`` or ``visibility: hidden``, and
simple rules of the page's own style sheets (tag, .class, #id) that say so.

Nothing is cut. Columns are as wide as their widest cell; only where the padding of one table would come to
over ``PAD`` characters, which takes a page of that kind of size, its widest columns are left unpadded.
Elements nested deeper than ``DEPTH``, as deep as usual browsers go, become siblings
of the deepest one; their text stays.

Edge cases: null html gives null text; empty or textless pages give "";
repeated rows are rendered each; extra columns stay (one named like an output is
replaced); an empty table gives an empty result; of attributes of one name the
first holds; a long page is one tree, rendered whole.
"""

from __future__ import annotations

import html as _html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .store import bounded_batches

PAD, DEPTH = 1 << 24, 512

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([.#]?)([a-zA-Z][\w-]*)\Z")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)

_set = lambda s: frozenset(s.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes noscript plaintext")
UNSEEN = _set("head script style title template noscript iframe noembed noframes datalist audio video canvas object rp meta link base param source track col colgroup")
# Blocks; those in SPACED stand apart by a blank line.
BLOCK = _set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td textarea tfoot th thead tr ul caption xmp plaintext listing")
SPACED = _set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp listing dir fieldset")
ENDS_P = BLOCK - _set("body html li dd dt option optgroup td th tr tbody thead tfoot caption textarea legend") | _set("li dd dt")
HEAD_ONLY = _set("base link meta script style template title noscript")
_TABLE = _set("table tbody thead tfoot tr")
_CLOSES = {
    "li": (_set("li"), _set("ul ol menu dir")),
    "dt": (_set("dt dd"), _set("dl")),
    "dd": (_set("dt dd"), _set("dl")),
    "option": (_set("option"), _set("select datalist optgroup")),
    "optgroup": (_set("option optgroup"), _set("select datalist")),
    "rt": (_set("rt rp"), _set("ruby")),
    "rp": (_set("rt rp"), _set("ruby")),
    "td": (_set("td th"), _set("tr table")),
    "th": (_set("td th"), _set("tr table")),
    "tr": (_set("td th tr caption colgroup"), _set("table")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (_set("td th tr tbody thead tfoot caption colgroup"), _set("table"))),
    **dict.fromkeys(("caption", "colgroup", "col"), (_set("td th tr tbody thead tfoot caption colgroup"), _set("table"))),
}
_P_BOUND = _set("table td th caption button html template object")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and not text.isspace():
        for m in _ATTR.finditer(text):
            value = m[2] or m[3] or m[4] or ""
            out.setdefault(m[1].lower(), _html.unescape(value) if "&" in value else value)
    return out


def parse(page: str) -> tuple[Node, list[str]]:
    """(root, texts of its style sheets)."""
    root, styles = Node("html", {}), []
    stack = [root]
    at, end = 0, len(page)

    def home() -> tuple[Node, int | None]:
        """Where content goes: the open element, or before a table that must not hold it."""
        if stack[-1].tag in _TABLE:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "table":
                    return stack[i - 1], stack[i - 1].kids.index(stack[i])
        return stack[-1], None

    def add(item: Node | str, foster: bool) -> None:
        node, place = home() if foster else (stack[-1], None)
        if place is None:
            node.kids.append(item)
        else:
            node.kids.insert(place, item)

    def shut(tags: frozenset, bound: frozenset) -> None:
        """Close the elements named ``tags`` nearest to the top, below no ``bound``."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in bound:
                break
            if stack[i].tag in tags:
                del stack[i:]
                if not any(x.tag in tags for x in stack):
                    break

    def text(s: str) -> None:
        if s:
            if "&" in s:
                s = _html.unescape(s)
            add(s, foster=stack[-1].tag in _TABLE and not s.isspace())

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None or not m[4]:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                add(Node("p", {}), foster=True)
            elif tag == "br":
                add(Node("br", {}), foster=True)
            elif tag not in ("html", "body"):
                block = tag in BLOCK
                for i in range(len(stack) - 1, 0, -1):
                    t = stack[i].tag
                    if t == tag or (tag in ("h1", "h2", "h3", "h4", "h5", "h6") and t in ("h1", "h2", "h3", "h4", "h5", "h6")):
                        del stack[i:]
                        break
                    if (t in BLOCK and not block) or (t in ("td", "th", "table", "caption") and tag not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "caption")) or (t == "table" and tag != "table"):
                        break
            continue
        attrs = _attributes(m[3])
        if tag in ("html", "body"):
            target = root if tag == "html" else next((x for x in stack if x.tag == "body"), None)
            if target is not None:
                for k, v in attrs.items():
                    target.attrs.setdefault(k, v)
                continue
        if any(x.tag == "head" for x in stack) and tag not in HEAD_ONLY:
            del stack[next(i for i, x in enumerate(stack) if x.tag == "head") :]
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _P_BOUND:
                    break
                if stack[i].tag == "p":
                    del stack[i:]
                    break
        if tag in _CLOSES:
            shut(*_CLOSES[tag])
        top = stack[-1].tag
        if tag == "tr" and top == "table" or tag in ("td", "th") and top == "table":
            stack.append(Node("tbody", {}))
            stack[-2].kids.append(stack[-1])
            top = "tbody"
        if tag in ("td", "th") and top in ("tbody", "thead", "tfoot"):
            stack.append(Node("tr", {}))
            stack[-2].kids.append(stack[-1])
        node = Node(tag, attrs)
        part = tag in ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup", "col")
        add(node, foster=not part and tag not in ("script", "style", "template"))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at) if tag != "plaintext" else None
            body = page[at : close.start() if close else end]
            at = close.end() if close else end
            if tag == "style":
                styles.append(body)
            elif tag in ("textarea", "xmp", "plaintext"):
                node.kids.append(_html.unescape(body) if tag == "textarea" else body)
        elif tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
    return root, styles


def _rules(styles: list[str]) -> frozenset[tuple[str, str]]:
    """(kind, name) of simple selectors that are not displayed."""
    found = set()
    for s in styles:
        for m in _RULE.finditer(re.sub(r"/\*.*?\*/", "", s, flags=re.S)):
            if _HIDE.search(m[2]):
                for one in m[1].split(","):
                    if (x := _SIMPLE.match(one.strip())):
                        found.add((x[1], x[2] if x[1] else x[2].lower()))
    return frozenset(found)


class _Writer:
    """Lines of text with indents, markers and pending blank lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""

    def inline(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s == " " or not s:
            self.space |= bool(s) and bool(self.parts)
            return
        if s[0] == " ":
            self.space |= bool(self.parts)
            s = s[1:]
        tail = s[-1] == " "
        if self.space:
            self.parts.append(" ")
        self.parts.append(s[:-1] if tail else s)
        self.space = tail

    def newline(self, always: bool = False) -> None:
        if self.parts or always:
            line = "".join(self.parts).replace("\xa0", " ")
            if self.lines and self.gap:
                self.lines += [""] * self.gap
            self.gap = 0
            prefix = "".join(self.indent)
            if self.marker:
                prefix = prefix[: max(0, len(prefix) - len(self.marker))] + self.marker
                self.marker = ""
            self.lines.append((prefix + line).rstrip(" "))
            self.parts = []
        self.space = False

    def preformatted(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").split("\n")
        if first:
            self.parts.append(first)
        for x in rest:
            self.newline(always=True)
            if x:
                self.parts.append(x)

    def block(self, gap: int) -> None:
        self.newline()
        if self.lines:
            self.gap = max(self.gap, gap)


def _number(value: str, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return int(m[1]) if m else default


class _Renderer:
    def __init__(self, hidden: frozenset):
        self.hidden = hidden

    def unseen(self, n: Node) -> bool:
        a = n.attrs
        if n.tag in UNSEEN or "hidden" in a or (n.tag == "dialog" and "open" not in a) or (n.tag == "input") or ("style" in a and _HIDE.search(a["style"])):
            return True
        if self.hidden:
            return ("", n.tag) in self.hidden or ("#", a.get("id", "")) in self.hidden or any((".", c) in self.hidden for c in a.get("class", "").split())
        return False

    def render(self, n: Node, w: _Writer, pre: bool = False, shown: bool = True, depth: int = 0) -> None:
        for k in n.kids:
            if isinstance(k, str):
                if shown:
                    w.preformatted(k) if pre else w.inline(k)
                continue
            if self.unseen(k):
                continue
            see = shown
            if "style" in k.attrs and (m := _VISIBILITY.search(k.attrs["style"])):
                see = m[1].lower() == "visible"
            tag = k.tag
            if tag == "br":
                w.newline(always=True)
                continue
            if tag not in BLOCK:
                self.render(k, w, pre, see, depth)
                continue
            gap = 1 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and depth) else 0
            w.block(gap)
            if tag == "table":
                self.table(k, w, see, depth)
            elif tag in ("ul", "menu", "dir", "ol"):
                self.items(k, w, see, depth)
            elif tag in ("pre", "textarea", "xmp", "plaintext", "listing"):
                if k.kids and isinstance(k.kids[0], str) and k.kids[0].startswith("\n"):
                    k.kids[0] = k.kids[0][1:]
                self.render(k, w, True, see, depth)
            elif tag in ("blockquote", "dd"):
                w.indent.append("  ")
                self.render(k, w, pre, see, depth)
                w.newline()
                w.indent.pop()
            else:
                self.render(k, w, pre, see, depth)
            w.block(gap)

    def items(self, n: Node, w: _Writer, shown: bool, depth: int) -> None:
        step = -1 if "reversed" in n.attrs else 1
        own = [k for k in n.kids if not isinstance(k, str) and k.tag == "li"]
        at = _number(n.attrs.get("start", ""), len(own) if step < 0 else 1)
        for k in n.kids:
            if isinstance(k, str) or k.tag != "li":
                holder = Node("div", {})
                holder.kids.append(k)
                self.render(holder, w, False, shown, depth + 1)
                continue
            if n.tag == "ol":
                at = _number(k.attrs.get("value", ""), at)
                mark = f"{at}. "
                at += step
            else:
                mark = "- "
            if self.unseen(k):
                continue
            w.newline()
            before = w.marker
            w.indent.append(" " * len(mark))
            w.marker = mark
            holder = Node("div", {})
            holder.kids.append(Node("div", {key: v for key, v in k.attrs.items() if key == "style"}))
            holder.kids[0].kids = k.kids
            self.render(holder, w, False, shown, depth + 1)
            w.newline()
            w.indent.pop()
            if w.marker == mark:
                w.marker = before  # an item without text leaves no marker

    def table(self, n: Node, w: _Writer, shown: bool, depth: int) -> None:
        rows: list[Node] = []
        order = {"thead": 0, "tfoot": 2}
        parts = [k for k in n.kids if not isinstance(k, str) and not self.unseen(k)]
        for k in parts:
            if k.tag == "caption":
                self.render(k, w, False, shown, depth)
                w.newline()
        for k in sorted((k for k in parts if k.tag in ("tbody", "thead", "tfoot", "tr")), key=lambda k: order.get(k.tag, 1)):
            rows += [k] if k.tag == "tr" else [r for r in k.kids if not isinstance(r, str) and r.tag == "tr" and not self.unseen(r)]
        taken: dict[int, int] = {}
        grid: list[dict[int, tuple[int, list[str]]]] = []
        for r in rows:
            cells: dict[int, tuple[int, list[str]]] = {}
            c = 0
            held = {k: v for k, v in taken.items() if v > 0}
            for cell in r.kids:
                if isinstance(cell, str) or cell.tag not in ("td", "th") or self.unseen(cell):
                    continue
                while held.get(c, 0) > 0:
                    c += 1
                see = shown
                if "style" in cell.attrs and (m := _VISIBILITY.search(cell.attrs["style"])):
                    see = m[1].lower() == "visible"
                sub = _Writer()
                self.render(cell, sub, False, see, 0)
                sub.newline()
                span = min(max(1, _number(cell.attrs.get("colspan", ""), 1)), 1000)
                down = min(max(1, _number(cell.attrs.get("rowspan", ""), 1)), 65534)
                cells[c] = (span, sub.lines)
                for j in range(c, c + span):
                    if down > 1:
                        taken[j] = down
                c += span
            for j in list(taken):
                taken[j] -= 1
                if taken[j] <= 0:
                    del taken[j]
            grid.append(cells)
        used = sorted({c for cells in grid for c, (_, lines) in cells.items() if lines})
        width = dict.fromkeys(used, 0)
        for cells in grid:
            for c, (span, lines) in cells.items():
                if lines and span == 1:
                    width[c] = max(width[c], max(map(len, lines)))
        padded = len(grid) * sum(width.values())
        for c in sorted(width, key=lambda c: -width[c]):
            if padded <= PAD:
                break
            padded -= len(grid) * width[c]
            width[c] = 0
        for cells in grid:
            filled = {c: x for c, x in cells.items() if x[1]}
            if not filled:
                continue
            last = max(filled)
            for i in range(max(len(lines) for _, lines in filled.values())):
                line = []
                for c in used:
                    if c > last:
                        break
                    s = filled[c][1][i] if c in filled and i < len(filled[c][1]) else ""
                    line.append(s.ljust(width[c]) if c < last else s)
                w.parts.append(" | ".join(line))
                w.newline(always=True)


def page_text(page: str) -> str:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))
    root, styles = parse(page)
    w = _Writer()
    body = Node("html", {})
    body.kids.append(root)
    _Renderer(_rules(styles)).render(body, w)
    w.newline()
    return "\n".join(w.lines).strip("\n")


def html_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` plus text: the rendered ``column``."""
    kept = [c for c in pages.columns if c != "text"]
    at = kept.index(column)
    bounded_batches(pages.sparkSession)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                text = [None if p is None else page_text(p) for p in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*kept, "text"])

    schema = StructType([*pages.select(*kept).schema.fields, *StructType.fromDDL("text string").fields])
    return pages.select(*kept).mapInArrow(render, schema)

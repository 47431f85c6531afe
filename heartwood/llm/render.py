"""Text of web pages as they are laid out.

A tree builder with implied tags (a paragraph ends where a block begins, an item
where the next begins, rows and bodies of tables appear where cells need them)
makes elements of any markup. Rendering leaves out what is not shown (heads,
scripts, hidden elements) and emits all other text: blocks on lines of their
own, with a blank line where margins stand, list items with their markers and
indents, preformatted text as it is, and table cells aligned in columns.

Defined cases: null and empty pages give the empty text; markup never closed
ends with the page; unmatched end tags are ignored; elements nested deeper than
DEPTH are laid out at that depth, with their text; cells of a table beyond COLUMNS
columns, and of columns that would begin beyond ALIGNED characters, follow the
cell before them two spaces on, whole; extra columns pass through. So the work on
a table, and its padding, are in proportion to its cells and lines.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, raw, steps, strings

DEPTH, COLUMNS, ALIGNED = 256, 1000, 512
_names = lambda s: frozenset(s.split())
VOID = _names("area base br col embed hr img input link meta param source track wbr")
#: Content taken as it is up to the end tag; of the second, character references count.
RAW, ESCAPABLE = _names("script style xmp iframe noembed noframes"), _names("textarea title")
HIDDEN = _names("head script style template noscript title meta link base datalist param iframe noembed noframes audio video canvas object rp")
BLOCK = _names("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table ul tr td th caption thead tbody tfoot xmp")
SPACED = _names("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr fieldset xmp")
ENDS_P = BLOCK - _names("option optgroup tr td th caption thead tbody tfoot html body")
#: start tag -> (elements that it ends, elements that shield what is outside them)
_CELL, _ROW, _PART = _names("td th"), _names("tr td th"), _names("tr td th thead tbody tfoot caption colgroup")
IMPLIED_END = {
    "li": (_names("li"), _names("ul ol menu dir")), "dt": (_names("dt dd"), _names("dl")), "dd": (_names("dt dd"), _names("dl")),
    "td": (_CELL, _names("table")), "th": (_CELL, _names("table")), "tr": (_ROW, _names("table")),
    "thead": (_PART, _names("table")), "tbody": (_PART, _names("table")), "tfoot": (_PART, _names("table")), "caption": (_PART, _names("table")),
    "option": (_names("option"), _names("select datalist")), "optgroup": (_names("option optgroup"), _names("select")),
    "body": (_names("head"), _names("html")),
}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_STYLE_NONE, _STYLE_VIS = re.compile(r"display\s*:\s*none", re.I), re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_GAP = re.compile(r"[ \t\n\f\r]+")


class Element:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        if not self.attrs or self.attrs.isspace():
            return {}
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTR.finditer(self.attrs)))}


def parse(page: str) -> Element:
    """The tree of a page."""
    root = Element("html")
    stack = [root]
    places: dict[str, list[int]] = {"html": [0]}  # where open elements of a tag stand in the stack

    def close(until: int) -> None:
        until = max(until, 1)
        for el in stack[until:]:
            places[el.tag].pop()
        del stack[until:]

    def top(names: frozenset[str]) -> int:
        """The place of the last open element of these, but for the root; 0 if there is none."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def last(names: frozenset[str], shields: frozenset[str]) -> int:
        i = top(names)
        return i if i >= top(shields) else 0

    def last_of_all(names: frozenset[str], shields: frozenset[str]) -> int:
        beyond = top(shields)
        first = [places[n][k] for n in names if n in places and (k := bisect_right(places[n], beyond)) < len(places[n])]
        return min(first, default=0)

    def push(tag: str, attrs: str = "") -> Element:
        el = Element(tag, attrs)
        parent = stack[-1] if len(stack) < DEPTH else stack[DEPTH - 1]
        parent.kids.append(el)
        places.setdefault(tag, []).append(len(stack))
        stack.append(el)
        return el

    at = 0
    find = _TOKEN.search
    final = page.rfind(">") + 1  # no tag ends beyond; a search that went on would read the rest for each "<"
    while m := find(page, at, final):
        if m.start() > at:
            stack[min(len(stack), DEPTH) - 1].kids.append(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = len(page)  # a comment without an end
            break
        end, start, attrs = m[1], m[2] or m[4], m[3] if m[2] else m[5]
        if end:
            tag = end.lower()
            if tag == "br":
                stack[min(len(stack), DEPTH) - 1].kids.append(Element("br"))
                continue
            shields = _names("table") if tag in _PART else _names("td th table caption") if tag not in ("table", "body", "html") else frozenset()
            i = last(frozenset((tag,)), shields)
            if i:
                close(i)
            continue
        if not start:
            continue
        tag = start.lower()
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag in IMPLIED_END:
            i = last_of_all(*IMPLIED_END[tag])
            if i:
                close(i)
        if tag in ENDS_P:
            i = last(_names("p"), _names("td th table caption button object"))
            if i:
                close(i)
            if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
                close(len(stack) - 1)
        if stack[-1].tag == "head" and tag not in HIDDEN:
            close(len(stack) - 1)
        if tag in _CELL and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            if stack[-1].tag == "table":
                push("tbody")
            push("tr")
        elif tag == "tr" and stack[-1].tag == "table":
            push("tbody")
        el = push(tag, attrs)
        if tag in VOID:
            close(len(stack) - 1)
        elif tag in RAW or tag in ESCAPABLE:
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, at, max(final, at))
            body = page[at : stop.start() if stop else len(page)]
            el.kids.append(body if tag in ESCAPABLE else body.replace("&", "&amp;"))
            at = stop.end() if stop else len(page)
            close(len(stack) - 1)
    rest = page[at:].partition("<!--")[0]
    if rest:
        stack[min(len(stack), DEPTH) - 1].kids.append(rest)
    return root


class Lines:
    """Lines of laid-out text: words are joined by single spaces, blocks by breaks."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0  # breaks before the next text: 1 ends a line, 2 leaves a blank one

    def text(self, s: str) -> None:
        words = _GAP.split(s)
        if len(words) == 1:
            self._put(s, False)
            return
        body = " ".join(w for w in words if w)
        if words[0] == "":
            self.space = True
        if body:
            self._put(body, False)
            self.space = words[-1] == ""

    def _put(self, s: str, exact: bool) -> None:
        if not s:
            return
        if self.gap and self.done:
            self.done += [""] * (self.gap - 1)
        self.gap = 0
        if self.now and self.space and not exact:
            self.now.append(" ")
        self.space = False
        self.now.append(s)

    def exact(self, s: str) -> None:
        """Preformatted text."""
        for i, line in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if line:
                self._put(line, True)

    def newline(self) -> None:
        """A line break inside of a block: an empty line stays."""
        if not self.now and self.gap and self.done:
            self.done += [""] * (self.gap - 1)
            self.gap = 0
        self.done.append("".join(self.now))
        self.now, self.space = [], False

    def end(self, gap: int) -> None:
        """The end of a block, or the beginning of one."""
        if self.now:
            self.done.append("".join(self.now))
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def block(self, lines: list[str], gap: int) -> None:
        self.end(gap)
        if not lines:
            return
        if self.done:
            self.done += [""] * (self.gap - 1)
        self.done += lines
        self.gap = gap

    def finish(self) -> list[str]:
        self.end(0)
        lines = self.done
        while lines and not lines[-1].strip():
            lines.pop()
        first = next((i for i, x in enumerate(lines) if x.strip()), 0)
        return lines[first:]


def _shown(el: Element) -> tuple[bool, str | None]:
    """Whether an element takes part in the layout, and the visibility that it sets."""
    if el.tag in HIDDEN:
        return False, None
    if not el.attrs:
        return el.tag != "dialog", None
    a = el.attributes()
    style = a.get("style", "")
    if "hidden" in a or el.tag == "dialog" and "open" not in a or el.tag == "input" and a.get("type", "").lower() == "hidden" or style and _STYLE_NONE.search(style):
        return False, None
    m = _STYLE_VIS.search(style) if style else None
    return True, m[1].lower() if m else None


def _lay(el: Element, out: Lines, visible: bool, pre: bool, item: list[int] | None = None) -> None:
    kids = el.kids
    if el.tag == "details" and "open" not in el.attributes():
        kids = [k for k in kids if not isinstance(k, str) and k.tag == "summary"][:1]
    for k in kids:
        if isinstance(k, str):
            if visible:
                s = unescape(k) if "&" in k else k
                out.exact(s) if pre else out.text(s)
            elif not pre and k[:1].isspace():
                out.space = True
            continue
        shown, vis = _shown(k)
        if not shown:
            continue
        see = visible if vis is None else vis == "visible"
        tag = k.tag
        if tag == "br":
            out.newline()
        elif tag == "wbr" or tag == "img":
            continue
        elif tag == "input":
            a = k.attributes()
            if see and a.get("value") and a.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                out.text(f" {a['value']} ")
        elif tag == "table":
            out.block(_table(k, see, pre), 2)
        elif tag == "li":
            mark = "- "
            if item is not None:
                value = k.attributes().get("value", "")
                if re.fullmatch(r"-?\d{1,9}", value):
                    item[0] = int(value)
                mark = f"{item[0]}. "
                item[0] += item[1]
            inner = Lines()
            _lay(k, inner, see, pre)
            lines = inner.finish()
            if lines:
                wide = " " * len(mark)
                out.block([mark + lines[0], *(wide + x if x else x for x in lines[1:])], 1)
        elif tag in ("ul", "ol", "menu", "dir"):
            count = None
            if tag == "ol":
                a = k.attributes()
                first = a.get("start", "")
                step = -1 if "reversed" in a else 1
                n = sum(not isinstance(x, str) and x.tag == "li" for x in k.kids)
                count = [int(first) if re.fullmatch(r"-?\d{1,9}", first) else n if step < 0 else 1, step]
            gap = 1 if el.tag == "li" else 2
            out.end(gap)
            _lay(k, out, see, pre, count)
            out.end(gap)
        elif tag in ("blockquote", "dd"):
            inner = Lines()
            _lay(k, inner, see, pre)
            out.block(["  " + x if x else x for x in inner.finish()], 2 if tag == "blockquote" else 1)
        elif tag in BLOCK:
            gap = 2 if tag in SPACED else 1
            out.end(gap)
            _lay(k, out, see, pre or tag in ("pre", "xmp", "textarea"))
            out.end(gap)
        elif tag == "textarea":
            out.end(1)
            _lay(k, out, see, True)
            out.end(1)
        elif tag == "q":
            if see:
                out.text("“")
            _lay(k, out, see, pre)
            if see:
                out.text("”")
        else:
            _lay(k, out, see, pre)


def _number(a: dict[str, str], name: str, most: int) -> int:
    v = a.get(name, "")
    return min(max(int(v), 1), most) if re.fullmatch(r"\d{1,6}", v) else 1


def _table(el: Element, visible: bool, pre: bool) -> list[str]:
    """Lines of a table: captions, then rows with their cells padded to columns."""
    captions, rows, loose = [], [], Lines()

    def gather(node: Element, see: bool) -> None:
        for k in node.kids:
            if isinstance(k, str):
                if k.strip() and see:
                    loose.text(unescape(k))
                continue
            shown, vis = _shown(k)
            if not shown:
                continue
            own = see if vis is None else vis == "visible"
            if k.tag in ("thead", "tbody", "tfoot"):
                gather(k, own)
            elif k.tag == "tr":
                rows.append((k, own))
            elif k.tag == "caption":
                captions.append((k, own))
            elif k.tag not in ("colgroup", "col"):
                box = Element("div")
                box.kids.append(k)
                _lay(box, loose, own, pre)

    gather(el, visible)
    grid: list[dict[int, tuple[list[str], int]]] = []
    until = np.zeros(COLUMNS, np.int64)  # of each column, the row that cells above no longer cover
    low = 0  # no column is covered from this row on
    for at, (tr, see) in enumerate(rows):
        line: dict[int, tuple[list[str], int]] = {}
        col = 0
        free = np.flatnonzero(until <= at) if low > at else None
        for k in tr.kids:
            if isinstance(k, str):
                if k.strip() and see:
                    loose.text(unescape(k))
                continue
            shown, vis = _shown(k)
            if not shown:
                continue
            if free is not None and col < COLUMNS:
                i = int(np.searchsorted(free, col))
                col = int(free[i]) if i < len(free) else COLUMNS
            inner = Lines()
            _lay(k, inner, see if vis is None else vis == "visible", pre)
            a = k.attributes()
            span, down = _number(a, "colspan", 1000), _number(a, "rowspan", 65534)
            line[col] = inner.finish(), span
            if down > 1:
                until[col : col + span] = at + down
                low = max(low, at + down)
            col += span
        grid.append(line)
    width: dict[int, int] = {}
    for line in grid:
        for c, (cell, span) in line.items():
            if span == 1 and c < COLUMNS:
                width[c] = max(width.get(c, 0), *(len(x) for x in cell), 0)
    out = [x for cap, see in captions for x in _box(cap, see, pre)] + loose.finish()
    columns = sorted({c for line in grid for c in line if c < COLUMNS})
    place, x = {}, 0
    for c in columns:
        if x > ALIGNED:
            break
        place[c] = x
        x += width.get(c, 0) + 2 if width.get(c, 0) else 0
    for line in grid:
        for i in range(max((len(cell) for cell, _ in line.values()), default=0)):
            parts, used = [], 0
            for c in sorted(line):
                cell = line[c][0]
                if i < len(cell) and cell[i]:
                    pad = max(place.get(c, 0) - used, 2 if used else 0)
                    parts.append(" " * pad + cell[i])
                    used += pad + len(cell[i])
            out.append("".join(parts))
    return out


def _box(el: Element, see: bool, pre: bool) -> list[str]:
    inner = Lines()
    _lay(el, inner, see, pre)
    return inner.finish()


def render(page: str) -> str:
    """All visible text of a page, laid out."""
    if not page:
        return ""
    if sys.getrecursionlimit() < 12 * DEPTH:
        sys.setrecursionlimit(12 * DEPTH)
    out = Lines()
    _lay(parse(page.replace("\0", "")), out, True, False)
    return "\n".join(x.rstrip() for x in out.finish()).replace("\xa0", " ")


def render_pages(pages: DataFrame, html: str = "html", keep: list[str] | None = None, name: str = "page_text") -> DataFrame:
    """pages' columns (those in keep, by default all but html) and the laid-out text. One pass, no shuffle."""
    kept = others(pages.columns if keep is None else keep, [name], html)
    schema = T.StructType([*pages.select(*kept).schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in steps(raw(strings(whole, len(kept)))[1]):
                batch = whole.slice(i, j - i)
                out = [render(t) for t in strings(batch, len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.string())], names=[*kept, name])

    return pages.select(*kept, F.col(html).alias("__html")).mapInArrow(run, schema)

"""HTML extraction: a tree builder with implied tags, then layout-aware rendering of what is visible.

Tree: the tokens of the standard library's HTML tokenizer become a tree; start tags close what they imply closed (a
paragraph before a block, an item before the next item, cells, rows, table sections, options, terms), void elements
have no content, an end tag closes up to its match inside the nearest scope, that of a formatting element closes no
block, and unmatched end tags are dropped.

Visibility: nothing of head, script, style, template, comments, form controls' options that are not chosen, media
fallbacks, titles, definitions and descriptions inside drawings, annotations of formulas; nothing under ``hidden`` or
``display:none``, a closed ``dialog`` or a closed ``details`` but its summary; text under ``visibility:hidden`` only where
an element below sets itself visible. Text of drawings (SVG, a line for each text element), formulas (MathML) and text
areas (their lines as they are) shows.

Rendering: white space collapses outside ``pre``; blocks stand on lines of their own, paragraphs, headings, lists and
tables with a blank line around them; list items get a bullet or their number and are indented by depth; table cells
are padded to the width of their column (``colspan`` and ``rowspan`` kept), cells with several lines too. Both passes
are loops, so deep nesting does no harm.

Defined results: a null or empty page gives an empty text, text outside any tag is text, an unclosed tag ends with
the page; repeated rows are rendered each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, ship

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary textarea ul table caption
thead tbody tfoot tr td th""".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl menu dir table figure hr".split())
UNSEEN = set("""head title script style template noscript noembed noframes datalist object video audio canvas iframe
param rp desc metadata defs annotation annotation-xml""".split())
ENDS_P = set("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul dd dt li""".split())
#: Start tag -> open elements that it closes, and the elements at which the search for them stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = {"table", "td", "th", "caption", "html"}
FLOW_IN_HEAD_ENDS = ENDS_P | {"a", "b", "i", "span", "em", "strong", "img", "br", "input", "button", "label", "body"}
SPACES = re.compile(r"[ \t\n\f\r]+")
NOT_DISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Parents of SVG text that stands by itself.
DRAWN = set("svg g a switch".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.counts: dict[str, int] = {}  # open elements by tag

    def _push(self, node: Node) -> None:
        self.open.append(node)
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.counts[self.open.pop().tag] -= 1

    def _close(self, tags: set[str], stops: set[str]) -> None:
        """Close the outermost open element of ``tags`` above the innermost of ``stops``."""
        if not any(self.counts.get(t) for t in tags):
            return
        found = 0
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in stops:
                break
            if tag in tags:
                found = i
        if found:
            self._pop_to(found)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in FLOW_IN_HEAD_ENDS and self.counts.get("head"):
            self._close({"head"}, {"html"})
        if tag in ENDS_P and self.counts.get("p"):
            self._close({"p"}, SCOPE | {"button"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        node = Node(tag, {k: v if v is not None else "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._push(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if not self.counts.get(tag):
            return
        stops = set() if tag in SCOPE else {"td", "th", "caption"} if tag not in ("table", "tr", "thead", "tbody", "tfoot") else {"table"}
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._pop_to(i)
                return
            if self.open[i].tag in stops or tag not in BLOCK and self.open[i].tag in BLOCK:
                return  # a formatting element's end closes no block

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(page: str) -> Node:
    builder = TreeBuilder()
    builder.feed(page)
    builder.close()
    return builder.root


def visible(node: Node, parent: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs or NOT_DISPLAYED.search(node.attrs.get("style", "")):
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    if parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary":
        return False
    return not (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden")


def shown_in(node: Node, shown: bool) -> bool:
    """Whether text right in ``node`` shows: visibility passes down until an element sets its own."""
    own = VISIBILITY.findall(node.attrs.get("style", "")) if "style" in node.attrs else ()
    return own[-1].lower() == "visible" if own else shown


def shows_again(node: Node) -> bool:
    """Whether an element below one that is not shown sets itself visible."""
    todo = [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                if shown_in(c, False):
                    return True
                todo.append(c)
    return False


def width(s: str) -> int:
    """Columns that a line takes: wide characters two, combining marks none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Flow:
    """Lines in the making: text with collapsed white space, line breaks and blank lines between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.blank, self.prefix, self.indent = False, False, "", 0

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._put(first)
            for part in rest:
                self.end_line(True)
                self._put(part)
            return
        parts = SPACES.split(s)
        for i, word in enumerate(parts):
            if i:
                self.space = True
            if word:
                if self.space and self.line:
                    self.line.append(" ")
                self.space = False
                self._put(word)

    def _put(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.line.append(" " * (self.indent - len(self.prefix)) + self.prefix)
            self.prefix = ""
        self.line.append(s)

    def end_line(self, keep_empty: bool = False) -> None:
        self.space = False
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif keep_empty and self.lines and not self.blank:
            self.lines.append("")

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.blank = self.blank or spaced

    def block_lines(self, lines: list[str]) -> None:
        for s in lines:
            self.end_line()
            if s:
                self._put(s)
                self.end_line()
            else:
                self.blank = True

    def result(self) -> list[str]:
        self.end_line()
        out = self.lines
        while out and not out[-1]:
            out.pop()
        return out


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def grid(self) -> list[str]:
        """The rows as lines, cells padded to the widths of their columns, two spaces between columns."""
        places, taken = [], {}  # (row, column, span, lines); column -> rows still taken by a rowspan
        for r, row in enumerate(self.rows):
            col, nxt = 0, {}
            for lines, across, down in row:
                while taken.get(col, 0) > 0:
                    col += 1
                places.append((r, col, across, lines))
                if down > 1:
                    nxt.update({c: down for c in range(col, col + across)})
                col += across
            taken = {c: n - 1 for c, n in {**taken, **nxt}.items() if n > 1}
        widths: dict[int, int] = {}
        for r, col, across, lines in sorted(places, key=lambda p: p[2]):
            need = max(map(width, lines), default=0)
            if across == 1:
                widths[col] = max(widths.get(col, 0), need)
            else:  # a spanning cell widens its last column if the others do not hold it
                have = sum(widths.get(c, 0) for c in range(col, col + across)) + 2 * (across - 1)
                last = col + across - 1
                widths[last] = widths.get(last, 0) + max(0, need - have)
        starts, at = {}, 0
        for c in range(max(widths, default=-1) + 1):
            starts[c] = at
            at += widths.get(c, 0) + (2 if widths.get(c, 0) else 0)
        out = []
        by_row: dict[int, list] = {}
        for r, col, _, lines in places:
            by_row.setdefault(r, []).append((col, lines))
        for r in sorted(by_row):
            for k in range(max((len(lines) for _, lines in by_row[r]), default=0)):
                s, used = [], 0
                for col, lines in by_row[r]:
                    if k < len(lines) and lines[k]:
                        s.append(" " * (starts.get(col, used) - used) + lines[k])
                        used = max(used, starts.get(col, used)) + width(lines[k])
                out.append("".join(s).rstrip(" "))
        return out


def _number(value: str, otherwise: int, most: int = 1000) -> int:
    return min(int(value), most) if value.isascii() and value.isdigit() and len(value) < 10 else otherwise


def render(root: Node) -> str:
    """The visible text of a tree."""
    flows, tables, lists, pre = [Flow()], [], [], 0
    todo: list[tuple] = [(root, root, False, True)]
    while todo:
        node, parent, leaving, shown = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not shown or parent.tag == "details" and "open" not in parent.attrs:
                continue
            if not (parent.tag in ("table", "thead", "tbody", "tfoot", "tr", "ul", "ol", "select") and not node.strip()):
                flow.text(node, pre > 0)
            continue
        tag = node.tag
        if not leaving:
            if node is not root and not visible(node, parent):
                continue
            shown = shown_in(node, shown)
            if not shown and not shows_again(node):
                continue
            if tag == "br":
                flow.end_line(True)
            elif tag == "wbr":
                continue
            elif tag == "img":
                if shown and node.attrs.get("alt", "").strip():
                    flow.text(node.attrs["alt"], False)
            elif tag == "input":
                if shown and node.attrs.get("type", "text").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
                    flow.text(node.attrs["value"], False)
            if tag in VOID:
                if tag == "hr":
                    flow.block(True)
                continue
            if tag == "option" and parent.tag in ("select", "optgroup") and "selected" not in node.attrs and node is not next(
                    (c for c in parent.children if isinstance(c, Node) and c.tag == "option"), None):
                continue
            todo.append((node, parent, True, shown))
            todo.extend((c, node, False, shown) for c in reversed(node.children))
            if tag in ("td", "th"):
                flows.append(Flow())
                continue
            if tag == "tr":
                if tables:
                    tables[-1].rows.append([])
                else:
                    flow.block(False)
                continue
            if tag in ("thead", "tbody", "tfoot"):
                continue
            if tag in BLOCK or tag == "text" and parent.tag in DRAWN:
                flow.block(tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir")))
            if tag == "table":
                tables.append(Table())
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag, _number(node.attrs.get("start", ""), 1, 10 ** 9)])
                flow.indent += 2
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                mark = "- " if kind[0] != "ol" else f"{_number(node.attrs.get('value', ''), kind[1], 10 ** 9)}. "
                if kind[0] == "ol":
                    kind[1] = _number(node.attrs.get("value", ""), kind[1], 10 ** 9) + 1
                flow.prefix = mark
                if not lists:
                    flow.indent += 2
            elif tag in ("blockquote", "dd"):
                flow.indent += 2
            elif tag in ("pre", "listing", "xmp", "textarea"):
                pre += 1
            continue
        # leaving
        if tag in ("td", "th"):
            lines = flows.pop().result()
            if tables:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                tables[-1].rows[-1].append((lines, max(1, _number(node.attrs.get("colspan", ""), 1)), max(1, _number(node.attrs.get("rowspan", ""), 1))))
            else:
                flows[-1].block_lines(lines)
            continue
        if tag == "tr" or tag in ("thead", "tbody", "tfoot"):
            if not tables:
                flow.block(False)
            continue
        if tag == "table":
            flow.block_lines(tables.pop().grid())
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            flow.indent -= 2
            flow.prefix = ""
        elif tag == "li":
            flow.prefix = ""
            if not lists:
                flow.indent -= 2
        elif tag in ("blockquote", "dd"):
            flow.indent -= 2
        elif tag in ("pre", "listing", "xmp", "textarea"):
            pre -= 1
        if tag in BLOCK or tag == "text" and parent.tag in DRAWN:
            flow.block(tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir")))
    return "\n".join(flows[0].result())


def html_text(page: str) -> str:
    return render(parse(page))


def extract_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every whole page."""
    ship(pages.sparkSession)
    x = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("h"))

    def run(batches):
        keep_only("html")
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [html_text(v.as_py()) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, text string")


def op4_html(spark, sf_dir: str) -> DataFrame:
    return extract_html(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(F.col("id").alias("page_id"), "text")

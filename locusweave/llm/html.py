"""Layout-aware text of HTML pages.

Scanner: tags, comments and text by one regular expression; script, style and the like run to their end tag. Tree
builder: elements with implied end tags (a paragraph ends at the next block, list items, cells, rows and options at their
sisters) and implied ends at a parent's end tag; unknown end tags are ignored and open elements end with the page. Rendering: all
visible text in document order, with white space collapsed as in a browser. Blocks begin on lines of their own, paragraphs
and headings stand between blank lines, list items have a bullet or their number and are indented by depth, preformatted text keeps its
lines, and a table's cells stand in the columns of its grid (colspan and rowspan), padded to the column's width as shown (wide letters count twice, combining marks
not at all). Boxes in a line (buttons, fields) stand apart from the text beside them.

Visibility: not shown are head parts, elements with the attribute hidden or with display:none in their style, templates, closed details and dialogs, scripts,
and what browsers show in place of other content (video, audio, canvas, iframe). visibility:hidden or collapse is inherited and ended by visibility:visible
further down. Pages are read without scripts and plugins, so noscript and an object's content are shown, and so are the texts of svg
(without title, desc, metadata, defs and symbols) and math (without annotations). aria-hidden hides nothing from the eye. Fields show their value, or else their placeholder.

The tree is walked with a stack of its own, so depth isn't bounded by Python's. The cost is linear in the page (times a logarithm of its depth, and the cells that rowspan and colspan
make): no token walks the open elements, and tables and indents beyond a fixed depth add no more levels. A page is all that a task holds beside its batch.

Defined results: null and empty pages give an empty text; broken markup gives the text that is there; repeated rows are rendered each; a
null id is kept; an empty table gives an empty result; extra columns are ignored. NUL characters are dropped.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame

from .common import sliced

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
SPACE = re.compile(r"[ \t\n\f\r]+")

#: Fixed values of the markup language, in groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noembed noframes iframe xmp textarea title".split())
UNSEEN = frozenset("script style noembed noframes iframe title head template canvas audio video datalist desc metadata defs symbol annotation annotation-xml".split())
BOXES = frozenset("button select textarea meter progress svg object".split())
#: Types of inputs that show no text of their own.
SILENT = frozenset("hidden password checkbox radio file range color image".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr fieldset".split())
#: What a new tag ends, and the elements beyond which it doesn't look.
ENDS_PARAGRAPH = BLOCK - frozenset(["body", "html", "legend", "optgroup", "option", "dd", "dt", "li"])
SISTERS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "rp": ({"rp", "rt"}, {"ruby"}), "rt": ({"rp", "rt"}, {"ruby"}), "body": ({"head"}, {"html"}),
}
#: Elements an end tag doesn't close from within.
WALLS = frozenset("table td th caption template button object marquee".split())
IN_TABLE = frozenset("table tr tbody thead tfoot td th".split())
#: Tables inside each other that have columns, and a quarter of the deepest indent; what lies deeper is shown as plain blocks or indented no further, as each level would carry all text once more.
DEEPEST = 16
#: The first of these ends an open head.
IN_HEAD = frozenset("base link meta noscript script style template title html head".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), _html.unescape(next((v for v in m.groups()[1:] if v is not None), "")))
    return out


class Builder:
    """The open elements of a page while its tokens come in. The places of each tag's open elements are kept apart, so no token walks down the stack."""

    def __init__(self) -> None:
        self.root = Node("#page", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def cut(self, at: int) -> None:
        """End the open elements from index `at` on."""
        for node in self.open[at:]:
            self.places[node.tag].pop()
        del self.open[at:]

    def innermost(self, tags) -> int:
        """Where the innermost open element of these tags is; 0 if there is none."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def end_up_to(self, tags, walls) -> None:
        """End the outermost open element of `tags` that lies inside the nearest of `walls`."""
        lists = [at for t in tags if (at := self.places.get(t))]
        if not lists:
            return
        wall = self.innermost(walls - tags)
        hit = min((at[k] for at in lists if (k := bisect_right(at, wall)) < len(at)), default=None)
        if hit is not None:
            self.cut(hit)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body", "head") and self.places.get(tag):
            return
        if tag not in IN_HEAD and self.places.get("head"):
            self.end_up_to({"head"}, {"template"})
        if tag in ENDS_PARAGRAPH or tag in ("li", "dd", "dt"):
            self.end_up_to({"p"}, WALLS)
        if tag in SISTERS:
            self.end_up_to(*SISTERS[tag])
        if tag == "td" or tag == "th":
            if self.places.get("table") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
                self.push("tr", {})
        self.push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        if tag == "br":
            return self.push("br", {})
        if not (own := self.places.get(tag)):
            return self.push("br", {}) if tag == "p" else None
        if self.innermost({"table"} if tag in IN_TABLE else WALLS) <= own[-1]:
            self.cut(own[-1])

    def text(self, value: str) -> None:
        if self.places.get("head") and self.open[-1].tag == "head" and value.strip():
            self.end_up_to({"head"}, frozenset())
        self.open[-1].children.append(value)


def parse(page: str) -> Node:
    b, at, n = Builder(), 0, len(page)
    low = None
    while at < n:
        m = TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        if m[4] is not None:
            b.text(m[4])
        elif m[2] is None:
            continue
        elif m[1]:
            b.end(m[2].lower())
        else:
            tag = m[2].lower()
            b.start(tag, attributes(m[3]))
            if tag == "plaintext":
                b.text(page[at:])
                break
            if tag in RAW:
                low = page.lower() if low is None else low
                # Lower-casing changes the length of few letters; then the tag is searched as it is.
                end = low.find("</" + tag, at) if len(low) == n else m.start() if (m := re.compile("</" + re.escape(tag), re.I).search(page, at)) else -1
                end = n if end < 0 else end
                b.text(page[at:end])
                at = end
    return b.root


def declared(node: Node) -> dict[str, str]:
    """What the style says of display and visibility: the last declaration counts, an important one before others."""
    out: dict[str, str] = {}
    important = set()
    for m in DECLARATION.finditer(node.attrs.get("style", "")):
        name = m[1].lower()
        if m[3] or name not in important:
            out[name] = m[2].lower()
            important |= {name} if m[3] else set()
    return out


def hidden(node: Node, style: dict[str, str]) -> bool:
    a = node.attrs
    return node.tag in UNSEEN or bool(a) and ("hidden" in a or style.get("display") == "none") or (node.tag == "dialog" and "open" not in a)


def width_of(text: str) -> int:
    """Columns that a text takes in a line."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in ("W", "F") else 1 for c in text)


class Table:
    """Rows of cells, and for each column the last row that a cell from above takes."""

    def __init__(self) -> None:
        self.rows: list[list[str]] = []
        self.taken: dict[int, int] = {}

    def row(self) -> None:
        self.rows.append([])

    def section(self) -> None:
        """Cells don't reach beyond their group of rows."""
        self.taken = {}

    def cell(self, text: str, across: int, down: int) -> None:
        row, at = self.rows[-1], len(self.rows)
        while self.taken.get(len(row), 0) >= at:
            row.append("")
        for k in range(len(row), len(row) + across):
            if down > 1:
                self.taken[k] = at + down - 1
        row.extend([text] + [""] * (across - 1))


def deeper(indent: str, more: int) -> str:
    return indent + " " * more if len(indent) < 4 * DEEPEST else indent


class Canvas:
    """Lines of text with collapsed space, pending breaks and an indent."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.mark_only = False
        self.blank = 0
        self.indent = ""
        self.mark = ""

    def word(self, text: str) -> None:
        parts = SPACE.split(text)
        if len(parts) == 1:
            self._put(parts[0])
            return
        if parts[0]:
            self._put(parts[0])
        middle = " ".join(x for x in parts[1:] if x)
        self.space = True
        if middle:
            self._put(middle)
            self.space = not parts[-1]

    def _put(self, text: str) -> None:
        if not text:
            return
        if not self.now:
            if self.blank > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.now.append(self.indent + self.mark)
            self.indent = deeper(self.indent, len(self.mark))
            self.mark = ""
        elif self.space:
            self.now.append(" ")
        self.now.append(text)
        self.space, self.blank = False, 0

    def line(self, text: str) -> None:
        """A line as it is."""
        self.flush()
        if self.blank > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.lines.append((self.indent + self.mark + text).rstrip())
        self.indent = deeper(self.indent, len(self.mark))
        self.mark, self.blank = "", 0

    def flush(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def gap(self, n: int) -> None:
        self.flush()
        self.blank = max(self.blank, n)

    def br(self) -> None:
        if self.now:
            self.flush()
        elif self.lines:
            self.lines.append("")

    def text(self) -> str:
        self.flush()
        return "\n".join(self.lines).strip("\n")


def aligned(rows: list[list[str]]) -> list[str]:
    """The rows of a table as lines: cells of several lines become several lines, columns are as wide as their widest line, two spaces apart."""
    cells = [[c.split("\n") for c in r] for r in rows]
    width: list[int] = []
    for r in cells:
        for k, c in enumerate(r):
            if k == len(width):
                width.append(0)
            if k < len(r) - 1:
                width[k] = max(width[k], max(map(width_of, c)))
    out = []
    for r in cells:
        for i in range(max(map(len, r), default=0)):
            parts = [c[i] if i < len(c) else "" for c in r]
            out.append("  ".join(x + " " * (width[k] - width_of(x)) if k < len(r) - 1 else x for k, x in enumerate(parts)).rstrip())
    return out


class Renderer:
    """Walks the tree with a stack of (what to do, with what)."""

    def __init__(self) -> None:
        self.canvas = [Canvas()]
        self.tables: list[Table | None] = []
        self.visible = True
        self.lists: list[list] = []  # [ordered, next number]
        self.pre = 0
        self.todo: list[tuple] = []

    def render(self, root: Node) -> str:
        self.todo = [("node", root)]
        while self.todo:
            what, x = self.todo.pop()
            if what == "node":
                self._text(x) if isinstance(x, str) else self._enter(x)
            else:
                getattr(self, "_" + what)(x)
        return self.canvas[0].text()

    def _text(self, value: str) -> None:
        if not self.visible:
            return
        value = _html.unescape(value).replace("\0", "")
        c = self.canvas[-1]
        if self.pre:
            *full, last = value.replace("\r\n", "\n").split("\n")
            for part in full:
                if c.now:
                    c.now.append(part)
                    c.flush()
                else:
                    c.line(part)
            if last:
                c.space = False
                c._put(last)
        else:
            c.word(value.replace("\xa0", " "))

    def _enter(self, n: Node) -> None:
        tag, c = n.tag, self.canvas[-1]
        style = declared(n) if "style" in n.attrs else {}
        if hidden(n, style):
            return
        if (seen := style.get("visibility")) in ("visible", "hidden", "collapse"):
            self.todo.append(("sight", self.visible))
            self.visible = seen == "visible"
        if tag == "br":
            return c.br()
        if tag == "hr":
            c.gap(2)
            return
        if tag == "img":
            return c.word(" " + n.attrs["alt"] + " ") if self.visible and n.attrs.get("alt", "").strip() else None
        if tag == "input":
            shown = next((x for k in ("value", "placeholder") if (x := n.attrs.get(k, "")).strip()), "")
            return c.word(" " + shown + " ") if self.visible and shown and n.attrs.get("type", "text").strip().lower() not in SILENT else None
        if tag in VOID:
            return None
        kids = n.children
        if tag == "details" and "open" not in n.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        if tag in ("tr", "td", "th") and (not self.tables or self.tables[-1] is None):
            return self._block(n, kids, 1)
        if tag == "table" and len(self.tables) >= DEEPEST:
            self.tables.append(None)
            self.todo.append(("leave_table", n))
            return self._block(n, kids, 2)
        if tag == "table":
            c.gap(2)
            self.tables.append(Table())
            self.todo.append(("close_table", n))
            # Text straight inside a table has no cell: it is shown before it.
        elif tag == "tr":
            self.tables[-1].row()
        elif tag in ("td", "th"):
            if not self.tables[-1].rows:
                self.tables[-1].row()
            self.canvas.append(Canvas())
            self.todo.append(("close_cell", n))
        elif tag in ("thead", "tbody", "tfoot"):
            if self.tables and self.tables[-1]:
                self.tables[-1].section()
        elif tag in BOXES or (tag == "text" and c.now):
            c.word(" ")
            self.todo.append(("close_box", n))
            if tag == "textarea" and not "".join(k for k in kids if isinstance(k, str)).strip() and n.attrs.get("placeholder"):
                kids = [_html.escape(n.attrs["placeholder"])]
        elif tag == "caption":
            return self._block(n, kids, 1)
        elif tag in ("ul", "ol", "menu", "dir"):
            start = n.attrs.get("start", "")
            self.lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            c.gap(1 if len(self.lists) > 1 else 2)
            self.todo.append(("close_list", c.indent))
            c.indent = deeper(c.indent, 2) if len(self.lists) > 1 and not c.mark and not c.indent else c.indent
        elif tag == "li":
            c.gap(1)
            mark = "* "
            if self.lists and self.lists[-1][0]:
                value = n.attrs.get("value", "")
                self.lists[-1][1] = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else self.lists[-1][1]
                mark = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            self.todo.append(("close_item", (c.indent, c.mark)))
            c.indent, c.mark = deeper(c.indent, len(c.mark)), mark
        elif tag in ("blockquote", "dd"):
            c.gap(2 if tag == "blockquote" else 1)
            self.todo.append(("close_indent", (c.indent, 2 if tag == "blockquote" else 1)))
            c.indent = deeper(c.indent, 2)
        elif tag == "pre" or tag == "xmp":
            c.gap(2)
            self.pre += 1
            self.todo.append(("close_pre", n))
            if kids and isinstance(kids[0], str) and kids[0][:1] == "\n":
                kids = [kids[0][1:], *kids[1:]]
        elif tag in BLOCK:
            return self._block(n, kids, 2 if tag in SPACED else 1)
        self._children(kids)
        return None

    def _children(self, kids: list) -> None:
        self.todo.extend(("node", k) for k in reversed(kids))

    def _block(self, n: Node, kids: list, gap: int) -> None:
        self.canvas[-1].gap(gap)
        self.todo.append(("close_block", gap))
        self._children(kids)

    def _close_block(self, gap: int) -> None:
        self.canvas[-1].gap(gap)

    def _close_indent(self, x: tuple[str, int]) -> None:
        self.canvas[-1].gap(x[1])
        self.canvas[-1].indent = x[0]

    def _close_item(self, x: tuple[str, str]) -> None:
        c = self.canvas[-1]
        c.gap(1)
        c.indent, c.mark = x

    def _close_list(self, indent: str) -> None:
        self.lists.pop()
        self.canvas[-1].gap(1 if self.lists else 2)
        self.canvas[-1].indent = indent

    def _close_pre(self, _n: Node) -> None:
        self.pre -= 1
        self.canvas[-1].gap(2)

    def _sight(self, before: bool) -> None:
        self.visible = before

    def _close_box(self, _n: Node) -> None:
        self.canvas[-1].word(" ")

    def _close_cell(self, n: Node) -> None:
        across, down = (int(x) if re.fullmatch(r"[0-9]{1,5}", x := n.attrs.get(k, "").strip()) else 1 for k in ("colspan", "rowspan"))
        # As in browsers: a colspan is at most 1000, and a rowspan of 0 goes to the end of the rows' group.
        self.tables[-1].cell(self.canvas.pop().text(), max(1, across if across <= 1000 else 1000), down or 65_534)

    def _leave_table(self, _n: Node) -> None:
        self.tables.pop()

    def _close_table(self, _n: Node) -> None:
        rows = self.tables.pop().rows
        c = self.canvas[-1]
        for line in aligned([r for r in rows if any(r)]):
            c.line(line)
        c.gap(2)


def text_of(page: str | None) -> str:
    """The visible text of a page."""
    return Renderer().render(parse(page)) if page else ""


def extract(pages: DataFrame, ident: str = "page_id", html: str = "html") -> DataFrame:
    """ident, text; one row for each input row. One narrow pass, no shuffle."""
    import pyarrow as pa

    def run(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of(x) for x in b.column(1).to_pylist()], pa.string())], [ident, "text"])

    src = pages.select(ident, html)
    return src.mapInArrow(run, f"`{ident}` {src.schema[0].dataType.simpleString()}, text string")

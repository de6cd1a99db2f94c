"""Visible text of HTML by layout-aware rendering.

``parse`` builds a tree, supplying the tags that HTML implies; ``render`` walks
it by visibility rules and lays out blocks, lists and tables. Both use stacks of
their own, so deep nesting can't overflow, and take time linear in the page,
whatever its markup is like:

* A quote that is never closed is an ordinary character. Once a tag is not closed
  outside of quotes, quotes hide no ``>`` in the rest of the page; a ``<`` behind
  the last ``>`` is text.
* Lines are indented by ``INDENT`` columns at most.
* Table cells are padded to their column's width up to twice its mean width (or
  ``NARROW``); a row that would still take more than ``SWOLLEN`` times its text is
  written without padding, and tables nested deeper than ``NESTED`` cell by cell.

No rule drops text. Of style sheets inside the page, rules for an element name, a
class, an id or a name with a class count (outside of at-rules), and of these
and of inline styles ``display: none``, ``visibility``, ``content-visibility:
hidden`` and ``white-space``.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm.common import slices, strings

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template noscript title noembed noframes iframe object audio video canvas datalist defs symbol clippath mask pattern marker desc metadata annotation annotation-xml mphantom".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = MARGIN | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav mtr option search section summary".split())
#: What may stand in an open head; any other opening tag, and text, closes it.
IN_HEAD = frozenset("html head base link meta title style script noscript noframes template".split())
#: An opening tag closes these, if one is open within the tags after the dash.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
    "a": ({"a"}, {"table", "td", "th"}),
}
#: What these open inside a table that lacks it.
NEEDS = {"td": "tr", "th": "tr"}
#: Closing tags don't reach beyond these.
SCOPE = frozenset("table td th caption html template".split())
#: Columns that a cell can keep in the rows below, by which blanks stay bounded; and its rows.
SPANNED, ROWS = 24, 65534
#: See above.
INDENT, NARROW, SWOLLEN, NESTED = 40, 40, 8, 8
#: Columns that any row may take.
ANY_ROW = 240
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())

#: A quote opens a value only right after '='; other values end at white space or '>'.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMED = re.compile("</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
DECLARATION = re.compile(r"([a-zA-Z-]++)\s*+:\s*+([a-zA-Z-]++)")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*+)?([.#][\w-]++)?")
#: Properties that count, and values of white-space that keep it.
PROPERTIES = frozenset("display visibility content-visibility white-space".split())
KEPT_SPACE = frozenset("pre pre-wrap pre-line break-spaces".split())
#: Kinds of fields that show no text, and labels of buttons without a value.
NO_TEXT = frozenset("hidden checkbox radio file image color range password".split())
LABELS = {"submit": "Submit", "reset": "Reset"}


def declarations(style: str) -> dict[str, str]:
    """The properties that count, of the declarations of a style."""
    out = {}
    for part in style.split(";"):
        m = DECLARATION.match(part.strip())
        if m and m[1].lower() in PROPERTIES:
            out[m[1].lower()] = m[2].lower()
    return out


class Sheet:
    """Rules of a page's style sheets by selector."""

    def __init__(self) -> None:
        self.rules: dict[str, dict[str, str]] = {}

    def add(self, css: str) -> None:
        first, *rest = css.split("/*")
        css, depth = first + " ".join(x.partition("*/")[2] for x in rest), 0
        for block in css.split("}"):
            head, brace, body = block.rpartition("{")
            if not brace:
                depth = max(0, depth - 1)
                continue
            depth += head.count("{")
            found = declarations(body) if not depth else {}
            for selector in head.split(",") if found else ():
                m = SELECTOR.fullmatch(selector.strip())
                if m and m[0]:
                    self.rules.setdefault((m[1] or "").lower() + (m[2] or ""), {}).update(found)

    def of(self, node: Node) -> dict[str, str]:
        """What the sheets and then its own style declare for an element; ids count more than classes, these more than names."""
        out: dict[str, str] = {}
        if self.rules:
            out |= self.rules.get(node.tag, {})
            if node.attributes:
                for mark, name in ((".", "class"), ("#", "id")):
                    for x in (node.attribute(name) or "").split():
                        out |= self.rules.get(mark + x, {}) | self.rules.get(node.tag + mark + x, {})
        style = node.attribute("style") if node.attributes else None
        return out | declarations(style) if style else out


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children = tag, attributes, []

    def attribute(self, name: str) -> str | None:
        """Its value, '' if it has none, None if it is absent."""
        if name not in self.attributes.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


class Builder:
    """Open elements, deepest last, and where each tag stands among them; every tag puts the tree in order at once."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def text(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip(" \t\n\f\r"):
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._cut(len(self.open) - 1)
        if tag == "html" or tag == "head" and self.open[-1].tag == "head":
            return
        closes, within = CLOSES.get(tag, (None, None))
        if closes:
            self._close_implied(closes, within)
        elif tag in BLOCK:
            self._close_implied({"p"}, SCOPE)
        if tag in NEEDS and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node(NEEDS[tag]))
        self._push(Node(tag, attributes))
        if tag in VOID or closed and tag not in BLOCK and tag not in RAW:
            self._cut(len(self.open) - 1)

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _cut(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()

    def _deepest(self, tags: set | frozenset) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close_implied(self, closes: set, within: set | frozenset) -> None:
        """Closes the topmost of some tags below the border that others set; a single one only where it is deepest."""
        border = self._deepest(within)
        found = [x[-1 if len(closes) == 1 else bisect_right(x, border)] for t in closes if (x := self.places.get(t)) and x[-1] > border]
        if found:
            self._cut(min(found))

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "", True)
            return
        place = self._deepest({tag})
        if place and (tag in TABLE_PARTS or place >= self._deepest(SCOPE)):
            self._cut(place)
        elif tag == "p":  # a closing tag alone is an empty paragraph
            self.open[-1].children.append(Node("p"))


def parse(source: str, sheet: Sheet | None = None) -> Node:
    """The tree of a page; ``sheet`` takes in its style sheets."""
    tree, at, n = Builder(), 0, len(source)
    last, pattern = source.rfind(">"), TAG
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            tree.text(source[at:lt])
        if lt == n:
            break
        after = source[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            comment = source.startswith("<!--", lt)
            end = source.find("-->" if comment else ">", lt + (2 if comment else 1))
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        if lt > last:
            tree.text(source[lt:])
            break
        if not NAMED.match(source, lt):
            if after == "/":
                at = source.find(">", lt) + 1  # a closing tag without a name is no text
            else:
                tree.text("<")
                at = lt + 1
            continue
        m = pattern.match(source, lt)
        if not m:
            pattern = LOOSE
            m = pattern.match(source, lt)
        at, tag = m.end(), m[2].lower()
        if m[1]:
            tree.end(tag)
            continue
        tree.start(tag, m[3], m[3].endswith("/"))
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
            stop = end.start() if end else n
            tree.text(source[at:stop])
            if tag == "style" and sheet is not None:
                sheet.add(source[at:stop])
            at = stop
        elif tag == "plaintext":
            tree.text(source[at:])
            break
    return tree.root


def hidden(node: Node, declared: dict[str, str] | None = None) -> bool:
    """By the element itself, its styles or the ``hidden`` attribute. A closed ``details`` and visibility, which elements inside can undo, are handled by ``render``."""
    if node.tag in HIDDEN or node.tag == "dialog" and node.attribute("open") is None:
        return True
    if declared is None:
        declared = declarations(node.attribute("style") or "") if node.attributes else {}
    if declared.get("content-visibility") == "hidden":
        return True
    if "display" in declared:
        return declared["display"] == "none"
    return bool(node.attributes) and node.attribute("hidden") is not None


def field_text(node: Node) -> str:
    """What an input field shows: its value, else its label or placeholder."""
    kind = (node.attribute("type") or "text").strip().lower()
    if kind in NO_TEXT:
        return ""
    value = node.attribute("value")
    return value if value else LABELS.get(kind, "") if value is None and kind in LABELS else (node.attribute("placeholder") or "") if kind not in ("submit", "reset", "button") else ""


def _inside(node: Node, wanted: frozenset, skip: bool) -> Iterator[Node]:
    """The topmost wanted elements in a node, in order; without what is hidden, if ``skip``."""
    todo = [x for x in reversed(node.children) if isinstance(x, Node)]
    while todo:
        x = todo.pop()
        if skip and hidden(x):
            continue
        if x.tag in wanted:
            yield x
        else:
            todo += [y for y in reversed(x.children) if isinstance(y, Node)]


def drawn(svg: Node) -> list:
    """The texts of a drawing, apart by blanks; other character data in it isn't shown."""
    return [y for x in _inside(svg, frozenset(("text", "foreignobject")), True) for y in (" ", x)][1:]


def _label(node: Node) -> str:
    """The label or else the text of an option, escaped as in the source."""
    label = node.attribute("label")
    if label or node.tag == "optgroup":
        return html.escape(label or "", quote=False)
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in ("script", "style"):
            todo += reversed(x.children)
    return "".join(out)


def chosen(select: Node) -> list:
    """What a browser shows of a field: all options of a list box, else the selected or the first one that can be."""
    options = []  # (option, whether it is disabled), or an option group
    for x in _inside(select, frozenset(("option", "optgroup")), False):
        off = x.tag == "optgroup" and x.attribute("disabled") is not None
        options += [(x, True), *((y, off or y.attribute("disabled") is not None) for y in _inside(x, frozenset(("option",)), False))] if x.tag == "optgroup" else [(x, x.attribute("disabled") is not None)]
    rows = select.attribute("size") or ""
    if select.attribute("multiple") is not None or re.fullmatch(r"\d{1,9}", rows) and int(rows) > 1:
        out = [Node("option") for x, _ in options if not hidden(x)]
        for new, text in zip(out, [_label(x) for x, _ in options if not hidden(x)], strict=True):
            new.children.append(text)
        return out
    only = [(x, off) for x, off in options if x.tag == "option"]
    marked = [x for x, _ in only if x.attribute("selected") is not None][-1:]
    return [_label(x) for x in marked or [x for x, off in only if not off][:1]]


class Flow:
    """Text being laid out: lines with collapsed white space, blank lines between blocks with margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = self.space = False
        self.indent = self.bullet = self.lead = ""

    def write(self, data: str, pre: bool) -> None:
        if pre:
            if self.space and self.line:
                self._add(" ")
            self.space = False
            first, *rest = data.split("\n")
            self._add(first)
            for x in rest:
                self._close(True)
                self._add(x)
            return
        words = data.split()
        if not words:
            self.space = self.space or bool(data)
            return
        if (self.space or data[0].isspace()) and self.line:
            self._add(" ")
        self._add(" ".join(words))
        self.space = data[-1].isspace()

    def _add(self, data: str) -> None:
        if not data:
            return
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.line.append(self.lead + self.bullet if self.bullet else self.indent)
            self.bullet = ""
        self.line.append(data)

    def deeper(self, columns: int, bullet: str = "") -> None:
        """Indents what follows, after a bullet in its first line; not beyond ``INDENT`` columns."""
        self.lead, self.bullet = self.indent, bullet
        if len(self.indent) + columns <= INDENT:
            self.indent += " " * columns

    def _close(self, always: bool = False) -> None:
        if self.line or always:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def br(self) -> None:
        self._close(True)

    def block(self, margin: bool) -> None:
        self._close()
        self.gap = self.gap or margin

    def text(self) -> str:
        self._close()
        return "\n".join(self.lines).strip("\n")


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in s)


def spread(rows: list[list[tuple[str, int, int]] | None]) -> list[list[tuple[str, int]]]:
    """(text, columns) by row, with empty cells where cells of rows above reach down to; None ends a group of rows and what reaches out of it."""
    out, until = [], {}
    for row in rows:
        if row is None:
            until = {}
            continue
        n, at = len(out), 0
        cells = []
        for text, span, down in row:
            while until.get(at, 0) > n:
                cells.append(("", 1))
                at += 1
            cells.append((text, span))
            if down > 1:
                until.update((c, max(n + down, until.get(c, 0))) for c in range(at, min(at + span, SPANNED)))
            at += span
        out.append(cells)
    return out


def grid(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Lines of a table: cells of a column start at one place; cells may span columns and have several lines."""
    placed, starts = [], set()
    for row in rows:
        at = 0
        placed.append([])
        for text, span in row:
            placed[-1].append((text.split("\n"), at, at + span))
            starts.add(at)
            at += span
    columns = sorted(starts)  # places where some cell starts: others tell nothing apart
    number = {at: k for k, at in enumerate(columns)}
    most, total, count = ([0] * len(columns) for _ in range(3))
    reach = [[bisect_right(columns, stop - 1) for _, _, stop in row] for row in placed]
    size = [[max(map(width, lines)) for lines, _, _ in row] for row in placed]
    for row, ends, sizes in zip(placed, reach, size, strict=True):
        for (_, at, _), end, w in zip(row, ends, sizes, strict=True):
            k = number[at]
            if end == k + 1:
                most[k], total[k], count[k] = max(most[k], w), total[k] + w, count[k] + 1
    sums = [0]
    for m, t, c in zip(most, total, count, strict=True):
        sums.append(sums[-1] + min(m, max(NARROW, 2 * t // max(1, c))) + 3)
    out = []
    for row, ends, sizes in zip(placed, reach, size, strict=True):
        room = [sums[end] - sums[number[at]] - 3 for (_, at, _), end in zip(row, ends, strict=True)]
        height = max((len(lines) for lines, _, _ in row), default=0)
        swollen = height * sum(max(r, w) + 3 for r, w in zip(room, sizes, strict=True))
        if swollen > SWOLLEN * sum(len(x.replace(" ", "")) for lines, _, _ in row for x in lines) + ANY_ROW:
            flat: list[str] = []  # cells of one line stay side by side
            for lines, _, _ in row:
                if len(lines) == 1:
                    flat.append(lines[0])
                else:
                    out += [" | ".join(flat).rstrip(), *lines] if any(flat) else lines
                    flat = []
            if any(flat):
                out.append(" | ".join(flat).rstrip())
            continue
        for i in range(height):
            parts = [(lines[i] if i < len(lines) else "", r) for (lines, _, _), r in zip(row, room, strict=True)]
            out.append(" | ".join(x + " " * max(0, r - width(x)) for x, r in parts).rstrip())
    return out


def _number(node: Node, name: str, pattern: str, other: int) -> int:
    value = (node.attribute(name) or "").strip()
    return int(value) if re.fullmatch(pattern, value) else other


def render(root: Node, sheet: Sheet | None = None) -> str:
    """Visible text: paragraphs apart by a blank line, list items marked and indented, table cells aligned."""
    sheet = sheet or Sheet()
    flows, tables, lists = [Flow()], [], []
    keeps, seen = [False], [True]  # white space is kept; text is visible
    todo: list[tuple] = [(root, None)]
    while todo:
        node, left = todo.pop()  # ``left`` tells what an element that ends changed, None if it begins
        flow = flows[-1]
        if isinstance(node, str):
            if seen[-1]:
                flow.write(html.unescape(node) if "&" in node else node, keeps[-1])
            continue
        tag = node.tag
        grids = 0 < len(tables) <= NESTED
        if left is None:
            declared = sheet.of(node) if node.attributes or sheet.rules else {}
            if hidden(node, declared):
                continue
            if tag == "br":
                flow.br()
                continue
            indent = flow.indent
            if tag == "table":
                flow.block(True)
                tables.append([])
            elif tag == "tr" and grids:
                tables[-1].append([])
            elif tag in ("thead", "tbody", "tfoot") and grids:
                tables[-1].append(None)
            elif tag in ("td", "th", "caption") and grids:
                flows.append(Flow())
            elif tag in BLOCK or tag in ("tr", "td", "th"):
                flow.block(tag in MARGIN and not (lists and tag in ("ul", "ol", "dl")))
                if tag in ("ul", "ol", "menu", "dir"):
                    lists.append([tag, _number(node, "start", r"-?\d{1,9}", 1) - 1])
                elif tag == "li":
                    kind = lists[-1] if lists else ["ul", 0]
                    kind[1] = _number(node, "value", r"-?\d{1,9}", kind[1] + 1)
                    bullet = f"{kind[1]}. " if kind[0] == "ol" else "- "
                    flow.deeper(len(bullet), bullet)
                elif tag in ("dd", "blockquote"):
                    flow.deeper(4)
            elif tag == "mtd":
                flow.write(" ", False)
            elif tag == "q" and seen[-1]:
                flow.write("\u201c", False)
            elif tag == "input" and seen[-1]:
                flow.write(field_text(node), False)
            changed = 0
            space = declared.get("white-space")
            if space or tag in ("pre", "textarea"):
                keeps.append(space in KEPT_SPACE if space else True)
                changed |= 1
            if declared.get("visibility") in ("visible", "hidden", "collapse"):
                seen.append(declared["visibility"] == "visible")
                changed |= 2
            todo.append((node, (changed, indent, grids)))
            children = node.children
            if tag == "details" and node.attribute("open") is None:
                children = [x for x in children if isinstance(x, Node) and x.tag == "summary"][:1]
            elif tag == "svg":
                children = drawn(node)
            elif tag == "select":
                children = chosen(node)
            elif tag in ("pre", "textarea") and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            elif tag in ("table", "tbody", "thead", "tfoot", "tr", "ul", "ol"):
                children = [x if isinstance(x, Node) else f" {x} " for x in children if isinstance(x, Node) or x.strip()]
            todo += [(x, None) for x in reversed(children)]
            continue
        changed, indent, grids = left
        if changed & 1:
            keeps.pop()
        if changed & 2:
            seen.pop()
        if tag in ("td", "th", "caption") and grids:
            text = flows.pop().text()
            span = min(1000, max(1, _number(node, "colspan", r"\d{1,9}", 1)))
            down = min(ROWS, _number(node, "rowspan", r"\d{1,9}", 1) or ROWS)
            if tag == "caption":
                for x in text.split("\n") if text else []:
                    flows[-1].write(x, True)
                    flows[-1].block(False)
            else:
                if not tables[-1] or tables[-1][-1] is None:
                    tables[-1].append([])
                tables[-1][-1].append((text, span, down))
        elif tag == "table":
            flow.block(False)  # what stood in the table, but in no cell
            for line in grid(spread(tables.pop())):
                flow.write(line, True)
                flow.block(False)
            flow.block(True)
        elif tag in ("thead", "tbody", "tfoot") and grids:
            tables[-1].append(None)
        elif tag == "q" and seen[-1]:
            flow.write("\u201d", False)
        elif tag in BLOCK or tag in ("tr", "td", "th") and not grids:
            flow.block(tag in MARGIN and not (len(lists) > 1 and tag in ("ul", "ol", "dl")))
            if tag in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            elif tag == "li":
                flow.bullet = ""
            flow.indent = indent
    return flows[0].text()


def extract(source: str | None) -> str:
    """Visible text of one page; none for null."""
    if not source:
        return ""
    sheet = Sheet()
    return render(parse(source, sheet), sheet)


def extract_text(pages: DataFrame, source: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but ``source`` by default) with the visible text ``out`` of each page.

    Null and empty sources give an empty text; broken markup never fails.
    Repeated rows stay, an empty table stays empty, an input column named
    ``out`` is replaced. One narrow pass; a worker holds one slice of pages.
    """
    keep = [c for c in (keep if keep is not None else pages.columns) if c not in (source, out)]
    rows = pages.select(*keep, source)
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source):
            texts = [extract(x) for x in strings(batch.column(source))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, out])

    return rows.mapInArrow(run, schema)

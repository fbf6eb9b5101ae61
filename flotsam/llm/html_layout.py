"""Visible text of HTML pages, laid out: blocks apart, lists with marks, table cells in aligned columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Fixed values of the HTML standard: elements by how they are parsed or shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript noembed noframes iframe object audio video canvas datalist title param source track area desc metadata defs symbol annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody thead tfoot tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre table figure fieldset".split())
#: An opening tag on the left ends an open element on the right, up to the elements that hold it in.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th", "caption", "colgroup"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"),
    "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), "option": ("option",), "optgroup": ("option", "optgroup"), "body": ("head",), "a": ("a",), "button": ("button",),
}
HOLDS = {"li": ("ul", "ol", "menu", "table"), "dt": ("dl", "table"), "dd": ("dl", "table"), "a": ("td", "th", "table"), "button": ("form", "table")}
#: Opening tags that end an open paragraph.
ENDS_P = BLOCK - {"body", "html", "li", "dd", "dt", "option", "optgroup", "legend", "caption", "tbody", "thead", "tfoot", "tr"} | {"li", "dd", "dt"}
#: Elements that may stand in each other before deeper ones are taken as inline; columns up to which cells are padded, and
#: the width from which a cell's line is not padded against.
DEPTH, PAD, WIDE = 512, 400, 120
#: Characters up to which lists and quotes within each other are indented; deeper ones stay at that indent.
INDENT = 24
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_VALUE = re.compile(r"\s*([\"']?)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]*))?")
_NONE, _SEEN = re.compile(r"(?<![\w-])display\s*:\s*none", re.I), re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible)", re.I)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value.strip("\"'")) if value else "")
    return out


def _tag_end(html: str, at: int) -> int:
    """The place after the ``>`` of the tag whose name ends at ``at``; quotes count after ``=`` alone.  Without one, -1."""
    while True:
        end = html.find(">", at)
        equals = html.find("=", at, end)
        if end < 0 or equals < 0:
            return end + 1 if end >= 0 else -1
        value = _VALUE.match(html, equals + 1)
        at = value.end()
        if value[1]:
            at = html.find(value[1], at) + 1
            if not at:
                return -1


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") as they stand, in one pass.

    Comments, declarations and ``<![CDATA[`` sections are left out; a tag or comment that never ends takes the rest.
    """
    at, text, n = 0, 0, len(html)
    while (at := html.find("<", at)) >= 0:
        tag = None
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) + 3
            end = end if end > 2 else n
        elif html.startswith("<![CDATA[", at):
            end = html.find("]]>", at + 9) + 3
            end = end if end > 2 else n
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at) + 1 or n
        else:
            tag = _TAG.match(html, at)
            if not tag:
                at += 1
                continue
            end = _tag_end(html, tag.end())
            if end < 0:
                tag, end = None, n
        if text < at:
            yield "text", html[text:at], ""
        if tag:
            name = tag[1].lower()
            if html[at + 1] == "/":
                yield "close", name, ""
            else:
                yield "open", name, html[tag.end() : end - 1]
                if name in RAW:
                    close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, end)
                    after = html.find(">", close.end()) + 1 if close else 0  # without one, no later name has one either
                    stop = close.start() if after else n
                    if stop > end:
                        yield "text", html[end:stop], ""
                    yield "close", name, ""
                    end = after or n
        at = text = end
    if text < n:
        yield "text", html[text:], ""


def events(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("open", tag, attributes), ("close", tag, {}) and ("text", text, {}), balanced: implied tags are put in.

    Void elements are opened and closed.  A closing tag without an open element is ignored, but ``</p>`` makes an empty
    paragraph and ``</br>`` a break.  Elements that are open at the end are closed.
    """
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # where each tag is open in the stack

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close_one() -> tuple[str, str, dict[str, str]]:
        tag = stack.pop()
        places[tag].pop()
        return "close", tag, {}

    def pop_to(tags, holds=()) -> Iterator[tuple[str, str, dict[str, str]]]:
        k = last(tags)
        if k > last(holds):
            while len(stack) > k:
                yield close_one()

    def push(tag: str, attributes: dict[str, str]) -> tuple[str, str, dict[str, str]]:
        places.setdefault(tag, []).append(len(stack))
        stack.append(tag)
        return "open", tag, attributes

    def opened(tag: str, attributes: dict[str, str]) -> Iterator[tuple[str, str, dict[str, str]]]:
        if tag in ENDS_P:
            yield from pop_to(("p",), ("table", "td", "th", "button"))
        if tag in CLOSES:
            holds = HOLDS.get(tag, ("table",))
            while last(CLOSES[tag]) > last(holds):
                yield from pop_to(CLOSES[tag], holds)
        if tag in ("td", "th") and places.get("table") and last(("tr",)) < last(("table",)):
            yield push("tr", {})
        yield push(tag, attributes)
        if tag in VOID:
            yield close_one()

    for kind, value, attributes in tokens(html):
        if kind == "text":
            yield "text", value, {}
        elif kind == "open":
            yield from opened(value, _attributes(attributes) if attributes.strip(" /\n\t\r") else {})
        elif places.get(value):
            yield from pop_to((value,), ("table",) if value not in ("table", "body", "html") else ())
        elif value in ("p", "br"):
            yield from opened(value, {})
            if value == "p":
                yield close_one()
    while stack:
        yield close_one()


def _shown(css: str) -> tuple[bool, bool | None]:
    """Whether declarations take an element out, and whether they make its text seen (None: as outside)."""
    seen = _SEEN.findall(css)
    return bool(_NONE.search(css)), seen[-1].lower() == "visible" if seen else None


def _sheet(css: str) -> dict[str, tuple[bool, bool | None]]:
    """What rules of one simple selector (tag, .class or #id) of a style sheet say of being shown."""
    out = {}
    for rule in re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S).split("}"):
        selectors, _, body = rule.rpartition("{")
        gone, seen = _shown(body)
        if gone or seen is not None:
            for s in selectors.split(","):
                if re.fullmatch(r"[.#]?[\w-]+", s.strip()):
                    before = out.get(s.strip(), (False, None))
                    out[s.strip()] = (gone or before[0], before[1] if seen is None else seen)
    return out


def _style_texts(html: str) -> str:
    return " ".join(value for kind, value, _ in _in_style(html))


def _in_style(html: str) -> Iterator[tuple[str, str, str]]:
    inside = False
    for token in tokens(html):
        if token[0] == "text" and inside:
            yield token
        inside = token[:2] == ("open", "style")


class _Flow:
    """Lines of a block container: text runs are joined, white space collapses, blocks stand apart."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = self.indent = 0

    def text(self, s: str, keep: bool) -> None:
        if keep:
            head, *rest = s.replace("\r\n", "\n").split("\n")
            self.run.append(head)
            for line in rest:
                self.end_line(force=True, keep=True)
                self.run.append(line)
        else:
            self.run.append(re.sub(r"[ \t\n\r\f]+", " ", s))

    def end_line(self, force: bool = False, keep: bool = False) -> None:
        line = "".join(self.run)
        line = line.rstrip() if keep else re.sub(r" {2,}", " ", line).strip(" ")
        self.run = []
        if line or force:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines.append(line)

    def apart(self, blank: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, int(blank))

    def block(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            if self.lines:
                self.lines += lines
            else:
                self.lines = lines


def _joined(reach: list[list]) -> list[list]:
    """Neighbouring or overlapping stretches of columns as one, which keeps all cells and the first of their ends."""
    out: list[list] = []
    for x in sorted(reach, key=lambda x: x[0]):
        if out and out[-1][1] >= x[0]:
            first, to, end, cells = out[-1]
            few, many = (cells, x[3]) if len(cells) <= len(x[3]) else (x[3], cells)
            many += few
            out[-1] = [first, to if to >= x[1] else x[1], end if end <= x[2] else x[2], many]
        else:
            out.append(x)
    return out


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Table rows of cells (lines, columns and rows spanned) as lines; columns stand two spaces apart.

    A cell stands in the first column that no cell from above reaches into.  Columns are as wide as their widest line of
    under WIDE characters in a cell of one column; a line that reaches beyond the next column, or a column that would
    begin after PAD characters, is followed by two spaces alone, so padding stays in proportion to the cells.
    """
    placed: list[list[tuple[int, list[str]]]] = []
    reach: list[list] = []  # [first column, column after the last, row in which one of them ends, cells] of neighbours from above
    widths: dict[int, int] = {}
    for r, row in enumerate(rows):
        if any(b[2] <= r for b in reach):
            still = [[a, b, end, [(a, b, end)]] for x in reach if x[2] <= r for a, b, end in x[3] if end > r]
            reach = _joined([x for x in reach if x[2] > r] + still)
        column, k, out, spans = 0, 0, [], []
        for lines, across, down in row:
            while k < len(reach) and reach[k][0] <= column:
                column = max(column, reach[k][1])
                k += 1
            out.append((column, lines))
            width = max([len(line) for line in lines if len(line) < WIDE], default=0) if across == 1 else 0
            if width >= widths.get(column, 0):
                widths[column] = width
            if down > 1:
                spans.append([column, column + across, r + down, [(column, column + across, r + down)]])
            column += across
        if spans:
            reach = _joined(reach + spans)
        placed.append(out)
    starts, at = {}, 0
    for column in sorted(widths):
        starts[column] = min(at, PAD)
        at += widths[column] + 2
    text = []
    for row in placed:
        for k in range(max((len(lines) for _, lines in row), default=0)):
            line = ""
            for column, lines in row:
                if column and (line or k < len(lines)):
                    line = line.ljust(starts[column]) if len(line) + 2 <= starts[column] else line + "  "
                line += lines[k] if k < len(lines) else ""
            text.append(line.rstrip())
    return text


def _span(attributes: dict[str, str], name: str, most: int) -> int:
    value = attributes.get(name, "1").strip()
    return min(int(value), most) if re.fullmatch(r"\d{1,9}", value) and int(value) else 1


def render(html: str | None) -> str:
    """The visible text of a page.

    Hidden are what browsers do not show as text, elements with ``hidden`` or a style of display none, text with a
    visibility of hidden (an element inside can be visible again), what simple rules of the page's own style sheets hide,
    and options that are not selected where a list shows one.  Blocks start lines, paragraphs, headings, lists,
    tables and preformatted text stand a blank line apart; list items carry ``-`` or their number and are indented;
    cells are padded to their columns, spans included; ``pre`` keeps its white space; ``hr`` is a line of dashes.
    Elements more than DEPTH deep are taken as inline, indents end at INDENT characters.  The work grows with the page's
    length, and so does the text: a line has at most INDENT characters of indent, and PAD of padding a table around it.
    """
    if not html:
        return ""
    sheet = _sheet(_style_texts(html)) if "<style" in html.lower() else {}
    flows, lists, tables, selects = [_Flow()], [], [], []
    hidden, pre = 0, 0
    state: list[tuple[bool, bool]] = []  # of open elements: out of the page; visible
    for kind, value, attributes in events(html):
        if kind == "text":
            if not hidden and (not state or state[-1][1]) and not (tables and tables[-1]["flow"] is flows[-1] and not value.strip()):
                flows[-1].text(unescape(value), pre > 0)
            continue
        tag = value
        if kind == "open":
            seen = state[-1][1] if state else True
            gone = tag in HIDDEN or "hidden" in attributes
            styles = [sheet[k] for k in (tag, *(f".{c}" for c in attributes.get("class", "").split()), f"#{attributes.get('id')}") if k in sheet] if sheet else []
            if attributes.get("style"):
                styles.append(_shown(attributes["style"]))
            for out, own in styles:
                gone, seen = gone or out, seen if own is None else own
            state.append((gone, seen))
            hidden += gone
            if hidden or len(state) > DEPTH:
                continue
            flow = flows[-1]
            if tag == "br":
                flow.end_line(force=True)
            elif tag == "hr":
                flow.block(["---"] if seen else [])
            elif tag in ("td", "th") and tables:
                flows.append(_Flow())
                flows[-1].indent = flow.indent
                flows[-1].span = (_span(attributes, "colspan", 1000), _span(attributes, "rowspan", 65534))
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag == "select":
                flows.append(_Flow())
                selects.append({"all": "multiple" in attributes or _span(attributes, "size", 999) > 1, "options": []})
            elif tag == "option" and selects:
                flows.append(_Flow())
                flows[-1].selected = "selected" in attributes
            elif tag == "li":
                flow.apart(False)
                number = lists[-1] if lists else None
                mark = "- " if number is None else f"{number}. "
                if number is not None:
                    lists[-1] += 1
                flows.append(_Flow())
                flows[-1].mark, flows[-1].seen, flows[-1].indent = mark, seen, flow.indent + len(mark)
            elif tag in ("dd", "blockquote"):
                flow.apart(tag in SPACED)
                flows.append(_Flow())
                flows[-1].indent = flow.indent + 2
            elif tag in BLOCK:
                flow.apart(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
                if tag in ("ul", "menu"):
                    lists.append(None)
                elif tag == "ol":
                    start = attributes.get("start", "1")
                    lists.append(int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)
                elif tag == "table":
                    tables.append({"rows": [], "flow": flow})
                elif tag == "pre":
                    pre += 1
        else:
            deep = len(state) > DEPTH
            gone, _ = state.pop()
            if hidden:
                hidden -= gone
                continue
            if deep:
                continue
            flow = flows[-1]
            if tag in ("td", "th") and tables:
                cell = flows.pop()
                cell.end_line()
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                tables[-1]["rows"][-1].append((cell.lines, *cell.span))
            elif tag == "option" and selects:
                option = flows.pop()
                option.end_line()
                selects[-1]["options"].append((option.selected, option.lines))
            elif tag == "select" and selects:
                flows.pop()
                box = selects.pop()
                shown = box["options"] if box["all"] else ([o for o in box["options"] if o[0]][-1:] or box["options"][:1])
                flows[-1].text(" ".join(line for _, lines in shown for line in lines), False)
            elif tag == "li":
                item = flows.pop()
                item.end_line()
                lines = item.lines or ([""] if item.seen else [])
                if item.indent <= INDENT:
                    lines = [(item.mark if k == 0 else " " * len(item.mark)) * bool(line or k == 0) + line for k, line in enumerate(lines)]
                elif lines:
                    lines[0] = item.mark + lines[0]
                flows[-1].block(lines)
            elif tag in ("dd", "blockquote"):
                inner = flows.pop()
                inner.end_line()
                flows[-1].block([f"  {line}" if line else line for line in inner.lines] if inner.indent <= INDENT else inner.lines)
                flows[-1].apart(tag in SPACED)
            elif tag in BLOCK and tag != "hr":
                if tag in ("ul", "ol", "menu") and lists:
                    lists.pop()
                elif tag == "table" and tables:
                    flow.end_line()
                    flow.block(_aligned(tables.pop()["rows"]))
                elif tag == "pre":
                    flow.end_line(keep=True)
                    pre -= 1
                flow.apart(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
    flow = flows[0]
    flow.end_line()
    return "\n".join(flow.lines).replace("\u00a0", " ")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_lines) for every row of pages: text is what ``render`` makes of html.

    Null and empty html give an empty text with no lines; repeated rows give repeated results, an empty table an empty
    one; extra columns are ignored.  Every row is judged alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x) for x in batch.column(1).to_pylist()]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=["page_id", "text", "n_lines"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id"), F.col("html")).mapInArrow(run, "page_id long, text string, n_lines long")

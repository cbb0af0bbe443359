"""Layout-aware text of web pages: a tolerant tree builder and a renderer of all that is visible.

The builder supplies implied end tags (paragraphs, list items, table parts, options), closes what an
outer end tag leaves open and reads raw-text elements to their end tag. The renderer leaves out what isn't
shown (scripts, styles, the head, closed details and dialogs, and what style rules for a screen hide), collapses white space outside pre,
separates blocks, marks list items and aligns table cells in columns.

Style: rules of one simple selector, by importance, specificity and order; display:none takes a whole element, visibility is inherited and can be
undone inside. Of media queries those count that fit a screen VIEWPORT pixels wide.
"""

from __future__ import annotations

import html as entities
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .frames import numbered, position

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas annotation annotation-xml area base link meta param source track col colgroup rp".split())
#: Blocks with an empty line around them, and blocks that only start a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu pre blockquote table figure hr fieldset xmp listing".split())
PLAIN = frozenset("html body div section article aside header footer nav main address form details summary dialog li dt dd figcaption center legend search tr option optgroup select".split())
BLOCK = SPACED | PLAIN
LISTS = frozenset({"ul", "ol", "menu"})
P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section summary table ul li dt dd xmp listing".split())
#: Start tag -> the open elements that it ends, and where the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup", "option"}, {"select", "datalist"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}), "th": ({"td", "th", "caption"}, {"table", "tr"}), "tr": ({"tr", "td", "th", "caption"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
SCOPE = frozenset({"td", "th", "caption", "table", "html"})
#: Input types that show no text of their own.
MUTE = frozenset("hidden password checkbox radio file image color range".split())
#: Inside svg only text elements show text, and none below these.
SVG_HIDDEN = frozenset("title desc metadata defs symbol clippath mask marker pattern style script template".split())
#: Browsers flatten deeper elements too, from 512 on. The spec's bounds for cells.
DEPTH, COLSPAN, ROWSPAN = 400, 1000, 65534
VIEWPORT = 1280


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


_NONE: dict[str, str] = {}


def _attrs(text: str) -> dict[str, str]:
    if not text or text == "/":
        return _NONE
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(page: str) -> Node:
    """The element tree; text is str, elements are Node. Elements deeper than DEPTH become siblings."""
    root = Node("#root", _NONE)
    stack = [root]
    at, n = 0, len(page)

    def pop_to(k: int) -> None:
        del stack[k:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].kids.append(entities.unescape(page[at:lt]) if "&" in page[at:lt] else page[at:lt])
        if lt == n:
            break
        m = _TAG.match(page, lt)
        if m is None:
            stack[-1].kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is not None:
            tag = m[2].lower()
            if tag in P_ENDERS:
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k].tag
                    if t == "p":
                        pop_to(k)
                        break
                    if t in SCOPE or t == "button":
                        break
            ends = ENDS.get(tag)
            if ends:
                cut = 0
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k].tag
                    if t in ends[1]:
                        break
                    if t in ends[0]:
                        cut = k
                        if tag in ("li", "dt", "dd", "option"):
                            break
                    elif t == "table":
                        break
                if cut:
                    pop_to(cut)
            top = stack[-1].tag
            if tag in ("td", "th") and top in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr", _NONE)
                stack[-1].kids.append(row)
                stack.append(row)
            elif tag not in HIDDEN and tag not in ("html", "body", "head") and top == "head":
                pop_to(len(stack) - 1)
            elif tag == "body":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "head":
                        pop_to(k)
                        break
            node = Node(tag, _attrs(m[3]))
            if tag not in RAW:
                stack[-1].kids.append(node)
                if tag not in VOID and len(stack) < DEPTH:
                    stack.append(node)
                continue
            stack[-1].kids.append(node)
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            raw = page[at:stop]
            node.kids.append(entities.unescape(raw) if tag in ("textarea", "title") else raw)
            if end:
                gt = page.find(">", end.end())
                stop = n if gt < 0 else gt + 1
            at = stop
        elif m[1] is not None:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].kids.append(Node("br", _NONE))
                continue
            if tag in ("html", "body"):
                continue  # what follows still belongs to the body
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k].tag
                if t == tag or (tag[0] == "h" and len(tag) == 2 and tag[1] in "123456" and t[0] == "h" and len(t) == 2 and t[1] in "123456"):
                    pop_to(k)
                    break
                if t in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption"):
                    break
                if t == "table" and tag != "table":
                    break
    return root


_SHOWS = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_SIMPLE = re.compile(r"^(\*|[a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?$")
_WIDTH = re.compile(r"\(\s*(min|max)-(?:device-)?width\s*:\s*(\d+(?:\.\d+)?)\s*(px|em|rem)?\s*\)")
#: selector -> [(property, hides, weight)]
Rules = dict[tuple[str, str, str], list[tuple[str, bool, tuple[bool, int, int]]]]


def on_screen(query: str) -> bool:
    """Whether a list of media queries fits a screen of VIEWPORT pixels; features other than its width don't."""
    for q in query.lower().split(","):
        words = q.split()
        if not words:
            return not query.strip()
        inverse = words[0] == "not"
        ok = True
        for part in re.split(r"\band\b", q):
            part = re.sub(r"^\s*(?:not|only)\b", "", part).strip()
            if m := _WIDTH.fullmatch(part):
                px = float(m[2]) * (16 if m[3] in ("em", "rem") else 1)
                ok &= px <= VIEWPORT if m[1] == "min" else px >= VIEWPORT
            else:
                ok &= part in ("screen", "all")
        if ok != inverse:
            return True
    return False


def css_rules(text: str, depth: int = 0) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) that hold on a screen, in order."""
    if depth == 0:
        text = re.sub(r"/\*.*?(?:\*/|\Z)", "", text, flags=re.S)
    at, start, open_at, level = 0, 0, 0, 0
    for m in re.finditer(r"[{};]", text):
        c, at = m[0], m.start()
        if c == "{":
            if level == 0:
                open_at = at
            level += 1
        elif c == "}" and level:
            level -= 1
            if level == 0:
                head, body = text[start:open_at].strip(), text[open_at + 1 : at]
                start = at + 1
                if not head.startswith("@"):
                    yield head, body
                    continue
                name, _, rest = head[1:].partition(" ") if " " in head else (head[1:].partition("(")[0], "", head[head.find("(") :] if "(" in head else "")
                if depth < 20 and (name.lower() in ("supports", "layer", "container") or (name.lower() == "media" and on_screen(rest))):
                    yield from css_rules(body, depth + 1)
        elif level == 0:
            start = at + 1
    if level == 1 and not text[start:open_at].strip().startswith("@"):  # the last rule isn't closed
        yield text[start:open_at].strip(), text[open_at + 1 :]


def declared(text: str) -> Iterator[tuple[str, bool, bool]]:
    """(property, hides, important) of the declarations of display and visibility."""
    for m in _SHOWS.finditer(text):
        prop, value = m[1].lower(), m[2].lower()
        if value not in ("inherit", "initial", "unset", "revert") or prop == "display":
            yield prop, value == "none" if prop == "display" else value in ("hidden", "collapse"), bool(m[3])


def style_rules(root: Node) -> Rules:
    """What the page's style elements say of tag, *, .class, #id, tag.class and tag#id."""
    out: Rules = {}
    sheets, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            if on_screen(node.attrs.get("media", "")):
                sheets.append("".join(x for x in node.kids if isinstance(x, str)))
            continue
        todo += [kid for kid in reversed(node.kids) if isinstance(kid, Node)]
    order = 0
    for sheet in sheets:
        for selectors, body in css_rules(sheet):
            found = list(declared(body))
            for sel in selectors.split(",") if found else ():
                if (m := _SIMPLE.match(sel.strip())) and sel.strip():
                    tag = "" if m[1] in (None, "*") else m[1].lower()
                    weight = {"": 0, ".": 10, "#": 100}[m[2] or ""] + bool(tag)
                    for prop, hides, important in found:
                        order += 1
                        out.setdefault((tag, m[2] or "", m[3] or ""), []).append((prop, hides, (important, weight, order)))
    return out


class Renderer:
    def __init__(self, rules: Rules, hide: bool = False):
        self.rules = rules
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = 0  # empty lines due before the next text
        self.indent = ""
        self.mark = ""  # list mark due before the next text
        self.depth = 0  # lists around
        self.hide = hide  # visibility here
        self.inner = hide  # visibility in the element that shown() has seen last

    def shown(self, node: Node) -> bool:
        """False if the element takes no place; else inner has its visibility."""
        tag, a = node.tag, node.attrs
        self.inner = self.hide
        if tag in HIDDEN or (tag == "dialog" and "open" not in a) or (tag == "input" and a.get("type", "").lower() == "hidden"):
            return False
        gone = "hidden" in a
        if not self.rules and "style" not in a:
            return not gone
        best: dict[str, tuple[tuple[bool, int, int], bool]] = {}
        if self.rules:
            keys = [("", "", ""), (tag, "", "")]
            if a:
                names = [(".", c) for c in a.get("class", "").split()] + ([("#", a["id"])] if "id" in a else [])
                keys += [(t, *x) for x in names for t in ("", tag)]
            for key in keys:
                for prop, hides, weight in self.rules.get(key, ()):
                    if prop not in best or weight > best[prop][0]:
                        best[prop] = weight, hides
        if "style" in a:
            for k, (prop, hides, important) in enumerate(declared(a["style"])):
                weight = (important, 1000, k)
                if prop not in best or weight > best[prop][0]:
                    best[prop] = weight, hides
        if best.get("display", (None, gone))[1]:
            return False
        if "visibility" in best:
            self.inner = best["visibility"][1]
        return True

    def end_line(self) -> None:
        if self.parts:
            line = "".join(self.parts).strip(" ")
            self.parts = []
            if line:
                self.put(line)

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = 0
        self.lines.append(f"{self.indent}{self.mark}{line}" if line else "")
        if self.mark:
            self.indent += " " * len(self.mark)
            self.mark = ""

    def text(self, s: str) -> None:
        if self.hide:
            return
        if s.isspace() or not s:
            if s and self.parts and not self.parts[-1].endswith(" "):
                self.parts.append(" ")
            return
        if "\n" in s or "  " in s or "\t" in s or "\r" in s or "\f" in s:
            s = _SPACE.sub(" ", s)
        if s[0] == " " and (not self.parts or self.parts[-1].endswith(" ")):
            s = s[1:]
        self.parts.append(s)

    def kids(self, node: Node, pre: bool) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                if pre:
                    if self.hide:
                        continue
                    head, *rest = kid.split("\n")
                    self.parts.append(head)
                    for x in rest:
                        self.end_pre()
                        self.parts.append(x)
                else:
                    self.text(kid)
            else:
                self.element(kid, pre)

    def end_pre(self) -> None:
        self.put("".join(self.parts).rstrip())
        self.parts = []

    def svg(self, node: Node) -> None:
        for kid in node.kids:
            if isinstance(kid, Node) and kid.tag not in SVG_HIDDEN and self.shown(kid):
                old, self.hide = self.hide, self.inner
                if kid.tag in ("text", "foreignobject"):
                    self.text(" ")
                    self.kids(kid, False)
                    self.text(" ")
                else:
                    self.svg(kid)
                self.hide = old

    def element(self, node: Node, pre: bool = False) -> None:
        if self.shown(node):
            old, self.hide = self.hide, self.inner
            self.visible(node, pre)
            self.hide = old

    def visible(self, node: Node, pre: bool) -> None:
        tag = node.tag
        if tag == "br":
            if pre or self.parts:
                self.end_pre() if pre else self.end_line()
            return
        if tag == "q":
            self.parts += [] if self.hide else ['"']
            self.kids(node, pre)
            self.parts += [] if self.hide else ['"']
            return
        if tag == "svg":
            self.svg(node)
            return
        if tag == "input":
            if node.attrs.get("type", "text").lower() not in MUTE and node.attrs.get("value"):
                self.text(f" {node.attrs['value']} ")
            return
        if tag not in BLOCK:
            if tag in ("td", "th", "caption", "button", "tbody", "thead", "tfoot"):
                self.text(" ")
            self.kids(node, pre or tag in ("textarea",))
            return
        self.end_line()
        spaced = tag in SPACED and not (self.depth and tag in LISTS)
        if spaced:
            self.blank = 1
        if tag == "table":
            self.table(node)
        elif tag in LISTS:
            self.depth += 1
            self.items(node)
            self.depth -= 1
        elif tag == "li":
            self.item(node, "- ")
        elif tag == "details" and "open" not in node.attrs:
            for kid in node.kids:
                if isinstance(kid, Node) and kid.tag == "summary":
                    self.element(kid)
                    break
        elif tag in ("blockquote", "dd"):
            old, self.indent = self.indent, self.indent + "  "
            self.kids(node, pre)
            self.end_line()
            self.indent = old
        elif tag in ("pre", "xmp", "listing"):
            if node.kids and isinstance(node.kids[0], str) and node.kids[0].startswith("\n"):
                node.kids[0] = node.kids[0][1:]
            self.kids(node, True)
            if self.parts:
                self.end_pre()
        else:
            self.kids(node, pre)
        self.end_line()
        if spaced:
            self.blank = 1

    def item(self, node: Node, mark: str) -> None:
        old = self.indent
        self.mark, had = mark, len(self.lines)
        self.kids(node, False)
        self.end_line()
        self.mark = ""
        self.indent = old
        if len(self.lines) > had:
            self.blank = 0

    def items(self, node: Node) -> None:
        whole = lambda x: int(x) if re.fullmatch(r"\s*[-+]?\d{1,9}\s*", x) and x.isascii() else None
        step = -1 if "reversed" in node.attrs and node.tag == "ol" else 1
        number = whole(node.attrs.get("start", ""))
        if number is None:
            number = 1 if step > 0 else sum(isinstance(k, Node) and k.tag == "li" and self.shown(k) for k in node.kids)
        outer, self.mark = self.mark, ""
        if outer:  # a list that begins its item takes the item's place
            self.indent += " " * len(outer)
        for kid in node.kids:
            if isinstance(kid, Node) and kid.tag == "li":
                if self.shown(kid):
                    old, self.hide = self.hide, self.inner
                    self.end_line()
                    if (given := whole(kid.attrs.get("value", ""))) is not None:
                        number = given
                    self.item(kid, f"{number}. " if node.tag == "ol" else "- ")
                    number += step
                    self.hide = old
            elif isinstance(kid, str):
                self.text(kid)
            else:
                self.element(kid)
        self.end_line()

    def rows(self, node: Node) -> Iterator[tuple[Node, bool]]:
        """Rows and their visibility."""
        for kid in node.kids:
            if isinstance(kid, Node):
                if kid.tag == "tr":
                    if self.shown(kid):
                        yield kid, self.inner
                elif kid.tag in ("thead", "tbody", "tfoot"):
                    if self.shown(kid):
                        old, self.hide = self.hide, self.inner
                        yield from self.rows(kid)
                        self.hide = old
                else:
                    self.element(kid)  # captions, and what doesn't belong in a table, come before it
            elif not kid.isspace():
                self.text(kid)

    def table(self, node: Node) -> None:
        grid: list[dict[int, list[str]]] = []  # column -> lines of the cell that begins there
        down: dict[int, int] = {}  # column -> rows that a cell above still covers
        rows = list(self.rows(node))
        self.end_line()
        for tr, hide in rows:
            row: dict[int, list[str]] = {}
            covered, at = {c for c in down if down[c] > 0}, 0
            down = {c: down[c] - 1 for c in covered}
            for cell in tr.kids:
                if isinstance(cell, str):
                    if cell.isspace() or not cell:
                        continue
                    cell = _wrap(cell)
                old, self.hide = self.hide, hide
                there, inside = self.shown(cell), self.inner
                self.hide = old
                if not there:
                    continue
                if cell.tag not in ("td", "th"):
                    cell = _wrap(cell)
                while at in covered:
                    at += 1
                inner = Renderer(self.rules, inside)
                inner.kids(cell, False)
                inner.end_line()
                wide, tall = (min(int(x), most) if (x := cell.attrs.get(k, "1")).isascii() and x.isdigit() and len(x) < 10 and int(x) else 1 for k, most in (("colspan", COLSPAN), ("rowspan", ROWSPAN)))
                row[at] = inner.lines
                if tall > 1:
                    down |= dict.fromkeys(range(at, at + wide), tall - 1)
                at += wide
            if any(row.values()) or any(c in covered for g in grid[-1:] for c in g):
                grid.append(row)
        columns = sorted({c for row in grid for c in row})
        if len(columns) < 2:
            for row in grid:
                for lines in row.values():
                    for line in lines:
                        self.put(line)
            return
        widths = {c: max((width(x) for row in grid for x in row.get(c, ())), default=0) for c in columns}
        for row in grid:
            for k in range(max(map(len, row.values()), default=0)):
                cells = [lines[k] if k < len(lines := row.get(c, ())) else "" for c in columns]
                last = max((j for j, x in enumerate(cells) if x), default=-1)
                self.put(" | ".join([*(x + " " * (widths[c] - width(x)) for x, c in zip(cells[:last], columns[:last], strict=True)), cells[last]]) if last >= 0 else " ")


def _wrap(kid: str | Node) -> Node:
    node = Node("td", _NONE)
    node.kids.append(kid)
    return node


def width(s: str) -> int:
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def render(page: str) -> str:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))
    root = parse(page)
    r = Renderer(style_rules(root))
    r.kids(root, False)
    r.end_line()
    return "\n".join(r.lines)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if x is None else render(x.as_py()) if x.is_valid else None for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], batch.schema.names)


def extract_text(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """df with html_col replaced by text_col, the visible text; no shuffle, one pass.

    A null page gives null, an empty one or one without visible text gives ''. Broken markup never fails, and pages of any length are read whole. Repeated
    rows give repeated rows; other columns are carried, whatever their names and types, and one that is named as text_col, in any case, is replaced. An empty
    table gives an empty result.
    """
    at = position(df, html_col)
    rest = [i for i, c in enumerate(df.columns) if i != at and c.lower() != text_col.lower()]
    plain = numbered(df).select(*[f"c{i}" for i in rest], F.col(f"c{at}").cast("string").alias("_html"))
    out = plain.mapInArrow(_run, StructType([*plain.schema.fields[:-1], StructField("_html", StringType())]))
    return out.toDF(*[df.columns[i] for i in rest], text_col)

"""Layout-aware text of HTML pages: a tree with implied tags, visibility, block spacing, lists and aligned tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from unicodedata import east_asian_width

from pyspark.sql import DataFrame, functions as F

from loamgrid.llm.base import per_document

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never shown, with all that is in them.
HIDDEN = frozenset(
    "head script style template noscript title iframe object audio video canvas datalist colgroup "
    "desc metadata defs symbol clippath mask annotation annotation-xml".split()
)
#: What a head may hold; anything else, and text, ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Set off by a blank line, and by a line break.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset form details".split())
BROKEN = frozenset(
    "html body div section article header footer main nav aside address li dt dd tr caption figcaption legend option optgroup select summary".split()
)
BLOCKS = SPACED | BROKEN | {"text", "foreignobject"}
#: Opening one of the values closes an open key that no barrier hides.
CLOSED_BY = {
    "p": SPACED | BROKEN - {"option", "optgroup", "tr"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option", "optgroup"},
    "optgroup": {"optgroup"},
    "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "tr": {"tr", "tbody", "thead", "tfoot"},
    "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
    "caption": {"tr", "tbody", "thead", "td", "th", "tfoot"},
    "head": {"body"},
}
BARRIERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}}
CELLS = frozenset("td th tr thead tbody tfoot caption".split())
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Whole property names; ``content-visibility: hidden`` hides, ``backface-visibility`` does not.
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)(?![\w-])", re.I)
COMMENT = re.compile(r"/\*.*?\*/", re.S)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """A forgiving tree: end tags may be missing, stray ones are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}  # places in ``open`` by tag

    def _last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _close(self, tags, barriers) -> None:
        """Close the innermost of ``tags`` and all in it, unless a barrier is further in."""
        i = self._last(tags)
        if i and i > self._last(barriers):
            while len(self.open) > i:
                self.at[self.open.pop().tag].pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open[-1].tag == "head" and tag not in HEAD:
            self._close({"head"}, ())
        for closed, by in CLOSED_BY.items():
            if tag in by:
                barrier = BARRIERS.get(closed, {"table"} if closed in CELLS else {"table", "td", "th", "button"})
                self._close({closed}, barrier)
        if tag in ("td", "th") and self._last(("table",)) >= self._last(("tr",)):
            self._push("tr", {})
        self._push(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self.at[self.open.pop().tag].pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """``<x/>`` has no content in drawings and formulas; elsewhere the slash means nothing."""
        drawn = self.at.get("svg") or self.at.get("math")
        self.handle_starttag(tag, attrs)
        if drawn and self.open[-1].tag == tag and tag not in VOID:
            self.at[self.open.pop().tag].pop()

    def _push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        barrier = frozenset() if tag in ("table", "body", "html") else {"table"} if tag in CELLS else {"td", "th"}
        self._close({tag}, barrier)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and SPACE.sub("", data):
            self._close({"head"}, ())
        self.open[-1].children.append(data)


class Writer:
    """Lines of text; white space is collapsed, and blocks ask for line breaks that come before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.wanted = 0
        self.prefix = ""
        self.mark = ""

    def block(self, blank: bool) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.wanted = max(self.wanted, 1 + blank)

    def text(self, data: str) -> None:
        words = SPACE.sub(" ", data)
        if not words.strip(" "):
            self.space = self.space or bool(words and self.line)
            return
        lead = words[0] == " " or self.space
        self._begin()
        if lead and self.line and self.line[-1][-1:] not in (" ", ""):
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def _begin(self) -> None:
        if self.line:
            return
        if self.wanted > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.wanted = 0
        lead = self.prefix
        if self.mark:
            lead = lead[: len(lead) - len(self.mark)] + self.mark
            self.mark = ""
        if lead:
            self.line.append(lead)

    def raw(self, data: str) -> None:
        """Preformatted text."""
        for i, part in enumerate(data.split("\n")):
            if i:
                self._begin()
                self.lines.append("".join(self.line).rstrip())
                self.line = []
            if part:
                self._begin()
                self.line.append(part)

    def newline(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif self.lines and not self.wanted and self.lines[-1]:
            self.lines.append("")
        self.space = False

    def result(self) -> str:
        self.block(False)
        return "\n".join(self.lines).strip("\n")


def _width(text: str) -> int:
    return sum(2 if east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


def aligned(rows: list[list[str]]) -> list[str]:
    """Table rows as lines: columns padded to their widest cell, cells of several lines side by side."""
    widths: list[int] = []
    split = [[c.split("\n") for c in row] for row in rows]
    for row in split:
        widths += [0] * (len(row) - len(widths))
        for k, cell in enumerate(row):
            widths[k] = max(widths[k], *map(_width, cell))
    out = []
    for row in split:
        for i in range(max(map(len, row), default=0)):
            parts = [cell[i] if i < len(cell) else "" for cell in row]
            out.append(" | ".join(p + " " * (widths[k] - _width(p)) for k, p in enumerate(parts)).rstrip())
    return out


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or node.tag == "input":
        return False
    return not ("style" in a and UNSEEN.search(COMMENT.sub("", a["style"])))


def render(root: Node) -> str:
    """The visible text under ``root``; walks with a stack, so nesting may be of any depth."""
    writers, tables, lists = [Writer()], [], []
    pre = 0
    stack: list[tuple] = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        out = writers[-1]
        if isinstance(node, str):
            out.raw(node) if pre else out.text(node)
            continue
        tag = node.tag
        if not leaving:
            if not visible(node):
                continue
            if tag == "br":
                out.newline()
                continue
            if tag == "wbr" or (tag in VOID and tag != "hr"):
                continue
            if tag in BLOCKS and tag not in ("tr",):
                out.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag == "hr":
                continue
            if tag in ("ul", "ol"):
                start = node.attrs.get("start", "")
                lists.append([tag == "ol", int(start) if start.lstrip("-").isdecimal() and len(start) < 10 else 1])
            elif tag == "li":
                ordered, n = lists[-1] if lists else (False, 1)
                mark = f"{n}. " if ordered else "- "
                if lists:
                    lists[-1][1] += 1
                out.prefix, out.mark = out.prefix + " " * len(mark), mark
                node.attrs["#indent"] = len(mark)
            elif tag == "dd":
                out.prefix += "  "
            elif tag == "blockquote":
                out.prefix += "> "
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                writers.append(Writer())
            elif tag == "details" and "open" not in node.attrs:
                node.children = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
            continue
        if tag in ("ul", "ol"):
            lists.pop()
        elif tag == "li":
            out.prefix, out.mark = out.prefix[: len(out.prefix) - node.attrs["#indent"]], ""
        elif tag in ("dd", "blockquote"):
            out.prefix = out.prefix[:-2]
        elif tag == "pre":
            pre -= 1
        elif tag in ("td", "th") and tables:
            cell = writers.pop().result()
            wide = node.attrs.get("colspan", "1")
            tables[-1][-1] += [cell] + [""] * (min(int(wide), 1000) - 1 if wide.isdecimal() and len(wide) < 5 else 0)
        elif tag == "table":
            for line in aligned([r for r in tables.pop() if any(r)]):
                out.block(False)
                out.raw(line)
            out.block(True)
        out = writers[-1]
        if tag in BLOCKS and tag != "tr":
            out.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
    return writers[0].result()


def visible_text(html: str) -> str:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return render(builder.root)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``page_id, text, n_lines, n_chars``: the visible text of each page.

    Null and empty pages give empty texts, unclosed and stray tags are repaired, nesting may be of any depth, repeated
    rows each get a row.  No shuffle.
    """

    def row(page: str) -> tuple:
        text = visible_text(page)
        return text, text.count("\n") + 1 if text else 0, len(text)

    df = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return per_document(df, row, "text string, n_lines long, n_chars long", text="html")

"""A tolerant HTML reader: trees of elements and texts, enough for extraction."""

from __future__ import annotations

import html
import re
import sys

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What an element that opens closes before it, up to a boundary.
CLOSES = {"li": ("li", frozenset(("ul", "ol", "menu"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))), "option": ("option", frozenset(("select",)))}
#: Levels of a tree, far beyond those of browsers (512); see parse.
MAX_DEPTH = 3000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Trees are walked by functions that call themselves, a few calls a level.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * MAX_DEPTH))


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def attribute(self, *names: str) -> str:
        """The values of attributes, in lower case, joined by spaces."""
        if not self.attributes:
            return ""
        found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(self.attributes)}
        return " ".join(found.get(n, "") for n in names).strip().lower()


def parse(page: str) -> Element:
    """The tree of a page. Unclosed, misnested and cut off elements end where a browser would about end them; an element deeper than MAX_DEPTH becomes a child of the one at that depth, as browsers do, with its own text in it. A slash before the end of a tag closes drawings and formulas only."""
    root = Element("#root")
    stack, at = [root], 0
    # A mark that the page is cut inside: the rest from there on is no text.
    while True:
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            text = page[at:end]
            if not m and (cut := re.search(r"<(?:/?[a-zA-Z!?])", text)):
                text = text[: cut.start()]
            if text:
                stack[-1].children.append(html.unescape(text))
        if not m:
            return root
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag does not end blocks around it
            continue
        if tag in BLOCK and tag != "html" and tag != "body":
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph and what is open in it
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in CLOSES:
            names, bound = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bound:
                    break
                if stack[k].tag in names.split():
                    del stack[k:]
                    break
        element = Element(tag, m[3].strip(" \t\r\n\f/"))
        (stack[-1] if len(stack) < MAX_DEPTH else stack[MAX_DEPTH - 1]).children.append(element)
        if tag in RAW:
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID:
            stack.append(element)

"""A small, fast HTML tree builder for text work: implied end tags, void and raw-text elements.

It follows the parts of the public HTML parsing rules that decide which text belongs to which
element: ``p`` ends at a block, ``li``, ``dt``, ``dd``, ``tr``, ``td``, ``option`` end at their
next sibling, headings end at a heading, raw text ends only at its own end tag, and input that is
cut off keeps what came before.  It is linear in the length of the input.
"""

from __future__ import annotations

import re
from html import unescape

TOKEN = re.compile(
    r"<(?:"
    r"!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)"
    r"|!\[CDATA\[(?:.*?)(?:\]\]>|\Z)"
    r"|[!?/][^>]*+(?:>|\Z)"
    r")",
    re.S,
)
_CUT = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset(("title", "textarea"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
BLOCK = ENDS_P | frozenset("body html head li dd dt tr td th caption thead tbody tfoot colgroup option title".split())
#: start tag -> open elements it ends, and the elements that stop the search
_SIBLINGS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table", "td"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td"))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "tr", "caption")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "tr", "caption")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "tr", "caption")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
}
_SCOPE = frozenset(("table", "td", "th", "caption", "html", "button", "object", "template"))


class Node:
    """An element; ``kids`` holds text (entities resolved) and elements in order."""

    __slots__ = ("tag", "raw", "kids", "parent", "at", "_attrs")

    def __init__(self, tag: str, raw: str, parent: "Node | None", at: int) -> None:
        self.tag, self.raw, self.parent, self.at = tag, raw, parent, at
        self.kids: list = []
        self._attrs: dict[str, str] | None = None

    @property
    def attrs(self) -> dict[str, str]:
        """Attributes, names in lower case; the first of a name holds."""
        if self._attrs is None:
            found: dict[str, str] = {}
            if self.raw:
                for m in ATTRIBUTE.finditer(self.raw):
                    value = m.group(2) or m.group(3) or m.group(4) or ""
                    found.setdefault(m.group(1).lower(), unescape(value) if "&" in value else value)
            self._attrs = found
        return self._attrs

    def text(self) -> str:
        """Text of the element and all below it, without separators."""
        parts: list[str] = []
        stack = [self]
        while stack:
            node = stack.pop()
            if node.__class__ is str:
                parts.append(node)
            else:
                stack.extend(reversed(node.kids))
        return "".join(parts)

    def walk(self):
        """All elements below, in document order."""
        stack = [k for k in reversed(self.kids) if k.__class__ is Node]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(k for k in reversed(node.kids) if k.__class__ is Node)


def parse(html: str) -> Node:
    """The tree of ``html`` under a root element without a tag."""
    if "\r" in html:
        html = html.replace("\r\n", "\n").replace("\r", "\n")
    root = Node("", "", None, 0)
    top = root
    open_tags = [""]  # tags of the open elements, to see quickly whether one is open
    at, size = 0, len(html)
    search = TOKEN.search
    while at < size:
        m = search(html, at)
        if m is None:
            rest = html[at:]
            cut = _CUT.search(rest)
            if cut:
                rest = rest[: cut.start()]
            if rest:
                top.kids.append(unescape(rest) if "&" in rest else rest)
            break
        start = m.start()
        if start > at:
            piece = html[at:start]
            top.kids.append(unescape(piece) if "&" in piece else piece)
        at = m.end()
        closing, tag, raw = m.groups()
        if tag is None:
            if html.startswith("<![CDATA[", start):
                top.kids.append(html[start + 9 : at].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if closing:
            if tag in open_tags:
                node = top
                stop = tag not in BLOCK
                while node is not None and node.tag != tag:
                    if (stop and node.tag in BLOCK) or (node.tag in _SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "td", "th")):
                        node = None
                        break
                    node = node.parent
                if node is None and tag in HEADINGS:
                    node = next((n for n in _up(top) if n.tag in HEADINGS), None)
                if node is not None and node.parent is not None:
                    while top is not node:
                        top = top.parent
                        open_tags.pop()
                    top = top.parent
                    open_tags.pop()
            elif tag in HEADINGS and top.tag in HEADINGS:
                top = top.parent
                open_tags.pop()
            continue
        raw = raw[:-1]
        if tag in ENDS_P and "p" in open_tags:
            top = _close(top, open_tags, "p", _SCOPE)
        if tag in HEADINGS and top.tag in HEADINGS:
            top = top.parent
            open_tags.pop()
        rule = _SIBLINGS.get(tag)
        if rule is not None:
            ends, stops = rule
            node = top
            last = None
            while node is not None and node.tag not in stops:
                if node.tag in ends:
                    last = node
                    if tag == "li" or tag == "dt" or tag == "dd" or tag == "option":
                        break
                node = node.parent
            if last is not None:
                while top is not last:
                    top = top.parent
                    open_tags.pop()
                top = top.parent
                open_tags.pop()
        if tag == "body" or tag == "html" or tag == "head":
            if tag in open_tags:
                continue
            if tag == "body" and "head" in open_tags:
                while top.tag != "head":
                    top = top.parent
                    open_tags.pop()
                top = top.parent
                open_tags.pop()
        node = Node(tag, raw, top, start)
        top.kids.append(node)
        if tag in VOID or raw.endswith("/") and tag not in BLOCK and tag not in RAW and tag not in RCDATA:
            continue
        if tag in RAW or tag in RCDATA:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            piece = html[at : end.start()] if end else html[at:]
            if piece:
                node.kids.append(unescape(piece) if tag in RCDATA and "&" in piece else piece)
            at = end.end() if end else size
            continue
        top = node
        open_tags.append(tag)
    return root


def _up(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def _close(top: Node, open_tags: list[str], tag: str, stops: frozenset) -> Node:
    node: Node | None = top
    while node is not None and node.tag != tag:
        if node.tag in stops:
            return top
        node = node.parent
    if node is None:
        return top
    while top is not node:
        top = top.parent
        open_tags.pop()
    open_tags.pop()
    return top.parent


def find_all(root: Node, *tags: str) -> list[Node]:
    """Elements with one of the tags, in document order."""
    return [n for n in root.walk() if n.tag in tags]


def find_first(root: Node, tag: str) -> Node | None:
    return next((n for n in root.walk() if n.tag == tag), None)

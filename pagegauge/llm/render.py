"""Layout-aware rendering of HTML: visible text as blocks, and the main body of a page.

``blocks`` walks the tree once and emits runs of text that no block-level tag and no double line
break interrupts.  Hidden elements, scripts, styles and comments emit nothing; formulas in scripts
do.  ``main_body`` chooses the element that holds the page's own content: it drops landmark
elements (navigation, sidebars, forms, footers), containers named as such, and containers that are
mostly links, then descends while a level has only containers.  All work is linear in the page.
"""

from __future__ import annotations

import re

from pagegauge.functions.htmltree import BLOCK, HEADINGS, Node, parse

_INVISIBLE = frozenset(
    "script style template noscript head title iframe object embed select option datalist textarea svg "
    "canvas audio video noframes noembed xmp button input ref".split()
)
_LANDMARK = frozenset("nav footer aside form dialog menu".split())
_CONTAINER = frozenset("div section main article center table tbody tr td th body html font header details fieldset".split())
_CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure hgroup b strong i em a code span img math script br q cite u".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:menu|nav|navbar|navigation|navi|breadcrumbs?|crumbs|sidebar|related|teasers?|promo|consent|"
    r"cookies?|cc|banner|footer|legal|imprint|share|social|newsletter|subscribe|popular|recommended|recommendations|"
    r"ads?|advert|advertisement|sponsor|sponsored|login|toolbar|notice|popup|modal|overlay|gdpr|copyright)(?=$|[\s_-])",
    re.I,
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_FIXED = re.compile(r"position\s*:\s*fixed", re.I)
_MATH_TYPE = re.compile(r"^\s*math/tex", re.I)
_WHOLE = re.compile(r"<body[\s>]", re.I)
BR = "\x01"
_TWO_BREAKS = re.compile(r"\x01[\s\x01]*\x01")
_SPACE = re.compile(r"\s+")
_TABLE_SKIP = frozenset(("div", "p", "ul", "ol", "pre", "blockquote", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "br"))


def collapse(text: str) -> str:
    """Each run of white space as one blank, ends trimmed."""
    return " ".join(text.split())


def is_whole_page(html: str) -> bool:
    return _WHOLE.search(html) is not None


def _hidden(node: Node) -> bool:
    raw = node.raw
    if not raw or ("hid" not in raw and "none" not in raw and "HID" not in raw):
        return False
    a = node.attrs
    return "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", "")))


class _Seen:
    """Per element: characters of visible text, those in links, links, whether it is left out."""

    __slots__ = ("chars", "linked", "links", "cut", "blocks", "h1")

    def __init__(self) -> None:
        self.chars = self.linked = self.links = self.blocks = 0
        self.cut = self.h1 = False


def _opened(node: Node, seen: dict[int, _Seen]) -> _Seen:
    s = _Seen()
    seen[id(node)] = s
    tag = node.tag
    if tag in _INVISIBLE or _hidden(node):
        s.cut = True
        return s
    if node.raw and tag in BLOCK and tag not in HEADINGS and tag not in ("p", "li", "pre", "body", "main", "article", "html", "blockquote"):
        a = node.attrs
        names = f"{a.get('class', '')} {a.get('id', '')}"
        if (len(names) > 1 and _NAMED.search(names)) or a.get("role", "").lower() in _ROLES or _FIXED.search(a.get("style", "")):
            s.cut = True
    if tag in _LANDMARK:
        s.cut = True
    return s


def _closed(node: Node, s: _Seen) -> None:
    tag = node.tag
    if tag == "a" and s.chars:
        s.links += 1
    if tag == "h1":
        s.h1 = True
    if tag == "header" and not s.h1:
        s.cut = True
    elif s.links and tag in ("div", "section", "td", "header") and s.linked >= 0.6 * s.chars and (s.links > 1 or s.blocks):
        s.cut = True
    elif s.links > 2 and tag in ("div", "td") and not s.blocks and s.linked >= 0.5 * s.chars:
        s.cut = True


def _measure(root: Node, seen: dict[int, _Seen]) -> _Seen:
    # a stack instead of recursion: elements nest as deep as they like
    top = _opened(root, seen)
    if top.cut:
        return top
    # element, its figures, in a link, kids left, first notice for pages without scripts, whether it is one
    stack: list[list] = [[root, top, root.tag == "a", iter(root.kids), None, False]]
    while stack:
        frame = stack[-1]
        node, s, in_link, kids, _, notice = frame
        for kid in kids:
            if kid.__class__ is str:
                n = len(kid) if not kid.isspace() else 0
                s.chars += n
                if in_link:
                    s.linked += n
                continue
            k = _opened(kid, seen)
            if kid.tag == "noscript":
                frame[4] = frame[4] or kid
            if kid.tag in BLOCK:
                s.blocks += 1
            if not k.cut:
                stack.append([kid, k, in_link or kid.tag == "a", iter(kid.kids), None, False])
                break
        else:
            fallback = frame[4]
            if not s.chars and fallback is not None:
                # without scripts the notice is all that this element shows
                fallback.tag = "div"
                frame[4] = None
                k = _opened(fallback, seen)
                s.linked = s.links = 0
                s.h1 = False
                if not k.cut:
                    stack.append([fallback, k, in_link, iter(fallback.kids), None, True])
                    continue
            stack.pop()
            _closed(node, s)
            if stack and (notice or not s.cut):
                up = stack[-1][1]
                up.chars += s.chars
                up.linked += s.linked
                up.links += s.links
                up.h1 = up.h1 or s.h1
    return top


def _find_main(node: Node, seen: dict[int, _Seen]) -> Node | None:
    for n in node.walk():
        s = seen.get(id(n))
        if s is not None and not s.cut and s.chars and (n.tag == "main" or n.raw and n.attrs.get("role") == "main"):
            return n
    return None


def main_body(root: Node) -> tuple[Node | None, dict[int, _Seen]]:
    """The element with the page's own content, and what was measured (``cut`` elements are left out)."""
    seen: dict[int, _Seen] = {}
    top = _measure(root, seen)
    if not top.chars:
        return None, seen
    node = _find_main(root, seen) or root
    while True:
        kids, direct = [], False
        for kid in node.kids:
            if kid.__class__ is str:
                if not kid.isspace():
                    direct = True
                continue
            s = seen.get(id(kid))
            if s is None or s.cut or not s.chars:
                continue
            if kid.tag in _CONTAINER and not (kid.tag == "table" and is_data_table(kid)):
                kids.append((kid, s))
            elif kid.tag in _CONTENT or kid.tag == "table":
                direct = True
            else:
                kids.append((kid, s))
        if direct or not kids:
            return node, seen
        if len(kids) > 1:
            if node.tag not in ("body", "html", "", "tr"):
                names = {k.attrs.get("class", "") for k, _ in kids}
                if len(names) == 1 and "" not in names:
                    return node, seen
            if any("width" in k.attrs for k, _ in kids) and node.tag == "tr":
                kids = [x for x in kids if "width" not in x[0].attrs] or kids
            kids = [x for x in kids if x[1].h1] or kids
        node = kids[0][0]


def is_data_table(table: Node) -> bool:
    """Whether the cells of a table hold values, and no blocks of a layout."""
    cells = 0
    for n in table.walk():
        if n.tag in ("td", "th"):
            cells += 1
            for kid in n.kids:
                if kid.__class__ is Node and kid.tag in _TABLE_SKIP:
                    return False
    return cells > 0


class Block:
    """A run of text: ``kind`` is heading, paragraph, list_item, quote, code, formula or cell."""

    __slots__ = ("kind", "text", "item", "level")

    def __init__(self, kind: str, text: str, item: int = 0, level: int = 0) -> None:
        self.kind, self.text, self.item, self.level = kind, text, item, level


class _Renderer:
    def __init__(self, cut: dict[int, _Seen] | None) -> None:
        self.cut = cut
        self.out: list[Block] = []
        self.run: list[str] = []
        self.items = 0

    def flush(self, kind: str, item: int, level: int) -> None:
        run = self.run
        if not run:
            return
        text = "".join(run)
        run.clear()
        if text.isspace() or not text:
            return
        for part in _TWO_BREAKS.split(text) if BR in text else (text,):
            if part.strip("\x01 \n\t\r\f"):
                self.out.append(Block(kind, part.replace(BR, "\n"), item, level))

    def walk(self, node: Node, kind: str, item: int, level: int) -> None:
        # kids left, what their text is, and what is flushed when they end
        stack: list[tuple] = [(iter(node.kids), kind, item, level, False)]
        while stack:
            kids, kind, item, level, ends = stack[-1]
            for kid in kids:
                if kid.__class__ is str:
                    self.run.append(kid)
                    continue
                tag = kid.tag
                if tag == "br":
                    self.run.append(BR)
                    continue
                if tag == "script":
                    if kid.raw and _MATH_TYPE.search(kid.attrs.get("type", "")):
                        tex = "".join(k for k in kid.kids if k.__class__ is str)
                        if "display" in kid.attrs["type"]:
                            self.flush(kind, item, level)
                            self.out.append(Block("formula", tex, item, level))
                        else:
                            self.run.append(f"\\({tex.strip()}\\)")
                    continue
                if tag == "math":
                    note = next((n for n in kid.walk() if n.tag == "annotation"), kid)
                    self.run.append(f"\\({note.text().strip()}\\)")
                    continue
                if tag in _INVISIBLE:
                    continue
                if self.cut is not None:
                    s = self.cut.get(id(kid))
                    if s is None or s.cut:
                        continue
                elif _hidden(kid):
                    continue
                if tag not in BLOCK:
                    stack.append((iter(kid.kids), kind, item, level, False))
                    break
                self.flush(kind, item, level)
                if tag == "pre" or tag == "syntaxhighlight":
                    self.out.append(Block("code", kid.text(), item, level))
                    continue
                if tag == "table" and is_data_table(kid):
                    self.table(kid, item)
                    continue
                inner = (kind, item, level)
                if tag in HEADINGS:
                    inner = ("heading", item, int(tag[1]))
                elif tag == "li":
                    self.items += 1
                    inner = ("list_item", self.items, level)
                elif tag == "blockquote":
                    inner = ("quote", item, level)
                stack.append((iter(kid.kids), *inner, True))
                break
            else:
                stack.pop()
                if ends:
                    self.flush(kind, item, level)

    def table(self, table: Node, item: int) -> None:
        """Cells of a data table, in aligned columns."""
        rows = [[collapse(c.text()) for c in r.kids if c.__class__ is Node and c.tag in ("td", "th")] for r in table.walk() if r.tag == "tr"]
        rows = [r for r in rows if r]
        widths = [max(len(r[i]) for r in rows if i < len(r)) for i in range(max(map(len, rows)))] if rows else []
        for r in rows:
            self.out.append(Block("cell", "  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip(), item))


def blocks(html: str, main_only: bool) -> list[Block]:
    """Blocks of the visible text; with ``main_only`` a whole page gives only its main body."""
    root = parse(html)
    if main_only and is_whole_page(html):
        node, seen = main_body(root)
        if node is None:
            return []
        renderer = _Renderer(seen)
    else:
        node, renderer = root, _Renderer(None)
    level = int(node.tag[1]) if node.tag in HEADINGS else 0
    renderer.walk(node, "heading" if level else "paragraph", 0, level)
    renderer.flush("heading" if level else "paragraph", 0, level)
    return renderer.out


def render_text(html: str, main_only: bool) -> str:
    """The visible text: blank lines between blocks, marks for list items, aligned table cells."""
    parts: list[str] = []
    last: Block | None = None
    for b in blocks(html, main_only):
        if b.kind == "code":
            text = b.text.strip("\n")
        elif b.kind == "cell":
            text = b.text
        else:
            text = collapse(b.text)
            if b.kind == "list_item" and (last is None or last.item != b.item):
                text = "- " + text
        if parts:
            parts.append("\n" if last is not None and last.kind == b.kind and b.kind in ("list_item", "cell") else "\n\n")
        parts.append(text)
        last = b
    return "".join(parts)

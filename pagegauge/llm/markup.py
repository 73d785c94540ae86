"""HTML, Markdown, wiki and LaTeX markup to clean text that keeps headings, lists, code and formulas.

``elements`` converts one field.  HTML goes through the layout-aware renderer; Markdown, wiki and
LaTeX go through one line-based reader, also where they occur inside HTML, and HTML inside of them
goes through the renderer.  Code and formulas are taken out first, so that nothing in them is read
as markup.

Defined results: NULL and empty fields have no elements; code and formulas that are not closed end
with the field; front matter, comments, preambles, templates, categories, references, scripts and
styles are no text; a list item that runs over lines is one item; equal elements count once.
"""

from __future__ import annotations

import re
from html import unescape

from pagegauge.functions.htmltree import parse
from pagegauge.llm.render import Block, _Renderer, blocks, collapse

_MARK = "\x02"
_FRONT = re.compile(r"\A\ufeff?---[ \t]*\n(?:.*?\n)??(?:---|\.\.\.)[ \t]*(?:\n|\Z)", re.S)
#: code blocks and comments, leftmost first
_CODE = re.compile(
    r"(?P<fence>^(?P<in>[ \t]{0,3}(?:>[ \t]?)*)(?P<f>`{3,}|~{3,})(?P<info>[^\n]*)\n(?P<fbody>.*?)(?:^[ \t>]{0,8}(?P=f)[`~]*[ \t]*$|\Z))"
    r"|(?P<env>\\begin\{(?P<name>lstlisting|verbatim\*?|Verbatim|minted)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?[ \t]*\n?(?P<ebody>.*?)(?:\\end\{(?P=name)\}|\Z))"
    r"|(?P<tag><(?P<t>syntaxhighlight|source|pre)\b[^>]*>(?P<tbody>.*?)(?:</(?P=t)\s*>|\Z))"
    r"|(?P<comment><!--.*?(?:-->|\Z))",
    re.S | re.M | re.I,
)
_FORMULA = re.compile(
    r"(?P<tick>(?P<q>`+)(?!`)(?:(?!\n[ \t]*\n).)+?(?<!`)(?P=q)(?!`))"
    r"|(?P<esc>\\[\\$](?!\())"
    r"|\$\$(?P<dd>(?:(?!\n[ \t]*\n|\$\$).)+)\$\$"
    r"|\\\[(?P<br>(?!sic)(?:(?!\n[ \t]*\n|\\\]).)+)\\\]"
    r"|\\\((?P<pa>(?:(?!\n[ \t]*\n|\\\)).)+)\\\)"
    r"|\\begin\{(?P<e>equation|align|gather|multline|eqnarray|displaymath|math)(?P<star>\*?)\}(?P<eq>.*?)\\end\{(?P=e)(?P=star)\}"
    r"|<math\b[^>]*>(?P<math>.*?)</math>"
    r"|<script\b[^>]*math/tex[^>]*>(?P<script>.*?)</script>"
    r"|(?<![\\$\w])\$(?P<d>(?![\s$])(?:(?!\n[ \t]*\n)[^$\\]|\\.)*?(?:(?!\n[ \t]*\n)[^$\\\s]|\\[^\s]))\$(?![\d$])",
    re.S | re.I,
)
_LATEX = re.compile(r"\\(?:(?:sub)*section\*?|chapter\*?|begin|documentclass|cite\w*)\s*[\[{]")
_LATEX_COMMENT = re.compile(r"(?:^|(?<=\s))%[^\n]*", re.M)
_PREAMBLE = re.compile(r"\A.*?\\begin\{document\}", re.S)
_DOCUMENT_END = re.compile(r"\\end\{document\}.*\Z", re.S)
_WIKI = re.compile(r"^={1,6}[^=\n].*=\s*$|'''|\[\[[^\]\n]+\]\]|^\{\||^\{\{[A-Z]", re.M)
_WIKI_TABLE = re.compile(r"^[ \t:]*\{\|.*?^[ \t]*\|\}[^\n]*$", re.S | re.M)
_TEMPLATE = re.compile(r"\{\{[^{}]*(?:\{\{[^{}]*\}\}[^{}]*)*\}\}")
_ASIDE = re.compile(r"\[\[(?:Category|File|Image|Media|Kategorie|Datei|Bild|Catégorie|Fichier|Categoría|Archivo)\s*:[^\]]*\]\]|(?-i:__[A-Z]{3,}__)", re.I)
_AUTOLINK = re.compile(r"<((?:https?|mailto):[^\s<>]+)>")
_HAS_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\s].*?)[ \t]*\1[ \t]*$")
_LATEX_HEADING = re.compile(r"^\s*\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?\s*(?:\[[^\]]*\])?\{")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^[ \t]*(?:[-+*•]|\d{1,9}[.)])(?:[ \t]+(.*)|)$")
_WIKI_ITEM = re.compile(r"^([*#:;]*[*#])[ \t]*(.*)$")
_LATEX_ITEM = re.compile(r"^\s*\\item\b\s*(?:\[[^\]]*\])?\s*(.*)$")
_LATEX_ENV = re.compile(r"^\s*\\(begin|end)\{([a-zA-Z*]+)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?\s*$")
_QUOTE = re.compile(r"^ {0,3}>[ \t]?(.*)$")
_TABLE_ROW = re.compile(r"^\s*\|.*\|\s*$")
_DEFINITION = re.compile(r"^ {0,3}\[([^\]\n]+)\]:[ \t]*\S+.*$", re.M)
_PLACE = re.compile(r"\x02([CF])(\d+)\x02")
_ESCAPE = re.compile(r"\\([\\`*_{}\[\]()#+\-.!|<>~$&%\"':;/=?@^,])")
_BASE = 0xE000
_RESTORE = re.compile(f"[{chr(_BASE)}-{chr(_BASE + 127)}]")
_STYLED = re.compile(r"\\(?:textbf|textit|emph|texttt|underline|textsc|textsf|textrm|textup|mbox|text|uline|enquote)\s*\{([^{}]*)\}")
_HREF = re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}")
_URL = re.compile(r"\\url\{([^{}]*)\}")
_DROPPED = re.compile(r"~?\\(?:cite\w*|label|ref|eqref|pageref|footnote|index|vspace|hspace)\*?(?:\[[^\]]*\])*\{[^{}]*\}")
_NAMED = re.compile(r"\\(textbackslash|textless|textgreater|textasciitilde|textasciicircum|textbar|ldots|dots|ss|quad|noindent|LaTeX|TeX)\b(?:\{\})?\s?")
_NAMED_TEXT = {"textbackslash": "\\", "textless": "<", "textgreater": ">", "textasciitilde": "~", "textasciicircum": "^", "textbar": "|", "ldots": "…", "dots": "…", "ss": "ß", "quad": " ", "noindent": "", "LaTeX": "LaTeX", "TeX": "TeX"}
_TICKS = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_IMAGE = re.compile(r"!\[([^\]]*)\]\((?:[^()]|\([^()]*\))*\)")
_LINK = re.compile(r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\((?:[^()\n]|\([^()\n]*\))*\)")
_REFERENCE = re.compile(r"\[([^\[\]]+)\][ ]?\[([^\[\]]*)\]")
_FOOTNOTE = re.compile(r"\[\^[^\]]+\]")
_WIKI_LINK = re.compile(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]")
_EXTERNAL = re.compile(r"\[(?:https?:)?//\S+[ \t]+([^\]]+)\]")
_QUOTES = re.compile(r"'{2,5}")
_STAR = re.compile(r"(?<![\w*])(\*{1,3})(?=[^\s*])(.+?)(?<=[^\s*])\1(?![\w*])", re.S)
_UNDER = re.compile(r"(?<![\w_])(_{1,3})(?=[^\s_])(.+?)(?<=[^\s_])\1(?![\w_])", re.S)
_STRIKE = re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S)
_INLINE_TAG = re.compile(r"</?(?:b|i|u|s|em|strong|code|span|a|sub|sup|small|big|mark|tt|kbd|q|cite|font|nowiki|br)\b[^<>]*>", re.I)


def _protect(text: str) -> str:
    return "".join(chr(_BASE + ord(c)) if c in "\\`*_{}[]()#+-.!|<>~$&%\"':;/=?@^," else c for c in text)


def _unprotect(m: re.Match) -> str:
    return chr(ord(m.group()) - _BASE)


class Converter:
    """Collects the elements of one field; ``plain`` text keeps its backslashes (HTML).

    With ``keep_text`` paragraphs, quotations and table rows are collected as well.
    """

    def __init__(self, plain: bool = False, keep_text: bool = False) -> None:
        self.plain = plain
        self.keep_text = keep_text
        self.found: list[tuple[str, str]] = []
        self.code: list[str] = []
        self.formulas: list[str] = []
        self.latex = self.wiki = False
        self.references: set[str] = set()

    def add(self, kind: str, text: str) -> None:
        text = collapse(text)
        if text:
            self.found.append((kind, text))

    # inline ---------------------------------------------------------------------------------

    def inline(self, text: str) -> str:
        """Visible text of a heading or list item, without markup."""
        if not self.plain:
            if self.latex:
                text = text.replace("\\\\", " ") if "\\\\ " in text or text.endswith("\\\\") else text
            text = _ESCAPE.sub(lambda m: chr(_BASE + ord(m.group(1))), text)
        if "\\" in text:
            text = _NAMED.sub(lambda m: _protect(_NAMED_TEXT[m.group(1)]), text)
            while True:  # styles in styles, from the inside; every round shortens the text
                before = text
                text = _DROPPED.sub("", _URL.sub(r"\1", _HREF.sub(r"\1", _STYLED.sub(r"\1", text))))
                if text == before:
                    break
        if "`" in text:
            text = _TICKS.sub(lambda m: _protect(m.group(2).strip()), text)
        if "[" in text:
            text = _IMAGE.sub(r"\1", text)
            text = _LINK.sub(r"\1", text)
            text = _WIKI_LINK.sub(r"\1", _ASIDE.sub("", text))
            text = _EXTERNAL.sub(r"\1", _FOOTNOTE.sub("", text))
            text = _REFERENCE.sub(lambda m: m.group(1) if (m.group(2) or m.group(1)).lower() in self.references else m.group(), text)
            if self.references:
                text = re.sub(r"\[([^\[\]]+)\]", lambda m: m.group(1) if m.group(1).lower() in self.references else m.group(), text)
        if "''" in text:
            text = _QUOTES.sub("", text)
        while True:
            before = text
            if "*" in text:
                text = _STAR.sub(r"\2", text)
            if "_" in text:
                text = _UNDER.sub(r"\2", text)
            if text == before:
                break
        if "~" in text:
            text = _STRIKE.sub(r"\1", text)
            if self.latex:
                text = text.replace("~", " ")
        if "<" in text:
            text = _INLINE_TAG.sub("", text)
        return self.formulas_in(_RESTORE.sub(_unprotect, text))

    def formulas_in(self, text: str) -> str:
        """Report formulas that stand in the text, and put their source in place."""
        if _MARK not in text:
            return text

        def place(m: re.Match) -> str:
            if m.group(1) == "C":
                self.add("code", self.code[int(m.group(2))])
                return " "
            tex = self.formulas[int(m.group(2))]
            self.add("formula", tex)
            return tex.strip()

        return _PLACE.sub(place, text)

    # blocks ---------------------------------------------------------------------------------

    def take_code(self, text: str) -> str:
        def place(m: re.Match) -> str:
            if m.group("comment") is not None:
                return ""
            if m.group("fence") is not None:
                if m.group("f")[0] == "`" and "`" in m.group("info"):
                    return m.group()
                body = m.group("fbody")
                if ">" in m.group("in"):
                    body = re.sub(r"(?m)^ {0,3}(?:> ?)+", "", body)
            elif m.group("env") is not None:
                body = m.group("ebody")
            else:
                body = m.group("tbody")
                if m.group("t").lower() != "source" or "&" in body:
                    body = unescape(re.sub(r"</?(?:code|span|b|i)\b[^<>]*>", "", body))
            self.code.append(body)
            return f"\n{_MARK}C{len(self.code) - 1}{_MARK}\n"

        return _CODE.sub(place, text)

    def take_formulas(self, text: str) -> str:
        def place(m: re.Match) -> str:
            if m.group("tick") is not None or m.group("esc") is not None:
                return m.group()
            tex = next(g for g in m.group("dd", "br", "pa", "eq", "math", "script", "d") if g is not None)
            if m.group("math") is not None or m.group("script") is not None:
                tex = unescape(tex)
            self.formulas.append(tex)
            return f"{_MARK}F{len(self.formulas) - 1}{_MARK}"

        if "$" in text or "\\" in text or "<math" in text or "math/tex" in text:
            return _FORMULA.sub(place, text)
        return text

    def rendered(self, found: list[Block]) -> None:
        """Elements of rendered HTML; runs of bare text may hold other markup."""
        at = 0
        while at < len(found):
            b = found[at]
            at += 1
            if b.kind == "code":
                self.add("code", b.text)
            elif b.kind == "formula":
                self.add("formula", b.text)
            elif b.kind == "heading":
                self.add("heading", self.inline(self.take_formulas(b.text)))
            elif b.kind == "list_item":
                parts = [b.text]
                while at < len(found) and found[at].kind == "list_item" and found[at].item == b.item:
                    parts.append(found[at].text)
                    at += 1
                self.add("list_item", self.inline(self.take_formulas(" ".join(parts))))
            elif b.kind == "cell":
                text = self.formulas_in(self.take_formulas(b.text))
                if self.keep_text:
                    self.add("cell", text)
            else:
                self.lines(self.take_formulas(b.text))

    def lines(self, text: str) -> None:
        """Read Markdown, wiki and LaTeX blocks line by line."""
        if "\n" not in text and _MARK not in text and not text.lstrip()[:1] in ("#", "=", "\\", "-", "+", "*", ">", "•", ":", ";") and not text.lstrip()[:1].isdigit():
            if self.keep_text:  # a paragraph without formulas holds no element
                self.add("paragraph", self.inline(text))
            return
        rows = text.split("\n")
        para: list[str] = []
        item: list[str] | None = None
        blank = True

        def end_item() -> None:
            nonlocal item
            if item is not None:
                self.add("list_item", self.inline("\n".join(item)))
                item = None

        def end_para() -> None:
            if para:
                if self.keep_text:
                    self.add("paragraph", self.inline("\n".join(para)))
                else:
                    self.formulas_in("\n".join(para))
                para.clear()

        at, n = 0, len(rows)
        while at < n:
            row = rows[at]
            at += 1
            s = row.strip()
            if not s:
                end_item()
                end_para()
                blank = True
                continue
            place = _PLACE.fullmatch(s)
            if place is not None and place.group(1) == "C":
                end_item()
                end_para()
                self.add("code", self.code[int(place.group(2))])
                blank = True
                continue
            head = s[0]
            if head == "#":
                m = _ATX.match(row)
                grouped = self.wiki and len(s) > 1 and s[1] not in "#" and (
                    (at < n and rows[at].lstrip().startswith("#") and not rows[at].lstrip().startswith("##"))
                    or (at > 1 and rows[at - 2].lstrip().startswith("#") and item is not None)
                )
                if m is not None and not grouped:
                    end_item()
                    end_para()
                    self.add("heading", self.inline(m.group(2) or ""))
                    blank = True
                    continue
            if head == "=" and not para:
                m = _WIKI_HEADING.match(s)
                if m is not None:
                    end_item()
                    self.add("heading", self.inline(m.group(2)))
                    blank = True
                    continue
            if head == "\\":
                m = _LATEX_HEADING.match(row)
                if m is not None:
                    end_item()
                    end_para()
                    self.add("heading", self.inline(_braced(row[m.end() :])))
                    blank = True
                    continue
                if _LATEX_ENV.match(row) is not None:
                    end_item()
                    end_para()
                    continue
                m = _LATEX_ITEM.match(row)
                if m is not None:
                    end_item()
                    end_para()
                    item = [m.group(1)]
                    continue
            if para and item is None and (m := _SETEXT.match(row)) is not None:
                self.add("heading", self.inline("\n".join(para)))
                para.clear()
                blank = True
                continue
            if _RULE.match(row) is not None:
                end_item()
                end_para()
                continue
            if head == ">":
                end_item()
                end_para()
                quoted = [_QUOTE.match(row).group(1) if _QUOTE.match(row) else s[1:]]
                while at < n and rows[at].strip() and ((m := _QUOTE.match(rows[at])) is not None):
                    quoted.append(m.group(1))
                    at += 1
                self.lines("\n".join(["", *quoted]))
                continue
            if blank and not self.latex and (row.startswith("    ") or row.startswith("\t")) and item is None and not para:
                body = [row]
                while at < n and (rows[at].startswith(("    ", "\t")) or not rows[at].strip()):
                    body.append(rows[at])
                    at += 1
                if not any(_ITEM.match(x) for x in body):
                    self.add("code", _RESTORE.sub(_unprotect, "\n".join(body)))
                    continue
                at -= len(body) - 1
            m = _ITEM.match(row)
            if m is not None and not (para and not head in "-+*•" and not s.startswith(("1.", "1)"))):
                end_item()
                end_para()
                item = [m.group(1) or ""]
                blank = False
                continue
            if head == "*" or self.wiki and head in "#:;":
                m = _WIKI_ITEM.match(s)
                if m is not None and (self.wiki or item is not None or not para) and not (head == "*" and re.match(r"\*{1,3}[^*\s][^*\n]*\*", s)):
                    end_item()
                    end_para()
                    item = [m.group(2)]
                    blank = False
                    continue
                if head in ":;":
                    s = s.lstrip(":; ")
            if _TABLE_ROW.match(row) is not None:
                end_item()
                end_para()
                text = self.formulas_in(row)
                if self.keep_text and not re.fullmatch(r"[\s|:\-]+", text):
                    self.add("cell", " ".join(text.strip().strip("|").split("|")))
                continue
            if _DEFINITION.match(row) is not None:
                continue
            if item is not None:
                item.append(s)
            else:
                para.append(s)
            blank = False
        end_item()
        end_para()

    def document(self, text: str) -> None:
        """A Markdown, wiki or LaTeX document with HTML in it."""
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        text = self.take_code(_FRONT.sub("", text))
        self.latex = _LATEX.search(text) is not None
        if self.latex:
            text = _DOCUMENT_END.sub("", _PREAMBLE.sub("", text))
            text = _LATEX_COMMENT.sub("", text)
        self.wiki = _WIKI.search(text) is not None
        if "\\begin{tabular}" in text:
            text = re.sub(r"\\begin\{tabular\}.*?(?:\\end\{tabular\}|\Z)", "\n", text, flags=re.S)
        text = self.take_formulas(text)
        if self.wiki:
            text = _WIKI_TABLE.sub("\n", text)
            if "{{" in text:
                text = _TEMPLATE.sub(lambda m: "" if "|" in m.group() or m.group()[2:3].isupper() else m.group(), text)
            text = _ASIDE.sub("", text)
        self.references = {m.group(1).lower() for m in _DEFINITION.finditer(text)} if "]:" in text else set()
        if "<" in text:
            text = _AUTOLINK.sub(r"\1", text)
        if _HAS_TAG.search(text) is not None:
            renderer = _Renderer(None)
            root = parse(text)
            renderer.walk(root, "paragraph", 0, 0)
            renderer.flush("paragraph", 0, 0)
            self.rendered(renderer.out)
        else:
            self.lines(unescape(text) if "&" in text else text)


def _braced(text: str) -> str:
    """Up to the brace that closes the argument."""
    depth = 1
    at = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[:at]
        at += 1
    return text


def clean_blocks(text: str | None, html: bool) -> list[tuple[str, str]]:
    """All blocks of a field as clean text, with their kinds, in order."""
    if not text:
        return []
    converter = Converter(plain=html, keep_text=True)
    if html:
        converter.rendered(blocks(text, True))
    else:
        converter.document(text)
    return converter.found


def clean_text(text: str | None, html: bool) -> str | None:
    """Clean text with structure: ``#`` before headings, ``-`` before items, fences around code."""
    if text is None:
        return None
    parts: list[str] = []
    inline: list[str] = []
    for kind, value in clean_blocks(text, html):
        if kind == "formula":
            inline.append(value)  # comes again inside its paragraph
            continue
        if kind == "heading":
            value = "# " + value
        elif kind == "list_item":
            value = "- " + value
        elif kind == "code":
            value = "```\n" + value + "\n```"
        elif kind == "paragraph" and value in inline:
            value = "$$" + value + "$$"
        inline.clear()
        parts.append(value)
    parts.extend("$$" + value + "$$" for value in inline)
    return "\n\n".join(parts)


def html_elements(html: str | None) -> list[tuple[str, str]]:
    """Elements of the main body of a page, or of a whole fragment."""
    if not html:
        return []
    converter = Converter(plain=True)
    converter.rendered(blocks(html, True))
    return converter.found


def markdown_elements(markdown: str | None) -> list[tuple[str, str]]:
    if not markdown:
        return []
    converter = Converter()
    converter.document(markdown)
    return converter.found


def heading_text(text: str | None) -> str:
    """An entry of a headings array as clean text, whatever markup it still carries."""
    if not text:
        return ""
    converter = Converter()
    row = text.strip()
    converter.latex = "\\" in row
    m = _ATX.match(row)
    if m is not None:
        row = m.group(2) or ""
    elif (m := _WIKI_HEADING.match(row)) is not None:
        row = m.group(2)
    elif (m := _LATEX_HEADING.match(row)) is not None:
        row = _braced(row[m.end() :])
    elif "\n" in row and _SETEXT.match(row.rsplit("\n", 1)[1]):
        row = row.rsplit("\n", 1)[0]
    row = converter.take_formulas(row)
    if _HAS_TAG.search(row) is not None:
        row = parse(row).text()
    elif "&" in row:
        row = unescape(row)
    return collapse(converter.inline(row))

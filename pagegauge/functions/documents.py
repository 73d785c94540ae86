"""HTML and Markdown pages to one parsed row each (the only step that leaves the JVM).

One Arrow UDF reads a page once and returns everything that rules, audits and graphs need: title,
headings, paragraphs, meta tags, links, images, language, canonicals, alternates, text, JSON-LD
facts.  NULL pages give NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagegauge.functions.htmltree import HEADINGS, Node, parse
from pagegauge.functions.jsonld import Facts
from pagegauge.schema import PARSED

_JS = "\t\n\x0b\x0c\r                  　﻿"
_RUN = re.compile(f"[{_JS}]+")
_FACTS = frozenset(("nodes", "errors", "diagnostics", "block_count"))


def _utf16(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def parse_html(html: str, wanted: frozenset[str] = frozenset(PARSED.names)) -> dict:
    """All facts of an HTML page; ``paragraphs``, ``raw_text``, ``images`` and JSON-LD facts only where wanted."""
    root = parse(html)
    with_paragraphs, with_facts = "paragraphs" in wanted, not _FACTS.isdisjoint(wanted)
    titles: list[str] = []
    headings, paragraphs, links, images, canonicals, alternates = [], [], [], [], [], []
    meta: dict[str, str] = {}
    values: dict[str, list[str]] = {}
    language = base = first_h1 = None
    area: Node | None = None
    body: Node | None = None
    facts = Facts()
    for n in root.walk():
        tag = n.tag
        if tag == "p" or tag == "li" or tag == "dd":
            if not with_paragraphs:
                continue
            text = n.text().strip(_JS)
            if _utf16(text) > 20:
                paragraphs.append(text)
        elif tag in HEADINGS:
            text = n.text().strip(_JS)
            headings.append({"level": int(tag[1]), "text": text})
            if tag == "h1" and first_h1 is None:
                first_h1 = text
        elif tag == "a":
            href = n.attrs.get("href", "")
            if href:
                links.append({"href": href, "text": n.text().strip(_JS), "rel": n.attrs.get("rel") or None})
        elif tag == "img":
            images.append({"src": n.attrs.get("src", ""), "alt": n.attrs.get("alt")})
        elif tag == "meta":
            a = n.attrs
            declared, content = a.get("name", ""), a.get("content", "")
            name = declared or a.get("property", "")
            if name and content:
                meta[name] = content
            if declared and content:
                values.setdefault(declared.strip(_JS).lower(), []).append(content)
        elif tag == "link":
            a = n.attrs
            rel = _RUN.split(a.get("rel", "").lower())
            if "canonical" in rel:
                canonicals.append(a.get("href", ""))
            if "alternate" in rel and a.get("hreflang") is not None and a.get("href"):
                alternates.append({"href": a["href"].strip(_JS), "lang": a["hreflang"].strip(_JS).lower()})
        elif tag == "title":
            above = n.parent
            if above is not None and (above.tag == "head" or above.tag in ("", "html") and body is None):
                titles.append(n.text().strip(_JS))
        elif tag == "html" and language is None:
            language = n.attrs.get("lang", "").strip(_JS) or None
        elif tag == "base" and base is None:
            base = n.attrs.get("href")
        elif tag == "body":
            body = body or n
        elif tag == "script" and with_facts and n.attrs.get("type", "").strip(_JS).lower() == "application/ld+json":
            facts.read(n.text(), html.count("\n", 0, n.at) + 1)
        if area is None and (tag == "main" or tag == "article" or n.raw and n.attrs.get("role") == "main"):
            area = n
    whole = area if area is not None else body if body is not None else root
    nodes, errors, diagnostics, count = facts.row()
    return {
        "document_title": titles[0] if titles else "",
        "titles": titles,
        "title": (titles[0] if titles else "") or first_h1 or None,
        "headings": headings,
        "paragraphs": paragraphs,
        "meta": meta,
        "meta_values": values,
        "links": links,
        "images": images,
        "language": language,
        "canonicals": canonicals,
        "base_href": base,
        "alternates": alternates,
        "raw_text": _RUN.sub(" ", whole.text()).strip(" ") if "raw_text" in wanted else None,
        "nodes": nodes,
        "errors": errors,
        "diagnostics": diagnostics,
        "block_count": count,
    }


_FRONT = re.compile(r"\A---[^\n]*\n(.*?)(?:^---[ \t]*$\n?|\Z)", re.S | re.M)
_OPEN = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_CLOSE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*$")
_HEADING = re.compile(r"^(#{1,6})[\s﻿]+(.+)$", re.M)
#: fixed values: what a Markdown text loses on the way to its plain words, in this order
_MARKS = (
    (re.compile(r"`[^`]+`"), ""),
    (re.compile(r"!\[.*?\]\(.*?\)"), ""),
    (re.compile(r"\[([^\]]+)\]\(.*?\)"), r"\1"),
    (re.compile(r"[#*_~`>]"), ""),
)
#: fixed value: a link or image of Markdown
_LINK = re.compile(r"(!?)\[([^\]]*)\]\(([^)\s]+)(?:\s+[\"'][^\"']*[\"'])?\)")


def without_fences(text: str) -> str:
    """Lines of fenced code as empty lines."""
    out, mark = [], ""
    for line in re.split(r"\r?\n", text):
        if mark:
            m = _CLOSE.match(line)
            if m and m.group(1)[0] == mark[0] and len(m.group(1)) >= len(mark):
                mark = ""
            out.append("")
            continue
        m = _OPEN.match(line)
        if m and not (m.group(1)[0] == "`" and "`" in m.group(2)):
            mark = m.group(1)
            out.append("")
        else:
            out.append(line)
    return "\n".join(out)


_PLAIN_TYPES = re.compile(r"[-+]?(?:\d[\d_]*(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?|[-+]?\.inf|\.nan|true|false|null|~|\d{4}-\d\d?-\d\d?(?:[Tt ].*)?|[\[{&*!|>%@].*", re.I)
_PAIR = re.compile(r"([^\s#:\-][^:]*?)[ \t]*:(?:[ \t]+(.*))?$")


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Strings of YAML front matter at its top level, and the text below it; numbers, dates, lists and maps are no strings."""
    m = _FRONT.match(text)
    if m is None:
        return {}, text
    found: dict[str, str] = {}
    for row in m.group(1).splitlines():
        pair = _PAIR.match(row)
        value = (pair.group(2) or "").strip() if pair else ""
        if not value:
            continue
        if value[0] in "\"'":
            end = re.match(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\']|\'\')*)\'', value)
            if end is None:
                continue
            value = re.sub(r'\\(["\\/])', r"\1", end.group(1)) if end.group(1) is not None else end.group(2).replace("''", "'")
        else:
            value = re.sub(r"\s+#.*$", "", value)
            if _PLAIN_TYPES.fullmatch(value):
                continue
        found[pair.group(1).strip("\"'")] = value
    return found, text[m.end() :]


def parse_markdown(text: str) -> dict:
    """All facts of a Markdown page."""
    fields, content = front_matter(text)
    visible = without_fences(content)
    headings = [{"level": len(m.group(1)), "text": m.group(2).strip(_JS)} for m in _HEADING.finditer(visible)]
    paragraphs: list[str] = []
    current: list[str] = []
    for line in [*visible.split("\n"), ""]:
        row = line.strip(_JS)
        if not row:
            if current:
                paragraphs.append(" ".join(current))
                current = []
        elif not row.startswith(("#", "-", "*")) and not re.match(r"\d+\.", row):
            current.append(row)
    raw = visible
    for pattern, kept in _MARKS:
        raw = pattern.sub(kept, raw)
    raw = _RUN.sub(" ", raw).strip(" ")
    links, images = [], []
    for m in _LINK.finditer(visible):
        if m.group(1):
            images.append({"src": m.group(3), "alt": m.group(2)})
        else:
            links.append({"href": m.group(3), "text": m.group(2), "rel": None})
    first = next((h["text"] for h in headings if h["level"] == 1), None)
    title = fields.get("title")
    return {
        "document_title": title,
        "titles": [title] if title else [],
        "title": title or first,
        "headings": headings,
        "paragraphs": paragraphs,
        "meta": {},
        "meta_values": {k: [v] for k, v in fields.items() if k == "description"},
        "links": links,
        "images": images,
        "language": fields.get("lang", fields.get("language")),
        "canonicals": [fields["canonical"]] if "canonical" in fields else [],
        "base_href": None,
        "alternates": [],
        "raw_text": raw,
        "nodes": [],
        "errors": [],
        "diagnostics": None,
        "block_count": 0,
    }


def _frame(rows: list[dict | None], names: list[str] = PARSED.names) -> pd.DataFrame:
    return pd.DataFrame([[None] * len(names) if r is None else [r[n] for n in names] for r in rows], columns=names)


@F.pandas_udf(PARSED)
def parsed_html(html: pd.Series) -> pd.DataFrame:
    return _frame([None if h is None else parse_html(h) for h in html])


def parsed_html_fields(*names: str) -> Callable[[Column | str], Column]:
    """``parsed_html`` with these fields only: the others are neither read out of the page nor sent back."""
    kind = StructType([PARSED[n] for n in names])
    wanted = frozenset(names)

    @F.pandas_udf(kind)
    def read(html: pd.Series) -> pd.DataFrame:
        return _frame([None if h is None else parse_html(h, wanted) for h in html], kind.names)

    return read


@F.pandas_udf(PARSED)
def parsed_markdown(markdown: pd.Series) -> pd.DataFrame:
    return _frame([None if m is None else parse_markdown(m) for m in markdown])

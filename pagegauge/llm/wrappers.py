"""Union-free regular expressions inferred from the token streams of a host (wrappers).

Every row of the fixture documents gives up to three token streams: its HTML (a page or a fragment),
its Markdown (lines by their marks) and its headings.  ``align`` brings a wrapper and a further
stream, or two wrappers, together: tokens that both have stay, texts that differ become slots, tokens
that only one side has become optional groups, and sequences that follow themselves become repeated
groups.  A run of optional items in which an item recurs becomes one repeated group of optional
items, so that a wrapper's size depends on the different items and not on the number of streams.

Streams are folded in the order of their hashes, first those of each of ``2 ** PREFIX_BITS`` ranges of
a host, then the ranges: a host with a third of all rows is spread over as many tasks, each holds one
wrapper at a time, and the result does not depend on how the rows lie.

Defined results: NULL and empty fields give no stream; rows without a host are not aligned with
anything and are counted under the NULL host without a wrapper; a host with one stream has the stream
itself as wrapper; repeated fields count once and change nothing; extra columns are ignored.
"""

from __future__ import annotations

import json
import marshal
import re
import sys
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.functions.htmltree import Node, parse
from pagegauge.llm.render import collapse, is_whole_page

PREFIX_BITS = 10
TEXT, ELEMENT, GROUP = "t", "e", "g"
_SKIP = frozenset(("script", "style", "svg", "template"))
_MARK = re.compile(r"\s*(#{1,6}|[-*+](?=\s)|\d{1,3}[.)](?=\s)|>|\||```+|~~~+|=+(?=[^=]+=+\s*$)|\\[a-zA-Z]+|\{\||\|[-}]|!(?=\s)|<[a-zA-Z/][^\s>]*)")

# an item is [kind, key, text, items, optional, repeated]


def _item(kind: str, key: str, text: str | None, items: list) -> list:
    return [kind, key, text, items, False, False]


def page_items(root: Node) -> list:
    """The token stream of a page as nested items."""
    out: list = []
    stack = [(iter(root.kids), out, None)]
    while stack:
        kids, items, above = stack[-1]
        for kid in kids:
            if kid.__class__ is str:
                text = collapse(kid)
                if text:
                    items.append(_item(TEXT, "#", text, []))
            elif kid.tag not in _SKIP:
                name = kid.attrs.get("id") or kid.attrs.get("class") or "" if kid.raw else ""
                inner = _item(ELEMENT, f"{kid.tag}.{name}" if name else kid.tag, None, [])
                items.append(inner)
                stack.append((iter(kid.kids), inner[3], inner))
                break
        else:
            stack.pop()
            if above is None:
                out = fold(items)
            else:
                above[3] = fold(items)
    return out


def line_items(text: str) -> list:
    """The token stream of a Markdown, wiki or LaTeX text: each line by its mark, with its text."""
    items = []
    for line in text.splitlines():
        if line.strip():
            m = _MARK.match(line)
            key = m.group(1) if m else "line"
            key = "1." if key[0].isdigit() else key
            rest = collapse(line[m.end() :] if m else line)
            items.append(_item(ELEMENT, key, None, [_item(TEXT, "#", rest, [])] if rest else []))
    return fold(items)


def heading_items(headings: list) -> list:
    return fold([_item(ELEMENT, f"h{level}", None, [_item(TEXT, "#", collapse(text), [])] if text and not text.isspace() else []) for level, text in headings])


def same(a: list, b: list) -> bool:
    return a[1] == b[1] and a[0] == b[0]


def align_item(a: list, b: list) -> list:
    inner = align(a[3], b[3]) if a[3] or b[3] else []
    return [a[0], a[1], a[2] if a[2] == b[2] else None, inner, a[4] or b[4], a[5] or b[5]]


def _periods(items: list) -> list[int]:
    """Distances between an item and its next equal one: the lengths that a repeated sequence can have."""
    last: dict[tuple, int] = {}
    found = set()
    for at, x in enumerate(items):
        key = (x[0], x[1])
        if key in last:
            found.add(at - last[key])
        last[key] = at
    return sorted(p for p in found if 2 * p <= len(items))


def fold(items: list) -> list:
    """Sequences that follow themselves become repeated groups, optional runs with a recurring item one group."""
    if len(items) < 2:
        return items
    for period in _periods(items):
        out: list = []
        at = 0
        while at < len(items):
            block = items[at : at + period]
            times = 1
            while True:
                following = items[at + times * period : at + (times + 1) * period]
                if len(following) < period or not all(map(same, block, following)):
                    break
                block = list(map(align_item, block, following))
                times += 1
            if times > 1:
                if period == 1:
                    block[0][5] = True
                    out.append(block[0])
                else:
                    out.append([GROUP, "(" + " ".join([x[1] for x in block]) + ")", None, block, False, True])
                at += times * period
            else:
                out.append(items[at])
                at += 1
        items = out
    if sum([x[4] for x in items]) < 2:
        return items
    out, run = [], []
    for x in [*items, None]:
        if x is not None and x[4]:
            run.append(x)
            continue
        out.extend(_optional_run(run))
        run = []
        if x is not None:
            out.append(x)
    return out


def _optional_run(run: list) -> list:
    single, open_ = [], list(reversed(run))
    while open_:
        x = open_.pop()
        if x[0] == GROUP:
            open_.extend(reversed(x[3]))
        else:
            single.append(x)
    if len({(x[0], x[1]) for x in single}) == len(single):
        return run
    known: dict[tuple, list] = {}
    for x in single:
        key = (x[0], x[1])
        known[key] = align_item(known[key], x) if key in known else x
    inner = [[*known[k][:4], True, known[k][5]] for k in sorted(known)]
    return [[GROUP, "*", None, inner, True, True]]


def align(a: list, b: list) -> list:
    """One list of items that both lists match: a longest common subsequence, the rest optional."""
    if len(a) == len(b) and all(map(same, a, b)):
        return list(map(align_item, a, b))
    head = 0
    while head < len(a) and head < len(b) and same(a[head], b[head]):
        head += 1
    out: list = list(map(align_item, a[:head], b[:head]))
    a, b = a[head:], b[head:]
    # longest common subsequence in bit vectors: bit j of a row tells whether b[j] adds nothing there
    masks: dict[tuple, int] = {}
    for j, x in enumerate(b):
        key = (x[0], x[1])
        masks[key] = masks.get(key, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        u = row & masks.get((x[0], x[1]), 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    pairs = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                pairs.append((i, j))
    i = j = 0
    for p, q in [*reversed(pairs), (len(a), len(b))]:
        out.extend([[*x[:4], True, x[5]] for x in a[i:p]])
        out.extend([[*x[:4], True, x[5]] for x in b[j:q]])
        if p < len(a) and q < len(b):
            out.append(align_item(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold(out)


def as_expression(items: list) -> str:
    """The wrapper as a union-free regular expression over tags, texts and ``SLOT``."""
    parts = []
    for kind, key, text, inner, optional, repeated in items:
        if kind == TEXT:
            body = "SLOT" if text is None else json.dumps(text, ensure_ascii=False)
        elif kind == GROUP:
            body = as_expression(inner)
        else:
            body = f"<{key}>{as_expression(inner)}</{key.split('.')[0]}>"
        mark = "*" if optional and repeated else "+" if repeated else "?" if optional else ""
        parts.append(f"({body}){mark}" if mark else body)
    return "".join(parts)


def count_parts(items: list) -> tuple[int, int, int]:
    """Numbers of slots, optional groups and repeated groups."""
    slots = optional = repeated = 0
    stack = list(items)
    while stack:
        kind, _, text, inner, o, r = stack.pop()
        slots += kind == TEXT and text is None
        optional += o
        repeated += r
        stack.extend(inner)
    return slots, optional, repeated


def fixed_texts(items: list) -> list[str]:
    """Texts that all streams have in their place: the template's own words."""
    found, stack = [], list(items)
    while stack:
        kind, _, text, inner, optional, _ = stack.pop()
        if not optional:
            if kind == TEXT and text is not None:
                found.append(text)
            stack.extend(inner)
    return found


def packed(items: list) -> bytes:
    """Items in one flat list, so that no nesting is too deep."""
    flat: list = []
    stack = list(reversed(items))
    while stack:
        kind, key, text, inner, o, r = stack.pop()
        flat.append((len(inner), kind, key, text, o, r))
        stack.extend(reversed(inner))
    return zlib.compress(marshal.dumps(flat), 1)


def unpacked(data: bytes) -> list:
    out: list = []
    open_: list = [(out, -1)]
    for n, kind, key, text, o, r in marshal.loads(zlib.decompress(data)):
        x = [kind, key, text, [], o, r]
        while True:
            items, left = open_.pop()
            if left:
                open_.append((items, left - 1))
                break
        items.append(x)
        if n:
            open_.append((x[3], n))
    return out


def host_of(url: str | None) -> str | None:
    try:
        return (urlsplit(url or "").hostname or "").lower() or None
    except ValueError:
        return None


class DeepCalls:
    """Lets functions call themselves as deep as documents nest."""

    def __enter__(self) -> None:
        self.limit = sys.getrecursionlimit()
        sys.setrecursionlimit(10_000_000)

    def __exit__(self, *_: object) -> None:
        sys.setrecursionlimit(self.limit)


_STREAM = "host string, form string, h bigint, n bigint, items binary"


def _level(value: float | None) -> str:
    return "" if value is None or value != value else str(int(value))  # Arrow gives levels beside a NULL as floats


def token_streams(docs: DataFrame) -> DataFrame:
    """(host, form, h, n, items) of each field of the documents (url, html, markdown, headings)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            without: dict[str, int] = {}  # fields without a host are counted only
            with DeepCalls():
                for url, html, markdown, headings in zip(part["url"], part["html"], part["markdown"], part["headings"]):
                    host = host_of(url)
                    found = []
                    if html:
                        found.append(("page" if is_whole_page(html) else "fragment", page_items, html))
                    if markdown:
                        found.append(("markdown", line_items, markdown))
                    if headings is not None and len(headings):
                        found.append(("headings", heading_items, [(_level(h["level"]), h["text"]) for h in headings if h is not None]))
                    for form, read_items, value in found:
                        if host is None:
                            without[form] = without.get(form, 0) + 1
                            continue
                        items = read_items(parse(value) if form in ("page", "fragment") else value)
                        if items:
                            data = packed(items)
                            text = value if isinstance(value, str) else repr(value)
                            rows.append((host, form, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), 1, data))
            rows.extend((None, form, 0, n, None) for form, n in without.items())
            yield pd.DataFrame(rows, columns=["host", "form", "h", "n", "items"])

    return docs.select("url", "html", "markdown", "headings").mapInPandas(read, _STREAM)


def _folded(streams: DataFrame, bits: int) -> DataFrame:
    """The streams of each range of hashes of a host folded into one, in the order of the hashes."""
    place = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)
    rows = streams.withColumn("range", place).repartition("host", "form", "range").sortWithinPartitions("host", "form", "h")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        last, first, n, wrapper = None, 0, 0, []

        def folded() -> tuple:
            return key[0], key[1], first, n, None if key[0] is None else packed(wrapper)

        for part in parts:
            out = []
            with DeepCalls():
                for host, form, h, count, data, span in zip(part["host"], part["form"], part["h"], part["n"], part["items"], part["range"]):
                    if (host, form, span) != key:
                        if key is not None:
                            out.append(folded())
                        key, last, first, n = (host, form, span), h, h, count
                        wrapper = unpacked(data) if data is not None else []
                    elif data is None:
                        n += count
                    elif h != last:
                        last, n, wrapper = h, n + count, align(wrapper, unpacked(data))
            yield pd.DataFrame(out, columns=["host", "form", "h", "n", "items"])
        if key is not None:
            with DeepCalls():
                yield pd.DataFrame([folded()], columns=["host", "form", "h", "n", "items"])

    return rows.select("host", "form", "h", "n", "items", "range").mapInPandas(run, _STREAM)


def infer_wrappers(docs: DataFrame) -> DataFrame:
    """(host, form, n_streams, n_slots, n_optional, n_repeated, wrapper) from (url, html, markdown, headings)."""
    folded = _folded(_folded(token_streams(docs), PREFIX_BITS), 0)
    schema = "host string, form string, n_streams bigint, n_slots int, n_optional int, n_repeated int, wrapper string"

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            with DeepCalls():
                for host, form, n, data in zip(part["host"], part["form"], part["n"], part["items"]):
                    wrapper = unpacked(data) if data is not None else None
                    rows.append((host, form, n, *((None,) * 4 if wrapper is None else (*count_parts(wrapper), as_expression(wrapper)))))
            frame = pd.DataFrame(rows, columns=["host", "form", "n_streams", "n_slots", "n_optional", "n_repeated", "wrapper"])
            yield frame.astype({c: "Int32" for c in ("n_slots", "n_optional", "n_repeated")})

    return folded.mapInPandas(write, schema)

"""Main body of each page, apart from menus, notices, sidebars, teasers, forms and footers.

The layout-aware renderer (tree builder with implied tags and visibility rules) emits the blocks of
each page; elements outside the main body count as not visible.  Pages whose main body is residue
(see ``residue``) have none.  Every page is rendered once, where it lies; only block leads or
rendered texts leave the Python workers.

Defined results: NULL and empty pages give nothing; fragments are not whole pages and give nothing
in ``page_blocks``; pages cut off at the end give what came before the cut; repeated rows of a page
count once; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm import residue
from pagegauge.llm.render import Block, blocks, collapse, is_whole_page, render_text

LEAD = 40
_PROSE_KINDS = frozenset(("paragraph", "heading", "list_item", "quote"))
_ONLY_FORMULA = re.compile(r"\s*(?:\$\$.*\$\$|\\\[.*\\\]|\\\((?:(?!\\\)).)*\\\))\s*", re.S)


def block_leads(found: list[Block]) -> list[str]:
    """First characters of the main body's text blocks."""
    leads = []
    for b in found:
        if b.kind in _PROSE_KINDS and len(b.text) >= LEAD:
            text = collapse(b.text)
            if len(text) >= LEAD and not _ONLY_FORMULA.fullmatch(text):
                leads.append(text[:LEAD].strip())
    return leads


def _page_leads(html: str, found: list[Block]) -> list[str] | None:
    return block_leads(found) if is_whole_page(html) else None


def _exploded(rows: DataFrame, src_table: str) -> DataFrame:
    return rows.select(F.lit(src_table).alias("src_table"), "row_id", F.explode("leads").alias("block_lead")).distinct()


def fetch_blocks(fetches: DataFrame) -> DataFrame:
    """(src_table, row_id, block_lead) of the whole pages in ``fetches``; residue has no main body."""
    scanned, index = residue.scan(fetches, _page_leads)
    real = residue.judged(scanned, index).where("label IS NULL").select(F.col("fetch_id").alias("row_id"), "leads")
    final = scanned.where("body IS NULL").select(F.col("fetch_id").alias("row_id"), "leads")
    return _exploded(final.unionByName(real), "fetches")


def page_blocks(pages: DataFrame, src_table: str, row_id: str) -> DataFrame:
    """(src_table, row_id, block_lead) of the whole pages in ``pages`` (columns ``row_id``, html)."""

    def lead(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            leads = [block_leads(blocks(html, True)) if is_whole_page(html) else [] for html in part["html"]]
            yield pd.DataFrame({"row_id": part["row_id"], "leads": leads})

    rows = pages.select(F.col(row_id).cast("bigint").alias("row_id"), "html").where(F.col(row_id).isNotNull() & (F.length("html") > 0))
    return _exploded(rows.mapInPandas(lead, "row_id bigint, leads array<string>"), src_table)


def rendered_pages(pages: DataFrame, src_table: str, row_id: str, main_only: bool) -> DataFrame:
    """(src_table, row_id, rendered_text) of every page of the fetches, and of whole pages of other tables: all visible text, or the main body only."""
    only_whole = src_table != "fetches"

    def render(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, render_text(h, main_only)) for i, h in zip(part["row_id"], part["html"]) if not only_whole or is_whole_page(h)]
            yield pd.DataFrame(rows, columns=["row_id", "rendered_text"]).assign(src_table=src_table)[["src_table", "row_id", "rendered_text"]]

    rows = pages.select(F.col(row_id).cast("bigint").alias("row_id"), "html").where(F.col(row_id).isNotNull() & (F.length("html") > 0))
    return rows.mapInPandas(render, "src_table string, row_id bigint, rendered_text string")

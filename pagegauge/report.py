"""HTML report of one run from small aggregates; every value is escaped."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators.rules import DIMENSIONS, site_averages

#: lowest pages that a report lists
LISTED = 50


def _table(head: list[str], rows: list[tuple]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{escape(str('' if v is None else v))}</{tag}>" for v in row)
    return f"<table><thead><tr>{cells('th', head)}</tr></thead><tbody>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</tbody></table>"


def render_report(title: str, scores: DataFrame, severities: DataFrame | None = None, changes: DataFrame | None = None) -> str:
    """``scores`` (page, dimensions, total), ``severities`` (severity, n_issues), ``changes`` (key, before, after, delta)."""
    average = site_averages(scores).collect()
    parts = [f"<!doctype html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    parts.append(_table(["dimension", "score", "of"], [(d, average[0][d] if average else 0, most) for d, most in DIMENSIONS.items()] + [("total", average[0]["total"] if average else 0, 100)]))
    lowest = scores.orderBy("total", "page").limit(LISTED).select("page", "total", *DIMENSIONS).collect()
    parts.append(_table(["page", "total", *DIMENSIONS], [tuple(r) for r in lowest]))
    if severities is not None:
        parts.append(_table(["severity", "issues"], [tuple(r) for r in severities.select("severity", "n_issues").collect()]))
    if changes is not None:
        parts.append(_table(["key", "before", "after", "delta"], [tuple(r) for r in changes.select("key", "before", "after", "delta").orderBy(F.col("key")).collect()]))
    return "".join(parts) + "</body></html>"


def preview_markup(text: str, most: int = 6000) -> str:
    """The beginning of a page's source for display, escaped, with a note where it is cut."""
    note = f"<p>First {most} of {len(text)} characters.</p>" if len(text) > most else ""
    return f"<pre>{escape(text[:most])}</pre>{note}"


def rule_rows(results: list[dict]) -> str:
    """Details of one page: each rule with its score, issues and suggestions, the weakest first."""
    ordered = sorted(results, key=lambda r: (r["score"] / r["max_score"] if r["max_score"] else 1.0, r["id"]))
    return _table(["rule", "score", "of", "issues", "suggestions"], [(r["id"], r["score"], r["max_score"], "; ".join(r["issues"]), "; ".join(r["suggestions"])) for r in ordered])


def write_report(path: str, html: str) -> None:
    """An existing file is an error."""
    with open(path, "x", encoding="utf-8") as file:
        file.write(html)

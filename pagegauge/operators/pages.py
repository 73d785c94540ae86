"""Pages of many sites: one row for each fetch, parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions.documents import parsed_html, parsed_html_fields
from pagegauge.functions.urls import normal_url, origin


def latest(rows: DataFrame, *columns: str) -> DataFrame:
    """(fetch_id, *columns) of the row of each fetch that was loaded last.

    Pages are parsed, and reduced to what is needed, before repeated rows meet here: HTML itself is
    never shuffled.
    """
    loaded = F.coalesce("loaded_at", "fetched_at", F.timestamp_seconds(F.lit(0)))
    picked = F.max_by(F.struct(*columns), loaded).alias("_row")
    return rows.groupBy("fetch_id").agg(picked).select("fetch_id", "_row.*")


def is_html(content_type: Column, html: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("html"), F.lit(False)) | F.coalesce(html.rlike(r"(?i)\A\s*(?:<!doctype\s+html|<html\b)"), F.lit(False))


def parsed_pages(fetches: DataFrame, html: Column | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """``fetches`` with normalised addresses and ``doc``, the parsed page of a successful HTML response (else NULL); with ``fields`` only these of it."""
    read = parsed_html_fields(*fields) if fields else parsed_html
    html = F.col("html") if html is None else html
    readable = F.col("status").between(200, 299) & is_html(F.col("content_type"), F.col("html"))
    with_html = fetches.withColumn("html", F.when(readable, html))
    return with_html.withColumns({"url": normal_url("requested_url"), "final": F.coalesce(normal_url("final_url"), normal_url("requested_url"))}).withColumns(
        {"doc": F.when(F.col("html").isNotNull(), read("html")), "origin": origin(F.col("final"))}
    )


# Tags for tests: the synthetic pages have no canonical, robots, alternate or JSON-LD tags.  The same
# SQL text builds them in Spark and in DuckDB.
EXTRA_TAGS = (
    "concat(CASE fetch_id % 5 WHEN 1 THEN concat('<link rel=\"canonical\" href=\"', final_url, '\">') "
    "WHEN 2 THEN '<link rel=\"canonical\" href=\"/\">' WHEN 3 THEN '<link rel=\"canonical\" href=\"/a\"><link rel=\"canonical\" href=\"/b\">' "
    "WHEN 4 THEN '<link rel=\"canonical\" href=\"mailto:a@b.example\">' ELSE '' END, "
    "CASE fetch_id % 7 WHEN 0 THEN '<meta name=\"robots\" content=\"noindex, follow\">' WHEN 1 THEN '<meta name=\"robots\" content=\"max-snippet: 20, nofollow\">' "
    "WHEN 2 THEN '<meta name=\"googlebot\" content=\"max-image-preview: none\">' ELSE '' END, "
    "CASE fetch_id % 4 WHEN 0 THEN '<script type=\"application/ld+json\">{\"@context\":\"https://schema.org\",\"@type\":\"Article\"}</script>' "
    "WHEN 1 THEN '<script type=\"application/ld+json\">{\"@type\":</script>' ELSE '' END)"
)
#: hubs of a site: addresses that other pages of it link to
HUBS = 16
#: before the body's end: links to a hub of the site, to the page itself, to other sites, to protected mail and to a private host, and images
EXTRA_BODY = (
    "concat(CASE WHEN fetch_id % 3 = 0 AND hub IS NOT NULL THEN concat('<a href=\"', hub, '#top\">hub</a>') ELSE '' END, "
    "CASE fetch_id % 6 WHEN 1 THEN concat('<a href=\"https://other.example/x\">out</a><a href=\"/cdn-cgi/l/email-protection#ab12\">mail</a><a href=\"http://127.0.0.1/x\">own</a><a href=\"', requested_url, '\">self</a>') "
    "WHEN 2 THEN '<img src=\"/a.png\" alt=\"A\"><img src=\"/b.png\">' WHEN 4 THEN '<img src=\"/c.png\" alt=\"\">' ELSE '' END)"
)
TAGGED_HTML = f"replace(replace(html, '</head>', concat({EXTRA_TAGS}, '</head>')), '</body>', concat({EXTRA_BODY}, '</body>'))"


def with_hubs(fetches: DataFrame) -> DataFrame:
    """``fetches`` (fetch_id, site_id, requested_url, status) with ``hub``, an address of the same site; for tests, with TAGGED_HTML.

    A site has at most ``HUBS`` hubs and the sites are a fixed table, so the hubs are few at every scale.
    """
    place = F.col("fetch_id") % HUBS
    worst = F.max(F.struct(F.coalesce("status", F.lit(0)), "requested_url"))["requested_url"]
    hubs = fetches.groupBy("site_id", place.alias("_p")).agg(worst.alias("_worst"), F.min("requested_url").alias("_first"))
    hubs = hubs.select("site_id", "_p", F.when(F.col("_p") % 2 == 0, F.col("_worst")).otherwise(F.col("_first")).alias("hub"))
    return fetches.withColumn("_p", (F.col("fetch_id") + 1) % HUBS).join(F.broadcast(hubs), ["site_id", "_p"], "left").drop("_p")

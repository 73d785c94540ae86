"""Derived artefacts: page lists, page texts, structured-data candidates, crawler groups to add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: crawlers whose control a policy may lack (fixed values)
CRAWLERS = ("GPTBot", "ChatGPT-User", "ClaudeBot", "PerplexityBot", "Google-Extended", "Applebot-Extended", "CCBot")
FULL_TEXT = 5000
ARTICLE_TYPES = ("Article", "TechArticle", "BlogPosting")


def list_line(title: Column, url: Column, total: Column) -> Column:
    return F.concat(F.lit("- ["), F.coalesce(title, F.lit("")), F.lit("]("), F.coalesce(url, F.lit("")), F.lit("): content-readiness score "), total.cast("string"), F.lit("/100"))


def full_text(title: Column, raw_text: Column) -> Column:
    """A page's section: title, text cut at the bound, a note where it was cut."""
    n = F.length(raw_text)
    note = F.when(n > FULL_TEXT, F.concat(F.lit("\n\n[cut: "), n.cast("string"), F.lit(f" characters, first {FULL_TEXT} shown]"))).otherwise(F.lit(""))
    return F.concat(F.lit("## "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.substring(raw_text, 1, FULL_TEXT), note, F.lit("\n\n---\n"))


def breadcrumb(links: Column) -> Column:
    """JSON of a breadcrumb list from the first five root-relative links with text, or NULL below two."""
    crumbs = F.slice(F.filter(links, lambda x: x["href"].startswith("/") & (F.length(x["text"]) > 0)), 1, 5)
    items = F.transform(crumbs, lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["text"].alias("name"), x["href"].alias("item")))
    whole = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement"))
    return F.when(F.size(crumbs) >= 2, F.to_json(whole))


def has_type(nodes: Column, *types: str) -> Column:
    return F.exists(nodes, lambda n: F.arrays_overlap(n["types"], F.array(*[F.lit(t) for t in types])))


def is_article_candidate(html: Column, meta: Column, headings: Column, paragraphs: Column) -> Column:
    date = F.coalesce(F.nullif(meta["article:published_time"], F.lit("")), F.nullif(meta["date"], F.lit("")))
    return (
        html.rlike(r"(?i)<article(?![A-Za-z0-9_])") & (F.coalesce(meta["author"], F.lit("")) != "") & date.isNotNull()
        & (F.size(headings) >= 2) & (F.size(paragraphs) >= 3)
    )


def missing_crawlers(policies: DataFrame, key: str = "origin", text: str = "text") -> DataFrame:
    """(key, crawler) of crawlers without a group of their own in the policy's text."""
    each = policies.select(key, F.col(text).alias("_t"), F.explode(F.array(*[F.lit(c) for c in CRAWLERS])).alias("crawler"))
    named = F.regexp_like(F.coalesce("_t", F.lit("")), F.concat(F.lit(r"(?i)User-agent:\s*"), F.col("crawler")))
    return each.where(~named).select(key, "crawler")


def article(title: Column, meta: Column, description: Column) -> Column:
    """JSON of an article from a page's own title, author and date."""
    date = F.coalesce(F.nullif(meta["article:published_time"], F.lit("")), F.nullif(meta["date"], F.lit("")))
    author = F.struct(F.lit("Person").alias("@type"), meta["author"].alias("name"))
    whole = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Article").alias("@type"), title.alias("headline"), author.alias("author"),
        date.alias("datePublished"), description.alias("description"),
    )
    return F.to_json(whole)


def site_list(pages: DataFrame, key: str, name: Column, about: Column) -> DataFrame:
    """(key, section, ord, line): the lines of each site's page list in order, head first, for a writer that sorts by (section, ord).

    Rows instead of one text for each site: a site may have a third of all pages.
    """
    heads = pages.groupBy(key).agg(F.min(F.struct("ord", name.alias("name"), about.alias("about"))).alias("h"))
    head = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("ord"), line.alias("line"))
        for i, line in enumerate((F.concat(F.lit("# "), F.col("h.name")), F.lit(""), F.concat(F.lit("> "), F.col("h.about")), F.lit(""), F.lit("## Pages"), F.lit("")))
    ])
    top = heads.select(key, F.lit(0).alias("section"), F.explode(head).alias("x")).select(key, "section", "x.ord", "x.line")
    body = pages.select(key, F.lit(1).alias("section"), F.col("ord").cast("bigint").alias("ord"), list_line(F.col("title"), F.col("url"), F.col("total")).alias("line"))
    return top.unionByName(body)

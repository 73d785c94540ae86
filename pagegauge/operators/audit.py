"""Checks of one page: PASS, WARNING, FAIL or N/A, and counts as evidence.

``page_checks`` audits a fetched page, ``build_checks`` a built HTML file before deployment; they
read the same parsed page but judge differently (tokens of robots directives, titles in the head,
canonicals against a base address), so they stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions.text import trim
from pagegauge.functions.urls import is_web, resolved_url, without_fragment

STATUSES = ("PASS", "WARNING", "FAIL", "N/A")
PAGE_CHECKS = (
    "http-status", "document-title", "meta-description", "heading-structure", "document-language", "canonical-link",
    "robots-directives", "link-discovery", "image-alternatives", "json-ld-structure",
)
BUILD_CHECKS = ("document-title", "meta-description", "canonical", "indexing-directives", "jsonld-syntax", "http-indexing")
#: fixed values: directives of robots tags and headers
BLOCKED = r"(?i)(?:^|[,\s])(?:noindex|none)(?:$|[,\s])"
UNFOLLOWED = r"(?i)(?:^|[,\s])nofollow(?:$|[,\s])"
PARAMETERS = r"(?i)\b(max-snippet|max-image-preview|max-video-preview|unavailable_after):\s+"


def column_name(check: str) -> str:
    return check.replace("-", "_")


def _filled(text: Column) -> Column:
    return trim(F.coalesce(text, F.lit(""))) != ""


def _status(first: Column, name: str) -> Column:
    return F.when(first, F.lit(name))


def robots_values(doc: Column) -> Column:
    """Contents of the robots and googlebot tags, in this order."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(doc["meta_values"]["robots"], empty), F.coalesce(doc["meta_values"]["googlebot"], empty))


def blocks_indexing(doc: Column, header: Column) -> Column:
    """Site-level test: any noindex or none token of tags and header, without binding parameters."""
    joined = F.array_join(F.filter(F.concat(robots_values(doc), F.array(header)), lambda v: F.coalesce(v, F.lit("")) != ""), ", ")
    return joined.rlike(BLOCKED)


def page_checks(pages: DataFrame) -> DataFrame:
    """``pages`` (status, x_robots_tag, final, doc) with one status column for each page check."""
    d = F.col("doc")
    headings = F.coalesce(d["headings"], F.array().cast("array<struct<level:int,text:string>>"))
    n = F.size(headings)
    at = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    skips = F.size(F.filter(at, lambda i: F.get(headings, i)["level"] > F.get(headings, i - 1)["level"] + 1))
    h1 = F.size(F.filter(headings, lambda h: h["level"] == 1))
    canonicals = d["canonicals"]
    resolved = F.col("_canonical")
    robots = F.regexp_replace(F.concat(F.array_join(robots_values(d), ", "), F.lit(", "), F.coalesce("x_robots_tag", F.lit(""))), PARAMETERS, "$1:")
    links = d["links"]
    empty_links = F.size(F.filter(links, lambda x: ~_filled(x["text"])))
    script_links = F.size(F.filter(links, lambda x: x["href"].rlike(r"(?i)\Ajavascript:")))
    no_alt = F.size(F.filter(d["images"], lambda x: x["alt"].isNull()))
    broken = (F.size(F.coalesce(d["diagnostics"], F.array())) > 0) | F.exists(d["nodes"], lambda x: ~x["is_object"])
    values = {
        "http-status": F.when(F.col("status").between(200, 299), "PASS").otherwise("FAIL"),
        "document-title": F.when(_filled(d["document_title"]), "PASS").otherwise("FAIL"),
        "meta-description": F.when(F.coalesce(d["meta"]["description"], F.lit("")) != "", "PASS").otherwise("WARNING"),
        "heading-structure": F.when(n == 0, "FAIL").when((h1 == 0) | (skips > 0), "WARNING").otherwise("PASS"),
        "document-language": F.when(d["language"].isNotNull(), "PASS").otherwise("WARNING"),
        "canonical-link": F.when(F.size(canonicals) == 0, "WARNING").when(F.size(canonicals) > 1, "FAIL").when(resolved.isNull(), "FAIL")
        .when(resolved != without_fragment(F.col("final")), "WARNING").otherwise("PASS"),
        "robots-directives": F.when(robots.rlike(BLOCKED) | robots.rlike(UNFOLLOWED), "WARNING").otherwise("PASS"),
        "link-discovery": F.when((F.size(links) == 0) | (empty_links > 0) | (script_links > 0), "WARNING").otherwise("PASS"),
        "image-alternatives": F.when(F.size(d["images"]) == 0, "N/A").when(no_alt > 0, "WARNING").otherwise("PASS"),
        "json-ld-structure": F.when(broken, "FAIL").when(d["block_count"] == 0, "N/A").otherwise("PASS"),
    }
    with_canonical = pages.where(d.isNotNull()).withColumn("_canonical", resolved_url(F.get(canonicals, F.lit(0)), F.col("final")))
    return with_canonical.withColumns({column_name(k): v for k, v in values.items()}).drop("_canonical")


SAMPLES = 20


def page_evidence(pages: DataFrame) -> DataFrame:
    """``pages`` (status, redirects, x_robots_tag, final, doc) with a column ``evidence``: check, what it saw and what a reader needs to judge it.

    Lists are cut to ``SAMPLES`` entries, as the contract has it; counts are of everything.
    """
    d = F.col("doc")
    headings, links, images = d["headings"], d["links"], d["images"]
    n = F.size(headings)
    at = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    level = lambda i: F.get(headings, i)["level"]
    skipped = F.transform(F.filter(at, lambda i: level(i) > level(i - 1) + 1), lambda i: F.concat(F.lit("H"), level(i - 1).cast("string"), F.lit(" -> H"), level(i).cast("string")))
    outline = F.transform(F.slice(headings, 1, SAMPLES), lambda h: F.concat(F.lit("H"), h["level"].cast("string"), F.lit(": "), h["text"]))
    hops = F.transform(F.coalesce("redirects", F.array().cast("array<struct<from_url:string,to_url:string,status:int>>")),
                       lambda h: F.concat(h["status"].cast("string"), F.lit(" "), h["from_url"], F.lit(" -> "), h["to_url"]))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    some = lambda c: F.array_join(F.slice(c, 1, SAMPLES), " | ")
    no_alt = F.filter(images, lambda x: x["alt"].isNull())
    types = F.array_sort(F.array_distinct(F.flatten(F.transform(d["nodes"], lambda x: x["types"]))))
    seen = {
        "http-status": F.concat(text(F.col("status")), F.lit(", hops "), F.size(hops).cast("string"), F.lit(": "), some(hops)),
        "document-title": text(F.nullif(d["document_title"], F.lit(""))),
        "meta-description": text(d["meta"]["description"]),
        "heading-structure": F.concat(text(n), F.lit(" headings, "), text(F.size(F.filter(headings, lambda h: h["level"] == 1))), F.lit(" h1, skips "), F.array_join(skipped, ", "), F.lit(", outline "), F.array_join(outline, " | ")),
        "document-language": text(d["language"]),
        "canonical-link": some(d["canonicals"]),
        "robots-directives": F.concat(F.array_join(robots_values(d), ", "), F.lit("; header "), text(F.col("x_robots_tag"))),
        "link-discovery": F.concat(text(F.size(links)), F.lit(" links, "), text(F.size(F.filter(links, lambda x: ~_filled(x["text"])))), F.lit(" without text: "), some(F.transform(links, lambda x: x["href"]))),
        "image-alternatives": F.concat(text(F.size(images)), F.lit(" images, "), text(F.size(F.filter(images, lambda x: x["alt"] == ""))), F.lit(" decorative, without alternative: "), some(F.transform(no_alt, lambda x: x["src"]))),
        "json-ld-structure": F.concat(text(d["block_count"]), F.lit(" blocks, types "), F.array_join(types, ", ")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check_id"), seen[k].alias("evidence")) for k in PAGE_CHECKS])
    return pages.where(d.isNotNull()).withColumn("evidence", rows)


def document_checks(docs: DataFrame) -> DataFrame:
    """``docs`` (doc, rendering, base) with one status column for each page check of a document that was not fetched.

    ``rendering`` is html or markdown; ``base`` is its address where it has one.  Markdown need not declare
    what only HTML can: description, language and canonical are N/A there when absent.
    """
    checked = page_checks(docs.withColumn("status", F.lit(200)).withColumn("x_robots_tag", F.lit(None).cast("string")).withColumn("final", F.col("base")))
    d = F.col("doc")
    markdown = F.col("rendering") == "markdown"
    missing = lambda: F.when(markdown, "N/A").otherwise("WARNING")
    href = F.get(d["canonicals"], F.lit(0))
    absolute = href.rlike(r"(?i)\A[a-z][a-z0-9+.\-]*:")
    resolved = F.col("_resolved")
    described = F.coalesce(F.nullif(d["meta"]["description"], F.lit("")), F.get(d["meta_values"]["description"], F.lit(0)))
    values = {
        "http_status": F.lit("N/A"),
        "document_title": F.when(_filled(F.when(markdown, d["title"]).otherwise(d["document_title"])), "PASS").otherwise("FAIL"),
        "meta_description": F.when(F.coalesce(described, F.lit("")) != "", "PASS").otherwise(missing()),
        "document_language": F.when(d["language"].isNotNull(), "PASS").otherwise(missing()),
        "canonical_link": F.when(F.size(d["canonicals"]) == 0, missing()).when(F.size(d["canonicals"]) > 1, "FAIL")
        .when(F.col("base").isNull() & (trim(href) != "") & ~absolute, "N/A").when(resolved.isNull(), "FAIL")
        .when(F.col("base").isNull() | (resolved != without_fragment(F.col("base"))), "WARNING").otherwise("PASS"),
    }
    return checked.withColumn("_resolved", resolved_url(href, F.col("base"))).withColumns(values).drop("_resolved", "status", "x_robots_tag", "final")


def build_checks(pages: DataFrame, base: str | None = None, expect_indexable: bool = False) -> DataFrame:
    """``pages`` (doc) with one status column for each build check; ``base`` names a column with the deployed address."""
    d = F.col("doc")
    descriptions = F.coalesce(d["meta_values"]["description"], F.array().cast("array<string>"))
    href = F.get(d["canonicals"], F.lit(0))
    absolute = href.rlike(r"(?i)\A[a-z][a-z0-9+.\-]*:")
    address = F.col(base) if base else F.lit(None).cast("string")
    html_base = F.when(d["base_href"].isNotNull(), resolved_url(d["base_href"], F.coalesce(address, F.lit("https://audit.invalid/"))))
    against = F.when(absolute, F.lit(None).cast("string")).otherwise(F.coalesce(html_base, address))
    target = F.col("_target")
    valid = is_web(target) & ~href.rlike(r"[\x00-\x20\x7f]") & ~target.rlike(r"^https?://[^/]*@")
    tokens = F.flatten(F.transform(robots_values(d), lambda v: F.split(F.regexp_replace(F.lower(v), r":\s+", ":"), r"[\s,]+")))
    blocked = F.arrays_overlap(tokens, F.array(F.lit("noindex"), F.lit("none")))
    kinds = F.transform(F.coalesce(d["diagnostics"], F.array().cast("array<struct<message:string,severity:string,kind:string,line:int,block:int,path:string>>")), lambda x: x["kind"])
    values = {
        "document-title": F.when((F.size(d["titles"]) == 1) & _filled(F.get(d["titles"], F.lit(0))), "PASS").otherwise("WARNING"),
        "meta-description": F.when((F.size(descriptions) == 1) & _filled(F.get(descriptions, F.lit(0))), "PASS").otherwise("WARNING"),
        "canonical": F.when(F.size(d["canonicals"]) == 0, "WARNING").when((F.size(d["canonicals"]) > 1) | ~_filled(href), "FAIL")
        .when(~absolute & against.isNull(), "N/A").when(target.isNull() | ~valid, "FAIL").when(href.contains("#"), "WARNING").otherwise("PASS"),
        "indexing-directives": F.when(blocked, "FAIL" if expect_indexable else "WARNING").otherwise("PASS"),
        "jsonld-syntax": F.when(d["block_count"] == 0, "N/A").when(F.exists(kinds, lambda k: k.isin("syntax", "root")), "FAIL")
        .when(F.size(kinds) > 0, "WARNING").otherwise("PASS"),
        "http-indexing": F.lit("N/A"),
    }
    with_target = pages.where(d.isNotNull()).withColumn("_against", against).withColumn("_target", resolved_url(href, F.col("_against")))
    return with_target.withColumns({"b_" + column_name(k): v for k, v in values.items()}).drop("_target", "_against")


def status_counts(checked: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """How often each status occurs, for each check; all four are always there."""
    long = checked.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("check_id"), F.col(c).alias("s")) for c in columns])).alias("x"))
    counts = [F.count_if(F.col("x.s") == s).alias("n_" + s.lower().replace("/", "")) for s in STATUSES]
    return long.groupBy(*by, F.col("x.check_id").alias("check_id")).agg(*counts)


def build_duplicates(checked: DataFrame) -> DataFrame:
    """(check_id, value, n_files): titles and canonicals that several built files share, unless all are translations of each other.

    ``checked`` is the result of ``build_checks`` with the files' addresses in ``final``.  Files are
    reduced to distinct (value, address); the pairs that list each other as translation are counted
    from the alternates, so no pairs of a group are built.
    """
    d = F.col("doc")
    title = F.when(F.col("b_document_title") == "PASS", F.lower(trim(F.get(d["titles"], F.lit(0)))))
    canonical = F.when(F.col("b_canonical").isin("PASS", "WARNING") & (F.size(d["canonicals"]) == 1), without_fragment(resolved_url(F.get(d["canonicals"], F.lit(0)), F.col("final"))))
    values = F.array(F.struct(F.lit("duplicate-title").alias("check_id"), title.alias("value")), F.struct(F.lit("duplicate-canonical").alias("check_id"), canonical.alias("value")))
    rows = checked.select("final", F.lower(d["language"]).alias("lang"), d["alternates"].alias("alternates"), F.explode(values).alias("v")).select("final", "lang", "alternates", "v.*").where("value IS NOT NULL")
    groups = rows.groupBy("check_id", "value").agg(F.countDistinct("final").alias("n_files")).where("n_files > 1")
    titled = rows.where("check_id = 'duplicate-title'")
    listed = titled.select("value", "final", "lang", F.explode("alternates").alias("a")).select("value", "final", "lang", resolved_url(F.col("a.href"), F.col("final")).alias("other"), F.col("a.lang").alias("other_lang")).distinct()
    back = listed.select("value", F.col("final").alias("other"), F.col("lang").alias("other_lang"), F.col("other").alias("final"), F.col("other_lang").alias("lang"))
    mutual = listed.join(back, ["value", "final", "lang", "other", "other_lang"], "left_semi").where((F.col("final") < F.col("other")) & (F.col("lang") != F.col("other_lang")))
    pairs = mutual.groupBy("value").agg(F.countDistinct("final", "other").alias("mutual")).withColumn("check_id", F.lit("duplicate-title"))
    return groups.join(pairs, ["check_id", "value"], "left").where(F.coalesce("mutual", F.lit(0)) < F.col("n_files") * (F.col("n_files") - 1) / 2).select("check_id", "value", "n_files")

"""Audits of pages and relations of sites over the fetches, with their SQL.

The synthetic pages carry no canonical, robots or JSON-LD tags, no images and no links to each other;
``pages.TAGGED_HTML`` adds some by the fetch's id, in Spark and in DuckDB alike.  The sitemap of a site is the two thirds
of its addresses whose fetch id is not divisible by three.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.functions import text as tx
from pagegauge.functions import urls
from pagegauge.functions.documents import parsed_html, parsed_markdown
from pagegauge.functions.reviews import parsed_review
from pagegauge.operators import audit, crawl, robots, site, sitemap
from pagegauge.operators.pages import HUBS, TAGGED_HTML, latest, parsed_pages, with_hubs
from pagegauge.session import cut_lineage
from pagegauge.sources.tables import read_spread, read_table

_COLUMNS = ("fetch_id", "site_id", "requested_url", "final_url", "status", "redirects", "content_type", "x_robots_tag", "html", "fetched_at", "loaded_at")


#: what relations need of a parsed page
_DOC = ("document_title", "language", "links", "canonicals", "alternates", "meta_values")
_SLIM = ("origin", "url", "final", "status", "redirects", "x_robots_tag", "fetched_at", "doc")


#: what checks need besides
_CHECKED = ("document_title", "titles", "title", "headings", "meta", "meta_values", "links", "images", "language", "canonicals", "base_href", "alternates", "nodes", "diagnostics", "block_count")


def parsed(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    """All rows of the fetches, parsed where they lie; of the documents these fields."""
    return parsed_pages(with_hubs(read_spread(spark, folder, "fetches", *_COLUMNS)), F.expr(TAGGED_HTML), fields or _CHECKED)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each fetch with the fields that relations need."""
    return latest(parsed(spark, folder, *_DOC), *_SLIM)


def pages_once(spark: SparkSession, folder: str) -> DataFrame:
    """``pages``, parsed once and written to the shared folder."""
    return cut_lineage(pages(spark, folder))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "fetches", "fetch_id", "requested_url").where("fetch_id % 3 <> 0")
    named = rows.select(urls.normal_url("requested_url").alias("url")).where("url IS NOT NULL").distinct()
    return named.select(urls.origin(F.col("url")).alias("origin"), "url")


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "sites", "origin").select(F.concat("origin", F.lit("/")).alias("url"))


def page_facts(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc")
    p = parsed(spark, folder).where(d.isNotNull())
    facts = p.select(
        "fetch_id", "loaded_at", "fetched_at", d["document_title"].alias("title"), d["language"].alias("lang"), F.size(d["headings"]).cast("bigint").alias("n_headings"),
        F.size(F.filter(d["headings"], lambda h: h["level"] == 1)).cast("bigint").alias("n_h1"), F.size(d["links"]).cast("bigint").alias("n_links"),
        F.size(d["canonicals"]).cast("bigint").alias("n_canonicals"), d["meta"]["description"].alias("description"),
    )
    return latest(facts, *facts.columns[3:])


def audit_checks(spark: SparkSession, folder: str) -> DataFrame:
    return latest(audit.page_checks(parsed(spark, folder)), *map(audit.column_name, audit.PAGE_CHECKS))


def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    return audit.status_counts(audit_checks(spark, folder), [audit.column_name(c) for c in audit.PAGE_CHECKS])


def page_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What each check of each page saw."""
    seen = latest(audit.page_evidence(parsed(spark, folder)), "evidence")
    return seen.select("fetch_id", F.explode("evidence").alias("x")).select("fetch_id", "x.check_id", "x.evidence").where("check_id <> 'document-title'")


def document_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Page checks of the fixture documents' HTML and Markdown, which were not fetched; every third has no address."""
    docs = read_spread(spark, folder, "fixture_docs", "fixture_id", "url", "html", "markdown")
    base = F.when(F.col("fixture_id") % 3 != 0, urls.normal_url("url"))
    front = F.when(F.col("fixture_id") % 4 == 0, F.concat(F.lit(_FRONT_MATTER), "markdown")).otherwise(F.col("markdown"))
    html = docs.where(F.length("html") > 0).select("fixture_id", F.lit("html").alias("rendering"), base.alias("base"), parsed_html("html").alias("doc"))
    text = docs.where(F.length("markdown") > 0).select("fixture_id", F.lit("markdown").alias("rendering"), base.alias("base"), parsed_markdown(front).alias("doc"))
    checked = audit.document_checks(html.unionByName(text))
    return checked.select("fixture_id", "rendering", *map(audit.column_name, audit.PAGE_CHECKS)).distinct()


_FRONT_MATTER = "---\ntitle: A page\ndescription: 'About it'\nlang: en # short\nnumber: 12\ncanonical: /here\n---\n"


def markdown_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Headings, links, images and plain text of the fixture documents' Markdown, fences left out; every fourth with front matter."""
    docs = read_spread(spark, folder, "fixture_docs", "fixture_id", "markdown").where(F.length("markdown") > 0)
    front = F.when(F.col("fixture_id") % 4 == 0, F.concat(F.lit(_FRONT_MATTER), "markdown")).otherwise(F.col("markdown"))
    d = F.col("doc")
    return docs.select("fixture_id", parsed_markdown(front).alias("doc")).select(
        "fixture_id", d["document_title"].alias("title"), d["language"].alias("lang"), F.size(d["headings"]).cast("bigint").alias("n_headings"),
        F.md5(F.array_join(F.transform(d["headings"], lambda h: F.concat(h["level"].cast("string"), F.lit(" "), h["text"])), "|")).alias("headings_md5"),
        F.size(d["links"]).cast("bigint").alias("n_links"), F.size(d["images"]).cast("bigint").alias("n_images"), F.md5(d["raw_text"]).alias("raw_md5"),
    ).distinct()


def build_checks(spark: SparkSession, folder: str) -> DataFrame:
    return latest(audit.build_checks(parsed(spark, folder)), *["b_" + audit.column_name(c) for c in audit.BUILD_CHECKS])


def link_edges(spark: SparkSession, folder: str) -> DataFrame:
    return site.link_edges(pages(spark, folder)).distinct()


def link_counts(spark: SparkSession, folder: str) -> DataFrame:
    return site.link_counts(site.link_edges(pages(spark, folder)).distinct())


def internal_targets(spark: SparkSession, folder: str) -> DataFrame:
    return site.targets(site.link_edges(pages(spark, folder)))


def broken_targets(spark: SparkSession, folder: str) -> DataFrame:
    p = pages_once(spark, folder)
    return site.broken_targets(site.link_edges(p), site.page_lookup(p))


def unchecked_targets(spark: SparkSession, folder: str) -> DataFrame:
    p = pages_once(spark, folder)
    edges = site.link_edges(p)
    return site.unchecked_targets(edges, site.page_lookup(p), _denied(spark, folder, site.targets(edges)))


def verified_canonicals(spark: SparkSession, folder: str) -> DataFrame:
    p = pages_once(spark, folder)
    return site.verified_canonicals(p, site.page_lookup(p))


def canonical_findings(spark: SparkSession, folder: str) -> DataFrame:
    p = pages_once(spark, folder)
    return site.canonical_findings(p, site.page_lookup(p))


def duplicate_titles(spark: SparkSession, folder: str) -> DataFrame:
    p = pages_once(spark, folder)
    return site.duplicate_titles(p, site.page_lookup(p))


def finding_members(spark: SparkSession, folder: str) -> DataFrame:
    """The pages behind each shared canonical and each duplicate title."""
    p = pages_once(spark, folder)
    return site.group_members(p, cut_lineage(site.page_lookup(p)))


def sitemap_omissions(spark: SparkSession, folder: str) -> DataFrame:
    p = pages_once(spark, folder)
    return site.sitemap_omissions(p, site.page_lookup(p), _listed(spark, folder))


def orphan_candidates(spark: SparkSession, folder: str) -> DataFrame:
    listed = _listed(spark, folder)
    return site.orphan_candidates(site.link_edges(pages(spark, folder)), listed, _starts(spark, folder), _denied(spark, folder, listed))


def site_findings_derived(spark: SparkSession, folder: str) -> DataFrame:
    return site.site_findings(pages_once(spark, folder), _listed(spark, folder), _starts(spark, folder), lambda urls: _denied(spark, folder, urls))


def page_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return site.page_metrics(pages(spark, folder))


def site_metrics_derived(spark: SparkSession, folder: str) -> DataFrame:
    return site.site_metrics(pages_once(spark, folder), _listed(spark, folder), _starts(spark, folder), lambda urls: _denied(spark, folder, urls))


def sitemap_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of the sitemap that answered with an error or not at all."""
    return site.sitemap_pages(site.page_lookup(pages(spark, folder)), _listed(spark, folder))


def discovered_from(spark: SparkSession, folder: str) -> DataFrame:
    """The different pages that link to each page, under its requested or its final address."""
    p = pages_once(spark, folder)
    return site.discovered_from(site.link_edges(p), p)


def sitemap_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Sitemaps that failed, are unavailable or unreadable; answers by the site's id."""
    return site.sitemap_classes(_sitemap_answers(spark, folder))


def _sitemap_answers(spark: SparkSession, folder: str) -> DataFrame:
    sites = read_table(spark, folder, "sites", "site_id", "origin")
    return sites.select("origin", F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.expr(_SITEMAP_STATUS).alias("status"), F.expr(_SITEMAP_KIND).alias("kind"))


def site_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The nine checks of each site with their counts."""
    p = pages_once(spark, folder)
    answers = read_table(spark, folder, "sites", "site_id", "origin").select("origin", F.expr(_ROBOTS_STATUS).alias("status"))
    return site.site_checks(p, _listed(spark, folder), _starts(spark, folder), answers, _sitemap_answers(spark, folder), lambda urls: _denied(spark, folder, urls))


def site_check_summary(spark: SparkSession, folder: str) -> DataFrame:
    checked = site_checks(spark, folder)
    counts = [F.count_if(F.col("status") == s).alias("n_" + s.lower().replace("/", "")) for s in audit.STATUSES]
    return checked.groupBy("check_id").agg(*counts)


def build_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    checked = audit.build_checks(parsed(spark, folder), base="final")
    slim = F.struct("doc.titles", "doc.canonicals", "doc.language", "doc.alternates")
    return audit.build_duplicates(latest(checked.withColumn("doc", slim), "final", "doc", "b_document_title", "b_canonical"))


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Scores read out of review texts that are built from the sites' ids."""
    sites = read_table(spark, folder, "sites", "site_id", "brand")
    return sites.select("site_id", parsed_review(F.expr(_REVIEW)).alias("r")).select("site_id", "r.available", "r.score", "r.structure", "r.schema", "r.aiMetadata", "r.insight")


_REVIEW = (
    "CASE site_id % 7 WHEN 0 THEN 'no answer' WHEN 1 THEN concat('Sure: {\"score\": ', site_id, '.5, \"structure\": ', site_id % 40, ', \"schema\": -3, \"insight\": \"{', brand, '}\"} done {}') "
    "WHEN 2 THEN concat('{\"x\": {\"score\": ', site_id % 101, ', \"structure\": 9, \"schema\": 7}}') WHEN 3 THEN '{\"score\": 12' "
    "WHEN 4 THEN '{\"score\": \"80\", \"structure\": 3}' WHEN 5 THEN concat('{\"structure\": 4, \"score\": ', site_id % 90, ', \"aiMetadata\": 7.5, \"insight\": \"a } b\"}') "
    "ELSE concat('{\"dimensions\": {\"structure\": 20}, \"score\": ', site_id % 50, ', \"aiMetadata\": null}') END"
)


#: each address, and one that the gate judges otherwise
_GATED = (
    "array(requested_url, CASE fetch_id % 6 WHEN 0 THEN concat('http://10.', fetch_id % 256, '.0.1/x') WHEN 1 THEN concat('http://172.', fetch_id % 40, '.0.1/') "
    "WHEN 2 THEN concat(regexp_extract(requested_url, '^https?://[^/?#]+', 0), '/cdn-cgi/l/email-protection') WHEN 3 THEN concat('http://localhost/', fetch_id % 7) "
    "WHEN 4 THEN concat('https://169.', 250 + fetch_id % 6, '.1.1/') ELSE concat('http://192.168.', fetch_id % 9, '.1/?q=1') END)"
)


def url_gate(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("requested_url")
    base = read_table(spark, folder, "fetches", "fetch_id", "requested_url")
    rows = base.select(F.explode(F.expr(_GATED)).alias("requested_url")).distinct()
    return rows.select(
        u, urls.normal_url(u).alias("url"), urls.is_web(u).alias("is_web"), urls.is_blocked_host(u).alias("is_blocked"), urls.is_mail_protection(u).alias("is_mail"),
        urls.path_and_query(u).alias("path"), urls.origin(u).alias("origin"),
    )


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt excerpt, escaped start, preview and script-page test of each page."""
    h = F.col("html")
    rows = read_spread(spark, folder, "fetches", "fetch_id", "html", "fetched_at", "loaded_at").where(F.length(h) > 0)
    texts = rows.select(
        "fetch_id", "loaded_at", "fetched_at", F.length(tx.prompt_excerpt(h)).cast("bigint").alias("excerpt_chars"), F.md5(tx.prompt_excerpt(h)).alias("excerpt_md5"),
        F.md5(tx.escape_html(h)).alias("escaped_md5"), F.md5(F.substring(h, 1, 6000)).alias("preview_md5"), (F.length(h) > 6000).alias("truncated"),
        tx.likely_script_page(h).alias("script_page"),
    )
    return latest(texts, *texts.columns[3:])


def redirect_hops(spark: SparkSession, folder: str) -> DataFrame:
    """Final address of each redirect chain, followed over the table of all hops."""
    rows = read_table(spark, folder, "fetches", "redirects").select(F.explode("redirects").alias("h"))
    hops = rows.select("h.from_url", "h.to_url").groupBy("from_url").agg(F.min("to_url").alias("to_url"))
    return crawl.follow_redirects(hops)


_ROBOTS_STATUS = "CASE site_id % 10 WHEN 7 THEN 503 WHEN 8 THEN 404 ELSE 200 END"
_SITEMAP_STATUS = "CASE site_id % 8 WHEN 1 THEN 500 WHEN 2 THEN 0 WHEN 3 THEN 404 ELSE 200 END"
_SITEMAP_KIND = "CASE site_id % 8 WHEN 5 THEN 'unknown' WHEN 0 THEN 'urlset' WHEN 4 THEN 'index' WHEN 6 THEN 'urlset' WHEN 7 THEN 'urlset' ELSE 'unknown' END"
#: robots.txt of a site, by its id
_ROBOTS = (
    "concat('# policy', chr(10), 'User-agent: *', chr(10), 'Disallow: /news/', chr(10), 'Allow: /news/*a', chr(10), 'Disallow:', chr(10), "
    "CASE site_id % 3 WHEN 0 THEN concat('User-agent: other', chr(10), 'Disallow: /', chr(10)) WHEN 1 THEN concat('User-agent: PageGauge', chr(10), "
    "'Disallow: /*.html$', chr(10), 'Disallow: /blog', chr(10), 'Allow: /blog/m', chr(10)) ELSE concat('User-agent: gauge', chr(10), 'User-agent: pagegauge', chr(10), "
    "'Disallow: /help/ # closed', chr(10), 'Sitemap: ', origin, '/sitemap.xml', chr(10)) END)"
)


def _policies(spark: SparkSession, folder: str) -> DataFrame:
    sites = read_table(spark, folder, "sites", "site_id", "origin")
    text = robots.effective_text(F.expr(_ROBOTS_STATUS), F.expr(_ROBOTS))
    return sites.select("origin", text.alias("text"))


def _denied(spark: SparkSession, folder: str, addresses: DataFrame) -> DataFrame:
    """(url) of the addresses (origin, url) that the site's robots.txt closes to the crawl."""
    rules = robots.selected_rules(robots.policy_lines(_policies(spark, folder)))
    return robots.decisions(addresses.select("origin", "url").distinct(), rules).where(~F.col("allowed")).select("url")


def robots_rules(spark: SparkSession, folder: str) -> DataFrame:
    return robots.selected_rules(robots.policy_lines(_policies(spark, folder))).select("origin", "directive", "pattern")


def robots_decisions(spark: SparkSession, folder: str) -> DataFrame:
    addresses = read_table(spark, folder, "fetches", "requested_url").select(urls.normal_url("requested_url").alias("url")).where("url IS NOT NULL").distinct()
    with_origin = addresses.withColumn("origin", urls.origin(F.col("url")))
    return robots.decisions(with_origin, robots.selected_rules(robots.policy_lines(_policies(spark, folder)))).select("url", "allowed")


def sitemap_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Sitemap documents built from the fetched addresses, one for each site and an index, walked from the index."""
    listed = _listed(spark, folder)
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
                   F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit("<url><loc>"), tx.escape_html(u), F.lit("</loc></url>"))), ""), F.lit("</urlset>"))
    leaves = listed.groupBy("origin").agg(xml.alias("body")).select("origin", F.concat("origin", F.lit("/pages.xml")).alias("url"), F.lit(200).alias("status"), "body")
    index = leaves.select(
        "origin", F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.lit(200).alias("status"),
        F.concat(F.lit("<sitemapindex><sitemap><loc>"), "url", F.lit("</loc></sitemap><sitemap><loc>/gone.xml</loc></sitemap></sitemapindex>")).alias("body"),
    )
    read = sitemap.read_sitemaps(leaves.unionByName(index))
    starts = index.select("origin", "url", F.lit(0).alias("pos"))
    return sitemap.walk_sitemaps(read, starts).select("origin", "url", "status", "kind", F.col("n_urls").cast("bigint").alias("n_urls"))


def _crawl_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    edges = cut_lineage(site.link_edges(pages(spark, folder)))
    starts = _starts(spark, folder)
    starts = starts.select(urls.origin(F.col("url")).alias("origin"), "url")
    rows = read_table(spark, folder, "fetches", "fetch_id", "requested_url").where("fetch_id % 3 <> 0")
    entries = rows.select(urls.normal_url("requested_url").alias("url"), F.col("fetch_id").alias("pos")).where("url IS NOT NULL").select(urls.origin(F.col("url")).alias("origin"), "url", "pos")
    targets = edges.where("internal").select("origin", F.col("dst").alias("url"))
    denied = cut_lineage(_denied(spark, folder, targets.unionByName(entries.select("origin", "url")).unionByName(starts)))
    return edges, starts, entries, denied


def crawl_order(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that a crawl of each site requests within the default limit, in order: links first, then the sitemap."""
    return crawl.crawl_order(*_crawl_inputs(spark, folder))


def crawl_rest(spark: SparkSession, folder: str) -> DataFrame:
    """How many pages each crawl requested, what it left in its queues, and whether its limit cut it off."""
    edges, starts, entries, denied = _crawl_inputs(spark, folder)
    return crawl.crawl_rest(crawl.crawl_order(edges, starts, entries, denied), edges, entries, denied)


def _plain(text: str) -> str:
    """SQL that resolves the entities of Latin letters and marks."""
    named = {n: c for n, c in html5.items() if n.endswith(";") and len(c) == 1 and "\xc0" <= c <= "\xff" and f"&{n}" not in ("&times;", "&divide;")}
    for name, letter in {**{n[:-1]: c for n, c in named.items()}, "quot": '"', "#39": "''", "lt": "<", "gt": ">", "amp": "&"}.items():
        text = f"replace({text}, '&{name};', '{letter}')"
    return text


_TITLE = "trim(" + _plain("regexp_extract(h, '(?s)<title>(.*?)</title>', 1)") + ")"
_SEL = f"""sel AS (SELECT origin, unnest(CASE WHEN {_ROBOTS_STATUS} = 503 THEN [{{'d': 'disallow', 'p': '/'}}] WHEN {_ROBOTS_STATUS} = 404 THEN [] WHEN site_id % 3 = 0 THEN
  [{{'d': 'disallow', 'p': '/news/'}}, {{'d': 'allow', 'p': '/news/*a'}}] WHEN site_id % 3 = 1 THEN
  [{{'d': 'disallow', 'p': '/*.html$'}}, {{'d': 'disallow', 'p': '/blog'}}, {{'d': 'allow', 'p': '/blog/m'}}] ELSE [{{'d': 'disallow', 'p': '/help/'}}] END) AS r FROM sites)"""
_PAGES = f"""
WITH pg0 AS (SELECT DISTINCT ON (fetch_id) * FROM fetches ORDER BY fetch_id, coalesce(loaded_at, fetched_at) DESC),
pg AS (SELECT *, status BETWEEN 200 AND 299 AND html IS NOT NULL AND (coalesce(lower(content_type) LIKE '%html%', false) OR regexp_matches(html, '(?i)^\\s*(?:<!doctype\\s+html|<html\\b)')) AS readable,
  {TAGGED_HTML} AS tagged FROM pg0 LEFT JOIN (SELECT site_id AS hub_site, fetch_id % {HUBS} AS place, CASE WHEN (fetch_id % {HUBS}) % 2 = 0 THEN max({{'s': coalesce(status, 0), 'u': requested_url}}).u ELSE min(requested_url) END AS hub FROM fetches GROUP BY site_id, fetch_id % {HUBS}) ON hub_site = site_id AND place = (fetch_id + 1) % {HUBS}),
p0 AS (SELECT fetch_id, status, x_robots_tag, redirects, fetched_at, requested_url AS url, coalesce(final_url, requested_url) AS final, regexp_extract(coalesce(final_url, requested_url), '^https?://[^/?#]+') AS origin, readable,
  regexp_replace(regexp_replace(tagged, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g') AS h, tagged FROM pg),
p AS (SELECT *, regexp_extract_all(h, '(?i)<a\\s(?:[^>]*\\s)?href="([^"]*)"[^>]*>', 1) AS hrefs FROM p0),
el AS (SELECT DISTINCT origin, src, dst, regexp_extract(dst, '^https?://[^/?#]+') = origin AS internal FROM (SELECT origin, src, CASE WHEN regexp_matches(x, '^https?://') THEN x ELSE
  origin || replace(replace(replace(replace(url_encode(x), '%2F', '/'), '%3F', '?'), '%3D', '='), '%26', '&') END AS dst FROM (SELECT origin, final AS src, regexp_replace(unnest(hrefs), '#.*$', '') AS x FROM p WHERE readable))
  WHERE NOT (dst = origin || '/cdn-cgi/l/email-protection')),
e AS (SELECT origin, src, dst FROM el WHERE internal),
lk AS (SELECT DISTINCT ON (address) address, status, final AS final_address, len(redirects) AS hops FROM (
  SELECT unnest(list_distinct([url, final])) AS address, * EXCLUDE (h, tagged, hrefs) FROM p) ORDER BY address, fetched_at DESC, fetch_id DESC),
can AS (SELECT origin, final, x_robots_tag, fetch_id, h, CASE fetch_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END * CASE WHEN contains(h, '</head>') THEN 1 ELSE 0 END AS n FROM p WHERE readable),
cr AS (SELECT DISTINCT origin, final, n, value, CASE WHEN value = 'mailto:a@b.example' THEN NULL WHEN starts_with(value, '/') THEN origin || value ELSE value END AS resolved FROM (
  SELECT origin, final, n, unnest(CASE WHEN n = 0 THEN [NULL] WHEN fetch_id % 5 = 1 THEN [final] WHEN fetch_id % 5 = 2 THEN ['/'] WHEN fetch_id % 5 = 3 THEN ['/a', '/b'] ELSE ['mailto:a@b.example'] END) AS value FROM can)),
open AS (SELECT DISTINCT origin, final FROM can WHERE NOT regexp_matches(concat_ws(', ', CASE WHEN contains(h, '</head>') THEN CASE fetch_id % 7 WHEN 0 THEN 'noindex, follow' WHEN 1 THEN 'max-snippet: 20, nofollow'
  WHEN 2 THEN 'max-image-preview: none' END END, x_robots_tag), '(?i)(?:^|[,\\s])(?:noindex|none)(?:$|[,\\s])')),
ver AS (SELECT DISTINCT c.final, c.resolved AS target FROM cr c JOIN lk ON lk.address = c.resolved AND lk.status = 200 AND lk.hops = 0 AND lk.final_address = lk.address
  WHERE c.n = 1 AND c.resolved IS NOT NULL AND c.resolved IN (SELECT final FROM cr WHERE n = 1 AND resolved = final) AND c.resolved IN (SELECT final FROM open)),
tg AS (SELECT origin, dst AS url, count(DISTINCT src) AS n_sources FROM e GROUP BY ALL),
listed AS (SELECT DISTINCT regexp_extract(requested_url, '^https?://[^/?#]+') AS origin, requested_url AS url FROM fetches WHERE fetch_id % 3 <> 0),
cf AS (SELECT origin, 'missing-canonical' AS kind, final AS target FROM cr WHERE n = 0
  UNION SELECT origin, 'malformed-canonical', final FROM cr WHERE n > 1
  UNION SELECT origin, 'malformed-canonical', final || ' -> ' || value FROM cr WHERE n > 0 AND resolved IS NULL
  UNION SELECT origin, 'non-self-canonical', final || ' -> ' || resolved FROM cr WHERE resolved <> final AND final NOT IN (SELECT final FROM ver)
  UNION SELECT origin, 'shared-canonical', resolved FROM (SELECT c.origin, c.resolved, count(DISTINCT c.final) AS n, bool_and(coalesce(v.target = c.resolved, false)) AS ok
    FROM (SELECT DISTINCT origin, resolved, final FROM cr WHERE resolved IS NOT NULL) c LEFT JOIN ver v USING (final) GROUP BY ALL) WHERE n > 1 AND NOT ok),
ti AS (SELECT origin, lower({_TITLE}) AS title, final FROM p WHERE readable),
dt AS (SELECT ti.origin, title, count(DISTINCT ti.final) AS n_pages, count(DISTINCT coalesce(target, ti.final)) AS n FROM ti LEFT JOIN ver ON ver.final = ti.final WHERE title <> '' GROUP BY ALL HAVING n > 1),
so AS (SELECT DISTINCT o.origin, coalesce(target, o.final) AS url FROM open o LEFT JOIN ver ON ver.final = o.final WHERE o.origin IN (SELECT origin FROM listed) AND coalesce(target, o.final) NOT IN (SELECT url FROM listed)),
{_SEL},
kn AS (SELECT origin, url FROM tg UNION SELECT origin, url FROM listed),
dis AS (SELECT url FROM (SELECT url, arg_max(d = 'allow', size * 2 + (d = 'allow')::INT) AS ok FROM (SELECT kn.url, r.d, length(replace(replace(r.p, '*', ''), '$', '')) AS size FROM kn JOIN sel USING (origin)
  WHERE regexp_matches(regexp_replace(kn.url, '^https?://[^/?#]+', ''), '^' || replace(replace(regexp_replace(r.p, '[$]$', ''), '.', '[.]'), '*', '.*') || CASE WHEN ends_with(r.p, '$') THEN '$' ELSE '' END)) GROUP BY url) WHERE NOT ok),
un AS (SELECT * FROM tg WHERE url NOT IN (SELECT address FROM lk WHERE status <> 0) AND url NOT IN (SELECT url FROM dis)),
qu AS (SELECT * FROM kn WHERE url NOT IN (SELECT address FROM lk) AND url NOT IN (SELECT url FROM dis)),
sp AS (SELECT l.origin, l.url, CASE WHEN status >= 400 THEN 'broken' ELSE 'unavailable' END AS kind FROM listed l JOIN lk ON lk.address = l.url WHERE status >= 400 OR status = 0),
sc AS (SELECT origin, url, CASE WHEN status = 0 THEN 'unavailable' WHEN status NOT IN (200, 404) THEN 'failed' ELSE 'invalid' END AS class FROM (
  SELECT origin, origin || '/sitemap.xml' AS url, {_SITEMAP_STATUS} AS status, {_SITEMAP_KIND} AS kind FROM sites) WHERE status NOT IN (200, 404) OR (status = 200 AND kind = 'unknown')),
oc AS (SELECT origin, url FROM listed WHERE url NOT IN (SELECT url FROM dis) AND url NOT IN (SELECT origin || '/' FROM sites) AND url NOT IN (SELECT dst FROM e WHERE src <> dst)),
lv AS (SELECT *, [CAST(x AS INT) FOR x IN regexp_extract_all(h, '(?i)<h([1-6])(?:\\s[^>]*)?>', 1)] AS levels FROM p)
"""
_SKIP = "len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] > levels[i - 1] + 1)) > 0"
_HEAD = "contains(h, '</head>')"
_CHECKS = f"""SELECT fetch_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'PASS' ELSE 'FAIL' END AS http_status,
  CASE WHEN trim(regexp_extract(h, '(?s)<title>(.*?)</title>', 1)) <> '' THEN 'PASS' ELSE 'FAIL' END AS document_title,
  CASE WHEN regexp_matches(h, '<meta name="description" content="[^"]+"') THEN 'PASS' ELSE 'WARNING' END AS meta_description,
  CASE WHEN len(levels) = 0 THEN 'FAIL' WHEN NOT list_contains(levels, 1) OR {_SKIP} THEN 'WARNING' ELSE 'PASS' END AS heading_structure,
  CASE WHEN regexp_matches(h, '(?i)<html[^>]*\\slang="[^"]+"') THEN 'PASS' ELSE 'WARNING' END AS document_language,
  CASE WHEN NOT {_HEAD} OR fetch_id % 5 = 0 THEN 'WARNING' WHEN fetch_id % 5 IN (3, 4) THEN 'FAIL' WHEN fetch_id % 5 = 2 AND final <> origin || '/' THEN 'WARNING' ELSE 'PASS' END AS canonical_link,
  CASE WHEN {_HEAD} AND fetch_id % 7 IN (0, 1) OR regexp_matches(coalesce(x_robots_tag, ''), '(?i)(?:^|[,\\s])(?:noindex|none|nofollow)(?:$|[,\\s])') THEN 'WARNING' ELSE 'PASS' END AS robots_directives,
  CASE WHEN len(hrefs) = 0 OR regexp_matches(h, '(?i)<a\\s[^>]*href="[^"]+"[^>]*>\\s*(?:</a>|$)') THEN 'WARNING' ELSE 'PASS' END AS link_discovery, CASE WHEN NOT contains(h, '</body>') OR fetch_id % 6 NOT IN (2, 4) THEN 'N/A' WHEN fetch_id % 6 = 2 THEN 'WARNING' ELSE 'PASS' END AS image_alternatives,
  CASE WHEN NOT {_HEAD} OR fetch_id % 4 > 1 THEN 'N/A' WHEN fetch_id % 4 = 0 THEN 'PASS' ELSE 'FAIL' END AS json_ld_structure FROM lv WHERE readable"""
_HEADING = "regexp_replace(replace(" + _plain("regexp_replace(regexp_extract_all(h, '(?is)<h[1-6](?:\\s[^>]*)?>(.*?)</h[1-6]>', 1)[i], '</?[a-zA-Z][^>]*>', '', 'g')") + ", chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g')"
_NAMES = [audit.column_name(c) for c in audit.PAGE_CHECKS]
_SUMMARY = " UNION ALL ".join(
    f"SELECT '{n}' AS check_id, count_if({n} = 'PASS') AS n_pass, count_if({n} = 'WARNING') AS n_warning, count_if({n} = 'FAIL') AS n_fail, count_if({n} = 'N/A') AS n_na FROM c" for n in _NAMES
)
_RULES = f"WITH {_SEL}\n"

_COUNTS = {w: c for c, e in site.EVIDENCE.items() for w in e}
_SITE_CHECKS = _PAGES + """, f AS (SELECT origin, 'pages' AS what FROM p UNION ALL SELECT origin, 'failed' FROM p WHERE status >= 400 UNION ALL SELECT origin, 'silent' FROM p WHERE status = 0
  UNION ALL SELECT origin, 'long' FROM p WHERE len(redirects) > 1 UNION ALL SELECT origin, 'html' FROM p WHERE readable UNION ALL SELECT origin, 'queued' FROM qu
  UNION ALL SELECT origin, 'skipped' FROM kn WHERE url IN (SELECT url FROM dis) UNION ALL SELECT origin, 'targets' FROM tg UNION ALL SELECT origin, 'broken' FROM tg WHERE url IN (SELECT address FROM lk WHERE status >= 400)
  UNION ALL SELECT origin, 'unchecked' FROM un UNION ALL SELECT origin, CASE kind WHEN 'missing-canonical' THEN 'missing' WHEN 'malformed-canonical' THEN 'malformed' WHEN 'non-self-canonical' THEN 'foreign' ELSE 'shared' END FROM cf
  UNION ALL SELECT origin, 'entries' FROM listed UNION ALL SELECT origin, 'sitemap_' || class FROM sc UNION ALL SELECT origin, 'entry_' || kind FROM sp UNION ALL SELECT origin, 'omitted' FROM so
  UNION ALL SELECT origin, 'orphans' FROM oc UNION ALL SELECT origin, 'titles' FROM dt UNION ALL SELECT origin, 'site' FROM sites),
c AS (SELECT origin, """ + ", ".join(f"count_if(what = '{w}') AS \"{w}\"" for w in _COUNTS) + f""" FROM f GROUP BY origin),
r AS (SELECT c.*, {_ROBOTS_STATUS} AS robots FROM c LEFT JOIN sites USING (origin)),
checks AS (""" + " UNION ALL ".join(
    f"SELECT origin, '{k}' AS check_id, {ladder} AS status, " + " || ', ' || ".join(f"'{w} ' || \"{w}\"" for w in site.EVIDENCE[k]) + " AS evidence FROM r"
    for k, ladder in {
        "crawl-coverage": "CASE WHEN pages = 0 THEN 'FAIL' WHEN queued > 0 THEN 'WARNING' ELSE 'PASS' END",
        "robots-policy": "CASE robots WHEN 200 THEN 'PASS' WHEN 404 THEN 'N/A' ELSE 'WARNING' END",
        "site-http-status": "CASE WHEN failed > 0 THEN 'FAIL' WHEN silent > 0 THEN 'WARNING' WHEN pages > 0 THEN 'PASS' ELSE 'N/A' END",
        "redirect-chains": "CASE WHEN pages = 0 THEN 'N/A' WHEN long > 0 THEN 'WARNING' ELSE 'PASS' END",
        "internal-link-targets": "CASE WHEN broken > 0 THEN 'FAIL' WHEN unchecked > 0 THEN 'WARNING' WHEN targets > 0 THEN 'PASS' ELSE 'N/A' END",
        "canonical-consistency": "CASE WHEN html = 0 THEN 'N/A' WHEN malformed > 0 THEN 'FAIL' WHEN missing + \"foreign\" + shared > 0 THEN 'WARNING' ELSE 'PASS' END",
        "sitemap-consistency": "CASE WHEN sitemap_failed + sitemap_invalid + entry_broken > 0 THEN 'FAIL' WHEN sitemap_unavailable + entry_unavailable + omitted > 0 THEN 'WARNING' WHEN entries = 0 THEN 'N/A' ELSE 'PASS' END",
        "orphan-candidates": "CASE WHEN entries = 0 THEN 'N/A' WHEN orphans > 0 THEN 'WARNING' ELSE 'PASS' END",
        "duplicate-titles": "CASE WHEN html = 0 THEN 'N/A' WHEN titles > 0 THEN 'WARNING' ELSE 'PASS' END",
    }.items()
) + ") "

QUERIES = {
    f.__name__: f
    for f in (
        page_facts, audit_checks, audit_summary, page_evidence, document_audit, markdown_facts, build_checks, link_edges, link_counts, internal_targets, broken_targets, unchecked_targets,
        verified_canonicals, canonical_findings, duplicate_titles, finding_members, sitemap_omissions, orphan_candidates, site_findings_derived, page_metrics, site_metrics_derived, sitemap_pages, discovered_from, sitemap_classes, site_checks, site_check_summary, build_duplicates, reviews,
        url_gate, page_texts, redirect_hops, robots_rules, robots_decisions, sitemap_entries, crawl_order, crawl_rest,
    )
}
ORACLE_SQL = {
    "page_facts": _PAGES + f"SELECT fetch_id, {_TITLE} AS title, "
    "nullif(regexp_extract(h, '(?i)<html[^>]*\\slang=\"([^\"]+)\"', 1), '') AS lang, len(levels) AS n_headings, len(list_filter(levels, lambda x: x = 1)) AS n_h1, len(hrefs) AS n_links, "
    "CASE fetch_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END * CASE WHEN contains(h, '</head>') THEN 1 ELSE 0 END AS n_canonicals, "
    "nullif(regexp_extract(h, '<meta name=\"description\" content=\"([^\"]+)\"', 1), '') AS description FROM lv WHERE readable",
    "audit_checks": _PAGES + _CHECKS,
    "audit_summary": _PAGES + f", c AS ({_CHECKS}) " + _SUMMARY,
    "markdown_facts": """WITH m AS (SELECT DISTINCT fixture_id, markdown FROM fixture_docs WHERE length(markdown) > 0),
f0 AS (SELECT fixture_id, markdown, CASE WHEN fixture_id % 4 <> 0 THEN regexp_extract(markdown, '(?ms)\\A---[^\\n]*\\n(.*?)(^---[ \\t]*$\\n?|\\z)', 0) ELSE '' END AS front FROM m),
v AS (SELECT fixture_id, front, regexp_replace(regexp_replace(replace(substr(markdown, length(front) + 1), chr(13) || chr(10), chr(10)), '(?ms)^ {0,3}`{3,}[^`\\n]*\\n(.*?^ {0,3}`{3,}[ \\t]*$|.*\\z)', '', 'g'),
  '(?ms)^ {0,3}~{3,}[^\\n]*\\n(.*?^ {0,3}~{3,}[ \\t]*$|.*\\z)', '', 'g') AS t FROM f0),
h AS (SELECT fixture_id, front, t, regexp_extract_all(t, '(?m)^(#{1,6})[\\s]+(.+)$', 1) AS marks, regexp_extract_all(t, '(?m)^(#{1,6})[\\s]+(.+)$', 2) AS heads FROM v)
SELECT fixture_id, CASE WHEN fixture_id % 4 = 0 THEN 'A page' ELSE nullif(trim(regexp_extract(front, '(?m)^title: *["'']?([^"''\\r\\n]*)', 1)), '') END AS title, CASE WHEN fixture_id % 4 = 0 THEN 'en' ELSE nullif(trim(regexp_extract(front, '(?m)^lang: *([^\\r\\n]*)', 1)), '') END AS lang, len(heads) AS n_headings,
  md5(array_to_string([length(marks[i]) || ' ' || trim(heads[i]) FOR i IN range(1, len(heads) + 1)], '|')) AS headings_md5,
  len(list_filter(regexp_extract_all(t, '(!?)\\[([^\\]]*)\\]\\(([^)\\s]+)(\\s+["''][^"'']*["''])?\\)'), lambda x: x[1] <> '!')) AS n_links,
  len(list_filter(regexp_extract_all(t, '(!?)\\[([^\\]]*)\\]\\(([^)\\s]+)(\\s+["''][^"'']*["''])?\\)'), lambda x: x[1] = '!')) AS n_images,
  md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '`[^`]+`', '', 'g'), '!\\[[^\\n]*?\\]\\([^\\n]*?\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^\\n]*?\\)', '\\1', 'g'), '[#*_~`>]', '', 'g'), '[\\s\\x{A0}]+', ' ', 'g'))) AS raw_md5 FROM h""",
    "page_evidence": _PAGES + f""", v AS (SELECT *, CASE fetch_id % 7 WHEN 0 THEN 'noindex, follow' WHEN 1 THEN 'max-snippet: 20, nofollow' WHEN 2 THEN 'max-image-preview: none' ELSE '' END AS tag, {_HEAD} AS head, contains(h, '</body>') AS body FROM lv)
SELECT fetch_id, unnest(['http-status', 'meta-description', 'heading-structure', 'document-language', 'canonical-link', 'robots-directives', 'link-discovery', 'image-alternatives', 'json-ld-structure']) AS check_id, unnest([
  status || ', hops ' || len(redirects) || ': ' || array_to_string([r.status || ' ' || r.from_url || ' -> ' || r.to_url FOR r IN redirects[1:20]], ' | '),
  coalesce(nullif(regexp_extract(h, '<meta name="description" content="([^"]+)"', 1), ''), 'none'),
  len(levels) || ' headings, ' || len(list_filter(levels, lambda x: x = 1)) || ' h1, skips ' || array_to_string(['H' || levels[i - 1] || ' -> H' || levels[i] FOR i IN range(2, len(levels) + 1) IF levels[i] > levels[i - 1] + 1], ', ')
    || ', outline ' || array_to_string(['H' || levels[i] || ': ' || {_HEADING} FOR i IN range(1, least(20, len(levels)) + 1)], ' | '),
  coalesce(nullif(regexp_extract(h, '(?i)<html[^>]*\\slang="([^"]+)"', 1), ''), 'none'),
  CASE WHEN NOT head THEN '' WHEN fetch_id % 5 = 1 THEN final WHEN fetch_id % 5 = 2 THEN '/' WHEN fetch_id % 5 = 3 THEN '/a | /b' WHEN fetch_id % 5 = 4 THEN 'mailto:a@b.example' ELSE '' END,
  CASE WHEN head THEN tag ELSE '' END || '; header ' || coalesce(x_robots_tag, 'none'),
  len(hrefs) || ' links, ' || len(regexp_extract_all(h, '(?i)<a\\s[^>]*href="[^"]+"[^>]*>\\s*(?:</a>|$)')) || ' without text: ' || array_to_string(hrefs[1:20], ' | '),
  CASE WHEN body AND fetch_id % 6 = 2 THEN '2 images, 0 decorative, without alternative: /b.png' WHEN body AND fetch_id % 6 = 4 THEN '1 images, 1 decorative, without alternative: ' ELSE '0 images, 0 decorative, without alternative: ' END,
  CASE WHEN head AND fetch_id % 4 = 0 THEN '1 blocks, types Article' WHEN head AND fetch_id % 4 = 1 THEN '1 blocks, types ' ELSE '0 blocks, types ' END]) AS evidence FROM v WHERE readable""",
    "build_checks": _PAGES + f"""SELECT fetch_id, CASE WHEN trim(regexp_extract(h, '(?s)<title>(.*?)</title>', 1)) <> '' THEN 'PASS' ELSE 'WARNING' END AS b_document_title,
  CASE WHEN regexp_matches(h, '<meta name="description" content="[^"]+"') THEN 'PASS' ELSE 'WARNING' END AS b_meta_description,
  CASE WHEN NOT {_HEAD} OR fetch_id % 5 = 0 THEN 'WARNING' WHEN fetch_id % 5 IN (3, 4) THEN 'FAIL' WHEN fetch_id % 5 = 2 THEN 'N/A' ELSE 'PASS' END AS b_canonical,
  CASE WHEN {_HEAD} AND fetch_id % 7 = 0 THEN 'WARNING' ELSE 'PASS' END AS b_indexing_directives,
  CASE WHEN NOT {_HEAD} OR fetch_id % 4 > 1 THEN 'N/A' WHEN fetch_id % 4 = 0 THEN 'PASS' ELSE 'FAIL' END AS b_jsonld_syntax, 'N/A' AS b_http_indexing FROM lv WHERE readable""",
    "link_edges": _PAGES + "SELECT origin, src, dst, internal FROM el",
    "link_counts": _PAGES + "SELECT origin, src, count_if(internal) AS n_internal, count_if(NOT internal) AS n_external FROM el GROUP BY ALL",
    "internal_targets": _PAGES + "SELECT * FROM tg",
    "broken_targets": _PAGES + "SELECT * FROM tg WHERE url IN (SELECT address FROM lk WHERE status >= 400)",
    "unchecked_targets": _PAGES + "SELECT * FROM un",
    "verified_canonicals": _PAGES + "SELECT * FROM ver",
    "canonical_findings": _PAGES + "SELECT * FROM cf",
    "duplicate_titles": _PAGES + "SELECT origin, title, n_pages FROM dt",
    "finding_members": _PAGES + """SELECT DISTINCT origin, 'shared-canonical' AS kind, resolved AS target, final AS page FROM cr WHERE (origin, resolved) IN (SELECT (origin, target) FROM cf WHERE kind = 'shared-canonical')
  UNION SELECT origin, 'duplicate-title', title, final FROM ti WHERE (origin, title) IN (SELECT (origin, title) FROM dt)""",
    "sitemap_omissions": _PAGES + "SELECT * FROM so",
    "orphan_candidates": _PAGES + "SELECT * FROM oc",
    "site_findings_derived": _PAGES + """SELECT DISTINCT origin, 'http-error' AS kind, url AS target FROM p WHERE status >= 400
  UNION SELECT origin, 'multi-hop-redirect', url FROM p WHERE len(redirects) > 1
  UNION SELECT origin, 'broken-internal-target', url FROM tg WHERE url IN (SELECT address FROM lk WHERE status >= 400)
  UNION SELECT * FROM cf UNION SELECT origin, 'sitemap-omission', url FROM so UNION SELECT origin, 'orphan-candidate', url FROM oc
  UNION SELECT origin, 'duplicate-title', title FROM dt""",
    "page_metrics": _PAGES + """SELECT origin, unnest(['crawled-pages', 'successful-pages', 'failed-pages', 'unavailable-pages', 'redirected-pages', 'long-redirects']) AS metric_id,
  unnest([count(*), count_if(status BETWEEN 200 AND 299), count_if(status >= 400), count_if(status = 0), count_if(len(redirects) > 0), count_if(len(redirects) > 1)]) AS value FROM p GROUP BY origin""",
    "site_metrics_derived": _PAGES + """, pm AS (SELECT origin, unnest(['crawled-pages', 'successful-pages', 'failed-pages', 'unavailable-pages', 'redirected-pages', 'long-redirects']) AS metric_id,
  unnest([count(*), count_if(status BETWEEN 200 AND 299), count_if(status >= 400), count_if(status = 0), count_if(len(redirects) > 0), count_if(len(redirects) > 1)]) AS value FROM p GROUP BY origin),
fm AS (SELECT origin, 'internal-targets' AS metric_id, count(*) AS n FROM tg GROUP BY ALL
  UNION ALL SELECT origin, 'broken-targets', count(*) FROM tg WHERE url IN (SELECT address FROM lk WHERE status >= 400) GROUP BY ALL
  UNION ALL SELECT origin, 'unchecked-targets', count(*) FROM un GROUP BY ALL
  UNION ALL SELECT origin, 'robots-skipped', count(*) FROM kn WHERE url IN (SELECT url FROM dis) GROUP BY ALL UNION ALL SELECT origin, 'queued-urls', count(*) FROM qu GROUP BY ALL
  UNION ALL SELECT origin, CASE kind WHEN 'missing-canonical' THEN 'missing-canonicals' WHEN 'malformed-canonical' THEN 'malformed-canonicals' WHEN 'non-self-canonical' THEN 'nonself-canonicals' ELSE 'shared-canonicals' END, count(*) FROM cf GROUP BY ALL
  UNION ALL SELECT origin, 'sitemap-urls', count(*) FROM listed GROUP BY ALL UNION ALL SELECT origin, 'sitemap-omissions', count(*) FROM so GROUP BY ALL
  UNION ALL SELECT origin, 'orphan-candidates', count(*) FROM oc GROUP BY ALL UNION ALL SELECT origin, 'duplicate-titles', count(*) FROM dt GROUP BY ALL),
gr AS (SELECT origin, count_if(readable) AS html, origin IN (SELECT origin FROM listed) AS mapped, unnest(['internal-targets', 'broken-targets', 'unchecked-targets', 'missing-canonicals', 'malformed-canonicals',
  'nonself-canonicals', 'shared-canonicals', 'sitemap-urls', 'sitemap-omissions', 'orphan-candidates', 'duplicate-titles', 'robots-skipped', 'queued-urls']) AS metric_id FROM p GROUP BY origin)
SELECT * FROM pm UNION ALL SELECT origin, metric_id, CASE WHEN metric_id LIKE '%canonicals' AND html = 0 THEN NULL
  WHEN metric_id IN ('sitemap-omissions', 'orphan-candidates', 'sitemap-urls') AND NOT mapped THEN NULL ELSE coalesce(n, 0) END AS value FROM gr LEFT JOIN fm USING (origin, metric_id)""",
    "sitemap_pages": _PAGES + "SELECT * FROM sp",
    "discovered_from": _PAGES + "SELECT DISTINCT url, src AS source FROM (SELECT url, unnest(list_distinct([url, final])) AS address FROM p) n JOIN e ON e.dst = n.address",
    "sitemap_classes": _PAGES + "SELECT * FROM sc",
    "site_checks": _SITE_CHECKS + "SELECT * FROM checks",
    "site_check_summary": _SITE_CHECKS + "SELECT check_id, count_if(status = 'PASS') AS n_pass, count_if(status = 'WARNING') AS n_warning, count_if(status = 'FAIL') AS n_fail, count_if(status = 'N/A') AS n_na FROM checks GROUP BY ALL",
    "build_duplicates": _PAGES + """, bt AS (SELECT 'duplicate-title' AS check_id, title AS value, final FROM ti WHERE title <> ''
  UNION ALL SELECT 'duplicate-canonical', resolved, final FROM cr WHERE n = 1 AND resolved IS NOT NULL)
SELECT check_id, value, count(DISTINCT final) AS n_files FROM bt GROUP BY ALL HAVING n_files > 1""",
    "reviews": """SELECT site_id, site_id % 7 IN (1, 2) AS available, CASE site_id % 7 WHEN 1 THEN least(100, site_id + 1) WHEN 2 THEN site_id % 101 END AS score,
  CASE site_id % 7 WHEN 1 THEN least(25, site_id % 40) WHEN 2 THEN 9 END AS structure, CASE site_id % 7 WHEN 1 THEN 0 WHEN 2 THEN 7 END AS schema, CASE WHEN site_id % 7 IN (1, 2) THEN 0 END AS aiMetadata,
  CASE site_id % 7 WHEN 1 THEN '{' || brand || '}' WHEN 2 THEN 'No insight provided' END AS insight FROM sites""",
    "url_gate": """SELECT DISTINCT requested_url, requested_url AS url, regexp_matches(requested_url, '(?i)^https?://') AS is_web,
  regexp_matches(requested_url, '^https?://(localhost/|10[.]|192[.]168[.]|169[.]254[.]|172[.](1[6-9]|2[0-9]|3[01])[.])') AS is_blocked, contains(requested_url, '/cdn-cgi/l/email-protection') AS is_mail,
  regexp_replace(regexp_replace(requested_url, '^https?://[^/?#]+', ''), '#.*$', '') AS path, regexp_extract(requested_url, '^https?://[^/?#]+') AS origin FROM (SELECT unnest(""" + _GATED.replace("array(", "list_value(") + ") AS requested_url FROM fetches)",
    "page_texts": f"""WITH p AS (SELECT DISTINCT ON (fetch_id) fetch_id, html FROM fetches WHERE length(html) > 0 ORDER BY fetch_id, coalesce(loaded_at, fetched_at) DESC),
t AS (SELECT *, substr(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '{tx.WS}+', ' ', 'g'), '^ | $', '', 'g'), 1, 8000) AS x FROM p)
SELECT fetch_id, length(x) AS excerpt_chars, md5(x) AS excerpt_md5, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5,
  md5(substr(html, 1, 6000)) AS preview_md5, length(html) > 6000 AS truncated,
  len(regexp_extract_all(html, '<(?:p|h[1-6]|li|article|main)[>\\s]')) < 10 AND len(regexp_extract_all(html, '<script')) > 3 AS script_page FROM t""",
    "redirect_hops": """WITH RECURSIVE hop AS (SELECT h.from_url AS f, min(h.to_url) AS t FROM (SELECT unnest(redirects) AS h FROM fetches) GROUP BY ALL),
walk AS (SELECT f AS start_url, t AS at_url, 1 AS n FROM hop UNION ALL SELECT start_url, t, n + 1 FROM walk JOIN hop ON hop.f = at_url WHERE n < 10)
SELECT start_url, arg_max(at_url, n) AS final_url, max(n) AS n_hops FROM walk GROUP BY start_url""",
    "robots_rules": _RULES + "SELECT origin, r.d AS directive, r.p AS pattern FROM sel",
    "robots_decisions": _RULES + """, u AS (SELECT DISTINCT requested_url AS url, regexp_extract(requested_url, '^https?://[^/?#]+') AS origin,
  regexp_replace(requested_url, '^https?://[^/?#]+', '') AS path FROM fetches),
m AS (SELECT u.url, r.d, length(replace(replace(r.p, '*', ''), '$', '')) AS size FROM u JOIN sel USING (origin)
  WHERE regexp_matches(path, '^' || replace(replace(regexp_replace(r.p, '[$]$', ''), '.', '[.]'), '*', '.*') || CASE WHEN ends_with(r.p, '$') THEN '$' ELSE '' END))
SELECT u.url, coalesce((SELECT arg_max(d = 'allow', size * 2 + (d = 'allow')::INT) FROM m WHERE m.url = u.url), true) AS allowed FROM u""",
    "sitemap_entries": """WITH l AS (SELECT regexp_extract(requested_url, '^https?://[^/?#]+') AS origin, count(DISTINCT requested_url) AS n FROM fetches WHERE fetch_id % 3 <> 0 GROUP BY ALL)
SELECT origin, origin || '/sitemap.xml' AS url, 200 AS status, 'index' AS kind, 2 AS n_urls FROM l UNION ALL SELECT origin, origin || '/pages.xml', 200, 'urlset', n FROM l
UNION ALL SELECT origin, origin || '/gone.xml', 0, 'unknown', 0 FROM l""",
}

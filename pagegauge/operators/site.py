"""Relations between the pages of each site: links, canonicals, titles, sitemap; many sites at once.

All joins are keyed by address (a page's own site is in it), so a hot site spreads over all
partitions; groups of pages with one title or canonical are reduced to distinct addresses before
they are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.functions.urls import is_mail_protection, origin, resolved_url
from pagegauge.operators.audit import blocks_indexing
from pagegauge.session import cut_lineage

#: gives the addresses (url) of (origin, url) that robots.txt closes
Closed = Callable[[DataFrame], DataFrame]
#: checks of a site (fixed values)
CHECKS = (
    "crawl-coverage", "robots-policy", "site-http-status", "redirect-chains", "internal-link-targets", "canonical-consistency",
    "sitemap-consistency", "orphan-candidates", "duplicate-titles",
)
#: kinds of findings (fixed values)
KINDS = (
    "http-error", "multi-hop-redirect", "broken-internal-target", "missing-canonical", "malformed-canonical",
    "non-self-canonical", "shared-canonical", "sitemap-omission", "orphan-candidate", "duplicate-title",
)


def link_edges(pages: DataFrame) -> DataFrame:
    """(origin, src, dst, internal): web links of each page, fragments dropped; mail-protection links are left out."""
    links = pages.where(F.col("doc").isNotNull()).select("origin", F.col("final").alias("src"), F.explode("doc.links").alias("x"))
    to = links.select("origin", "src", resolved_url(F.col("x.href"), F.col("src")).alias("dst")).where(F.col("dst").isNotNull())
    return to.withColumn("internal", origin(F.col("dst")) == F.col("origin")).where(~(F.col("internal") & is_mail_protection(F.col("dst"))))


def link_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("origin", "src").agg(F.count_if("internal").alias("n_internal"), F.count_if(~F.col("internal")).alias("n_external"))


def targets(edges: DataFrame) -> DataFrame:
    """Different internal targets with the number of different pages that link to them."""
    return edges.where("internal").groupBy("origin", F.col("dst").alias("url")).agg(F.countDistinct("src").alias("n_sources"))


def page_lookup(pages: DataFrame) -> DataFrame:
    """(address, page facts): every page under its requested and its final address; the later fetch holds."""
    facts = F.struct("fetched_at", "fetch_id", "status", "final", "hops")
    return (
        pages.withColumn("hops", F.coalesce(F.size("redirects"), F.lit(0)))
        .select(F.explode(F.array_distinct(F.array("url", "final"))).alias("address"), facts.alias("p"))
        .where(F.col("address").isNotNull())
        .groupBy("address")
        .agg(F.max("p").alias("p"))
        .select("address", "p.status", F.col("p.final").alias("final_address"), "p.hops")
    )


def broken_targets(edges: DataFrame, lookup: DataFrame) -> DataFrame:
    bad = lookup.where(F.col("status") >= 400).select(F.col("address").alias("url"))
    return targets(edges).join(bad, "url", "left_semi")


def unchecked_targets(edges: DataFrame, lookup: DataFrame, denied: DataFrame) -> DataFrame:
    """Internal targets without an answer, but for those (url) that the crawl left to robots.txt."""
    answered = lookup.where(F.col("status") != 0).select(F.col("address").alias("url"))
    return targets(edges).join(answered, "url", "left_anti").join(denied, "url", "left_anti")


def queued(edges: DataFrame, lookup: DataFrame, listed: DataFrame, denied: DataFrame) -> DataFrame:
    """(origin, url) of link targets and sitemap entries that no page answers to and robots.txt does not close: what a longer crawl would visit."""
    known = targets(edges).select("origin", "url").unionByName(listed.select("origin", "url")).distinct()
    return known.join(lookup.select(F.col("address").alias("url")), "url", "left_anti").join(denied, "url", "left_anti")


def sitemap_pages(lookup: DataFrame, listed: DataFrame) -> DataFrame:
    """(origin, url, kind) of sitemap entries whose page answered with an error (broken) or not at all (unavailable)."""
    found = listed.select("origin", "url").distinct().join(lookup.select(F.col("address").alias("url"), "status"), "url")
    kind = F.when(F.col("status") >= 400, "broken").when(F.col("status") == 0, "unavailable")
    return found.select("origin", "url", kind.alias("kind")).where("kind IS NOT NULL")


def sitemap_classes(answers: DataFrame) -> DataFrame:
    """(origin, url, class) of the sitemaps (origin, url, status, kind) that failed, gave no answer or cannot be read."""
    status = F.col("status")
    kind = F.when(status == 0, "unavailable").when(~status.isin(200, 404), "failed").when((status == 200) & (F.col("kind") == "unknown"), "invalid")
    return answers.select("origin", "url", kind.alias("class")).where("class IS NOT NULL")


def discovered_from(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, source): the different pages that link to each page, under its requested or its final address.

    Rows instead of a list for each page: everything links to a hub.
    """
    links = edges.where("internal").select(F.col("dst").alias("address"), F.col("src").alias("source")).distinct()
    names = pages.select("url", F.explode(F.array_distinct(F.array("url", "final"))).alias("address")).where("address IS NOT NULL").distinct()
    return names.join(links, "address").select("url", "source").distinct()


def canonical_rows(pages: DataFrame) -> DataFrame:
    """(origin, final, n, value, resolved): each canonical of each HTML page; pages without one have n = 0."""
    html = pages.where(F.col("doc").isNotNull())
    rows = html.select("origin", "final", F.size("doc.canonicals").alias("n"), F.explode_outer("doc.canonicals").alias("value"))
    return rows.withColumn("resolved", resolved_url("value", "final"))


def verified_canonicals(pages: DataFrame, lookup: DataFrame) -> DataFrame:
    """(final, target): the only canonical of a page, whose target is fetched, indexable, direct and its own canonical."""
    own = canonical_rows(pages).where((F.col("n") == 1) & F.col("resolved").isNotNull() & (origin(F.col("resolved")) == F.col("origin")))
    target = lookup.where((F.col("status") == 200) & (F.col("hops") == 0) & (F.col("address") == F.col("final_address"))).select(F.col("address").alias("resolved"))
    itself = own.where(F.col("resolved") == F.col("final")).select(F.col("final").alias("resolved")).distinct()
    open_ = pages.where(F.col("doc").isNotNull() & ~blocks_indexing(F.col("doc"), F.col("x_robots_tag"))).select(F.col("final").alias("resolved")).distinct()
    good = target.join(itself, "resolved", "left_semi").join(open_, "resolved", "left_semi")
    return own.join(good, "resolved", "left_semi").select("final", F.col("resolved").alias("target")).distinct()


def canonical_findings(pages: DataFrame, lookup: DataFrame) -> DataFrame:
    """(origin, kind, target) of missing, malformed, foreign and shared canonicals."""
    rows = canonical_rows(pages)
    verified = verified_canonicals(pages, lookup)
    missing = rows.where(F.col("n") == 0).select("origin", F.lit("missing-canonical").alias("kind"), F.col("final").alias("target"))
    several = rows.where(F.col("n") > 1).select("origin", F.lit("malformed-canonical").alias("kind"), F.col("final").alias("target"))
    bad = rows.where((F.col("n") > 0) & F.col("resolved").isNull())
    unreadable = bad.select("origin", F.lit("malformed-canonical").alias("kind"), F.concat("final", F.lit(" -> "), "value").alias("target"))
    foreign = rows.where(F.col("resolved") != F.col("final")).join(verified, "final", "left_anti")
    foreign = foreign.select("origin", F.lit("non-self-canonical").alias("kind"), F.concat("final", F.lit(" -> "), "resolved").alias("target"))
    owners = rows.where(F.col("resolved").isNotNull()).select("origin", "resolved", "final").distinct()
    checked = owners.join(verified.select("final", F.col("target").alias("_t")), "final", "left")
    groups = checked.groupBy("origin", "resolved").agg(F.count(F.lit(1)).alias("owners"), F.bool_and(F.coalesce(F.col("_t") == F.col("resolved"), F.lit(False))).alias("all_verified"))
    shared = groups.where((F.col("owners") > 1) & ~F.col("all_verified")).select("origin", F.lit("shared-canonical").alias("kind"), F.col("resolved").alias("target"))
    return missing.unionByName(several).unionByName(unreadable).unionByName(foreign).unionByName(shared).distinct()


def duplicate_titles(pages: DataFrame, lookup: DataFrame) -> DataFrame:
    """(origin, title, n_pages): titles of several different pages that are not translations of each other.

    Pages are first reduced to distinct (title, address).  A title is excused only when every pair of
    its addresses lists each other as alternate; the pairs that do are counted from the alternates,
    so no pairs of a group are built.
    """
    verified = verified_canonicals(pages, lookup)
    titled = pages.where(F.col("doc").isNotNull() & (F.trim("doc.document_title") != "")).select(
        "origin", F.lower("doc.document_title").alias("title"), "final", F.lower("doc.language").alias("lang"), "doc.alternates"
    )
    owned = titled.join(verified, "final", "left").withColumn("address", F.coalesce("target", "final"))
    sizes = owned.groupBy("origin", "title").agg(F.countDistinct("address").alias("n"), F.countDistinct("final").alias("n_pages")).where("n > 1")
    listed = owned.select("origin", "title", "address", "lang", F.explode("alternates").alias("a")).select(
        "origin", "title", "address", "lang", resolved_url(F.col("a.href"), F.col("address")).alias("other"), F.col("a.lang").alias("other_lang")
    ).distinct()
    back = listed.select("origin", "title", F.col("address").alias("other"), F.col("lang").alias("other_lang"), F.col("other").alias("address"), F.col("other_lang").alias("lang"))
    mutual = listed.join(back, ["origin", "title", "address", "lang", "other", "other_lang"], "left_semi").where((F.col("address") < F.col("other")) & (F.col("lang") != F.col("other_lang")))
    pairs = mutual.groupBy("origin", "title").agg(F.countDistinct("address", "other").alias("mutual"))
    return sizes.join(pairs, ["origin", "title"], "left").where(F.coalesce("mutual", F.lit(0)) < F.col("n") * (F.col("n") - 1) / 2).select("origin", "title", "n_pages")


def group_members(pages: DataFrame, lookup: DataFrame) -> DataFrame:
    """(origin, kind, target, page): the different pages behind each shared canonical and each duplicate title, as rows, since a group may be large."""
    shared = canonical_findings(pages, lookup).where("kind = 'shared-canonical'")
    owners = canonical_rows(pages).where(F.col("resolved").isNotNull()).select("origin", F.col("resolved").alias("target"), F.col("final").alias("page")).distinct()
    titles = duplicate_titles(pages, lookup).select("origin", F.col("title").alias("target"))
    titled = pages.where(F.col("doc").isNotNull()).select("origin", F.lower("doc.document_title").alias("target"), F.col("final").alias("page")).distinct()
    by_title = titled.join(titles, ["origin", "target"], "left_semi").select("origin", F.lit("duplicate-title").alias("kind"), "target", "page")
    return shared.join(owners, ["origin", "target"]).select("origin", "kind", "target", "page").unionByName(by_title)


def sitemap_omissions(pages: DataFrame, lookup: DataFrame, listed: DataFrame) -> DataFrame:
    """Indexable pages missing from the sitemap (origin, url) of their site, where it has one."""
    verified = verified_canonicals(pages, lookup)
    open_ = pages.where(F.col("doc").isNotNull() & ~blocks_indexing(F.col("doc"), F.col("x_robots_tag"))).select("origin", "final")
    effective = open_.join(verified, "final", "left").select("origin", F.coalesce("target", "final").alias("url")).distinct()
    has = listed.select("origin").distinct()
    return effective.join(has, "origin", "left_semi").join(listed.select("url").distinct(), "url", "left_anti")


def orphan_candidates(edges: DataFrame, listed: DataFrame, starts: DataFrame, denied: DataFrame) -> DataFrame:
    """Pages of the sitemap that no other page links to, without start pages (url) and those (url) left to robots.txt."""
    linked = edges.where(F.col("internal") & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("url")).distinct()
    candidates = listed.where(~is_mail_protection(F.col("url"))).select("origin", "url").distinct()
    return candidates.join(starts.select("url"), "url", "left_anti").join(denied, "url", "left_anti").join(linked, "url", "left_anti")


def relations(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page lookup, distinct link edges), written once because several findings read them."""
    return cut_lineage(page_lookup(pages)), cut_lineage(link_edges(pages).distinct())


def site_findings(pages: DataFrame, listed: DataFrame, starts: DataFrame, closed: Closed) -> DataFrame:
    """(origin, kind, target): the ten kinds of findings of every site."""
    lookup, edges = relations(pages)
    kind = lambda df, name, target: df.select("origin", F.lit(name).alias("kind"), F.col(target).alias("target"))
    parts = [
        kind(pages.where(F.col("status") >= 400), "http-error", "url"),
        kind(pages.where(F.size("redirects") > 1), "multi-hop-redirect", "url"),
        kind(broken_targets(edges, lookup), "broken-internal-target", "url"),
        canonical_findings(pages, lookup),
        kind(sitemap_omissions(pages, lookup, listed), "sitemap-omission", "url"),
        kind(orphan_candidates(edges, listed, starts, closed(listed)), "orphan-candidate", "url"),
        kind(duplicate_titles(pages, lookup), "duplicate-title", "title"),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.distinct()


def page_metrics(pages: DataFrame) -> DataFrame:
    """(origin, metric_id, value): counts of pages by their answers."""
    hops = F.coalesce(F.size("redirects"), F.lit(0))
    counts = {
        "crawled-pages": F.count(F.lit(1)),
        "successful-pages": F.count_if(F.col("status").between(200, 299)),
        "failed-pages": F.count_if(F.col("status") >= 400),
        "unavailable-pages": F.count_if(F.col("status") == 0),
        "redirected-pages": F.count_if(hops > 0),
        "long-redirects": F.count_if(hops > 1),
    }
    wide = pages.groupBy("origin").agg(*[c.alias(n) for n, c in counts.items()])
    return wide.select("origin", F.explode(F.array(*[F.struct(F.lit(n).alias("metric_id"), F.col(f"`{n}`").alias("value")) for n in counts])).alias("m")).select("origin", "m.*")


def site_metrics(pages: DataFrame, listed: DataFrame, starts: DataFrame, closed: Closed) -> DataFrame:
    """(origin, metric_id, value): counts of pages, targets and findings of every site; NULL is not measured.

    Canonical counts need an HTML page, sitemap counts a sitemap.
    """
    lookup, edges = relations(pages)
    known = targets(edges).select("origin", "url").unionByName(listed.select("origin", "url")).distinct()
    denied = cut_lineage(closed(known))
    count = lambda df, name: df.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).select("origin", F.lit(name).alias("metric_id"), "n")
    canonical = cut_lineage(canonical_findings(pages, lookup))
    of_kind = lambda kind, name: count(canonical.where(F.col("kind") == kind), name)
    parts = [
        count(targets(edges), "internal-targets"),
        count(broken_targets(edges, lookup), "broken-targets"),
        count(unchecked_targets(edges, lookup, denied), "unchecked-targets"),
        of_kind("missing-canonical", "missing-canonicals"),
        of_kind("malformed-canonical", "malformed-canonicals"),
        of_kind("non-self-canonical", "nonself-canonicals"),
        of_kind("shared-canonical", "shared-canonicals"),
        count(listed.select("origin", "url").distinct(), "sitemap-urls"),
        count(sitemap_omissions(pages, lookup, listed), "sitemap-omissions"),
        count(orphan_candidates(edges, listed, starts, denied), "orphan-candidates"),
        count(duplicate_titles(pages, lookup), "duplicate-titles"),
        count(known.join(denied, "url", "left_semi"), "robots-skipped"),
        count(queued(edges, lookup, listed, denied), "queued-urls"),
    ]
    names = ["internal-targets", "broken-targets", "unchecked-targets", "missing-canonicals", "malformed-canonicals", "nonself-canonicals",
             "shared-canonicals", "sitemap-urls", "sitemap-omissions", "orphan-candidates", "duplicate-titles", "robots-skipped", "queued-urls"]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    origins = pages.groupBy("origin").agg(F.count_if(F.col("doc").isNotNull()).alias("html")).join(listed.select("origin").distinct().withColumn("mapped", F.lit(True)), "origin", "left")
    grid = origins.withColumn("metric_id", F.explode(F.array(*[F.lit(n) for n in names])))
    measured = (
        F.when(F.col("metric_id").endswith("canonicals"), F.col("html") > 0)
        .when(F.col("metric_id").isin("sitemap-omissions", "orphan-candidates", "sitemap-urls"), F.coalesce("mapped", F.lit(False)))
        .otherwise(True)
    )
    filled = grid.join(found, ["origin", "metric_id"], "left").select("origin", "metric_id", F.when(measured, F.coalesce("n", F.lit(0))).alias("value"))
    return page_metrics(pages).unionByName(filled)


#: what each check counts
EVIDENCE = {
    "crawl-coverage": ("pages", "queued"),
    "robots-policy": ("skipped",),
    "site-http-status": ("failed", "silent"),
    "redirect-chains": ("long",),
    "internal-link-targets": ("targets", "broken", "unchecked"),
    "canonical-consistency": ("html", "missing", "malformed", "foreign", "shared"),
    "sitemap-consistency": ("entries", "sitemap_failed", "sitemap_invalid", "sitemap_unavailable", "entry_broken", "entry_unavailable", "omitted"),
    "orphan-candidates": ("orphans",),
    "duplicate-titles": ("titles",),
}


def site_checks(pages: DataFrame, listed: DataFrame, starts: DataFrame, robots_answers: DataFrame, sitemap_answers: DataFrame, closed: Closed) -> DataFrame:
    """(origin, check_id, status, evidence) of the nine checks of every site in ``robots_answers`` (origin, status) or with pages.

    Everything that the checks count is one row (origin, what) of a union, which one aggregation
    without large groups turns into a row of counts for each site; the ladders are columns of it.
    """
    lookup, edges = relations(pages)
    known = targets(edges).select("origin", "url").unionByName(listed.select("origin", "url")).distinct()
    denied = cut_lineage(closed(known))
    canonical = canonical_findings(pages, lookup)
    hops = F.coalesce(F.size("redirects"), F.lit(0))
    names = {"missing-canonical": "missing", "malformed-canonical": "malformed", "non-self-canonical": "foreign", "shared-canonical": "shared"}
    kind = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    row = lambda df, what: df.select("origin", (F.lit(what) if isinstance(what, str) else what).alias("what"))
    of_page = F.array_compact(F.array(
        F.lit("pages"), F.when(F.col("status") >= 400, "failed"), F.when(F.col("status") == 0, "silent"), F.when(hops > 1, "long"), F.when(F.col("doc").isNotNull(), "html"),
    ))
    parts = [
        pages.select("origin", F.explode(of_page).alias("what")),
        row(queued(edges, lookup, listed, denied), "queued"),
        row(known.join(denied, "url", "left_semi"), "skipped"),
        row(targets(edges), "targets"),
        row(broken_targets(edges, lookup), "broken"),
        row(unchecked_targets(edges, lookup, denied), "unchecked"),
        row(canonical, kind[F.col("kind")]),
        row(listed.select("origin", "url").distinct(), "entries"),
        row(sitemap_classes(sitemap_answers), F.concat(F.lit("sitemap_"), "class")),
        row(sitemap_pages(lookup, listed), F.concat(F.lit("entry_"), "kind")),
        row(sitemap_omissions(pages, lookup, listed), "omitted"),
        row(orphan_candidates(edges, listed, starts, denied), "orphans"),
        row(duplicate_titles(pages, lookup), "titles"),
        row(robots_answers, "site"),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    counted = found.groupBy("origin").agg(*[F.count_if(F.col("what") == w).alias(w) for e in EVIDENCE.values() for w in e])
    c = counted.join(robots_answers.select("origin", F.col("status").alias("_robots")), "origin", "left")
    n = F.col
    ladders = {
        "crawl-coverage": F.when(n("pages") == 0, "FAIL").when(n("queued") > 0, "WARNING").otherwise("PASS"),
        "robots-policy": F.when(n("_robots") == 200, "PASS").when(n("_robots") == 404, "N/A").otherwise("WARNING"),
        "site-http-status": F.when(n("failed") > 0, "FAIL").when(n("silent") > 0, "WARNING").when(n("pages") > 0, "PASS").otherwise("N/A"),
        "redirect-chains": F.when(n("pages") == 0, "N/A").when(n("long") > 0, "WARNING").otherwise("PASS"),
        "internal-link-targets": F.when(n("broken") > 0, "FAIL").when(n("unchecked") > 0, "WARNING").when(n("targets") > 0, "PASS").otherwise("N/A"),
        "canonical-consistency": F.when(n("html") == 0, "N/A").when(n("malformed") > 0, "FAIL").when(n("missing") + n("foreign") + n("shared") > 0, "WARNING").otherwise("PASS"),
        "sitemap-consistency": F.when(n("sitemap_failed") + n("sitemap_invalid") + n("entry_broken") > 0, "FAIL")
        .when(n("sitemap_unavailable") + n("entry_unavailable") + n("omitted") > 0, "WARNING").when(n("entries") == 0, "N/A").otherwise("PASS"),
        "orphan-candidates": F.when(n("entries") == 0, "N/A").when(n("orphans") > 0, "WARNING").otherwise("PASS"),
        "duplicate-titles": F.when(n("html") == 0, "N/A").when(n("titles") > 0, "WARNING").otherwise("PASS"),
    }
    evidence = lambda check: F.concat_ws(", ", *[F.concat(F.lit(w + " "), n(w).cast("string")) for w in EVIDENCE[check]])
    rows = F.array(*[F.struct(F.lit(k).alias("check_id"), ladders[k].alias("status"), evidence(k).alias("evidence")) for k in CHECKS])
    return c.select("origin", F.explode(rows).alias("x")).select("origin", "x.*")

"""Comparisons, histograms, ledger, artefacts and blends, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.functions import text as tx
from pagegauge.operators import compare, generate, ledger, rules
from pagegauge.operators.snapshots import snapshot_statuses
from pagegauge.plans import rule_queries as rq
from pagegauge.plans.site_queries import _ROBOTS
from pagegauge.plans.snapshot_queries import FINDING_ROWS
from pagegauge.sources.tables import read_table

SEVERITIES = ("critical", "warning", "info")


def metrics_compare(spark: SparkSession, folder: str) -> DataFrame:
    return compare.metric_changes(read_table(spark, folder, "site_reports"), read_table(spark, folder, "site_metrics"))


#: what the reports' table lacks, by site and snapshot: origin, pages, addresses left to robots.txt, requests without response
_REPORT_PARTS = {
    "origin": "concat('o', CASE WHEN site_id % 11 = 3 AND snapshot_no % 2 = 1 THEN 1 ELSE 0 END)",
    "n_skipped": "CASE WHEN (site_id + snapshot_no) % 9 = 4 THEN 2 ELSE 0 END",
    "n_silent": "CASE WHEN (site_id + snapshot_no) % 8 = 5 THEN 1 ELSE 0 END",
}


def report_gate(spark: SparkSession, folder: str) -> DataFrame:
    reports = read_table(spark, folder, "site_reports").withColumns({c: F.expr(e) for c, e in _REPORT_PARTS.items()})
    turned = F.when((F.col("site_id") % 5 == 2) & (F.col("snapshot_no") % 3 == 0), 1).otherwise(0)
    pages = F.array(F.lit("/b"), F.concat(F.lit("/a"), turned.cast("string")), F.lit("/b"))
    paired = compare.consecutive_reports(reports.withColumn("page_urls", F.when(F.col("snapshot_no") % 2 == 0, F.array_sort(pages)).otherwise(pages))).where(F.col("base").isNotNull())
    return paired.select("site_id", "snapshot_no", (F.size("reasons") == 0).alias("comparable"), F.array_join("reasons", ",").alias("reasons"))


def findings_persisting(spark: SparkSession, folder: str) -> DataFrame:
    """How many findings of each kind are new, gone, changed and unchanged in each snapshot."""
    statuses = snapshot_statuses(read_table(spark, folder, "site_findings"), read_table(spark, folder, "site_reports", "site_id", "snapshot_no"))
    return statuses.groupBy("site_id", "snapshot_no", "kind", "change_kind").agg(F.count(F.lit(1)).alias("n"))


def severity_histogram(spark: SparkSession, folder: str) -> DataFrame:
    levels = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    rows = read_table(spark, folder, "issues", "issue_id", "severity").distinct()
    counted = rows.groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n_issues"))


def issues_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "issues", "issue_id", "rule_id", "dimension", "severity", "fixture_id").distinct()
    return rows.groupBy("rule_id", F.coalesce("dimension", F.lit("none")).alias("dimension")).agg(
        F.count(F.lit(1)).alias("n_issues"), F.countDistinct("fixture_id").alias("n_documents"), F.count_if(F.lower("severity") == "critical").alias("n_critical")
    )


def first_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Each different message of a rule once, with the first issue that has it."""
    rows = read_table(spark, folder, "issues", "issue_id", "rule_id", "message").where(F.length("message") > 0)
    return rows.groupBy("rule_id", "message").agg(F.min("issue_id").alias("issue_id"), F.countDistinct("issue_id").alias("n"))


def unknown_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Issues whose rule and dimension are not in the roster of rules."""
    roster = spark.createDataFrame([(r.id, r.dimension) for r in rules.REGISTRY], "rule_id string, dimension string")
    rows = read_table(spark, folder, "issues", "issue_id", "rule_id", "dimension").where(F.col("dimension").isNotNull()).distinct()
    return rows.join(F.broadcast(roster), ["rule_id", "dimension"], "left_anti")


def fixture_expectations(spark: SparkSession, folder: str) -> DataFrame:
    """Computed against expected score of each fixture document's own rule."""
    expected = read_table(spark, folder, "fixture_docs", "fixture_id", "rule_id", "kind", "expected").select("fixture_id", "rule_id", "kind", F.col("expected.score").alias("want")).distinct()
    scores = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.col(rules.rule_column(r)).alias("got")) for r in rules.REGISTRY])
    long = rq.rule_scores(spark, folder).select("fixture_id", F.explode(scores).alias("x")).select("fixture_id", "x.*")
    return expected.join(long, ["fixture_id", "rule_id"]).groupBy("rule_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("got") == F.col("want")).alias("n_equal"), F.sum("got").alias("points")
    )


def readiness_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Average readiness of the positive documents against the negative ones."""
    kinds = read_table(spark, folder, "fixture_docs", "fixture_id", "kind").distinct()
    scored = rq.scored(spark, folder).select("fixture_id", *rules.DIMENSIONS, "total").join(kinds, "fixture_id")
    return compare.readiness_changes(rules.site_averages(scored.where("kind = 'positive'")), rules.site_averages(scored.where("kind = 'negative'")))


def _observations(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    return rows.select(
        F.col("event_id").alias("seq"), F.concat(F.lit(" User  "), F.col("user_id").cast("string"), F.lit(" ")).alias("keyword"), F.concat(F.lit("/"), "event_type").alias("target_path"),
        F.col("ts").alias("observed_at"), (F.floor("value") % 30 + 1).cast("bigint").alias("position"),
    )


def ledger_latest_observation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _observations(spark, folder).withColumn("query", ledger.normal_query(F.col("keyword"))).drop("keyword")
    latest = ledger.latest_observations(rows, "query", "target_path")
    return latest.select("query", "target_path", "seq", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"), "position")


def _full_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations with all fields of their identity, some of them refused; made from the events."""
    rows = read_table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    e = F.col("event_id")
    return rows.select(
        e.alias("seq"), F.when(e % 41 == 7, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("observedAt"), F.lit("search").alias("source"),
        F.when(e % 31 == 3, "  ").otherwise(F.concat(F.lit(' A "quoted"  User '), F.col("user_id").cast("string"))).alias("keyword"), F.concat(F.lit("/"), "event_type").alias("targetPath"),
        F.when(e % 5 == 1, None).otherwise((e % 60) / 2).alias("position"), F.when(e % 47 == 5, -1).otherwise(e % 9).cast("double").alias("clicks"), (e % 100).cast("double").alias("impressions"),
        F.when(e % 43 == 9, "2026-02-30").otherwise("2026-02-01").alias("startDate"), F.when(e % 37 == 11, "2026-01-31").otherwise("2026-02-28").alias("endDate"), F.lit("US").alias("country"),
        F.when(e % 2 == 0, "mobile").otherwise("desktop").alias("device"), F.when(e % 3 == 0, None).otherwise("web").alias("searchType"),
    )


def observation_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the observations that are recorded."""
    none = spark.createDataFrame([], "observation_id string")
    return ledger.record_observations(_full_observations(spark, folder), none)[0].select("seq", "observation_id")


def refused_observations(spark: SparkSession, folder: str) -> DataFrame:
    """How many observations are refused, by reason; every seventh of those recorded is known already."""
    rows = _full_observations(spark, folder)
    known = ledger.record_observations(rows.where("seq % 7 = 0"), spark.createDataFrame([], "observation_id string"))[0].select("observation_id")
    return ledger.record_observations(rows, known)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _ledger_queries(spark: SparkSession, folder: str) -> DataFrame:
    users = read_table(spark, folder, "events", "user_id").distinct()
    u = F.col("user_id")
    return users.select(
        F.concat(F.lit("  User  "), u.cast("string")).alias("keyword"), F.lit("/p").alias("target_path"), F.when(u % 10 == 9, "urgent").otherwise(F.element_at(F.array(*map(F.lit, ledger.PRIORITIES)), (u % 3 + 1).cast("int"))).alias("priority"), "user_id",
    )


def ledger_new_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Queries that can be added: every fifth is in the ledger already, every tenth has no priority that counts."""
    rows = _ledger_queries(spark, folder)
    known = rows.where("user_id % 5 = 0").select(ledger.normal_query(F.col("keyword")).alias("query"))
    return ledger.add_queries(rows, known)


def ledger_totals(spark: SparkSession, folder: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("eligible"), F.lit("monitoring"), F.lit("completed"), F.lit("paused")), (F.col("user_id") % 4 + 1).cast("int"))
    return ledger.status_totals(_ledger_queries(spark, folder).select(status.alias("status")), read_table(spark, folder, "events", "event_id"))


def ledger_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The first candidate of each kind of event; groups and priorities by the event's id."""
    rows = read_table(spark, folder, "events", "event_id", "event_type")
    e = F.col("event_id")
    ranked = rows.select(
        "event_type", e.alias("seq"), ((F.length("event_type") + e % 2) % 3).alias("rank_group"), F.when(e % 4 == 0, None).otherwise(e % 50 + 1).alias("position"), (e % 83).alias("impressions"),
        F.element_at(F.array(*map(F.lit, ledger.PRIORITIES)), (e % 3 + 1).cast("int")).alias("priority"),
    )
    return ledger.first_candidates(ranked, "event_type", "rank_group").select("event_type", F.col("rank_group").cast("bigint").alias("rank_group"), "seq")


def ledger_segments(spark: SparkSession, folder: str) -> DataFrame:
    """How many later observations each query has in the segment of its first one."""
    e = F.col("event_id")
    rows = read_table(spark, folder, "events", "event_id", "ts", "user_id", "event_type").select(
        e.alias("seq"), F.col("ts").alias("observed_at"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("query"), F.concat(F.lit("/"), "event_type").alias("target_path"),
        F.lit("search").alias("source"), F.lit("US").alias("country"), F.when(e % 2 == 0, "mobile").otherwise("desktop").alias("device"), F.lit("web").alias("search_type"),
    )
    rest = [c for c in rows.columns if c not in ("query", "target_path")]
    first = rows.groupBy("query", "target_path").agg(F.min_by(F.struct(*rest), F.struct("observed_at", "seq")).alias("x")).select("query", "target_path", "x.*")
    return ledger.segment_pairs(first, rows).groupBy("query", "target_path", "baseline_seq").agg(F.count(F.lit(1)).alias("n_reviews"))


def evidence_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Dimension scores that the rule results do not reproduce; the structure of every tenth document is changed here."""
    results = [F.struct(F.lit(r.dimension).alias("dimension"), F.col(rules.rule_column(r)).alias("score"), F.lit(r.weight).alias("max_score"), F.lit(r.weight).alias("weight")) for r in rules.REGISTRY]
    pages = rq.scored(spark, folder).select("fixture_id", *[(F.col(d) + F.when(F.col("fixture_id") % 10 == 0, int(d == "structure")).otherwise(0)).alias(d) for d in rules.DIMENSIONS])
    evidence = rq.rule_scores(spark, folder).select("fixture_id", F.explode(F.array(*results)).alias("x")).select("fixture_id", "x.*")
    return compare.evidence_violations(pages, evidence, "fixture_id")


def readiness_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of comparable readiness reports before and after, one report for each rule; scores and reports are made from the documents' ids."""
    docs = read_table(spark, folder, "fixture_docs", "fixture_id", "rule_id").distinct().select("rule_id", F.concat(F.lit("/"), F.col("fixture_id").cast("string")).alias("url"), "fixture_id")
    after = docs.select("rule_id", "url", (F.col("fixture_id") % 101).alias("total"))
    before = docs.select("rule_id", "url", (F.col("fixture_id") % 97).alias("total"))
    return compare.page_pairs(_readiness_gate(spark, folder), after, before, "rule_id")


def _readiness_gate(spark: SparkSession, folder: str) -> DataFrame:
    # one row for each rule of the roster, with a few addresses
    names = spark.createDataFrame([(r.id,) for r in rules.REGISTRY], "rule_id string")
    n = F.length("rule_id")
    pages = lambda turned: F.when(n % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("/a"), turned))
    after = names.select("rule_id", F.when(n % 7 == 0, None).otherwise("v2").alias("scoring_version"), pages(F.lit("/b")).alias("page_urls"), F.timestamp_seconds(F.lit(2000)).alias("report_ts"))
    before = names.select("rule_id", F.when(n % 5 == 0, "v1").otherwise("v2").alias("scoring_version"), pages(F.when(n % 4 == 0, "/c").otherwise("/b")).alias("page_urls"), F.timestamp_seconds(F.when(n % 3 == 0, 3000).otherwise(1000)).alias("report_ts"))
    return compare.readiness_gate(after, before, "rule_id")


def readiness_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _readiness_gate(spark, folder).select("rule_id", "comparable", F.array_join("reasons", ",").alias("reasons"))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Names and labels of documents and targets."""
    docs = read_table(spark, folder, "fixture_docs", "fixture_id", "title", "url").distinct()
    i = F.col("fixture_id")
    target = F.element_at(F.array(F.col("url"), F.lit("docs/a.md"), F.lit("site.example"), F.lit("./docs"), F.lit("../x"), F.lit("plain"), F.lit("a/b.c/d")), (i % 7 + 1).cast("int"))
    capture = F.element_at(F.array(*[F.lit(c) for c in tx.CAPTURES]), (i % 5 + 1).cast("int"))
    name = F.when(i % 2 == 0, F.concat("title", F.lit(" | Site - X"))).when(i % 3 == 0, F.lit(" - x"))
    return docs.select(
        "fixture_id", tx.percent((i % 200) / 200).alias("share"), tx.source_label(target).alias("label"), tx.capture_label(capture).alias("capture"), tx.site_name(name, F.lit("/srv/site/")).alias("name"),
        tx.audit_source(F.when(i % 2 == 0, "markdown").otherwise("static")).alias("source"), tx.target_kind(target).alias("kind"), tx.target_path(target).alias("path"),
        ledger.day_after(F.concat(F.lit("2024-02-"), F.lpad((i % 31).cast("string"), 2, "0")), 3).alias("after"),
    )


def site_list(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each host's page list in order."""
    docs = read_table(spark, folder, "fixture_docs", "fixture_id", "title", "url").distinct()
    totals = rq.scored(spark, folder).select("fixture_id", "total")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    pages = docs.join(totals, "fixture_id").select(host.alias("host"), F.col("fixture_id").alias("ord"), "title", "url", "total").where("host <> ''")
    return generate.site_list(pages, "host", tx.site_name(F.col("title"), F.col("host")), F.concat(F.lit("Pages of "), F.col("host")))


def generated_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that is generated, as (artefact, subject, ord, text)."""
    lines = site_list(spark, folder).select(F.lit("page-list").alias("artefact"), F.col("host").alias("subject"), (F.col("section") * (1 << 40) + F.col("ord")).alias("ord"), F.col("line").alias("text"))
    crumbs = breadcrumb_candidates(spark, folder).select(F.lit("breadcrumb"), F.col("fixture_id").cast("string"), F.lit(0).cast("bigint"), "json")
    articles = article_candidates(spark, folder).select(F.lit("article"), F.col("fixture_id").cast("string"), F.lit(0).cast("bigint"), "json")
    crawlers = robots_suggestions(spark, folder).select(F.lit("robots"), "origin", F.lit(0).cast("bigint"), F.concat(F.lit("User-agent: "), "crawler"))
    return lines.union(crumbs).union(articles).union(crawlers)


def first_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Each different action once for every rule: the first issue with it, by severity and then by id."""
    rows = read_table(spark, folder, "issues", "issue_id", "rule_id", "severity", "selector").where("selector IS NOT NULL")
    order = F.struct(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower("severity")).alias("s"), "issue_id")
    return rows.groupBy("rule_id", F.col("selector").alias("action")).agg(F.min_by("issue_id", order).alias("issue_id"))


def llms_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "fixture_docs", "fixture_id", "title", "url").distinct()
    totals = rq.scored(spark, folder).select("fixture_id", "total")
    return docs.join(totals, "fixture_id").select("fixture_id", generate.list_line(F.col("title"), F.col("url"), F.col("total")).alias("line"))


def llms_full_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "fixture_docs", "fixture_id", "title", "raw_text").distinct()
    return docs.select("fixture_id", generate.full_text(F.col("title"), F.coalesce("raw_text", F.lit(""))).alias("section"))


def breadcrumb_candidates(spark: SparkSession, folder: str) -> DataFrame:
    docs = rq.prepared(spark, folder).where(~generate.has_type(F.col("facts.nodes"), "BreadcrumbList"))
    return docs.select("fixture_id", generate.breadcrumb(F.col("links")).alias("json")).where("json IS NOT NULL").distinct()


def article_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an article element and enough structure; author and date are given here by their id."""
    meta = F.map_concat(F.col("meta"), F.when(F.col("fixture_id") % 2 == 0, F.create_map(F.lit("author"), F.lit("A"), F.lit("date"), F.lit("2026-01-01"))).otherwise(F.create_map().cast("map<string,string>")))
    docs = rq.prepared(spark, folder).withColumn("given", meta).where(~generate.has_type(F.col("facts.nodes"), *generate.ARTICLE_TYPES))
    found = docs.where(generate.is_article_candidate(F.col("html"), F.col("given"), F.col("headings"), F.col("paragraphs")))
    titles = read_table(spark, folder, "fixture_docs", "fixture_id", "title").distinct()
    json = generate.article(F.col("title"), F.col("given"), F.nullif(F.col("given")["description"], F.lit("")))
    return found.select("fixture_id", "given").join(titles, "fixture_id").select("fixture_id", json.alias("json")).distinct()


def robots_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.expr(_ROBOTS), F.expr("CASE WHEN site_id % 2 = 0 THEN 'user-agent:  gptbot' ELSE '' END"))
    return generate.missing_crawlers(read_table(spark, folder, "sites", "site_id", "origin").select("origin", text.alias("text")))


_REVIEWS = "(60 + (site_id * k) % 40)"


def ai_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Rule scores of each site blended with up to three reviews; both are made from the site's id."""
    sites = read_table(spark, folder, "sites", "site_id")
    scores = {d: (F.col("site_id") * (i + 3)) % (most + 1) for i, (d, most) in enumerate(rules.DIMENSIONS.items())}
    base = sites.select("site_id", *[c.cast("int").alias(d) for d, c in scores.items()])
    base = base.withColumn("total", sum((F.col(d) for d in rules.DIMENSIONS), F.lit(0)))
    reviews = sites.select("site_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select(
        "site_id", F.col("k").cast("string").alias("source"), (F.col("k") <= F.col("site_id") % 4).alias("available"), F.expr(_REVIEWS).cast("int").alias("score"),
        *[((F.col("site_id") + F.col("k") * (i + 1)) % (most + 5)).cast("int").alias(d) for i, (d, most) in enumerate(rules.DIMENSIONS.items())],
    )
    return compare.blended(base, reviews, "site_id")


_PAIRED = """
WITH r AS (SELECT *, lag(snapshot_no) OVER w AS b_no, lag(report_ts) OVER w AS b_ts, lag(start_url) OVER w AS b_url, lag(metric_evidence_version) OVER w AS b_version,
  lag(max_pages) OVER w AS b_pages, lag(truncated) OVER w AS b_cut FROM site_reports WINDOW w AS (PARTITION BY site_id ORDER BY snapshot_no)),
g AS (SELECT site_id, snapshot_no, b_no, concat_ws(',', CASE WHEN metric_evidence_version IS NULL OR metric_evidence_version IS DISTINCT FROM b_version THEN 'evidence-version' END,
  CASE WHEN start_url IS DISTINCT FROM b_url THEN 'start-url' END, CASE WHEN max_pages IS DISTINCT FROM b_pages THEN 'page-limit' END,
  CASE WHEN coalesce(truncated, false) OR coalesce(b_cut, false) THEN 'page-limit-reached' END, CASE WHEN report_ts < b_ts THEN 'baseline-newer' END) AS reasons FROM r WHERE b_no IS NOT NULL)
"""
_GATE = f"""
WITH x AS (SELECT *, {", ".join(f"{e} AS {c}" for c, e in _REPORT_PARTS.items())}, CASE WHEN site_id % 5 = 2 AND snapshot_no % 3 = 0 THEN 1 ELSE 0 END AS turned FROM site_reports),
r AS (SELECT *, lag(snapshot_no) OVER w AS b_no, lag(report_ts) OVER w AS b_ts, lag(start_url) OVER w AS b_url, lag(metric_evidence_version) OVER w AS b_version, lag(max_pages) OVER w AS b_pages,
  lag(truncated) OVER w AS b_cut, lag(origin) OVER w AS b_origin, lag(n_skipped) OVER w AS b_skipped, lag(n_silent) OVER w AS b_silent, lag(turned) OVER w AS b_turned FROM x WINDOW w AS (PARTITION BY site_id ORDER BY snapshot_no)),
g AS (SELECT site_id, snapshot_no, concat_ws(',', CASE WHEN metric_evidence_version IS NULL OR metric_evidence_version IS DISTINCT FROM b_version THEN 'evidence-version' END,
  CASE WHEN start_url IS DISTINCT FROM b_url OR origin <> b_origin THEN 'start-url' END, CASE WHEN max_pages IS DISTINCT FROM b_pages THEN 'page-limit' END,
  CASE WHEN coalesce(truncated, false) OR coalesce(b_cut, false) THEN 'page-limit-reached' END, CASE WHEN turned <> b_turned THEN 'page-set' END, CASE WHEN n_skipped > 0 OR b_skipped > 0 THEN 'robots-skipped' END,
  CASE WHEN n_silent > 0 OR b_silent > 0 THEN 'no-response' END, CASE WHEN report_ts < b_ts THEN 'baseline-newer' END) AS reasons FROM r WHERE b_no IS NOT NULL)
"""
_IDS = """
WITH o AS (SELECT event_id AS e, 'search' AS source, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS stamp, 'a "quoted" user ' || user_id AS k, user_id, event_type, CASE WHEN event_id % 31 = 3 THEN 'empty-text' WHEN event_id % 41 = 7 THEN 'timestamp' WHEN event_id % 43 = 9 THEN 'date'
  WHEN event_id % 37 = 11 THEN 'date-order' WHEN event_id % 47 = 5 THEN 'number' END AS reason,
  '{"observedAt":"' || stamp || '","source":"search","keyword":"A \\"quoted\\" User ' || user_id || '","targetPath":"/' || event_type || '","position":' || CASE WHEN event_id % 5 = 1 THEN 'null' WHEN event_id % 2 = 0 THEN ((event_id % 60) // 2)::VARCHAR ELSE ((event_id % 60) // 2) || '.5' END
  || ',"clicks":' || event_id % 9 || ',"impressions":' || event_id % 100 || ',"startDate":"2026-02-01","endDate":"2026-02-28","country":"US","device":"' || CASE WHEN event_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END || '","searchType":"web"}' AS identity FROM events)
"""
_GATED_REPORTS = "WITH n AS (SELECT rule_id, length(rule_id) AS n FROM (VALUES " + ", ".join(f"('{r.id}')" for r in rules.REGISTRY) + """) v(rule_id)),
g AS (SELECT rule_id, concat_ws(',', CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN 'scoring-version' END, CASE WHEN n % 11 = 0 THEN 'no-pages' END, CASE WHEN n % 11 <> 0 AND n % 4 = 0 THEN 'page-set' END, CASE WHEN n % 3 = 0 THEN 'baseline-newer' END) AS reasons FROM n) """
_PRIORITY = "['high', 'medium', 'low']"
_SITE_LIST = rq._SCORED + """, pg AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, fixture_id, title, url, total FROM totals JOIN (SELECT DISTINCT fixture_id, title, url FROM fixture_docs) USING (fixture_id)),
hd AS (SELECT host, min({'f': fixture_id, 't': coalesce(title, '')}).t AS t FROM pg WHERE host <> '' GROUP BY host),
nm AS (SELECT host, coalesce(nullif(trim(split_part(split_part(t, '|', 1), '-', 1)), ''), host) AS name FROM hd),
sl AS (SELECT host, 0 AS section, unnest([0, 1, 2, 3, 4, 5])::BIGINT AS ord, unnest(['# ' || name, '', '> Pages of ' || host, '', '## Pages', '']) AS line FROM nm
  UNION ALL SELECT host, 1, fixture_id, '- [' || coalesce(title, '') || '](' || coalesce(url, '') || '): content-readiness score ' || total || '/100' FROM pg WHERE host <> '') """
_EVENTS = "SELECT event_id AS seq, 'user ' || user_id AS query, '/' || event_type AS target_path, strftime(ts, '%Y-%m-%d %H:%M:%S') AS observed_at, ts, CAST(floor(value) AS BIGINT) % 30 + 1 AS position FROM events"
_DIMS = list(rules.DIMENSIONS.items())
_MIX = "CASE WHEN n = 0 THEN {r} WHEN n = 1 THEN floor({r} * 0.6 + {a} * 0.4 + 0.5) ELSE floor({r} * 0.5 + {a} * 0.5 + 0.5) END"

QUERIES = {
    f.__name__: f
    for f in (
        metrics_compare, report_gate, findings_persisting, severity_histogram, issues_by_rule, first_messages, unknown_evidence, fixture_expectations,
        readiness_compare, readiness_gate, readiness_pairs, evidence_violations, ledger_latest_observation, observation_ids, refused_observations, ledger_new_queries, ledger_totals,
        ledger_candidates, ledger_segments, labels, first_suggestions, llms_lines, llms_full_text, site_list, breadcrumb_candidates, article_candidates, generated_bundle,
        robots_suggestions, ai_blend,
    )
}
ORACLE_SQL = {
    "metrics_compare": _PAIRED + """SELECT g.site_id, g.snapshot_no, a.metric_id, b.metric_value AS before, a.metric_value AS after,
  CASE WHEN g.reasons = '' THEN a.metric_value - b.metric_value END AS delta, g.reasons FROM g JOIN site_metrics a ON a.site_id = g.site_id AND a.snapshot_no = g.snapshot_no
  LEFT JOIN site_metrics b ON b.site_id = g.site_id AND b.snapshot_no = g.b_no AND b.metric_id = a.metric_id""",
    "report_gate": _GATE + "SELECT site_id, snapshot_no, reasons = '' AS comparable, reasons FROM g",
    "findings_persisting": FINDING_ROWS + """SELECT site_id, snapshot_no, kind, change_kind, count(*) AS n FROM (SELECT * FROM changes UNION ALL
  SELECT a.site_id, a.snapshot_no, a.kind, a.target, 'persisting' FROM a JOIN b ON b.site_id = a.site_id AND b.snapshot_no = a.snapshot_no
    AND b.kind IS NOT DISTINCT FROM a.kind AND b.target IS NOT DISTINCT FROM a.target
  WHERE NOT (a.severity IS DISTINCT FROM b.severity OR a.observed IS DISTINCT FROM b.observed OR a.occurrences IS DISTINCT FROM b.occurrences)) GROUP BY ALL""",
    "severity_histogram": "SELECT v.severity, count(issue_id) AS n_issues FROM (VALUES ('critical'), ('warning'), ('info')) v(severity) "
    "LEFT JOIN (SELECT DISTINCT issue_id, severity FROM issues) i ON lower(i.severity) = v.severity GROUP BY ALL",
    "issues_by_rule": "SELECT rule_id, coalesce(dimension, 'none') AS dimension, count(*) AS n_issues, count(DISTINCT fixture_id) AS n_documents, count_if(lower(severity) = 'critical') AS n_critical "
    "FROM (SELECT DISTINCT issue_id, rule_id, dimension, severity, fixture_id FROM issues) GROUP BY ALL",
    "first_messages": "SELECT rule_id, message, min(issue_id) AS issue_id, count(DISTINCT issue_id) AS n FROM issues WHERE length(message) > 0 GROUP BY ALL",
    "unknown_evidence": "SELECT DISTINCT rule_id, dimension, issue_id FROM issues WHERE dimension IS NOT NULL AND (rule_id, dimension) NOT IN (VALUES "
    + ", ".join(f"('{r.id}', '{r.dimension}')" for r in rules.REGISTRY) + ")",
    "fixture_expectations": rq._DOCS + ", l AS (" + " UNION ALL ".join(f"SELECT fixture_id, '{r.id}' AS rule_id, CAST({rq.RULE_SQL[r.id][0]} AS INT) AS got FROM s" for r in rules.REGISTRY)
    + "), x AS (SELECT DISTINCT fixture_id, rule_id, kind, expected.score AS want FROM fixture_docs) SELECT rule_id, kind, count(*) AS n, count_if(got = want) AS n_equal, sum(got) AS points FROM x JOIN l USING (fixture_id, rule_id) GROUP BY ALL",
    "readiness_compare": rq._SCORED + ", k AS (SELECT DISTINCT fixture_id, kind FROM fixture_docs), m AS (SELECT kind, " + ", ".join(f'CAST(floor(avg("{d}") + 0.5) AS INT) AS "{d}"' for d, _ in _DIMS)
    + " FROM totals JOIN k USING (fixture_id) GROUP BY kind), t AS (SELECT *, " + " + ".join(f'"{d}"' for d, _ in _DIMS) + " AS total FROM m), u AS ("
    + " UNION ALL ".join(f"SELECT kind, '{d}' AS key, \"{d}\" AS v FROM t" for d in [*rules.DIMENSIONS, "total"])
    + ") SELECT b.key, b.v AS before, a.v AS after, a.v - b.v AS delta FROM u a JOIN u b USING (key) WHERE a.kind = 'positive' AND b.kind = 'negative'",
    "ledger_latest_observation": f"SELECT query, target_path, seq, observed_at, position FROM ({_EVENTS}) QUALIFY row_number() OVER (PARTITION BY query, target_path ORDER BY ts DESC, seq) = 1",
    "observation_ids": _IDS + "SELECT e AS seq, substr(sha256(identity), 1, 16) AS observation_id FROM o WHERE reason IS NULL",
    "refused_observations": _IDS + "SELECT reason, count(*) AS n FROM (SELECT coalesce(reason, CASE WHEN e % 7 = 0 THEN 'known' END) AS reason FROM o) WHERE reason IS NOT NULL GROUP BY ALL",
    "ledger_new_queries": f"SELECT 'user ' || user_id AS query, '/p' AS target_path, {_PRIORITY}[user_id % 3 + 1] AS priority, 'eligible' AS status FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 5 <> 0 AND user_id % 10 <> 9",
    "ledger_totals": "SELECT count_if(user_id % 4 = 0) AS eligible, count_if(user_id % 4 = 1) AS monitoring, count_if(user_id % 4 = 2) AS completed, (SELECT count(*) FROM events) AS observations FROM (SELECT DISTINCT user_id FROM events)",
    "ledger_candidates": f"""SELECT event_type, rank_group, seq FROM (SELECT event_type, event_id AS seq, (length(event_type) + event_id % 2) % 3 AS rank_group, CASE WHEN event_id % 4 <> 0 THEN event_id % 50 + 1 END AS position, event_id % 83 AS impressions,
  event_id % 3 AS priority FROM events) QUALIFY row_number() OVER (PARTITION BY event_type, rank_group ORDER BY CASE rank_group WHEN 0 THEN coalesce(position, 1e9) WHEN 1 THEN -impressions ELSE priority END, CASE WHEN rank_group = 1 THEN coalesce(position, 1e9) ELSE 0 END, seq) = 1""",
    "ledger_segments": """WITH o AS (SELECT event_id AS seq, ts, 'u' || user_id AS query, '/' || event_type AS target_path, event_id % 2 AS device FROM events),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query, target_path ORDER BY ts, seq) = 1)
SELECT query, target_path, f.seq AS baseline_seq, count(*) AS n_reviews FROM f JOIN o USING (query, target_path, device) WHERE o.ts > f.ts GROUP BY ALL""",
    "evidence_violations": rq._SCORED + "SELECT fixture_id, 'structure' AS dimension, structure + 1 AS given, structure AS actual FROM totals WHERE fixture_id % 10 = 0",
    "readiness_gate": _GATED_REPORTS + "SELECT rule_id, reasons = '' AS comparable, reasons FROM g",
    "readiness_pairs": _GATED_REPORTS + "SELECT rule_id, '/' || fixture_id AS url, fixture_id % 97 AS before, fixture_id % 101 AS after, fixture_id % 101 - fixture_id % 97 AS delta FROM (SELECT DISTINCT fixture_id, rule_id FROM fixture_docs) JOIN g USING (rule_id) WHERE reasons = ''",
    "labels": """WITH d AS (SELECT DISTINCT fixture_id AS i, title, url, [url, 'docs/a.md', 'site.example', './docs', '../x', 'plain', 'a/b.c/d'][fixture_id % 7 + 1] AS target FROM fixture_docs),
k AS (SELECT *, CASE WHEN i % 7 = 0 THEN CASE WHEN url IS NOT NULL THEN 'url' END WHEN i % 7 = 1 THEN 'file' WHEN i % 7 IN (3, 4) THEN 'refused' ELSE 'url' END AS kind FROM d)
SELECT i AS fixture_id, floor((i % 200)::DOUBLE / 200 * 100 + 0.5)::BIGINT || '%' AS share, CASE WHEN i % 7 = 0 AND url IS NOT NULL THEN 'Affected URL' ELSE 'Affected source group' END AS label,
  ['local file', 'response HTML', 'browser-rendered HTML', 'provided HTML', 'Markdown'][i % 5 + 1] AS capture,
  coalesce(nullif(CASE WHEN i % 2 = 0 THEN trim(split_part(split_part(coalesce(title || ' | Site - X', ''), '|', 1), '-', 1)) END, ''), 'site') AS name, CASE WHEN i % 2 = 0 THEN 'markdown' ELSE 'html' END AS source, kind,
  CASE WHEN i % 7 IN (0, 1) THEN target WHEN kind = 'url' THEN 'https://' || target END AS path, strftime(TRY_CAST('2024-02-' || lpad((i % 31)::VARCHAR, 2, '0') AS DATE) + INTERVAL 3 DAY, '%Y-%m-%d') AS after FROM k""",
    "first_suggestions": """SELECT rule_id, selector AS action, issue_id FROM issues WHERE selector IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rule_id, selector
  ORDER BY coalesce(list_position(['critical', 'warning', 'info'], lower(severity)), 0), issue_id) = 1""",
    "site_list": _SITE_LIST + "SELECT * FROM sl",
    "llms_lines": rq._SCORED + "SELECT fixture_id, '- [' || coalesce(title, '') || '](' || coalesce(url, '') || '): content-readiness score ' || total || '/100' AS line "
    "FROM totals JOIN (SELECT DISTINCT fixture_id, title, url FROM fixture_docs) USING (fixture_id)",
    "llms_full_text": "SELECT DISTINCT fixture_id, '## ' || coalesce(title, '') || chr(10) || chr(10) || substr(coalesce(raw_text, ''), 1, 5000) || CASE WHEN length(raw_text) > 5000 THEN chr(10) || chr(10) || '[cut: ' || "
    "length(raw_text) || ' characters, first 5000 shown]' ELSE '' END || chr(10) || chr(10) || '---' || chr(10) AS section FROM fixture_docs",
    "breadcrumb_candidates": rq._DOCS + """, c AS (SELECT fixture_id, list_filter(links, lambda x: starts_with(x.href, '/') AND length(x.text) > 0)[1:5] AS ls FROM s)
SELECT fixture_id, '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[' || array_to_string([
  '{"@type":"ListItem","position":' || i || ',"name":' || to_json(ls[i].text) || ',"item":' || to_json(ls[i].href) || '}' FOR i IN range(1, len(ls) + 1)], ',') || ']}' AS json FROM c WHERE len(ls) >= 2""",
    "article_candidates": rq._DOCS + ", a AS (SELECT DISTINCT fixture_id FROM n WHERE ok AND typ IN ('Article', 'TechArticle', 'BlogPosting')), t AS (SELECT DISTINCT fixture_id, title FROM fixture_docs) "
    "SELECT fixture_id, '{\"@context\":\"https://schema.org\",\"@type\":\"Article\",' || coalesce('\"headline\":' || to_json(title) || ',', '') || '\"author\":{\"@type\":\"Person\",\"name\":\"A\"},\"datePublished\":\"2026-01-01\"' "
    "|| coalesce(',\"description\":' || to_json(nullif(meta['description'], '')), '') || '}' AS json FROM s JOIN t USING (fixture_id) WHERE fixture_id % 2 = 0 "
    "AND regexp_matches(html, '(?i)<article\\b') AND len(headings) >= 2 AND len(paragraphs) >= 3 AND fixture_id NOT IN (SELECT fixture_id FROM a)",
    "robots_suggestions": "SELECT origin, c AS crawler FROM (SELECT site_id, origin, unnest([" + ", ".join(f"'{c}'" for c in generate.CRAWLERS) + "]) AS c FROM sites) WHERE NOT (c = 'GPTBot' AND site_id % 2 = 0)",
    "ai_blend": "WITH b AS (SELECT site_id, " + ", ".join(f'CAST((site_id * {i + 3}) % {most + 1} AS INT) AS "{d}"' for i, (d, most) in enumerate(_DIMS))
    + " FROM sites), t AS (SELECT *, " + " + ".join(f'"{d}"' for d, _ in _DIMS) + " AS total FROM b), v AS (SELECT site_id, count(*) AS n, avg(score) AS score, "
    + ", ".join(f'floor(avg("{d}") + 0.5) AS "{d}"' for d, _ in _DIMS) + " FROM (SELECT site_id, k, (60 + (site_id * k) % 40) AS score, "
    + ", ".join(f'(site_id + k * {i + 1}) % {most + 5} AS "{d}"' for i, (d, most) in enumerate(_DIMS))
    + " FROM sites, (VALUES (1), (2), (3)) x(k) WHERE k <= site_id % 4) GROUP BY site_id), j AS (SELECT t.*, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN v.score ELSE floor(v.score + 0.5) END AS s, "
    + ", ".join(f'v."{d}" AS "v_{d}"' for d, _ in _DIMS) + " FROM t LEFT JOIN v USING (site_id)) SELECT site_id, n AS n_reviews, CAST(" + _MIX.format(r="total", a="s") + " AS INT) AS consensus, "
    + ", ".join(f'CAST(least({most}, {_MIX.format(r=chr(34) + d + chr(34), a=chr(34) + "v_" + d + chr(34))}) AS INT) AS "{d}"' for d, most in _DIMS) + " FROM j",
}
ORACLE_SQL["generated_bundle"] = (
    f"SELECT 'page-list' AS artefact, host AS subject, section * {1 << 40} + ord AS ord, line AS text FROM ({ORACLE_SQL['site_list']}) "
    f"UNION ALL SELECT 'breadcrumb', fixture_id::VARCHAR, 0, json FROM ({ORACLE_SQL['breadcrumb_candidates']}) "
    f"UNION ALL SELECT 'article', fixture_id::VARCHAR, 0, json FROM ({ORACLE_SQL['article_candidates']}) "
    f"UNION ALL SELECT 'robots', origin, 0, 'User-agent: ' || crawler FROM ({ORACLE_SQL['robots_suggestions']})"
)

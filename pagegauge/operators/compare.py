"""Comparisons between reports: metrics with a gate, readiness changes, blended scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.operators.rules import DIMENSIONS


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


#: what a report may hold besides, each left out of the gate where the table has no such column
_OPTIONAL = ("origin", "page_urls", "n_skipped", "n_silent")


def consecutive_reports(reports: DataFrame) -> DataFrame:
    """Each report of a site with its baseline, the report before, and the reasons why they cannot be compared.

    Reports are one row for each site and snapshot, with at most 200 page addresses: the window sorts only these.
    """
    held = [c for c in _OPTIONAL if c in reports.columns]
    order = Window.partitionBy("site_id").orderBy("snapshot_no")
    base = F.lag(F.struct("snapshot_no", "report_ts", "start_url", "metric_evidence_version", "max_pages", "truncated", *held)).over(order)
    paired = reports.withColumn("base", base)
    b = F.col("base")
    moved = ~F.col("start_url").eqNullSafe(b["start_url"])
    reasons = [
        F.when(F.col("metric_evidence_version").isNull() | ~F.col("metric_evidence_version").eqNullSafe(b["metric_evidence_version"]), "evidence-version"),
        F.when(moved | ~F.col("origin").eqNullSafe(b["origin"]) if "origin" in held else moved, "start-url"),
        F.when(~F.col("max_pages").eqNullSafe(b["max_pages"]), "page-limit"),
        F.when(F.coalesce("truncated", F.lit(False)) | F.coalesce(b["truncated"], F.lit(False)), "page-limit-reached"),
    ]
    if "page_urls" in held:
        reasons.append(F.when(~same_set(F.col("page_urls"), b["page_urls"]), "page-set"))
    if "n_skipped" in held:
        reasons.append(F.when((F.col("n_skipped") > 0) | (b["n_skipped"] > 0), "robots-skipped"))
    if "n_silent" in held:
        reasons.append(F.when((F.col("n_silent") > 0) | (b["n_silent"] > 0), "no-response"))
    reasons.append(F.when(F.col("report_ts") < b["report_ts"], "baseline-newer"))
    return paired.withColumn("reasons", F.when(b.isNotNull(), F.array_compact(F.array(*reasons))))


def metric_changes(reports: DataFrame, metrics: DataFrame) -> DataFrame:
    """(site_id, snapshot_no, metric_id, before, after, delta): delta is NULL unless both are measured and the reports comparable."""
    paired = consecutive_reports(reports).where(F.col("base").isNotNull()).select("site_id", "snapshot_no", F.col("base.snapshot_no").alias("_b"), "reasons")
    after = metrics.select("site_id", "snapshot_no", "metric_id", F.col("metric_value").alias("after"))
    before = metrics.select("site_id", F.col("snapshot_no").alias("_b"), "metric_id", F.col("metric_value").alias("before"))
    joined = paired.join(after, ["site_id", "snapshot_no"]).join(before, ["site_id", "_b", "metric_id"], "left")
    delta = F.when(F.size("reasons") == 0, F.col("after") - F.col("before"))
    return joined.select("site_id", "snapshot_no", "metric_id", "before", "after", delta.alias("delta"), F.array_join("reasons", ",").alias("reasons"))


def readiness_changes(after: DataFrame, before: DataFrame) -> DataFrame:
    """(key, before, after, delta): one row for the total and each dimension of two one-row averages."""
    keys = [*DIMENSIONS, "total"]
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias(name)) for k in keys])).alias("x")).select("x.*")
    joined = long(before, "before").join(F.broadcast(long(after, "after")), "key")
    return joined.withColumn("delta", F.col("after") - F.col("before"))


def _half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("int")


def blended(rules: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """``rules`` (key, dimensions, total) blended with the available ``reviews`` (key, source, available, score, dimensions).

    No review: the rules hold; one: 60 to 40; more: half of the rounded mean of the reviews.
    Dimensions are capped at their maximum.
    """
    usable = reviews.where(F.col("available") & (F.col("score") > 0))
    means = usable.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_reviews"), F.avg("score").alias("_score"), *[_half_up(F.avg(d)).alias(f"_{d}") for d in DIMENSIONS]
    )
    joined = rules.join(means, key, "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))
    n = F.col("n_reviews")
    review = F.when(n == 1, F.col("_score")).otherwise(_half_up(F.col("_score")))
    mix = lambda rule, other: F.when(n == 0, rule).when(n == 1, _half_up(rule * 0.6 + other * 0.4)).otherwise(_half_up(rule * 0.5 + other * 0.5))
    dims = {d: F.least(F.lit(most), mix(F.col(d), F.col(f"_{d}"))).cast("int") for d, most in DIMENSIONS.items()}
    return joined.select(key, n.cast("bigint").alias("n_reviews"), mix(F.col("total"), review).cast("int").alias("consensus"), *[c.alias(d) for d, c in dims.items()])


def readiness_gate(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(key, comparable, reasons) of two readiness reports (key, scoring_version, page_urls, report_ts) of one subject."""
    b = {c: F.col(f"_b_{c}") for c in ("scoring_version", "page_urls", "report_ts")}
    paired = after.join(before.select(key, *[F.col(c).alias(f"_b_{c}") for c in b]), key)
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    reasons = F.array_compact(F.array(
        F.when(F.coalesce("scoring_version", F.lit("")).isin("") | ~F.col("scoring_version").eqNullSafe(b["scoring_version"]), "scoring-version"),
        F.when(none(F.col("page_urls")) | none(b["page_urls"]), "no-pages"),
        F.when(~F.array_sort("page_urls").eqNullSafe(F.array_sort(b["page_urls"])), "page-set"),
        F.when(F.col("report_ts") < b["report_ts"], "baseline-newer"),
    ))
    return paired.select(key, (F.size(reasons) == 0).alias("comparable"), reasons.alias("reasons"))


def page_pairs(gate: DataFrame, after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(key, url, before, after, delta) of the pages (key, url, total) of comparable reports."""
    joined = after.select(key, "url", F.col("total").alias("after")).join(before.select(key, "url", F.col("total").alias("before")), [key, "url"])
    return joined.join(gate.where("comparable").select(key), key, "left_semi").withColumn("delta", F.col("after") - F.col("before"))


def evidence_violations(pages: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, dimension, given, actual): dimension scores of ``pages`` that the rule results (key, dimension, score, max_score, weight) do not reproduce.

    A dimension without results counts as 0.
    """
    sums = evidence.groupBy(key, "dimension").agg(F.sum("score").alias("s"), F.sum("max_score").alias("m"), F.sum("weight").alias("w"))
    actual = sums.select(key, "dimension", F.when(F.col("m") > 0, _half_up(F.col("s") / F.col("m") * F.col("w"))).otherwise(0).alias("actual"))
    given = pages.select(key, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("given")) for d in DIMENSIONS])).alias("x")).select(key, "x.*")
    return given.join(actual, [key, "dimension"], "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where(F.col("given") != F.col("actual"))

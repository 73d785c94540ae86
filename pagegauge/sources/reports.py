"""Report readers with fixed schemas and checks, and sinks that never overwrite by accident."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.functions.text import CAPTURES
from pagegauge.functions.urls import is_web
from pagegauge.operators.rules import DIMENSIONS
from pagegauge.operators.site import KINDS

SCORES = ", ".join(f"{d}: int" for d in DIMENSIONS) + ", total: int"
RESULT = "id: string, dimension: string, weight: int, score: double, maxScore: double, issues: array<struct<message: string, severity: string>>, suggestions: array<struct<action: string, detail: string>>"
PREVIEW = "text: string, truncated: boolean, format: string, capture: string"
SCAN_REPORT = (
    f"scoringVersion string, timestamp string, overall struct<{SCORES}>, pages array<struct<url: string, title: string, scores: struct<{SCORES}>, "
    f"ruleResults: array<struct<{RESULT}>>, sourcePreview: struct<{PREVIEW}>>>"
)
#: fixed values of the contract
SCORING_VERSIONS = ("readiness-v0.6.0-details-v1", "readiness-v0.6.1-details-v1")
SEVERITIES = ("critical", "warning", "info")
PREVIEW_CHARS = 6000
SITE_REPORT = (
    "contractVersion string, metricEvidenceVersion string, startUrl string, origin string, maxPages int, crawledPages int, truncated boolean, timestamp string, "
    "pages array<struct<requestedUrl: string, finalUrl: string, status: int>>, findings array<struct<kind: string, target: string>>, checks array<struct<id: string, status: string>>"
)


def read_scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """Scan reports; a report that breaks the contract fails the read."""
    return spark.read.schema(SCAN_REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_site_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SITE_REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def scan_violations(reports: DataFrame) -> DataFrame:
    """(timestamp, violation): scores out of range, totals that are no sums, averages that do not follow from the pages."""
    s = F.col("overall")
    out_of_range = F.exists(F.array(*[(s[d] < 0) | (s[d] > most) | s[d].isNull() for d, most in DIMENSIONS.items()]), lambda x: x)
    bad_total = s["total"] != sum((s[d] for d in DIMENSIONS), F.lit(0))
    n = F.size("pages")
    mean = lambda d: F.floor(F.aggregate("pages", F.lit(0), lambda a, p: a + p["scores"][d]) / F.greatest(n, F.lit(1)) + 0.5).cast("int")
    bad_mean = (n > 0) & F.exists(F.array(*[mean(d) != s[d] for d in DIMENSIONS]), lambda x: x)
    urls = F.transform("pages", lambda p: p["url"])
    page_total = F.exists("pages", lambda p: p["scores"]["total"] != sum((p["scores"][d] for d in DIMENSIONS), F.lit(0)))
    results = F.flatten(F.transform("pages", lambda p: F.coalesce(p["ruleResults"], F.array().cast(f"array<struct<{RESULT}>>"))))
    odd = lambda r: F.coalesce((r["score"] < 0) | (r["score"] > r["maxScore"]) | r["maxScore"].isNull() | r["score"].isNull(), F.lit(True))
    severity = F.exists(results, lambda r: F.exists(F.coalesce(r["issues"], F.array().cast("array<struct<message: string, severity: string>>")), lambda i: ~F.coalesce(i["severity"].isin(*SEVERITIES), F.lit(False)) | i["message"].isNull()))
    repeated = F.exists("pages", lambda p: F.size(F.array_distinct(F.transform(p["ruleResults"], lambda r: r["id"]))) != F.size(p["ruleResults"]))
    previews = F.filter(F.transform("pages", lambda p: p["sourcePreview"]), lambda v: v.isNotNull())
    preview = F.exists(previews, lambda v: ~F.coalesce((F.length(v["text"]) <= PREVIEW_CHARS) & v["truncated"].isNotNull() & v["capture"].isin(*CAPTURES) & ((v["capture"] == "markdown") == (v["format"] == "markdown")), F.lit(False)))
    tests = {
        "score-range": out_of_range, "total": bad_total | F.coalesce(page_total, F.lit(False)), "average": bad_mean, "timestamp": F.try_to_timestamp("timestamp").isNull(),
        "repeated-url": F.size(F.array_distinct(urls)) != F.size(urls), "version": F.col("scoringVersion").isNotNull() & ~F.col("scoringVersion").isin(*SCORING_VERSIONS),
        "rule-score": F.exists(results, odd), "rule-issue": severity, "rule-repeated": F.coalesce(repeated, F.lit(False)), "preview": preview,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    return reports.select("timestamp", F.explode(found).alias("violation"))


def site_violations(reports: DataFrame) -> DataFrame:
    """(startUrl, violation): repeated addresses and checks, counts that disagree, values that the contract does not have."""
    urls = F.transform("pages", lambda p: p["requestedUrl"])
    checks = F.transform("checks", lambda c: c["id"])
    tests = {
        "repeated-url": F.size(F.array_distinct(urls)) != F.size(urls),
        "page-count": F.size("pages") != F.col("crawledPages"),
        "page-limit": F.col("crawledPages") > F.col("maxPages"),
        "version": ~F.coalesce(F.col("contractVersion") == "1.0", F.lit(False)) | (F.col("metricEvidenceVersion").isNotNull() & ~F.col("metricEvidenceVersion").isin("1.0", "1.1")),
        "limit-range": ~F.col("maxPages").between(1, 200),
        "address": F.exists(F.concat(F.array("startUrl", "origin"), urls), lambda u: ~F.coalesce(is_web(u), F.lit(False))),
        "status": F.exists("pages", lambda p: ~F.coalesce((p["status"] == 0) | p["status"].between(100, 599), F.lit(False))),
        "timestamp": F.try_to_timestamp("timestamp").isNull(),
        "check": F.size(F.array_distinct(checks)) != F.size(checks),
        "check-status": F.exists("checks", lambda c: ~F.coalesce(c["status"].isin("PASS", "WARNING", "FAIL", "N/A"), F.lit(False))),
        "finding": F.exists("findings", lambda f: ~F.coalesce(f["kind"].isin(*KINDS), F.lit(False)) | f["target"].isNull()),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    return reports.select("startUrl", F.explode(found).alias("violation"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; an existing target is an error."""
    df.write.mode("errorifexists").json(path)


def write_lines(df: DataFrame, path: str, line: str, *order: str) -> None:
    """One text artefact in order, as parts whose names sort in order; an existing target is an error."""
    ordered = df.orderBy(*order) if order else df
    ordered.select(F.col(line).alias("value")).write.mode("errorifexists").text(path)


def append_table(df: DataFrame, path: str) -> None:
    """Append-only ledger table."""
    df.write.mode("append").parquet(path)

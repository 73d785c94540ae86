"""Command line: python -m pagegauge.cli scan DIRECTORY [--threshold N] [--report FILE] | audit-build DIRECTORY | query NAME FOLDER."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.functions.documents import parsed_html, parsed_markdown
from pagegauge.operators import audit, rules
from pagegauge.report import render_report, write_report
from pagegauge.session import build_session
from pagegauge.sources import files
from pagegauge.sources.reports import write_json


def scanned(spark: SparkSession, root: str) -> DataFrame:
    """Dimension scores of all HTML and Markdown files below ``root``."""
    read = files.read_pages(spark, files.scan(root))
    html = read.where("format = 'html'").select("path", F.col("content").alias("html"), F.lit(None).cast("string").alias("markdown")).withColumn("doc", parsed_html("html"))
    text = read.where("format = 'markdown'").select("path", F.lit(None).cast("string").alias("html"), F.col("content").alias("markdown")).withColumn("doc", parsed_markdown("markdown"))
    docs = rules.from_parsed(html.unionByName(text))
    return rules.dimension_scores(rules.evaluated(docs)).select(F.col("path").alias("page"), *rules.DIMENSIONS, "total")


def scan_summary(scores: DataFrame) -> dict:
    """The head of a scan report: how many pages, the rounded averages, zeros where there are none."""
    found = rules.site_averages(scores).collect()
    overall = found[0].asDict() if found else {}
    return {"pageCount": scores.count(), "overall": {k: int(overall.get(k) or 0) for k in (*rules.DIMENSIONS, "total")}}


def audited_build(spark: SparkSession, root: str) -> DataFrame:
    read = files.read_pages(spark, files.scan_build(root)).withColumn("doc", parsed_html("content"))
    return audit.build_checks(read).select("path", *["b_" + audit.column_name(c) for c in audit.BUILD_CHECKS])


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagegauge")
    verbs = parser.add_subparsers(dest="verb", required=True)
    scan = verbs.add_parser("scan")
    scan.add_argument("directory")
    scan.add_argument("--threshold", type=float)
    scan.add_argument("--report")
    scan.add_argument("--json", help="folder for the report's pages, one JSON line each")
    verbs.add_parser("audit-build").add_argument("directory")
    query = verbs.add_parser("query")
    query.add_argument("name")
    query.add_argument("folder")
    options = parser.parse_args(args)
    if getattr(options, "threshold", None) is not None and not 0 <= options.threshold <= 100:
        parser.error("the threshold is a number from 0 to 100")
    spark = SparkSession.getActiveSession() or build_session()
    if options.verb == "scan":
        scores = scanned(spark, options.directory).cache()
        total = rules.site_averages(scores).collect()
        result = total[0].asDict() if total else {}
        print(json.dumps(scan_summary(scores)))
        if options.json:
            write_json(scores, options.json)
        if options.report:
            write_report(options.report, render_report(options.directory, scores))
        scores.unpersist()
        return int(options.threshold is not None and result.get("total", 0) < options.threshold)
    if options.verb == "audit-build":
        for row in audited_build(spark, options.directory).orderBy("path").toLocalIterator():
            print(json.dumps(row.asDict()))
        return 0
    from pagegauge.plans import catalogue

    for row in catalogue.QUERIES[options.name](spark, options.folder).toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""All queries of the core, in order, with the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagegauge.plans import report_queries, rule_queries, site_queries, snapshot_queries

_MODULES = (rule_queries, site_queries, snapshot_queries, report_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for module in _MODULES for name, query in module.QUERIES.items()
}
ORACLE_SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}

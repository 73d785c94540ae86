"""Queries over full snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagegauge.operators.snapshots import change_counts, snapshot_changes
from pagegauge.sources.tables import read_table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Findings added, removed or changed since the site's snapshot before."""
    return snapshot_changes(
        read_table(spark, folder, "site_findings"),
        read_table(spark, folder, "site_reports", "site_id", "snapshot_no"),
    )


def p6_change_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of findings added, removed and changed for each site and snapshot."""
    return change_counts(p6_found(spark, folder))


_TRIM = "regexp_replace(target, '^[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+|[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+$', '', 'g')"

FINDING_ROWS = f"""
WITH trimmed AS (SELECT *, {_TRIM} AS t FROM site_findings),
parts AS (SELECT *, regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS a FROM trimmed),
named AS (SELECT site_id, snapshot_no, kind, severity, observed, occurrences, delivered_at,
  CASE WHEN a = '' THEN t ELSE
    CASE WHEN starts_with(lower(a), 'http://') THEN regexp_replace(lower(a), ':(0*80)?$', '')
         WHEN starts_with(lower(a), 'https://') THEN regexp_replace(lower(a), ':(0*443)?$', '')
         ELSE lower(a) END || substr(t, length(a) + 1) END AS target FROM parts),
held AS (SELECT * FROM named
  QUALIFY row_number() OVER (PARTITION BY site_id, snapshot_no, kind, target ORDER BY delivered_at DESC) = 1),
cal AS (SELECT site_id, snapshot_no, lead(snapshot_no) OVER (PARTITION BY site_id ORDER BY snapshot_no) AS nxt,
  lag(snapshot_no) OVER (PARTITION BY site_id ORDER BY snapshot_no) AS prv
  FROM (SELECT DISTINCT site_id, snapshot_no FROM site_reports)),
b AS (SELECT h.site_id, c.nxt AS snapshot_no, kind, target, severity, observed, occurrences
  FROM held h JOIN cal c ON h.site_id = c.site_id AND h.snapshot_no = c.snapshot_no WHERE c.nxt IS NOT NULL),
a AS (SELECT h.site_id, h.snapshot_no, kind, target, severity, observed, occurrences
  FROM held h JOIN cal c ON h.site_id = c.site_id AND h.snapshot_no = c.snapshot_no WHERE c.prv IS NOT NULL),
changes AS (
  SELECT site_id, snapshot_no, kind, target, 'added' AS change_kind FROM a
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.site_id = a.site_id AND b.snapshot_no = a.snapshot_no
    AND b.kind IS NOT DISTINCT FROM a.kind AND b.target IS NOT DISTINCT FROM a.target)
  UNION ALL
  SELECT site_id, snapshot_no, kind, target, 'removed' FROM b
  WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.site_id = a.site_id AND b.snapshot_no = a.snapshot_no
    AND b.kind IS NOT DISTINCT FROM a.kind AND b.target IS NOT DISTINCT FROM a.target)
  UNION ALL
  SELECT a.site_id, a.snapshot_no, a.kind, a.target, 'changed' FROM a JOIN b
    ON b.site_id = a.site_id AND b.snapshot_no = a.snapshot_no
    AND b.kind IS NOT DISTINCT FROM a.kind AND b.target IS NOT DISTINCT FROM a.target
  WHERE a.severity IS DISTINCT FROM b.severity OR a.observed IS DISTINCT FROM b.observed
    OR a.occurrences IS DISTINCT FROM b.occurrences)
"""

QUERIES = {"p6_found": p6_found, "p6_change_counts": p6_change_counts}
ORACLE_SQL = {
    "p6_found": FINDING_ROWS + "SELECT site_id, snapshot_no, kind, target, change_kind FROM changes",
    "p6_change_counts": FINDING_ROWS
    + "SELECT site_id, snapshot_no, count(*) FILTER (change_kind = 'added') AS n_added, "
    "count(*) FILTER (change_kind = 'removed') AS n_removed, count(*) FILTER (change_kind = 'changed') AS n_changed "
    "FROM changes GROUP BY ALL",
}

"""What changed between consecutive full snapshots of a table.

Each snapshot lists every record that exists then.  Consecutive snapshots are compared by one
full outer join on the primary key, over canonical row hashes: a missing side is an addition or a
removal, unequal hashes are a change.

Defined results
---------------
* repeated and corrected rows: the row with the latest ``delivered_at`` holds; on a tie the
  greatest (hash) row, so that the result does not depend on the order of the rows;
* NULL equals NULL in keys and in compared values;
* late rows take their snapshot's place, whenever they were delivered;
* snapshots are the rows of the calendar (``site_reports``), also those without any record; a
  site's first snapshot gives no rows; records of a snapshot that is not in the calendar are
  ignored; repeated calendar rows count once;
* empty tables give an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

_DEFAULT_PORT = r"(?i)^(?:(http://[^/?#]*):0*80|(https://[^/?#]*):0*443|(http://[^/?#]*|https://[^/?#]*):)(?=[/?#]|$)"
_WHITE = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def canonical_target(target: Column) -> Column:
    """Trim, lower-case scheme and host, drop the scheme's default port; keep path and query."""
    trimmed = F.regexp_replace(target, f"^{_WHITE}|{_WHITE}$", "")
    authority = F.regexp_extract(trimmed, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    lowered = F.concat(F.lower(authority), F.substr(trimmed, F.length(authority) + F.lit(1)))
    ported = F.regexp_replace(lowered, _DEFAULT_PORT, "$1$2$3")
    return F.when(F.length(authority) > 0, ported).otherwise(trimmed)


def canonical_hash(*values: Column) -> Column:
    """A 64-bit hash of the values as text; NULL differs from every text.  Only hashes of one key are compared."""
    parts = F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("v"), v.cast("string")), F.lit("n")) for v in values])
    return F.xxhash64(parts)


_LIMIT = 1 << 60


def _word() -> Column:
    """2 ** 64, above which the version stands."""
    return F.lit(Decimal(1 << 64)).cast("decimal(20,0)")


def _ranked(version: Column, value: Column) -> Column:
    """Version and hash as one number that orders by version, then by hash: a maximum that a hash aggregation can hold."""
    high = (F.greatest(F.least(version, F.lit(_LIMIT)), F.lit(-_LIMIT)) + F.lit(_LIMIT)).cast("decimal(19,0)")
    low = value.cast("decimal(20,0)") + F.when(value < 0, _word()).otherwise(F.lit(Decimal(0)))
    return (high * _word() + low).cast("decimal(38,0)")


def _coded(value: Column) -> Column:
    """The value as a text that is never NULL, so that NULL equals NULL in plain equality."""
    return F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit("n"))


def _decoded(text: Column, kind: DataType) -> Column:
    return F.when(text != "n", F.substr(text, F.lit(2))).cast(kind)


def snapshot_changes(
    records: DataFrame,
    calendar: DataFrame,
    *,
    group: str = "site_id",
    snapshot: str = "snapshot_no",
    key: dict[str, Column] | None = None,
    values: tuple[str, ...] = ("severity", "observed", "occurrences"),
    version: str = "delivered_at",
) -> DataFrame:
    """Rows (group, snapshot, *key, change_kind) that were added, removed or changed."""
    found = snapshot_statuses(records, calendar, group=group, snapshot=snapshot, key=key, values=values, version=version)
    return found.where(F.col("change_kind") != "persisting")


def snapshot_statuses(
    records: DataFrame,
    calendar: DataFrame,
    *,
    group: str = "site_id",
    snapshot: str = "snapshot_no",
    key: dict[str, Column] | None = None,
    values: tuple[str, ...] = ("severity", "observed", "occurrences"),
    version: str = "delivered_at",
) -> DataFrame:
    """Rows (group, snapshot, *key, change_kind) for every pair of consecutive snapshots, unchanged ones as persisting.

    ``records`` holds the snapshots' rows, ``calendar`` one row for each snapshot of a group.
    The join key is (group, snapshot, *key): a hot group spreads over all partitions, because its
    records differ in the key.  Corrections end in one hash aggregation by that key, which combines them
    before the shuffle; the later side of the join stays where it is then, and the earlier one moves to
    its next snapshot.  The calendar is one row per group and snapshot, so its ``lead`` window is small against
    the records.
    """
    key = key or {"kind": F.col("kind"), "target": canonical_target(F.col("target"))}
    names = [f"_k_{n}" for n in key]
    kinds = records.select(*[expr.alias(n) for n, expr in zip(names, key.values())]).schema
    moment = F.col(version)
    moment = F.unix_micros(moment.cast("timestamp")) if dict(records.dtypes)[version].startswith("timestamp") else moment.cast("bigint")
    place = ["_g", "_s", *names]
    rows = (
        records.select(
            _coded(F.col(group)).alias("_g"),
            F.col(snapshot).alias("_s"),
            *[_coded(expr).alias(n) for n, expr in zip(names, key.values())],
            canonical_hash(*[F.col(v) for v in values]).alias("_hash"),
            F.coalesce(moment, F.lit(-_LIMIT)).alias("_version"),
        )
        .where(F.col("_s").isNotNull())
        .groupBy(*place)
        .agg(F.max(_ranked(F.col("_version"), F.col("_hash"))).alias("_last"))
        .select(*place, (F.col("_last") % _word()).alias("_hash"))
    )
    order = Window.partitionBy("_g").orderBy("_s")
    pairs = (
        calendar.select(_coded(F.col(group)).alias("_g"), F.col(snapshot).alias("_s"))
        .where(F.col("_s").isNotNull())
        .distinct()
        .select("_g", "_s", F.lead("_s").over(order).alias("_next"), F.lag("_s").over(order).alias("_prev"))
    )
    before = rows.join(pairs.where("_next IS NOT NULL").select("_g", "_s", "_next"), ["_g", "_s"]).select("_g", F.col("_next").alias("_s"), *names, F.col("_hash").alias("_before"))
    after = rows.join(pairs.where("_prev IS NOT NULL").select("_g", "_s"), ["_g", "_s"]).select(*place, F.col("_hash").alias("_after"))
    kind = (
        F.when(F.col("_before").isNull(), "added")
        .when(F.col("_after").isNull(), "removed")
        .when(F.col("_after") != F.col("_before"), "changed")
        .otherwise("persisting")
    )
    return (
        before.join(after, place, "full_outer")
        .withColumn("change_kind", kind)
        .select(
            _decoded(F.col("_g"), records.schema[group].dataType).alias(group),
            F.col("_s").alias(snapshot),
            *[_decoded(F.col(n), kinds[n].dataType).alias(name) for n, name in zip(names, key)],
            "change_kind",
        )
    )


def change_counts(changes: DataFrame, group: str = "site_id", snapshot: str = "snapshot_no") -> DataFrame:
    """How many records were added, removed and changed in each snapshot that has any change."""
    count = lambda kind: F.count_if(F.col("change_kind") == kind).cast("bigint")
    return changes.groupBy(group, snapshot).agg(
        count("added").alias("n_added"), count("removed").alias("n_removed"), count("changed").alias("n_changed")
    )

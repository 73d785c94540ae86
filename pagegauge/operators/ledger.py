"""Ledger of search observations: normalised queries, stable ids, latest observation of each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions.text import collapse, trim


def normal_query(keyword: Column) -> Column:
    return F.lower(collapse(keyword))


def is_date(text: Column) -> Column:
    """A calendar date as YYYY-MM-DD that exists."""
    return text.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def required(text: Column) -> Column:
    """The trimmed text, NULL where nothing is left."""
    return F.nullif(trim(text), F.lit(""))


def utc_timestamp(text: Column) -> Column:
    """An ISO timestamp in UTC with milliseconds; NULL where it is none."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_after(date: Column, days: Column | int) -> Column:
    """The date so many days later as YYYY-MM-DD; NULL where it is no date."""
    return F.when(is_date(date), F.date_format(F.date_add(F.try_to_date(date, "yyyy-MM-dd"), days), "yyyy-MM-dd"))


def is_amount(value: Column) -> Column:
    """NULL, or a finite number that is not negative."""
    number = value.cast("double")
    return value.isNull() | (~F.isnan(number) & (number >= 0) & (number < float("inf")))


def same_segment(left: str, right: str) -> Column:
    """Join condition: both observations are of one source, country, device and kind of search."""
    return F.lit(True) & (F.col(f"{left}.source") == F.col(f"{right}.source")) & (F.col(f"{left}.country") == F.col(f"{right}.country")) \
        & (F.col(f"{left}.device") == F.col(f"{right}.device")) & (F.col(f"{left}.search_type") == F.col(f"{right}.search_type"))


def _json_number(value: Column) -> Column:
    """A number as JSON writes it: whole numbers without a point."""
    whole = value.cast("bigint")
    return F.when(value.cast("double") == whole.cast("double"), whole.cast("string")).otherwise(value.cast("double").cast("string"))


def observation_id(identity: dict[str, Column], numbers: tuple[str, ...] = ("position", "clicks", "impressions")) -> Column:
    """First 16 hex digits of the hash of the identity as a JSON object in the order given; NULL as null, ``numbers`` unquoted."""
    parts = []
    for name, value in identity.items():
        if name in numbers:
            written = _json_number(value)
        else:
            # the text between the quotes of a one-field object, escaped as JSON has it
            written = F.regexp_extract(F.to_json(F.struct(value.cast("string").alias("x"))), r"(?s)\A\{\"x\":(.*)\}\z", 1)
        parts.append(F.concat(F.lit(f'"{name}":'), F.when(value.isNull(), F.lit("null")).otherwise(written)))
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256), 1, 16)


def latest_observations(observations: DataFrame, *keys: str) -> DataFrame:
    """The newest observation of each key; of equal times the first row (smallest ``seq``) holds."""
    rest = [c for c in observations.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct("observed_at", (-F.col("seq")).alias("_s")))
    return observations.groupBy(*keys).agg(picked.alias("o")).select(*keys, "o.*")


#: fields of an observation's identity, in order (fixed values)
IDENTITY = ("observedAt", "source", "keyword", "targetPath", "position", "clicks", "impressions", "startDate", "endDate", "country", "device", "searchType")
PRIORITIES = ("high", "medium", "low")


def record_observations(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with their id, refused with the reason) of ``rows`` with the fields of ``IDENTITY``.

    Refused are rows without a text that is required, with a timestamp or date that is none, dates in the
    wrong order, negative numbers, and ids that are known already or come before in ``rows``.
    """
    clean = rows.withColumns({
        **{c: required(F.col(c)) for c in ("source", "targetPath", "country", "device")}, "keyword": required(collapse(F.col("keyword"))),
        "searchType": required(F.coalesce("searchType", F.lit("web"))), "observedAt": utc_timestamp(F.col("observedAt")),
    })
    reason = F.when(F.coalesce(*[F.when(F.col(c).isNull(), c) for c in ("source", "keyword", "targetPath", "country", "device", "searchType")]).isNotNull(), "empty-text")
    reason = reason.when(F.col("observedAt").isNull(), "timestamp").when(~is_date(F.col("startDate")) | ~is_date(F.col("endDate")), "date")
    reason = reason.when(F.col("startDate") > F.col("endDate"), "date-order").when(~(is_amount(F.col("position")) & is_amount(F.col("clicks")) & is_amount(F.col("impressions"))), "number")
    judged = clean.withColumn("reason", reason).withColumn("observation_id", observation_id({c: F.col(c) for c in IDENTITY}))
    good = judged.where("reason IS NULL").drop("reason").dropDuplicates(["observation_id"])
    fresh = good.join(known.select("observation_id"), "observation_id", "left_anti")
    again = judged.where("reason IS NULL").join(known.select("observation_id"), "observation_id", "left_semi").withColumn("reason", F.lit("known"))
    return fresh, judged.where("reason IS NOT NULL").unionByName(again)


def add_queries(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (keyword, target_path, priority) that are new: normalised keyword not in ``known`` (query), a priority of ``PRIORITIES``; of equal keywords the first path."""
    named = rows.withColumn("query", normal_query(required(F.col("keyword")))).where(F.col("query").isNotNull() & F.col("priority").isin(*PRIORITIES) & required(F.col("target_path")).isNotNull())
    first = named.groupBy("query").agg(F.min(F.struct("target_path", "priority")).alias("x")).select("query", "x.target_path", "x.priority")
    return first.join(known.select("query"), "query", "left_anti").withColumn("status", F.lit("eligible"))


def status_totals(queries: DataFrame, observations: DataFrame) -> DataFrame:
    """(eligible, monitoring, completed, observations): one row, also of empty tables."""
    counts = queries.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("eligible", "monitoring", "completed")])
    return counts.join(F.broadcast(observations.agg(F.count(F.lit(1)).alias("observations"))))


def first_candidates(ranked: DataFrame, *by: str) -> DataFrame:
    """The first row of each ``by`` in the order of its group: group 0 by position, group 1 by impressions and position, others by priority, then by ``seq``.

    A minimum over a struct, so nothing is sorted.  A position that is missing comes last.
    """
    far = F.coalesce(F.col("position").cast("double"), F.lit(float("inf")))
    weight = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    none = F.lit(0.0)
    one = F.when(F.col("rank_group") == 0, far).when(F.col("rank_group") == 1, -F.coalesce(F.col("impressions").cast("double"), none)).otherwise(weight.cast("double"))
    two = F.when(F.col("rank_group") == 1, far).otherwise(none)
    rest = [c for c in ranked.columns if c not in by]
    return ranked.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(F.col("rank_group").alias("_g"), one.alias("_1"), two.alias("_2"), F.col("seq").alias("_s"))).alias("x")).select(*by, "x.*")


def segment_pairs(baselines: DataFrame, reviews: DataFrame) -> DataFrame:
    """(query, target_path, baseline seq, review seq): later observations of the same query in the same segment."""
    b, r = baselines.alias("b"), reviews.alias("r")
    same = (F.col("b.query") == F.col("r.query")) & (F.col("b.target_path") == F.col("r.target_path")) & same_segment("b", "r") & (F.col("b.observed_at") < F.col("r.observed_at"))
    return b.join(r, same).select("b.query", "b.target_path", F.col("b.seq").alias("baseline_seq"), F.col("r.seq").alias("review_seq"))

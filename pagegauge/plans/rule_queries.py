"""Rule results, scores and histograms over the fixture documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.functions import text as tx
from pagegauge.operators import rules
from pagegauge.sources.tables import read_spread

_COLUMNS = ("fixture_id", "html", "markdown", "headings", "paragraphs", "json_ld", "meta_tags", "links", "raw_text")


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the rules read them; repeated rows are removed from the results, which are small."""
    return rules.prepare(read_spread(spark, folder, "fixture_docs", *_COLUMNS))


def rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(fixture_id, one score for each rule)."""
    results = rules.evaluated(prepared(spark, folder))
    return results.select("fixture_id", *[F.col(f"{rules.rule_column(r)}.score").alias(rules.rule_column(r)) for r in rules.REGISTRY]).distinct()


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """(fixture_id, dimensions, total)."""
    results = rules.dimension_scores(rules.evaluated(prepared(spark, folder)))
    return results.select("fixture_id", *rules.DIMENSIONS, "total").distinct()


_W = tx.WS


def _split(text: str) -> str:
    return f"regexp_split_to_array({text}, '{_W}+')"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


_DOCS = f"""
WITH d0 AS (SELECT DISTINCT ON (fixture_id) * FROM fixture_docs),
d AS (SELECT fixture_id, coalesce(nullif(html, ''), nullif(markdown, ''), '') AS source, coalesce(html, '') AS html,
  coalesce(raw_text, '') AS raw_text, coalesce(headings, []) AS headings, coalesce(paragraphs, []) AS paragraphs,
  coalesce(links, []) AS links, meta_tags AS meta, list_filter(coalesce(json_ld, []), lambda j: j IS NOT NULL) AS blocks FROM d0),
b AS (SELECT fixture_id, unnest(blocks) AS j FROM d),
v AS (SELECT fixture_id, json_valid(j) AS ok, CASE WHEN json_valid(j) THEN j ELSE 'null' END AS body FROM b),
g AS (SELECT fixture_id, ok, CASE WHEN json_exists(body, '$."@graph"') THEN json_extract(body, '$."@graph"[*]') ELSE [json_extract(body, '$')] END AS parts FROM v),
n0 AS (SELECT fixture_id, ok, unnest(parts) AS node FROM g),
n AS (SELECT fixture_id, ok AND json_type(node) = 'OBJECT' AS ok, json_extract_string(node, '$."@context"') IS NOT NULL AS ctx, json_extract_string(node, '$."@type"') AS typ,
  json_exists(node, '$.author') AS author, json_exists(node, '$.datePublished') AS published FROM n0),
f AS (SELECT fixture_id, count_if(NOT ok) AS errors, count_if(ok) AS nodes, count_if(NOT ok OR NOT ctx OR typ IS NULL) AS diagnostics,
  sum(CASE WHEN ok THEN 12 - {_flag("NOT ctx")} * 6 - {_flag("typ IS NULL")} * 6 END) AS points,
  count_if(ok AND author) AS authors, count_if(ok AND published) AS dates,
  sum(CASE WHEN ok AND regexp_matches(typ, '(?i)article') THEN {_flag("NOT author")} + {_flag("NOT published")} ELSE 0 END) AS advice
  FROM n GROUP BY fixture_id),
w AS (SELECT d.*, coalesce(f.errors, 0) AS errors, coalesce(f.nodes, 0) AS nodes, coalesce(f.diagnostics, 0) AS diagnostics, coalesce(points, 0) AS points,
  coalesce(authors, 0) AS authors, coalesce(dates, 0) AS dates, coalesce(advice, 0) AS advice, len(blocks) AS block_count,
  len({_split("raw_text")}) AS raw_words, len(list_filter({_split("raw_text")}, lambda x: x <> '')) AS words,
  len(list_filter({_split("array_to_string(paragraphs, ' ')")}, lambda x: x <> '')) AS para_words,
  len(list_filter(range(2, len(headings) + 1), lambda i: headings[i].level > headings[i - 1].level + 1)) AS skips,
  len(list_filter(headings, lambda h: h.level = 1)) AS h1s,
  len(list_filter(paragraphs, lambda p: len({_split("p")}) > 150)) AS long_paras,
  len(list_filter(paragraphs, lambda p: regexp_matches(regexp_replace(p, '^{_W}+', ''), '(?i)^(?:{rules.DANGLING})\\b'))) AS dangling,
  {_count("raw_text", rules.DATA.replace("(?:", "(?:"))} AS claims,
  regexp_matches(raw_text, '{rules.SOURCES}') OR len(list_filter(links, lambda x: regexp_matches(x.href, '(?i)^https?://'))) > 0 AS sourced,
  {_count("raw_text", r"(?i)\b[A-Za-z0-9_]+" + _W + "+(?:is|are|refers to|means|defines?|defined as)" + _W + "+")} AS defined,
  coalesce(nullif(meta['description'], ''), nullif(meta['og:description'], ''), '') AS descr,
  coalesce(meta['robots'], '') AS robots FROM d LEFT JOIN f USING (fixture_id)),
toks AS (SELECT fixture_id, raw_text, list_filter({_split("lower(raw_text)")}, lambda x: length(x) > 1) AS ws FROM w),
content AS (SELECT fixture_id, raw_text, ws, list_filter(ws, lambda x: NOT list_contains({list(rules.STOP_WORDS)}, x)) AS cw FROM toks),
usable AS (SELECT * FROM content WHERE len(ws) >= 50 AND len(cw) >= 20),
ranked AS (SELECT fixture_id, word, row_number() OVER (PARTITION BY fixture_id ORDER BY count(*) DESC, min(pos)) AS rn
  FROM (SELECT fixture_id, unnest(cw) AS word, generate_subscripts(cw, 1) AS pos FROM usable) GROUP BY fixture_id, word),
sents AS (SELECT fixture_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(raw_text, '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'),
  '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '[.!?。！？]+'), lambda s: length(regexp_replace(s, '^{_W}+|{_W}+$', '', 'g')) > 10) AS ss FROM usable),
streaks AS (SELECT r.fixture_id, len(list_filter(range(2, len(ss) + 1), lambda i: contains(replace(lower(ss[i - 1]), chr(1), '.'), word) AND contains(replace(lower(ss[i]), chr(1), '.'), word))) / (len(ss) - 1) AS share
  FROM ranked r JOIN sents USING (fixture_id) WHERE rn <= 3 AND len(ss) >= 2),
hits AS (SELECT fixture_id, count_if(share > 0.6) AS hits FROM streaks GROUP BY fixture_id),
s AS (SELECT w.*, coalesce(len(list_distinct(u.cw)) / len(u.cw), 1.0) AS diversity, coalesce(hits.hits, 0) AS hits
  FROM w LEFT JOIN usable u USING (fixture_id) LEFT JOIN hits USING (fixture_id))
"""

_SPARSE = "(raw_words > 500 AND len(headings) < 3)"
_NO_LIST = f"(raw_words > 300 AND NOT regexp_matches(source, '(?m)(?:<[ou]l>|^[-*]{_W}|^[0-9]+\\.{_W})'))"
_MOST, _MANY = "(long_paras * 2 > len(paragraphs))", "(long_paras * 5 > len(paragraphs))"
_DMOST, _DMANY = "(dangling * 5 > len(paragraphs) * 2)", "(dangling * 5 > len(paragraphs))"
_BARE = "(claims > 0 AND NOT sourced)"
_DEFS = "(CASE WHEN defined >= 3 OR regexp_matches(html, '(?i)<dl') THEN 5 WHEN defined >= 1 THEN 3 ELSE 1 END)"
_ATTR = (
    f"({_flag('coalesce(meta[$q$author$q$], $q$$q$) <> $q$$q$ OR coalesce(meta[$q$article:author$q$], $q$$q$) <> $q$$q$ OR authors > 0')} * 2"
    f" + {_flag('coalesce(meta[$q$article:published_time$q$], $q$$q$) <> $q$$q$ OR coalesce(meta[$q$date$q$], $q$$q$) <> $q$$q$ OR dates > 0')} * 2"
    f" + {_flag(f'regexp_matches(raw_text, $q${rules.CITATIONS}$q$)')})"
).replace("$q$", "'")
_NOINDEX = "regexp_matches(robots, '(?i)noindex')"
_DWORDS = f"len(list_filter({_split('descr')}, lambda x: x <> ''))"
_WEAK = (
    f"((({_DWORDS} < 3 AND {_count('descr', '[\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}]')} < 10) OR "
    f"regexp_matches(regexp_replace(descr, '^{_W}+|{_W}+$', '', 'g'), '(?i)^(?:home|welcome|official site|website)$')) OR "
    f"({_count('descr', '[,，、]')} >= 4 AND NOT regexp_matches(descr, '[.!?。！？]')))"
)
_RATIO = "(CASE WHEN words = 0 THEN 0 WHEN para_words * 5 >= words * 3 THEN 5 WHEN para_words * 5 >= words * 2 THEN 3 ELSE 1 END)"
_STUFF = "(CASE WHEN diversity < 0.25 AND hits >= 2 THEN 0 WHEN diversity < 0.3 OR hits >= 2 THEN 2 ELSE 5 END)"
_UNIQUE = f"(2 + {_flag(f'regexp_matches(raw_text, $q${rules.RESEARCH}$q$)')} * 2 + {_flag('regexp_matches(source, $q$(?i)<code|<pre|```$q$)')})".replace("$q$", "'")

#: rule id -> SQL of score, issues, suggestions
RULE_SQL = {
    "heading-hierarchy": (
        f"CASE WHEN len(headings) = 0 THEN 0 ELSE greatest(0, 10 - {_flag('h1s = 0')} * 2 - least(3, skips) - {_flag(_SPARSE)}) END",
        f"CASE WHEN len(headings) = 0 THEN 1 ELSE {_flag('h1s = 0')} + least(3, skips) END",
        f"CASE WHEN len(headings) = 0 THEN 0 ELSE {_flag(_SPARSE)} END",
    ),
    "paragraph-length": (
        f"CASE WHEN len(paragraphs) = 0 THEN 0 ELSE 8 - CASE WHEN {_MOST} THEN 5 WHEN {_MANY} THEN 3 ELSE 0 END END",
        f"CASE WHEN len(paragraphs) = 0 OR {_MANY} THEN 1 ELSE 0 END",
        _flag("long_paras > 0"),
    ),
    "faq-presence": ("0", "0", "0"),
    "list-usage": (f"CASE WHEN {_NO_LIST} THEN 4 ELSE 7 END", "0", _flag(_NO_LIST)),
    "self-contained-statements": (
        f"CASE WHEN len(paragraphs) = 0 THEN 0 ELSE 8 - CASE WHEN {_DMOST} THEN 5 WHEN {_DMANY} THEN 3 ELSE 0 END END",
        _flag(f"len(paragraphs) > 0 AND {_DMOST}"),
        _flag("dangling > 0"),
    ),
    "data-stats-presence": (f"CASE WHEN {_BARE} THEN 3 ELSE 7 END", _flag(_BARE), _flag(_BARE)),
    "clear-definitions": (_DEFS, "0", _flag(f"{_DEFS} = 1")),
    "attribution": (_ATTR, "0", _flag(f"{_ATTR} < 3")),
    "json-ld-presence": ("8", _flag("errors > 0 OR block_count = 0"), "0"),
    "json-ld-completeness": ("CASE WHEN nodes = 0 THEN 12 ELSE least(12, floor(points / nodes + 0.5)) END", "diagnostics", "CASE WHEN nodes = 0 THEN 0 ELSE advice END"),
    "ai-relevant-schema-types": ("0", "0", _flag("nodes > 0")),
    "llms-txt-presence": ("0", "0", "0"),
    "robots-txt-ai-config": (f"CASE WHEN {_NOINDEX} THEN 0 ELSE 8 END", _flag(_NOINDEX), _flag(f"NOT {_NOINDEX}")),
    "meta-description-quality": (
        f"CASE WHEN descr = '' THEN 0 WHEN {_WEAK} THEN 3 ELSE 7 END", _flag("descr = ''"), _flag(f"descr <> '' AND {_WEAK}"),
    ),
    "content-boilerplate-ratio": (_RATIO, _flag("words = 0"), _flag(f"{_RATIO} = 1")),
    "keyword-stuffing-detection": (_STUFF, _flag(f"{_STUFF} < 5"), _flag(f"{_STUFF} < 5")),
    "content-uniqueness-signals": (_UNIQUE, "0", _flag(f"{_UNIQUE} < 4")),
}


def _rule_query(rule: rules.Rule):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return prepared(spark, folder).withColumn("r", rule.expression()).select("fixture_id", "r.score", "r.issues", "r.suggestions").distinct()

    return query


_SCORES = ", ".join(
    f"CAST({' + '.join('(' + RULE_SQL[r.id][0] + ')' for r in rules.REGISTRY if r.dimension == d)} AS INT) AS \"{d}\"" for d in rules.DIMENSIONS
)
_SUM = " + ".join(f'"{d}"' for d in rules.DIMENSIONS)
_SCORED = f"{_DOCS}, scores AS (SELECT fixture_id, {_SCORES} FROM s), totals AS (SELECT *, CAST({_SUM} AS INT) AS total FROM scores) "
_AVERAGES = ", ".join(f'CAST(floor(avg("{d}") + 0.5) AS INT) AS "{d}"' for d in rules.DIMENSIONS)


def dimension_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("fixture_id", *rules.DIMENSIONS, "total")


def page_totals(spark: SparkSession, folder: str) -> DataFrame:
    total = F.col("total")
    return scored(spark, folder).select("fixture_id", "total", tx.grade(total).alias("grade"), tx.score_band(total).alias("band"), (total < 60).alias("below_threshold"))


def site_readiness(spark: SparkSession, folder: str) -> DataFrame:
    return rules.site_averages(scored(spark, folder))


def score_bands(spark: SparkSession, folder: str) -> DataFrame:
    bands = spark.createDataFrame([("0-39",), ("40-69",), ("70-100",)], "band string")
    counted = scored(spark, folder).groupBy(tx.score_band(F.col("total")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return bands.join(counted, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n_pages"))


def lowest_rule(spark: SparkSession, folder: str) -> DataFrame:
    """For each rule: how many documents lose points, and the average score."""
    long = rule_scores(spark, folder).select(F.explode(F.array(*[
        F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.dimension).alias("dimension"), F.lit(r.weight).alias("weight"), F.col(rules.rule_column(r)).alias("score"))
        for r in rules.REGISTRY
    ])).alias("x")).select("x.*")
    return long.groupBy("rule_id", "dimension", "weight").agg(F.count_if(F.col("score") < F.col("weight")).alias("n_losing"), F.sum("score").alias("points"))


def top_words(spark: SparkSession, folder: str) -> DataFrame:
    """The three most frequent content words of each document; equal counts: first to occur."""
    docs = read_spread(spark, folder, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    words = F.filter(F.split(F.lower("text"), f"{tx.WS}+"), lambda w: (F.length(w) > 1) & ~w.isin(rules.STOP_WORDS))
    counted = docs.select("doc_id", F.posexplode(words).alias("pos", "word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    ranked = counted.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "word", "n"))), 1, 3).alias("t"))
    return ranked.select("doc_id", F.posexplode("t").alias("pos", "t")).select("doc_id", (F.col("pos") + 1).alias("place"), "t.word", "t.n")


def doc_word_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_spread(spark, folder, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    t = F.col("text")
    return docs.select(
        "doc_id", tx.raw_word_count(t).cast("bigint").alias("raw_words"), tx.word_count(t).cast("bigint").alias("words"),
        F.regexp_count(t, F.lit(rules.DATA)).cast("bigint").alias("claims"), F.regexp_count(t, F.lit(tx.CJK)).cast("bigint").alias("cjk"),
        tx.sentence_count(t).cast("bigint").alias("sentences"), t.rlike(rules.CITATIONS).alias("cites"), t.rlike(rules.RESEARCH).alias("researches"),
    )


_DOC_STATS = f"""
WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len({_split("text")}) AS raw_words, len(list_filter({_split("text")}, lambda w: w <> '')) AS words,
  {_count("text", rules.DATA)} AS claims, {_count("text", "[\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}]")} AS cjk,
  len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'),
    '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '[.!?。！？]+'), lambda s: length(regexp_replace(s, '^{_W}+|{_W}+$', '', 'g')) > 10)) AS sentences,
  regexp_matches(text, '{rules.CITATIONS}') AS cites, regexp_matches(text, '{rules.RESEARCH}') AS researches FROM d"""
_TOP_WORDS = f"""
WITH t AS (SELECT doc_id, list_filter({_split("lower(text)")}, lambda x: length(x) > 1 AND NOT list_contains({list(rules.STOP_WORDS)}, x)) AS ws FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t) GROUP BY doc_id, word)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS INT) AS place, word, n FROM c
QUALIFY place <= 3"""

QUERIES = {f"rule_{r.id.replace('-', '_')}": _rule_query(r) for r in rules.REGISTRY} | {
    f.__name__: f for f in (dimension_scores, page_totals, site_readiness, score_bands, lowest_rule, top_words, doc_word_stats)
}
_LONG = " UNION ALL ".join(
    f"SELECT '{r.id}' AS rule_id, '{r.dimension}' AS dimension, {r.weight} AS weight, CAST({RULE_SQL[r.id][0]} AS INT) AS score FROM s" for r in rules.REGISTRY
)
ORACLE_SQL = {
    f"rule_{r.id.replace('-', '_')}": _DOCS + "SELECT fixture_id, " + ", ".join(f"CAST({e} AS INT) AS {n}" for n, e in zip(("score", "issues", "suggestions"), RULE_SQL[r.id])) + " FROM s"
    for r in rules.REGISTRY
} | {
    "dimension_scores": _SCORED + f"SELECT * FROM totals",
    "page_totals": _SCORED + "SELECT fixture_id, total, CASE WHEN total >= 80 THEN 'Excellent' WHEN total >= 60 THEN 'Good' WHEN total >= 40 THEN 'Needs Work' ELSE 'Poor' END AS grade, "
    "CASE WHEN total >= 70 THEN '70-100' WHEN total >= 40 THEN '40-69' ELSE '0-39' END AS band, total < 60 AS below_threshold FROM totals",
    "site_readiness": _SCORED + f", a AS (SELECT count(*) AS n_pages, {_AVERAGES} FROM totals) SELECT *, {_SUM} AS total FROM a",
    "score_bands": _SCORED + "SELECT band, count(total) AS n_pages FROM (VALUES ('0-39'), ('40-69'), ('70-100')) v(band) LEFT JOIN totals ON band = "
    "CASE WHEN total >= 70 THEN '70-100' WHEN total >= 40 THEN '40-69' ELSE '0-39' END GROUP BY band",
    "lowest_rule": _DOCS + f", l AS ({_LONG}) SELECT rule_id, dimension, weight, count_if(score < weight) AS n_losing, sum(score) AS points FROM l GROUP BY ALL",
    "top_words": _TOP_WORDS,
    "doc_word_stats": _DOC_STATS,
}

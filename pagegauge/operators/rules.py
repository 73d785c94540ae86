"""The seventeen readiness rules as expressions over a parsed document.

``prepare`` gives every document the columns of ``DOCUMENT``, NULL fields as empty ones.  Each rule
returns a struct of score, number of issues and number of suggestions, and the codes of the issues;
``REGISTRY`` holds id, dimension, weight and expression in output order, and ``register`` adds more.
Only the repetition signals of the keyword rule need Python (one Arrow UDF), all else stays in the
JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from pagegauge.functions.jsonld import json_ld_facts
from pagegauge.functions.text import CJK, SENTENCE_END, WS, list_of, raw_word_count, text_of, trim, word_count
from pagegauge.schema import DIAGNOSTIC, FACTS, SIGNALS

# fixed values of the contract
LONG_PARAGRAPH = 150
DANGLING = "this|that|these|those|it|they|he|she|however|moreover|furthermore|additionally"
STOP_WORDS = (
    "the and for are but not you all can had her was one our out has his how its may new now old see way who did get let say "
    "she too use that this with from have been they their will would could should about which when what there where your more "
    "some than them into other also just only very does each"
).split()
DATA = (
    r"(?i)(?:\d+%|\$[\d,.]+|€[\d,.]+|\d{4}[-/]\d{2}[-/]\d{2}|\d+" + WS + r"*(?:users|customers|companies|countries|years|months|hours|minutes|"
    r"seconds|ms|GB|MB|TB|requests|transactions))"
)
SOURCES = r"(?i)(?:according to|source:|reference:|cited from|data from)"
CITATIONS = rf"(?i)(?:according to|source:|cited from|reference:|via{WS})"
DEFINITION = rf"(?i)(?<![A-Za-z0-9_])[A-Za-z0-9_]+{WS}+(?:is|are|refers to|means|defines?|defined as){WS}+"
RESEARCH = rf"(?i)(?:our{WS}+(?:data|research|analysis|survey|study)|we{WS}+(?:found|discovered|measured|tested|analyzed))"
NOT_DEFINING = "是否|但是|於是|于是|還是|还是|就是"
NO_SUBJECT = "這|这|那|它|他|她|我|你|您|此|其|目前|現在|现在|當前|当前|今天|當時|当时|本次"
SUBJECT = r"([\p{IsHan}A-Za-z0-9 _/+.-]{2,24}?)"
DIMENSIONS = {"structure": 25, "citability": 25, "schema": 20, "aiMetadata": 15, "contentDensity": 15}


def prepare(docs: DataFrame) -> DataFrame:
    """``docs`` with parsed fields (html, markdown, headings, paragraphs, json_ld, meta_tags, links, raw_text)."""
    kinds = dict(docs.dtypes)
    facts = json_ld_facts(F.col("json_ld")) if "json_ld" in kinds else F.lit(None).cast(FACTS)
    prepared = docs.withColumn("facts", facts)
    return prepared.withColumns({
        "source": F.coalesce(F.nullif(F.col("html"), F.lit("")), F.nullif(F.col("markdown"), F.lit("")), F.lit("")),
        "html": text_of("html"),
        "raw_text": text_of("raw_text"),
        "headings": list_of("headings", kinds["headings"]),
        "paragraphs": list_of("paragraphs", kinds["paragraphs"]),
        "links": list_of("links", kinds["links"]),
        "meta": F.coalesce("meta_tags", F.create_map().cast("map<string,string>")),
        "stuffing": stuffing_signals(text_of("raw_text")),
    })


def from_parsed(parsed: DataFrame, struct: str = "doc") -> DataFrame:
    """Parsed pages (a struct of ``functions.documents``) in the shape that the rules read."""
    d = F.col(struct)
    return parsed.withColumns({
        "source": F.coalesce(F.nullif(F.col("html"), F.lit("")), F.lit("")),
        "html": text_of("html"),
        "raw_text": F.coalesce(d["raw_text"], F.lit("")),
        "headings": d["headings"],
        "paragraphs": d["paragraphs"],
        "links": d["links"],
        "meta": d["meta"],
        "facts": F.struct(d["nodes"].alias("nodes"), d["errors"].alias("errors"), d["diagnostics"].alias("diagnostics"), d["block_count"].alias("block_count")),
        "stuffing": stuffing_signals(F.coalesce(d["raw_text"], F.lit(""))),
    })


_SPLIT = re.compile(SENTENCE_END)
_BLANKS = re.compile("[\t\n\x0b\x0c\r    -     　﻿]+")
_STOP = frozenset(STOP_WORDS)


def repetition_signals(text: str) -> tuple[float | None, int]:
    """(share of different words, frequent words that stand in most neighbouring sentences); None for short texts."""
    words = [w for w in _BLANKS.split(text.lower()) if len(w) > 1]
    if len(words) < 50:
        return None, 0
    words = [w for w in words if w not in _STOP]
    if len(words) < 20:
        return None, 0
    counts = Counter(words)
    sentences = [s.lower() for s in _SPLIT.split(text) if len(_BLANKS.sub(" ", s).strip(" ")) and len(_strip(s)) > 10]
    hits = 0
    if len(sentences) >= 2:
        for word, _ in sorted(counts.items(), key=lambda x: -x[1])[:3]:  # equal counts: first to occur
            inside = [word in s for s in sentences]
            pairs = sum(a and b for a, b in zip(inside, inside[1:]))
            hits += pairs / (len(sentences) - 1) > 0.6
    return len(counts) / len(words), hits


def _strip(text: str) -> str:
    return re.sub(f"^{_BLANKS.pattern}|{_BLANKS.pattern}$", "", text)


@F.pandas_udf(SIGNALS)
def stuffing_signals(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repetition_signals(t or "") for t in text], columns=["diversity", "hits"])


def _result(score: Column | int, suggestions: Column | int, *issues: Column) -> Column:
    """``issues`` are codes, or NULL where there is none."""
    score, suggestions = (F.lit(x) if isinstance(x, int) else x for x in (score, suggestions))
    codes = F.array_compact(F.array(*issues)) if issues else F.array().cast("array<string>")
    return F.struct(score.cast("int").alias("score"), F.size(codes).cast("int").alias("issues"), suggestions.cast("int").alias("suggestions"), codes.alias("codes"))


def _result_list(score: Column, suggestions: Column, codes: Column) -> Column:
    return F.struct(score.cast("int").alias("score"), F.size(codes).cast("int").alias("issues"), suggestions.cast("int").alias("suggestions"), codes.alias("codes"))


_ZERO = 0


def _if(condition: Column, code: str) -> Column:
    return F.when(condition, F.lit(code))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def skipped_levels() -> Column:
    """Headings more than one level below the one before."""
    h, n = F.col("headings"), F.size("headings")
    at = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(at, lambda i: F.get(h, i)["level"] > F.get(h, i - 1)["level"] + 1))


def heading_hierarchy() -> Column:
    n, skips = F.size("headings"), skipped_levels()
    no_h1 = ~F.exists("headings", lambda h: F.coalesce(h["level"] == 1, F.lit(False)))
    sparse = (raw_word_count(F.col("raw_text")) > 500) & (n < 3)
    score = F.greatest(F.lit(0), F.lit(10) - _flag(no_h1) * 2 - F.least(F.lit(3), skips) - _flag(sparse))
    codes = F.concat(F.array_compact(F.array(_if(no_h1, "no-main-heading"))), F.array_repeat(F.lit("skipped-level"), F.least(F.lit(3), skips)))
    return F.when(n == 0, _result(_ZERO, _ZERO, F.lit("no-headings"))).otherwise(_result_list(score, _flag(sparse), codes))


def paragraph_length() -> Column:
    n = F.size("paragraphs")
    long = F.size(F.filter("paragraphs", lambda p: raw_word_count(p) > LONG_PARAGRAPH))
    most, many = long * 2 > n, long * 5 > n
    score = F.lit(8) - F.when(most, 5).when(many, 3).otherwise(0)
    return F.when(n == 0, _result(_ZERO, _ZERO, F.lit("no-paragraphs"))).otherwise(
        _result(score, _flag(long > 0), F.when(most, "mostly-long-paragraphs").when(many, "long-paragraphs"))
    )


def no_score() -> Column:
    return _result(_ZERO, _ZERO)


def list_usage() -> Column:
    lists = F.col("source").rlike(rf"(?m)(?:<[ou]l>|^[-*]{WS}|^\d+\.{WS})")
    low = ~lists & (raw_word_count(F.col("raw_text")) > 300)
    return _result(F.when(low, 4).otherwise(7), _flag(low))


def self_contained() -> Column:
    n = F.size("paragraphs")
    dangling = F.size(F.filter("paragraphs", lambda p: trim(p).rlike(rf"(?i)\A(?:{DANGLING})(?![A-Za-z0-9_])")))
    most, many = dangling * 5 > n * 2, dangling * 5 > n
    return F.when(n == 0, _result(_ZERO, _ZERO)).otherwise(
        _result(F.lit(8) - F.when(most, 5).when(many, 3).otherwise(0), _flag(dangling > 0), _if(most, "dangling-paragraphs"))
    )


def data_stats() -> Column:
    claims = F.regexp_count("raw_text", F.lit(DATA)) > 0
    sourced = F.col("raw_text").rlike(SOURCES) | F.exists("links", lambda x: F.coalesce(x["href"].rlike(r"(?i)\Ahttps?://"), F.lit(False)))
    bare = claims & ~sourced
    return _result(F.when(bare, 3).otherwise(7), _flag(bare), _if(bare, "claims-without-source"))


def chinese_definitions(text: Column) -> Column:
    """Sentences that define a term in Chinese."""

    def defines(part: Column) -> Column:
        s = trim(part)
        named = F.regexp_extract(s, rf"\A(?:所謂|所谓){WS}*{SUBJECT}[，,]{WS}*.{{4,}}\z", 1)
        said = F.regexp_extract(s, rf"\A{SUBJECT}{WS}*(?:定義為|定义为|意指|稱為|称为|是|指(?!定|令|示|出|導|导|向|標|标)){WS}*.{{4,}}\z", 1)
        subject = trim(F.when(named != "", named).otherwise(said))
        return (
            (F.length(s) <= 160) & ~s.rlike(NOT_DEFINING) & (subject != "") & ~subject.rlike(rf"\A(?:{NO_SUBJECT})")
            & ~subject.rlike("[的地得是，,]") & subject.rlike(r"[\p{IsHan}A-Z0-9]")
        )

    return F.size(F.filter(F.split(text, rf"(?<![0-9])\.|\.(?![0-9])|[!?。！？\n]+"), defines))


def clear_definitions() -> Column:
    summed = F.aggregate("paragraphs", F.lit(0), lambda a, p: a + chinese_definitions(p))
    found = F.regexp_count("raw_text", F.lit(DEFINITION)) + F.greatest(chinese_definitions(F.col("raw_text")), summed)
    listed = F.col("html").rlike("(?i)<dl")
    score = F.when((found >= 3) | listed, 5).when(found >= 1, 3).otherwise(1)
    return _result(score, _flag(score == 1))


def _meta(name: str) -> Column:
    return F.coalesce(F.col("meta")[name], F.lit("")) != ""


def attribution() -> Column:
    author = _meta("author") | _meta("article:author") | F.exists("facts.nodes", lambda n: n["has_author"])
    date = _meta("article:published_time") | _meta("date") | F.exists("facts.nodes", lambda n: n["has_date"])
    score = _flag(author) * 2 + _flag(date) * 2 + _flag(F.col("raw_text").rlike(CITATIONS))
    return _result(score, _flag(score < 3))


def json_ld_presence() -> Column:
    return _result(F.lit(8), _ZERO, F.when(F.size("facts.errors") > 0, "json-ld-errors").when(F.col("facts.block_count") == 0, "no-json-ld"))


def json_ld_completeness() -> Column:
    nodes = F.col("facts.nodes")
    n = F.size(nodes)
    points = F.aggregate(nodes, F.lit(0), lambda a, x: a + F.lit(12) - _flag(~x["has_context"]) * 6 - _flag(~x["has_type"]) * 6)
    articles = F.filter(nodes, lambda x: F.exists(x["types"], lambda t: t.rlike("(?i)article")))
    advice = F.aggregate(articles, F.lit(0), lambda a, x: a + _flag(~x["has_author"]) + _flag(~x["has_date"]))
    codes = F.transform(F.coalesce("facts.diagnostics", F.array().cast(ArrayType(DIAGNOSTIC))), lambda d: F.concat(F.lit("json-ld-"), d["kind"]))
    score = F.when(n == 0, 12).otherwise(F.least(F.lit(12), F.floor(points / F.greatest(n, F.lit(1)) + 0.5)))
    return _result_list(score, F.when(n == 0, 0).otherwise(advice), codes)


def schema_types() -> Column:
    return _result(_ZERO, _flag(F.size("facts.nodes") > 0))


def robots_meta() -> Column:
    blocked = F.coalesce(F.col("meta")["robots"], F.lit("")).rlike("(?i)noindex")
    return _result(F.when(blocked, 0).otherwise(8), _flag(~blocked), _if(blocked, "noindex"))


def meta_description() -> Column:
    desc = F.coalesce(F.nullif(F.col("meta")["description"], F.lit("")), F.nullif(F.col("meta")["og:description"], F.lit("")), F.lit(""))
    generic = ((word_count(trim(desc)) < 3) & (F.regexp_count(desc, F.lit(CJK)) < 10)) | trim(desc).rlike(r"(?i)\A(?:home|welcome|official site|website)\z")
    keywords = (F.regexp_count(desc, F.lit("[,，、]")) >= 4) & ~desc.rlike("[.!?。！？]")
    weak = generic | keywords
    return F.when(desc == "", _result(_ZERO, _ZERO, F.lit("no-description"))).otherwise(_result(F.when(weak, 3).otherwise(7), _flag(weak)))


def boilerplate_ratio() -> Column:
    words, whole = word_count(F.array_join("paragraphs", " ")), word_count(F.col("raw_text"))
    score = F.when(words * 5 >= whole * 3, 5).when(words * 5 >= whole * 2, 3).otherwise(1)
    return F.when(whole == 0, _result(_ZERO, _ZERO, F.lit("no-text"))).otherwise(_result(score, _flag(score == 1)))


def keyword_stuffing() -> Column:
    d, hits = F.coalesce("stuffing.diversity", F.lit(1.0)), F.coalesce("stuffing.hits", F.lit(0))
    score = F.when((d < 0.25) & (hits >= 2), 0).when((d < 0.3) | (hits >= 2), 2).otherwise(5)
    return _result(score, _flag(score < 5), _if(score < 5, "keyword-repetition"))


def uniqueness_signals() -> Column:
    score = F.lit(2) + _flag(F.col("raw_text").rlike(RESEARCH)) * 2 + _flag(F.col("source").rlike("(?i)<code|<pre|```"))
    return _result(score, _flag(score < 4))


@dataclass(frozen=True)
class Rule:
    id: str
    dimension: str
    weight: int
    expression: Callable[[], Column]


REGISTRY: list[Rule] = [
    Rule("heading-hierarchy", "structure", 10, heading_hierarchy),
    Rule("paragraph-length", "structure", 8, paragraph_length),
    Rule("faq-presence", "structure", 0, no_score),
    Rule("list-usage", "structure", 7, list_usage),
    Rule("self-contained-statements", "citability", 8, self_contained),
    Rule("data-stats-presence", "citability", 7, data_stats),
    Rule("clear-definitions", "citability", 5, clear_definitions),
    Rule("attribution", "citability", 5, attribution),
    Rule("json-ld-presence", "schema", 8, json_ld_presence),
    Rule("json-ld-completeness", "schema", 12, json_ld_completeness),
    Rule("ai-relevant-schema-types", "schema", 0, schema_types),
    Rule("llms-txt-presence", "aiMetadata", 0, no_score),
    Rule("robots-txt-ai-config", "aiMetadata", 8, robots_meta),
    Rule("meta-description-quality", "aiMetadata", 7, meta_description),
    Rule("content-boilerplate-ratio", "contentDensity", 5, boilerplate_ratio),
    Rule("keyword-stuffing-detection", "contentDensity", 5, keyword_stuffing),
    Rule("content-uniqueness-signals", "contentDensity", 5, uniqueness_signals),
]


def register(rule: Rule) -> None:
    """Add a rule of your own; its dimension must be known and its id new."""
    if rule.dimension not in DIMENSIONS or any(r.id == rule.id for r in REGISTRY):
        raise ValueError(f"cannot register {rule.id}")
    REGISTRY.append(rule)


def rule_column(rule: Rule) -> str:
    return "r_" + rule.id.replace("-", "_")


def evaluated(prepared: DataFrame) -> DataFrame:
    """``prepared`` with one struct column for each rule (no shuffle)."""
    return prepared.withColumns({rule_column(r): r.expression() for r in REGISTRY})


def dimension_scores(results: DataFrame) -> DataFrame:
    """The five dimension scores and their total, from the rules' structs in the same row."""
    columns: dict[str, Column] = {}
    for dimension in DIMENSIONS:
        rules = [r for r in REGISTRY if r.dimension == dimension]
        weight = sum(r.weight for r in rules)
        score = sum((F.col(f"{rule_column(r)}.score") for r in rules), F.lit(0))
        # every rule's maximum is its weight
        columns[dimension] = F.floor(score / F.lit(weight) * F.lit(weight) + 0.5).cast("int") if weight else F.lit(0)
    total = sum((c for c in columns.values()), F.lit(0))
    return results.withColumns(columns | {"total": total.cast("int")})


def site_averages(scores: DataFrame, *by: str) -> DataFrame:
    """Rounded averages of the dimensions; the total is the sum of the rounded averages."""
    rounded = {d: F.floor(F.avg(d) + 0.5).cast("int") for d in DIMENSIONS}
    grouped = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pages"), *[c.alias(d) for d, c in rounded.items()])
    filled = grouped.withColumns({d: F.coalesce(d, F.lit(0)) for d in DIMENSIONS})
    return filled.withColumn("total", sum((F.col(d) for d in DIMENSIONS), F.lit(0)).cast("int"))

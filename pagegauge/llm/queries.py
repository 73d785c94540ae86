"""Queries of the llm operators, with the SQL that must agree with them where SQL can express them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import confusables, mainbody, markup, mixing, quality, repetition, residue, tokenise, wrappers
from pagegauge.sources.tables import read_spread, read_table


def _line_model(spark: SparkSession, folder: str) -> quality.LineModel:
    """The model that p3 judges by, fitted over all texts."""
    return quality.fit_line_model(_texts(spark, folder), quality.load_common_words(read_table(spark, folder, "common_words")))


# 1. markup residue


def p1_method(spark: SparkSession, folder: str) -> DataFrame:
    """Wrappers of each host, inferred from the token streams of its pages, fragments, Markdown texts and headings."""
    return wrappers.infer_wrappers(read_spread(spark, folder, "fixture_docs", "url", "html", "markdown", "headings"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Headings, list items, code blocks and formulas of each fixture document's fields."""
    model = _line_model(spark, folder)

    def convert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: set[tuple] = set()
            for fixture_id, html, markdown, headings in zip(part["fixture_id"], part["html"], part["markdown"], part["headings"]):
                rows.update((fixture_id, "html", kind, text) for kind, text in markup.html_elements(html))
                if markdown and not quality.is_not_prose(markdown, model):
                    rows.update((fixture_id, "markdown", kind, text) for kind, text in markup.markdown_elements(markdown))
                if headings is not None:
                    rows.update((fixture_id, "headings", "heading", text) for text in map(markup.heading_text, headings) if text)
            yield pd.DataFrame(list(rows), columns=["fixture_id", "field_name", "element_kind", "content_text"])

    docs = read_spread(spark, folder, "fixture_docs", "fixture_id", "html", "markdown", "headings")
    return (
        docs.where(F.col("fixture_id").isNotNull())
        .withColumn("headings", F.transform("headings", lambda h: h["text"]))
        .mapInPandas(convert, "fixture_id bigint, field_name string, element_kind string, content_text string")
        .distinct()
    )


def p1_clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """html and markdown of each fixture document as clean text with its structure."""

    def clean(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({
                "fixture_id": part["fixture_id"],
                "html_text": [markup.clean_text(h, True) for h in part["html"]],
                "markdown_text": [markup.clean_text(m, False) for m in part["markdown"]],
            })

    docs = read_spread(spark, folder, "fixture_docs", "fixture_id", "html", "markdown")
    return docs.mapInPandas(clean, "fixture_id bigint, html_text string, markdown_text string").distinct()


# 2. template residue and error pages


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Fetches whose main body is residue."""
    return residue.residue_pages(read_spread(spark, folder, "fetches", "fetch_id", "html")).select("fetch_id").distinct()


def p2_labels(spark: SparkSession, folder: str) -> DataFrame:
    """How many fetches are residue, by label."""
    found = residue.residue_pages(read_spread(spark, folder, "fetches", "fetch_id", "html"))
    return found.groupBy("label").agg(F.countDistinct("fetch_id").alias("n_fetches"))


# 3. text quality


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_spread(spark, folder, "fixture_docs", "fixture_id", "markdown")
    issues = read_spread(spark, folder, "issues", "issue_id", "message")
    return docs.select(F.lit("fixture_docs").alias("src_table"), F.col("fixture_id").alias("row_id"), F.col("markdown").alias("text")).unionByName(
        issues.select(F.lit("issues").alias("src_table"), F.col("issue_id").alias("row_id"), F.col("message").alias("text"))
    )


def _label_shares(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder)
    return quality.label_shares(texts.where(F.col("row_id").isNotNull()), _line_model(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are not natural prose."""
    return _label_shares(spark, folder).where("is_case").select("src_table", "row_id").distinct()


def p3_label_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the characters of each text by the label of their lines."""
    return _label_shares(spark, folder).distinct()


def p3_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and ratios of each text, and its share of common words of any language."""
    texts = _texts(spark, folder)
    common = sorted(quality.load_common_words(read_table(spark, folder, "common_words")))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    shared = F.size(F.filter(words, lambda w: w.isin(common)))
    stats = quality.text_statistics(F.col("text"))
    return texts.select(
        "src_table", "row_id", *[c.alias(n) for n, c in stats.items()],
        F.when(F.size(words) > 0, F.round(shared / F.size(words), 6)).alias("common_share"),
    ).distinct()


_P3_STATISTICS = r"""
WITH t AS (
  SELECT 'fixture_docs' AS src_table, fixture_id AS row_id, markdown AS text FROM fixture_docs
  UNION ALL SELECT 'issues', issue_id, message FROM issues),
p AS (SELECT *,
  list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '') AS words,
  list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: length(trim(x)) > 0) AS lines,
  list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '') AS plain,
  length(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g')) AS kept, cw FROM t CROSS JOIN (SELECT list(DISTINCT lower(word)) AS cw FROM common_words))
SELECT DISTINCT src_table, row_id, length(text) AS n_chars, CASE WHEN text IS NOT NULL THEN len(words) END AS n_words,
  CASE WHEN len(words) > 0 THEN round(list_sum(list_transform(words, lambda w: length(w))) / len(words), 6) END AS mean_word_length,
  CASE WHEN length(text) > 0 THEN round((length(text) - kept) / length(text), 6) END AS symbol_ratio,
  CASE WHEN text IS NOT NULL THEN len(lines) END AS n_lines,
  CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。！？][ \t]*$'))) / len(lines), 6) END AS ends_in_punctuation,
  CASE WHEN len(plain) > 0 THEN round(len(list_filter(plain, lambda w: list_contains(cw, w))) / len(plain), 6) END AS common_share
FROM p"""


# 4. repetition


def p4_method(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity of each field under a Kneser-Ney model of its language, and whether its band rejects it."""
    docs = read_spread(spark, folder, "fixture_docs", "fixture_id", "html", "markdown")
    common = repetition.common_by_language(read_table(spark, folder, "common_words"))
    return repetition.perplexity_bands(repetition.corpus_perplexities(docs, common)).distinct()


def _shares(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition_shares(read_spread(spark, folder, "fixture_docs", "fixture_id", "html", "markdown"), _line_model(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of which at least two fifths of the words repeat what came before."""
    return _shares(spark, folder).where("is_case").select("fixture_id", "field_name").distinct()


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of repeated words of each field."""
    return _shares(spark, folder)


# 5. main body


def p5_method(spark: SparkSession, folder: str) -> DataFrame:
    """All visible text of each fetch and of each whole page of the fixture documents: block spacing, lists and aligned cells kept."""
    fetches = mainbody.rendered_pages(read_spread(spark, folder, "fetches", "fetch_id", "html"), "fetches", "fetch_id", False)
    docs = mainbody.rendered_pages(read_spread(spark, folder, "fixture_docs", "fixture_id", "html"), "fixture_docs", "fixture_id", False)
    return fetches.unionByName(docs).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Leads of the text blocks in the main body of each whole page."""
    found = mainbody.fetch_blocks(read_spread(spark, folder, "fetches", "fetch_id", "html"))
    return found.unionByName(mainbody.page_blocks(read_spread(spark, folder, "fixture_docs", "fixture_id", "html"), "fixture_docs", "fixture_id"))


def p5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of each fetch and of each whole page of the fixture documents as text."""
    fetches = mainbody.rendered_pages(read_spread(spark, folder, "fetches", "fetch_id", "html"), "fetches", "fetch_id", True)
    docs = mainbody.rendered_pages(read_spread(spark, folder, "fixture_docs", "fixture_id", "html"), "fixture_docs", "fixture_id", True)
    return fetches.unionByName(docs).distinct()


# 7. encoding


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of each document; empty for empty and NULL texts."""
    return tokenise.token_ids(read_spread(spark, folder, "documents", "doc_id", "text"))


def p7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, tokens and characters of each source."""
    docs = read_spread(spark, folder, "documents", "doc_id", "source", "n_chars", "text")
    counted = tokenise.token_counts(docs, ["doc_id", "source", "n_chars"])
    return counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_chars").cast("bigint")).alias("n_chars"))


# 8. mixing


def p8_method(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of all documents by soft membership: posteriors of a classifier and projected gradients."""
    return mixing.soft_rates(read_spread(spark, folder, "documents", "doc_id", "source", "text"), read_table(spark, folder, "mix_targets"))[0]


def p8_soft_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target, expected and real share of each source under the rates of ``p8_method``."""
    return mixing.soft_rates(read_spread(spark, folder, "documents", "doc_id", "source", "text"), read_table(spark, folder, "mix_targets"))[1]


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix with their numbers of copies, by the sources as labelled."""
    return mixing.hard_mix(read_spread(spark, folder, "documents", "doc_id", "source", "text"), read_table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    return mixing.hard_mix(read_spread(spark, folder, "documents", "doc_id", "source", "text"), read_table(spark, folder, "mix_targets"))[1]


# 9. look-alikes


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with different texts that look the same."""
    return confusables.look_alike_pairs(read_spread(spark, folder, "documents", "doc_id", "text"))


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of look-alike texts of each document that has any."""
    return confusables.look_alike_classes(read_spread(spark, folder, "documents", "doc_id", "text"))


def p9_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of each document."""
    return confusables.consistent_forms(read_spread(spark, folder, "documents", "doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_method, p1_found, p1_clean_text, p2_found, p2_labels, p3_found, p3_label_shares, p3_statistics,
        p4_method, p4_found, p4_shares, p5_method, p5_found, p5_main_text,
        p7_ids, p7_token_counts, p8_method, p8_soft_shares, p8_mix, p8_shares, p9_found, p9_classes, p9_forms,
    )
}
ORACLE_SQL = {"p3_statistics": _P3_STATISTICS}

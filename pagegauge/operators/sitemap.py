"""Sitemaps: documents to kinds and addresses, and the bounded walk through indexes."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pagegauge.functions.urls import origin, resolved_url
from pagegauge.schema import struct

#: at most so many sitemaps of a site are read (a fixed bound of the contract)
MAX_SITEMAPS = 5
SITEMAP = struct(kind=StringType(), urls=ArrayType(StringType()))
_LOC = {"index": re.compile(r"<(?:\w+:)?sitemap\b[^>]*>(.*?)</(?:\w+:)?sitemap>", re.S), "urlset": re.compile(r"<(?:\w+:)?url\b[^>]*>(.*?)</(?:\w+:)?url>", re.S)}
_INNER = re.compile(r"<loc\b[^>]*>(.*?)</loc>", re.S)


def parse_sitemap(xml: str | None) -> tuple[str, list[str]]:
    """(index, urlset or unknown, addresses); broken XML is read as far as its entries are whole."""
    if not xml:
        return "unknown", []
    try:
        root = ElementTree.fromstring(xml.strip())
        name = lambda e: e.tag.rpartition("}")[2]
        names = {name(e) for e in root.iter()}
        kind = "index" if "sitemapindex" in names else "urlset" if "urlset" in names else "unknown"
        parent = {"index": "sitemap", "urlset": "url"}.get(kind)
        found = [(c.text or "").strip() for e in root.iter() if name(e) == parent for c in e if c.tag.rpartition("}")[2] == "loc" and not c.tag.startswith("{http://www.google.com")]
        return kind, [u for u in found if u]
    except ElementTree.ParseError:
        kind = "index" if "<sitemapindex" in xml else "urlset" if "<urlset" in xml else "unknown"
        if kind == "unknown":
            return kind, []
        found = [m.group(1).strip() for entry in _LOC[kind].finditer(xml) for m in _INNER.finditer(entry.group(1))]
        return kind, [u for u in found if u]


@F.pandas_udf(SITEMAP)
def parsed_sitemap(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_sitemap(x) for x in xml], columns=["kind", "urls"])


def read_sitemaps(documents: DataFrame) -> DataFrame:
    """(origin, url, status, kind, urls) of (origin, url, status, body); only a 200 is parsed."""
    return documents.withColumn("m", parsed_sitemap(F.when(F.col("status") == 200, F.col("body")))).select(
        "origin", "url", "status", F.when(F.col("status") == 200, F.col("m.kind")).otherwise("unknown").alias("kind"),
        F.when(F.col("status") == 200, F.col("m.urls")).otherwise(F.array().cast("array<string>")).alias("urls"),
    )


def walk_sitemaps(sitemaps: DataFrame, starts: DataFrame, most: int = MAX_SITEMAPS) -> DataFrame:
    """The sitemaps of each origin that a breadth-first walk from ``starts`` (origin, url, pos) reads, in order."""
    seen = None
    frontier = starts.select("origin", "url", F.array(F.col("pos").cast("int")).alias("step")).withColumn("level", F.lit(0))
    for level in range(most):
        order = Window.partitionBy("origin").orderBy("level", "step", "url")
        known = frontier if seen is None else seen.select("origin", "url", "level", "step").unionByName(frontier)
        first = known.groupBy("origin", "url").agg(F.min(F.struct("level", "step")).alias("k")).select("origin", "url", "k.level", "k.step")
        kept = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        seen = kept.join(sitemaps, ["origin", "url"], "left")
        frontier = (
            seen.where((F.col("kind") == "index") & (F.col("level") == level))
            .select("origin", F.col("url").alias("_from"), F.col("step").alias("_s"), F.posexplode("urls").alias("_p", "_u"))
            .select("origin", resolved_url("_u", "_from").alias("url"), F.concat("_s", F.array("_p")).alias("step"))
            .where(origin(F.col("url")) == F.col("origin"))
            .withColumn("level", F.lit(level + 1))
        )
    return seen.select("origin", "url", "place", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce(F.size("urls"), F.lit(0)).alias("n_urls"))

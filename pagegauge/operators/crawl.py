"""Crawl order over a table of pages, and redirect chains over a table of hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.session import cut_lineage

#: fixed bounds of the contract
MAX_HOPS = 10
MAX_PAGES = 200
DEFAULT_PAGES = 20


def follow_redirects(hops: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """(start_url, final_url, n_hops) from (from_url, to_url), at most ``most`` hops; a loop ends there.

    A round moves only the chains that still go on, and the rounds end with the longest chain.
    """
    step = hops.select(F.col("from_url").alias("_f"), F.col("to_url").alias("_t"))
    moving = hops.select(F.col("from_url").alias("start_url"), F.col("to_url").alias("final_url"), F.lit(1).alias("n_hops"))
    reached = moving
    for _ in range(most - 1):
        moving = cut_lineage(moving.join(step, F.col("final_url") == F.col("_f")).select("start_url", F.col("_t").alias("final_url"), (F.col("n_hops") + 1).alias("n_hops")))
        if moving.isEmpty():
            break
        reached = reached.unionByName(moving)
    last = reached.groupBy("start_url").agg(F.max(F.struct("n_hops", "final_url")).alias("m"))
    return last.select("start_url", "m.final_url", "m.n_hops")


def check_page_limit(most: int | None) -> int:
    most = DEFAULT_PAGES if most is None else most
    if not isinstance(most, int) or not 1 <= most <= MAX_PAGES:
        raise ValueError(f"the page limit must be a whole number from 1 to {MAX_PAGES}")
    return most


def crawl_order(edges: DataFrame, starts: DataFrame, entries: DataFrame, denied: DataFrame, most: int | None = None) -> DataFrame:
    """(origin, url, place): the addresses that a bounded crawl of each site requests, in order.

    ``starts`` (origin, url) are visited first, then what visited pages link to (``edges``: origin, src,
    dst, internal), first found first, and where no such link is left the next entry of the sitemap
    (``entries``: origin, url, pos) with its links.  Addresses in ``denied`` (url) are passed over and cost
    nothing; addresses without a page are requested in vain and count.  Links of one page go by address.

    Every round moves all sites: one by the links of its last pages, one without such by its sitemap, up to
    the first entry with new links.  A site places at most ``most`` pages, so at most that many rows of a
    site are ranked in a task.
    """
    most = check_page_limit(most)
    links = cut_lineage(edges.where("internal").select("origin", "src", "dst").distinct().join(denied.select(F.col("url").alias("dst")), "dst", "left_anti"))
    queue = cut_lineage(entries.groupBy("origin", "url").agg(F.min("pos").alias("pos")).join(denied, "url", "left_anti"))
    seen = cut_lineage(starts.groupBy("origin").agg(F.min("url").alias("url")).join(denied, "url", "left_anti").select("origin", "url", F.lit(1).alias("place")))
    sites = starts.select("origin").distinct()
    frontier = seen
    for _ in range(2 * most):
        known = seen.select("origin", "url")
        base = sites.join(seen.groupBy("origin").agg(F.max("place").alias("_base")), "origin", "left").select("origin", F.coalesce("_base", F.lit(0)).alias("_base")).where(F.col("_base") < most)
        found = frontier.select("origin", F.col("url").alias("src"), "place").join(links, ["origin", "src"]).groupBy("origin", F.col("dst").alias("url")).agg(F.min("place").cast("bigint").alias("_at"))
        linked = _first(found.join(known, ["origin", "url"], "left_anti"), most)
        waiting = queue.join(linked.select("origin").distinct(), "origin", "left_anti").join(known, ["origin", "url"], "left_anti").withColumnRenamed("pos", "_at")
        waiting = _first(waiting, most)
        fresh = links.join(known.select("origin", F.col("url").alias("dst")), ["origin", "dst"], "left_anti").where("src <> dst").select("origin", F.col("src").alias("url")).distinct()
        stops = waiting.join(fresh, ["origin", "url"], "left_semi").groupBy("origin").agg(F.min("_rank").alias("_stop"))
        listed = waiting.join(stops, "origin", "left").where(F.col("_stop").isNull() | (F.col("_rank") <= F.col("_stop"))).drop("_stop")
        placed = linked.unionByName(listed).join(base, "origin").withColumn("place", F.col("_rank") + F.col("_base")).where(F.col("place") <= most)
        frontier = cut_lineage(placed.select("origin", "url", "place"))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def _first(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows (origin, url, _at) of each site with their rank; the bound is pushed below the shuffle."""
    order = Window.partitionBy("origin").orderBy("_at", "url")
    return rows.select("origin", "url", "_at").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_at")


def crawl_rest(order: DataFrame, edges: DataFrame, entries: DataFrame, denied: DataFrame) -> DataFrame:
    """(origin, crawled, remaining, truncated): what a crawl left in its queues."""
    seen = order.select("origin", "url")
    found = edges.where("internal").join(seen.withColumnRenamed("url", "src"), ["origin", "src"], "left_semi").select("origin", F.col("dst").alias("url"))
    rest = found.unionByName(entries.select("origin", "url")).distinct().join(denied, "url", "left_anti").join(seen, ["origin", "url"], "left_anti")
    counted = order.groupBy("origin").agg(F.count(F.lit(1)).alias("crawled"))
    left = rest.groupBy("origin").agg(F.count(F.lit(1)).alias("remaining"))
    whole = counted.join(left, "origin", "full_outer")
    n = F.coalesce("remaining", F.lit(0))
    return whole.select("origin", F.coalesce("crawled", F.lit(0)).alias("crawled"), n.alias("remaining"), (n > 0).alias("truncated"))

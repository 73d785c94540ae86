"""robots.txt as relations: parsed groups, selection by user agent, decisions by longest pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.functions.text import trim
from pagegauge.functions.urls import path_and_query

USER_AGENT = "pagegauge"
#: answers that count as a complete disallow (fixed values)
UNREADABLE = (401, 403, 429)


def effective_text(status: Column, text: Column) -> Column:
    """The policy that counts: the text of a 200, nothing allowed on errors, everything otherwise."""
    denied = status.isin(*UNREADABLE) | (status >= 500) | (status == 0) | status.isNull()
    return F.when(status == 200, F.coalesce(text, F.lit(""))).when(denied, F.lit("User-agent: *\nDisallow: /")).otherwise(F.lit(""))


def policy_lines(policies: DataFrame, key: str = "origin", text: str = "text") -> DataFrame:
    """(key, pos, field, value) of the lines that count."""
    lines = policies.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "raw"))
    bare = trim(F.regexp_replace("raw", "#.*$", ""))
    cut = F.instr("bare", ":")
    return (
        lines.withColumn("bare", bare)
        .where(cut > 0)
        .select(key, "pos", F.lower(trim(F.expr("substring(bare, 1, instr(bare, ':') - 1)"))).alias("field"), trim(F.expr("substring(bare, instr(bare, ':') + 1)")).alias("value"))
        .where(F.col("field").isin("user-agent", "allow", "disallow", "sitemap"))
    )


def policy_groups(lines: DataFrame, key: str = "origin") -> DataFrame:
    """``lines`` without sitemaps and empty disallows, with their group number.

    A user-agent line after a rule begins a group; further ones join it.  Lines of one policy are
    few, whatever the number of policies.
    """
    rows = lines.where((F.col("field") != "sitemap") & ~((F.col("field") == "disallow") & (F.col("value") == "")))
    order = Window.partitionBy(key).orderBy("pos")
    agent = F.col("field") == "user-agent"
    begins = agent & (F.lag(agent).over(order).isNull() | ~F.lag(agent).over(order))
    return rows.withColumn("_b", begins.cast("int")).withColumn("group_no", F.sum("_b").over(order)).drop("_b").where(F.col("group_no") > 0)


def selected_rules(lines: DataFrame, agent: str = USER_AGENT, key: str = "origin") -> DataFrame:
    """(key, pos, directive, pattern) of the groups with the longest agent name in ``agent``, else of ``*``."""
    grouped = policy_groups(lines, key)
    agents = grouped.where((F.col("field") == "user-agent") & (F.col("value") != "")).select(key, "group_no", F.lower("value").alias("name"))
    fitting = agents.withColumn("size", F.when(F.col("name") == "*", 0).when(F.lit(agent.lower()).contains(F.col("name")), F.length("name"))).where("size IS NOT NULL")
    best = fitting.groupBy(key).agg(F.max("size").alias("size"))
    chosen = fitting.join(best, [key, "size"]).select(key, "group_no").distinct()
    rules = grouped.where(F.col("field").isin("allow", "disallow"))
    return rules.join(chosen, [key, "group_no"]).select(key, "pos", F.col("field").alias("directive"), F.col("value").alias("pattern"))


def pattern_expression(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: ``*`` any text, a final ``$`` the end."""
    body = F.regexp_replace(pattern, r"\$$", "")
    escaped = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), F.lit("$")).otherwise(F.lit("")))


def decisions(urls: DataFrame, rules: DataFrame, key: str = "origin", url: str = "url") -> DataFrame:
    """``urls`` with ``allowed``: the longest matching pattern decides, allow before disallow.

    Rules are joined by origin, so a URL meets the rules of its own site only; the winner is an
    aggregate, not a sort.
    """
    rule = rules.where(F.col("pattern") != "").select(
        F.col(key).alias("_k"), pattern_expression(F.col("pattern")).alias("_e"),
        F.struct(F.length(F.regexp_replace("pattern", r"[*$]", "")).alias("size"), (F.col("directive") == "allow").cast("int").alias("allow")).alias("_r"),
    )
    packed = rule.groupBy("_k").agg(F.collect_list(F.struct("_e", "_r")).alias("_rules"))
    path = path_and_query(F.col(url))
    joined = urls.join(packed, urls[key] == packed["_k"], "left").withColumn("_path", path)
    best = F.array_max(F.transform(F.filter("_rules", lambda r: F.regexp_like(F.col("_path"), r["_e"])), lambda r: r["_r"]))
    return joined.withColumn("allowed", F.coalesce(best["allow"] == 1, F.lit(True))).drop("_k", "_rules", "_path")

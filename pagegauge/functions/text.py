"""Native text functions with the white-space and word rules of the readiness contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space as the contract counts it: Unicode blanks, line separators and the byte order mark
WS = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: ends of sentences; a point between digits is none
SENTENCE_END = r"(?<![0-9])\.|\.(?![0-9])|[!?。！？]+"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"{WS}+", " "))


def raw_word_count(text: Column) -> Column:
    """Parts between runs of white space; an empty text has one."""
    return F.size(F.split(text, f"{WS}+"))


def word_count(text: Column) -> Column:
    """Words, without empty parts."""
    return F.size(F.filter(F.split(text, f"{WS}+"), lambda w: w != ""))


def sentence_count(text: Column, least: int = 10) -> Column:
    """Sentences of more than ``least`` characters."""
    return F.size(F.filter(F.split(text, SENTENCE_END), lambda s: F.length(trim(s)) > least))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def list_of(column: str, kind: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(kind))


def escape_html(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def prompt_excerpt(html: Column, most: int = 8000) -> Column:
    """Text without tags, collapsed and cut to the prompt's bound."""
    return F.substring(collapse(F.regexp_replace(html, "<[^>]*>", " ")), 1, most)


def score_band(total: Column) -> Column:
    return F.when(total >= 70, "70-100").when(total >= 40, "40-69").otherwise("0-39")


def grade(total: Column) -> Column:
    return F.when(total >= 80, "Excellent").when(total >= 60, "Good").when(total >= 40, "Needs Work").otherwise("Poor")


def percent(share: Column) -> Column:
    """A share as a whole percentage, halves up."""
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def source_label(target: Column) -> Column:
    return F.when(target.rlike(r"(?i)\A\s*https?://[^/?#\s]+"), "Affected URL").otherwise("Affected source group")


#: how a preview was captured (fixed values)
CAPTURES = {
    "local-file": "local file",
    "response-html": "response HTML",
    "browser-rendered-html": "browser-rendered HTML",
    "provided-html": "provided HTML",
    "markdown": "Markdown",
}


def capture_label(capture: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CAPTURES.items() for x in pair])[capture]


def site_name(title: Column, path: Column) -> Column:
    """What stands before the first bar and dash of the title, else the last part of the path."""
    short = trim(F.split_part(F.split_part(F.coalesce(title, F.lit("")), F.lit("|"), F.lit(1)), F.lit("-"), F.lit(1)))
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")
    return F.coalesce(F.nullif(short, F.lit("")), F.try_element_at(parts, F.lit(-1)), F.lit("Website"))


def audit_source(rendering: Column) -> Column:
    return F.when(rendering == "markdown", "markdown").otherwise("html")


def target_kind(target: Column) -> Column:
    """What a scan target is: directory paths need to be named as such, so they are refused here."""
    web = target.startswith("http://") | target.startswith("https://")
    file = F.lower(target).rlike(r"\.(?:html?|mdx?|markdown)\z")
    bare = target.contains(".") & ~target.contains("/") & ~target.contains("\\")
    return F.when(target.isNull(), None).when(web, "url").when(file, "file").when(bare, "url").when(target.startswith("./") | target.startswith("/") | target.startswith(".."), "refused").otherwise("url")


def target_path(target: Column) -> Column:
    """The address or path of a target; an address without scheme is of https."""
    kind = target_kind(target)
    web = target.startswith("http://") | target.startswith("https://")
    return F.when((kind == "url") & ~web, F.concat(F.lit("https://"), target)).when(kind != "refused", target)


def likely_script_page(html: Column) -> Column:
    """Few content elements and many scripts: the page is probably built in the browser."""
    return (F.regexp_count(html, F.lit(r"<(?:p|h[1-6]|li|article|main)[>\s]")) < 10) & (F.regexp_count(html, F.lit("<script")) > 3)

"""Parsing and pure functions of the core."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagegauge.functions.documents import parse_html, parse_markdown, without_fences
from pagegauge.functions.htmltree import find_all, parse
from pagegauge.functions.jsonld import Facts
from pagegauge.functions import urls
from pagegauge.functions.urls import normalise
from pagegauge.operators.crawl import check_page_limit
from pagegauge.operators.rules import repetition_signals
from pagegauge.operators.sitemap import parse_sitemap
from pagegauge.sources import files


def test_implied_end_tags():
    root = parse("<p>a<p>b<ul><li>c<li>d<ul><li>e</ul></ul><h2>f<h3>g</h3><table><tr><td>h<td>i<tr><td>j</table>")
    assert [n.text() for n in find_all(root, "p")] == ["a", "b"]
    assert [n.text() for n in find_all(root, "li")] == ["c", "de", "e"]
    assert [n.text() for n in find_all(root, "h2", "h3", "td")] == ["f", "g", "h", "i", "j"]


def test_raw_text_and_cut_input():
    root = parse("<title>a &amp; <b></title><script>if(a<b){'</p>'}</script><p title='>'>x &lt; y</p><!-- <p>no</p> --><p>z<a hr")
    assert [n.text() for n in find_all(root, "title", "script", "p")] == ["a & <b>", "if(a<b){'</p>'}", "x < y", "z"]


@given(st.text(alphabet="<>/abp!- \"'=&;#divliscrpt", max_size=150))
@settings(max_examples=200, deadline=None)
def test_any_text_parses(text):
    parse_html(text)


def test_html_fields():
    doc = parse_html(
        "<html lang=' en '><head><title> T </title><meta name=Description content=d><meta property='og:x' content=y>"
        "<link rel='x canonical' href=/c><link rel=alternate hreflang=DE href=/de></head><body><svg><title>no</title></svg>"
        "<main><h1>A <b>b</b></h1><p>short</p><p>twenty one characters</p><a href=/x rel=nofollow>l</a><a>no</a><img src=i></main><p>outside the main area here</p>"
        "<script type='application/ld+json'>{\"@context\":\"c\",\"@type\":\"T\"}</script></body></html>"
    )
    assert (doc["document_title"], doc["language"], doc["canonicals"], doc["titles"]) == ("T", "en", ["/c"], ["T"])
    assert doc["headings"] == [{"level": 1, "text": "A b"}]
    assert doc["paragraphs"] == ["twenty one characters", "outside the main area here"]
    assert doc["meta"] == {"Description": "d", "og:x": "y"} and doc["meta_values"] == {"description": ["d"]}
    assert doc["links"] == [{"href": "/x", "text": "l", "rel": "nofollow"}] and doc["images"] == [{"src": "i", "alt": None}]
    assert doc["alternates"] == [{"href": "/de", "lang": "de"}]
    assert doc["raw_text"] == "A bshorttwenty one characterslno" and doc["block_count"] == 1 and not doc["diagnostics"]


def test_markdown_fields():
    doc = parse_markdown("---\ntitle: T\nlang: fr\n---\n# H\n\nOne\ntwo [l](/x \"t\") ![i](/y)\n\n- item\n\n```\n# no\n```\n## H2 ##\n")
    assert (doc["document_title"], doc["language"], [h["text"] for h in doc["headings"]]) == ("T", "fr", ["H", "H2 ##"])
    assert doc["paragraphs"] == ["One two [l](/x \"t\") ![i](/y)"]
    assert doc["links"] == [{"href": "/x", "text": "l", "rel": None}] and doc["images"] == [{"src": "/y", "alt": "i"}]
    assert doc["raw_text"] == "H One two l - item H2"


@pytest.mark.parametrize(("opening", "closing", "kept"), [("```", "```", False), ("~~~~", "~~~", False), ("``` a`b", "```", True), ("    ```", "```", True), ("~~~", "~~~", False)])
def test_fences(opening, closing, kept):
    assert ("# x" in without_fences(f"{opening}\n# x\n{closing}\nafter")) is kept


@pytest.mark.parametrize(
    ("block", "nodes", "errors", "kinds"),
    [
        ('{"@context":"c","@type":"T"}', 1, 0, []),
        ("{", 0, 1, ["syntax"]),
        ("NaN", 0, 1, ["syntax"]),
        ("null", 0, 1, ["root"]),
        ("1", 1, 1, ["root"]),
        ("[[1]]", 1, 1, ["root", "structure"]),
        ("{}", 1, 0, ["structure"]),
        ('{"@context":"c","@graph":[{"@type":"A"},{"@type":"B","@context":null}]}', 2, 0, ["structure"]),
        ('{"@context":[],"@type":"T"}', 1, 0, ["structure"]),
        ('{"@context":"c","@type":["A",""]}', 1, 0, ["structure"]),
        ('{"@context":"c","@id":"x","@graph":[]}', 0, 0, []),
        ('[{"@context":"c","@type":"T"},null]', 1, 1, ["root"]),
    ],
)
def test_json_ld(block, nodes, errors, kinds):
    facts = Facts()
    facts.read(block, 4)
    assert (len(facts.nodes), len(facts.errors), [d["kind"] for d in facts.diagnostics]) == (nodes, errors, kinds)
    assert all(d["line"] == 4 and d["block"] == 1 for d in facts.diagnostics)


def test_deep_json_ld_does_not_overflow():
    facts = Facts()
    facts.read('{"@graph":' * 300 + "[]" + "}" * 300)
    assert facts.nodes == []


@pytest.mark.parametrize(
    ("value", "base", "expected"),
    [
        ("HTTP://A.Test:80/a/../b/./c?q#f", None, "http://a.test/b/c?q"),
        ("/x y", "https://a.test/d/e", "https://a.test/x%20y"),
        ("é", "https://a.test/d/e", "https://a.test/d/%C3%A9"),
        ("?q=1", "https://a.test/d", "https://a.test/d?q=1"),
        ("//b.test", "https://a.test", "https://b.test/"),
        ("mailto:a@b.c", "https://a.test", None),
        ("javascript:x", "https://a.test", None),
        ("", "https://a.test/d#f", "https://a.test/d"),
        ("https://a.test:443", None, "https://a.test/"),
        ("https://a.test:8443/", None, "https://a.test:8443/"),
        ("/relative", None, None),
        (None, None, None),
        ("http://[bad", None, None),
    ],
)
def test_urls(value, base, expected):
    assert normalise(value, base) == expected


@pytest.mark.parametrize(
    ("xml", "kind", "urls"),
    [
        ("<urlset><url><loc> a </loc><image:image xmlns:image='i'><image:loc>no</image:loc></image:image></url></urlset>", "urlset", ["a"]),
        ("<?xml version='1.0'?><sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc>b</loc></sitemap></sitemapindex>", "index", ["b"]),
        ("<urlset><url><loc>c</loc></url><url><loc>d", "urlset", ["c"]),
        ("<html></html>", "unknown", []),
        ("", "unknown", []),
        (None, "unknown", []),
    ],
)
def test_sitemaps(xml, kind, urls):
    assert parse_sitemap(xml) == (kind, urls)


def test_repetition_signals():
    assert repetition_signals("word " * 49) == (None, 0)
    d, hits = repetition_signals("cheap shoes buy shoes now. " * 30)
    assert d < 0.25 and hits >= 2


def test_page_limit():
    assert check_page_limit(None) == 20 and check_page_limit(200) == 200
    for bad in (0, 201, 1.5):
        with pytest.raises(ValueError):
            check_page_limit(bad)


def test_directory_scans(tmp_path):
    for name in ("a.html", "b.MD", ".c.html", "sub/d.htm", ".hidden/e.html", "node_modules/f.html", "g.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
    (tmp_path / "link.html").symlink_to(tmp_path / "a.html")
    names = lambda found: sorted(p[len(str(tmp_path)) + 1 :] for p in found)
    assert names(files.scan(str(tmp_path))) == [".c.html", "a.html", "b.MD", "link.html", "sub/d.htm"]
    assert names(files.scan_build(str(tmp_path))) == ["a.html", "sub/d.htm"]
    with pytest.raises(ValueError):
        files.scan_build(str(tmp_path / "node_modules" / "none"))


def test_reading_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "b.md").write_text("# y")
    rows = files.read_pages(spark, sorted(map(str, tmp_path.iterdir()))).collect()
    assert sorted((r["format"], r["content"]) for r in rows) == [("html", "<p>x</p>"), ("markdown", "# y")]
    with pytest.raises(ValueError):
        files.read_pages(spark, ["x.pdf"])


def test_reports_round_trip(spark, tmp_path):
    from pagegauge.sources import reports

    dims = {"structure": 20, "citability": 20, "schema": 20, "aiMetadata": 10, "contentDensity": 10}
    good = {"scoringVersion": reports.SCORING_VERSIONS[0], "timestamp": "2026-01-01T00:00:00Z", "overall": {**dims, "total": 80}, "pages": [{"url": "u", "title": "t", "scores": {**dims, "total": 80}}]}
    bad = {**good, "timestamp": "2026-01-02T00:00:00Z", "overall": {**dims, "structure": 26, "total": 80}}
    for i, report in enumerate((good, bad)):
        (tmp_path / f"{i}.json").write_text(json.dumps(report))
    found = reports.scan_violations(reports.read_scan_reports(spark, str(tmp_path))).collect()
    assert sorted(tuple(r) for r in found) == [("2026-01-02T00:00:00Z", v) for v in ("average", "score-range", "total")]
    reports.write_json(spark.range(1).toDF("x"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        reports.write_json(spark.range(1).toDF("x"), str(tmp_path / "out"))


def test_native_addresses_are_those_of_the_reader(spark):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(3)
    parts = ["http://", "https://", "HTTP://", "//", "/", "a", "B", "x.test", "S.Test", ":80", ":443", ":8080", ".", "..", "/./", "/../", "?", "q=1", "#f", "%2e", "%41", " ", "é", "'", "\"", "@", "mailto:", "\\", "&", "-", "[", "a.b"]
    values = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 7))) for _ in range(3000)] + [None, "", "http://x.test", "http://x.test/", "https://x.test/a?", "http://x.test/a/..", "http://x.test/.a", "/a.b/c", "//x.test/a"]
    bases = [rnd.choice(["http://s.test/d/e?x=1", "https://s.test/", "HTTP://S.test/a", None, "s", "http://s.test"]) for _ in values]
    df = spark.createDataFrame(list(zip(values, bases)), "v string, b string").select("v", "b", urls.normal_url("v").alias("n"), urls.resolved_url(F.col("v"), "b").alias("r"))
    for r in df.collect():
        assert r["n"] == urls.normalise(r["v"]), r
        assert r["r"] == urls.normalise(r["v"], r["b"]), r

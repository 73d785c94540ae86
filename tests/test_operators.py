"""Operators of the core on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagegauge.operators import audit, compare, crawl, ledger, robots, rules, site
from pagegauge.operators.pages import latest, parsed_pages
from pagegauge.operators.snapshots import canonical_target, change_counts, snapshot_changes
from pagegauge.streaming.observations import distinct_observations, windowed_counts

DOC = (
    "id string, html string, markdown string, headings array<struct<level:int,text:string>>, paragraphs array<string>, json_ld array<string>, "
    "meta_tags map<string,string>, links array<struct<href:string,text:string,rel:string>>, raw_text string"
)
STUFFED = "Cheap shoes buy cheap shoes here today. " * 30


def doc(name, html=None, markdown=None, headings=(), paragraphs=(), json_ld=(), meta=None, links=(), raw=""):
    return (name, html, markdown, list(headings), list(paragraphs), list(json_ld), meta or {}, list(links), raw)


#: (rule, document, score, issues, suggestions)
CASES = [
    ("heading-hierarchy", doc("a", headings=[(1, "A"), (2, "B"), (3, "C")]), 10, 0, 0),
    ("heading-hierarchy", doc("b"), 0, 1, 0),
    ("heading-hierarchy", doc("c", headings=[(1, "A"), (1, "B"), (2, "C")]), 10, 0, 0),
    ("heading-hierarchy", doc("d", headings=[(2, "A"), (4, "B"), (6, "C")]), 6, 3, 0),
    ("heading-hierarchy", doc("e", headings=[(1, "A")], raw="w " * 600), 9, 0, 1),
    ("paragraph-length", doc("f", paragraphs=["w " * 150 + "w", "w " * 150 + "w", "short"]), 3, 1, 1),
    ("paragraph-length", doc("g", paragraphs=["w " * 149 + "w"]), 8, 0, 0),
    ("paragraph-length", doc("h"), 0, 1, 0),
    ("list-usage", doc("i", markdown="text", raw="w " * 300 + "w"), 4, 0, 1),
    ("list-usage", doc("j", markdown="text", raw="w " * 299 + "w"), 7, 0, 0),
    ("list-usage", doc("k", markdown="x\n- item", raw="w " * 400), 7, 0, 0),
    ("self-contained-statements", doc("l", paragraphs=["This is", "It is", "They are", "Cats", "Dogs"]), 3, 1, 1),
    ("self-contained-statements", doc("m", paragraphs=["This is", "Cats", "Dogs", "Cows", "Itself"]), 8, 0, 1),
    ("data-stats-presence", doc("n", raw="Growth of 40% in a year"), 3, 1, 1),
    ("data-stats-presence", doc("o", raw="40% according to Them"), 7, 0, 0),
    ("data-stats-presence", doc("p", raw="40%", links=[("https://a.test", "t", None)]), 7, 0, 0),
    ("clear-definitions", doc("q", raw="A is b. C means d. E refers to f."), 5, 0, 0),
    ("clear-definitions", doc("r", raw="Nothing here"), 1, 0, 1),
    ("clear-definitions", doc("s", raw="API是一種應用程式介面。爬蟲是自動程式。索引指資料的目錄。"), 5, 0, 0),
    ("attribution", doc("t", raw="according to x", meta={"author": "A"}), 3, 0, 0),
    ("json-ld-presence", doc("u"), 8, 1, 0),
    ("json-ld-completeness", doc("v", json_ld=["{}"]), 0, 1, 0),
    ("json-ld-completeness", doc("w", json_ld=['{"@context":"c","@type":"Article"}']), 12, 0, 2),
    ("ai-relevant-schema-types", doc("x", json_ld=['{"@context":"c","@type":"T"}']), 0, 0, 1),
    ("robots-txt-ai-config", doc("y", meta={"robots": "NoIndex,nofollow"}), 0, 1, 0),
    ("meta-description-quality", doc("z"), 0, 1, 0),
    ("meta-description-quality", doc("aa", meta={"description": "Home"}), 3, 0, 1),
    ("meta-description-quality", doc("ab", meta={"description": "a, b, c, d, e"}), 3, 0, 1),
    ("meta-description-quality", doc("ac", meta={"og:description": "A page about three things."}), 7, 0, 0),
    ("content-boilerplate-ratio", doc("ad", paragraphs=["w " * 20], raw="w " * 100), 1, 0, 1),
    ("content-boilerplate-ratio", doc("ae", paragraphs=["w " * 40], raw="w " * 100), 3, 0, 0),
    ("content-boilerplate-ratio", doc("af"), 0, 1, 0),
    ("keyword-stuffing-detection", doc("ag", raw=STUFFED), 0, 1, 1),
    ("keyword-stuffing-detection", doc("ah", raw="w " * 49), 5, 0, 0),
    ("content-uniqueness-signals", doc("ai", html="<pre>x</pre>", raw="We measured it"), 5, 0, 0),
]


@pytest.fixture(scope="module")
def evaluated(spark):
    docs = spark.createDataFrame([d for _, d, *_ in CASES] + [("null", *[None] * 8)], DOC)
    return {r["id"]: r for r in rules.dimension_scores(rules.evaluated(rules.prepare(docs))).collect()}


@pytest.mark.parametrize(("rule", "document", "score", "issues", "suggestions"), CASES, ids=[f"{c[0]}-{c[1][0]}" for c in CASES])
def test_rules(evaluated, rule, document, score, issues, suggestions):
    r = evaluated[document[0]]["r_" + rule.replace("-", "_")]
    assert (r["score"], r["issues"], r["suggestions"]) == (score, issues, suggestions)


def test_a_document_of_nulls_has_scores(evaluated):
    assert evaluated["null"]["total"] is not None


def test_registry():
    with pytest.raises(ValueError):
        rules.register(rules.Rule("faq-presence", "structure", 0, rules.no_score))
    assert sum(r.weight for r in rules.REGISTRY) == 100


@pytest.mark.parametrize(
    ("text", "agent", "expected"),
    [
        ("User-agent: *\nDisallow: /a # x\nAllow: /a/b", "bot", [("allow", "/a/b"), ("disallow", "/a")]),
        ("User-agent: bo\nDisallow: /1\nUser-agent: bot\nDisallow: /2\nUser-agent: *\nDisallow: /3", "mybot", [("disallow", "/2")]),
        ("User-agent: x\nDisallow:\nUser-agent: bot\nDisallow: /j", "bot", [("disallow", "/j")]),
        ("Disallow: /before\nUser-agent: *\n", "bot", []),
        ("", "bot", []),
    ],
)
def test_robots_groups(spark, text, agent, expected):
    lines = robots.policy_lines(spark.createDataFrame([("o", text)], "origin string, text string"))
    assert sorted((r["directive"], r["pattern"]) for r in robots.selected_rules(lines, agent).collect()) == expected


def test_robots_decisions(spark):
    urls = spark.createDataFrame([("http://o.test", f"http://o.test{p}") for p in ("/a", "/a/b?x", "/c.html", "/c.html?q", "/d")] + [("http://n.test", "http://n.test/a")], "origin string, url string")
    found = spark.createDataFrame([("http://o.test", d, p) for d, p in (("disallow", "/a"), ("allow", "/a/b"), ("disallow", "/*.html$"), ("allow", ""))], "origin string, directive string, pattern string")
    got = {r["url"][13:]: r["allowed"] for r in robots.decisions(urls, found).collect() if "o.test" in r["url"]}
    assert got == {"/a": False, "/a/b?x": True, "/c.html": False, "/c.html?q": True, "/d": True}


def ts(day):
    return dt.datetime(2026, 1, day)


FINDING = "site_id int, snapshot_no int, kind string, target string, severity string, observed string, occurrences int, delivered_at timestamp, change_kind string"


def test_snapshots(spark):
    rows = [
        (1, 1, "k", "http://A.test:80/X", "w", None, 1, ts(1), "clash"),
        (1, 1, "k", "http://a.test/Y", "w", "o", 1, ts(1), None),
        (1, 1, "k", "http://a.test/Z", "w", "o", 1, ts(1), None),
        (1, 3, "k", " http://a.test/X ", "w", None, 1, ts(9), None),
        (1, 3, "k", "http://a.test/Y", "w", "o", 2, ts(3), None),
        (1, 3, "k", "http://a.test/Y", "w", "o", 1, ts(4), None),
        (1, 3, "k", "http://a.test/x", "w", "o", 1, ts(3), None),
        (1, 3, "k", "http://a.test/x", "w", "o", 1, ts(3), None),
        (1, 3, None, None, "w", "o", 1, ts(3), None),
        (1, 9, "k", "http://a.test/not-in-the-calendar", "w", "o", 1, ts(3), None),
    ]
    calendar = spark.createDataFrame([(1, 1), (1, 3), (1, 3), (1, 4), (2, 1)], "site_id int, snapshot_no int")
    changes = snapshot_changes(spark.createDataFrame(rows, FINDING), calendar)
    got = sorted((tuple(r) for r in changes.collect()), key=str)
    assert got == sorted(
        [
            (1, 3, "k", "http://a.test/Z", "removed"), (1, 3, "k", "http://a.test/x", "added"), (1, 3, None, None, "added"),
            (1, 4, "k", "http://a.test/X", "removed"), (1, 4, "k", "http://a.test/Y", "removed"), (1, 4, "k", "http://a.test/x", "removed"), (1, 4, None, None, "removed"),
        ],
        key=str,
    )
    assert sorted(tuple(r) for r in change_counts(changes).collect()) == [(1, 3, 2, 1, 0), (1, 4, 0, 4, 0)]
    empty = spark.createDataFrame([], FINDING)
    assert snapshot_changes(empty, calendar).count() == 0 and snapshot_changes(empty, calendar.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("target", "expected"),
    [(" HTTPS://A.B:443/P?Q ", "https://a.b/P?Q"), ("http://a.b:8080/", "http://a.b:8080/"), ("http://a.b:80", "http://a.b"), ("/Path", "/Path"), ("https://a.b:80/x", "https://a.b:80/x"), (None, None)],
)
def test_canonical_target(spark, target, expected):
    assert spark.createDataFrame([(target,)], "t string").select(canonical_target(F.col("t"))).collect()[0][0] == expected


def test_snapshots_of_a_hot_group(spark):
    """One site with most rows: changes equal those computed in plain Python."""
    import random

    random.seed(1)
    rows = [(1 if random.random() < 0.9 else 2, s, "k", f"/t{random.randint(0, 400)}", random.choice("ab"), None, 1, ts(s), None) for s in (1, 2, 3) for _ in range(900)]
    got = snapshot_changes(spark.createDataFrame(rows, FINDING), spark.createDataFrame([(g, s) for g in (1, 2) for s in (1, 2, 3)], "site_id int, snapshot_no int"))
    state = {}
    for g, s, k, t, sev, *_ in rows:
        state.setdefault((g, s), {}).setdefault(t, set()).add(sev)
    kinds = {tuple(r)[:2] + (tuple(r)[3],): r["change_kind"] for r in got.collect()}
    for g in (1, 2):
        for s in (2, 3):
            a, b = state[(g, s - 1)], state[(g, s)]
            assert {t for t in b if t not in a} == {k[2] for k, v in kinds.items() if k[:2] == (g, s) and v == "added"}
            assert {t for t in a if t not in b} == {k[2] for k, v in kinds.items() if k[:2] == (g, s) and v == "removed"}


FETCH = (
    "fetch_id bigint, requested_url string, final_url string, status int, redirects array<struct<from_url:string,to_url:string,status:int>>, content_type string, "
    "x_robots_tag string, html string, fetched_at timestamp, loaded_at timestamp"
)


def page(i, path, body, head="", status=200, final=None, hops=0, header=None):
    url = f"http://s.test{path}"
    html = f"<html lang=en><head><title>{path}</title>{head}</head><body>{body}</body></html>"
    return (i, url, final or url, status, [(url, url, 301)] * hops, "text/html", header, html, ts(1), ts(1))


@pytest.fixture(scope="module")
def pages(spark):
    canonical = "<link rel=canonical href='http://s.test{}'>"
    rows = [
        page(1, "/", "<a href=/b>b</a><a href=/gone>g</a><a href='http://o.test/'>o</a><a href=/cdn-cgi/l/email-protection#x>m</a>", canonical.format("/")),
        page(2, "/b", "<a href=/b#self>s</a><a href=/unknown>u</a>", canonical.format("/")),
        page(3, "/gone", "", status=404),
        page(4, "/c", "", canonical.format("/c") + canonical.format("/d")),
        page(5, "/n", "", canonical.format("/n") + "<meta name=robots content='noindex'>"),
        page(6, "/t", "", "<title>/</title>".replace("/", "/", 1)),
        page(7, "/r", "", hops=2),
        page(8, "/n2", "", canonical.format("/n")),
    ]
    parsed = parsed_pages(spark.createDataFrame(rows + rows[:1], FETCH))
    return latest(parsed, *[c for c in parsed.columns if c not in ("fetch_id", "html")]).cache()


def test_site_relations(spark, pages):
    edges, lookup = site.link_edges(pages), site.page_lookup(pages)
    of = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert of(site.link_counts(edges), "src", "n_internal", "n_external")[0] == ("http://s.test/", 2, 1)
    assert of(site.broken_targets(edges, lookup), "url") == [("http://s.test/gone",)]
    closed = lambda *urls: spark.createDataFrame([(u,) for u in urls], "url string")
    assert of(site.unchecked_targets(edges, lookup, closed()), "url") == [("http://s.test/unknown",)]
    assert of(site.unchecked_targets(edges, lookup, closed("http://s.test/unknown")), "url") == []
    assert of(site.verified_canonicals(pages, lookup), "final", "target") == [("http://s.test/", "http://s.test/"), ("http://s.test/b", "http://s.test/")]
    kinds = of(site.canonical_findings(pages, lookup), "kind", "target")
    assert ("malformed-canonical", "http://s.test/c") in kinds and ("missing-canonical", "http://s.test/t") in kinds
    assert ("non-self-canonical", "http://s.test/n2 -> http://s.test/n") in kinds and ("shared-canonical", "http://s.test/n") in kinds
    assert not any(k == "shared-canonical" and t == "http://s.test/" for k, t in kinds)
    listed = spark.createDataFrame([("http://s.test", u) for u in ("http://s.test/", "http://s.test/b", "http://s.test/lonely")], "origin string, url string")
    starts = spark.createDataFrame([("http://s.test/",)], "url string")
    assert of(site.orphan_candidates(edges, listed, starts, closed()), "url") == [("http://s.test/lonely",)]
    assert of(site.orphan_candidates(edges, listed, starts, closed("http://s.test/lonely")), "url") == []
    assert of(site.queued(edges, lookup, listed, closed()), "url") == [("http://s.test/lonely",), ("http://s.test/unknown",)]
    gone = spark.createDataFrame([("http://s.test", "http://s.test/gone")], "origin string, url string")
    assert of(site.sitemap_pages(lookup, gone), "url", "kind") == [("http://s.test/gone", "broken")]
    assert of(site.discovered_from(edges, pages), "url", "source") == [("http://s.test/b", "http://s.test/"), ("http://s.test/b", "http://s.test/b"), ("http://s.test/gone", "http://s.test/")]
    maps = spark.createDataFrame([("http://s.test", "a", 500, "unknown"), ("http://s.test", "b", 0, "unknown"), ("http://s.test", "c", 404, "unknown"), ("http://s.test", "d", 200, "unknown"), ("http://s.test", "e", 200, "urlset")], "origin string, url string, status int, kind string")
    assert of(site.sitemap_classes(maps), "url", "class") == [("a", "failed"), ("b", "unavailable"), ("d", "invalid")]
    answers = spark.createDataFrame([("http://s.test", 200), ("http://empty.test", 404)], "origin string, status int")
    checks = {(r["origin"][7:8], r["check_id"]): (r["status"], r["evidence"]) for r in site.site_checks(pages, listed, starts, answers, maps, lambda urls: closed()).collect()}
    assert len(checks) == 18 and checks["s", "internal-link-targets"] == ("FAIL", "targets 3, broken 1, unchecked 1")
    assert checks["s", "crawl-coverage"] == ("WARNING", "pages 8, queued 2") and checks["e", "crawl-coverage"][0] == "FAIL" and checks["e", "robots-policy"][0] == "N/A"
    assert checks["s", "site-http-status"][0] == "FAIL" and checks["s", "redirect-chains"][0] == "WARNING" and checks["s", "sitemap-consistency"][0] == "FAIL" and checks["e", "duplicate-titles"][0] == "N/A"
    omitted = of(site.sitemap_omissions(pages, lookup, listed), "url")
    assert ("http://s.test/n",) not in omitted and ("http://s.test/r",) in omitted and ("http://s.test/b",) not in omitted
    assert {r["kind"] for r in site.site_findings(pages, listed, starts, lambda urls: closed()).collect()} <= set(site.KINDS)


def crawled(edges, starts, entries, denied, most):
    """The order of a crawl of one site, address by address."""
    links, order, queue, closed = {}, [], [], set(denied)
    for src, dst in edges:
        links.setdefault(src, set()).add(dst)
    seen, listed = set(), list(entries)
    queue = list(starts)
    while len(order) < most and (queue or listed):
        url = queue.pop(0) if queue else listed.pop(0)
        if url in seen or url in closed:
            continue
        seen.add(url)
        order.append(url)
        queue.extend(sorted(links.get(url, ())))
    return order


def test_crawl_order_against_a_crawl_address_by_address(spark):
    import random

    rnd = random.Random(5)
    edges, starts, entries, denied, want = [], [], [], [], {}
    for n in range(12):
        urls = [f"http://s{n}.test/{i:02}" for i in range(25)]
        links = {(rnd.choice(urls), rnd.choice(urls)) for _ in range(rnd.choice((0, 10, 40)))}
        listed = rnd.sample(urls, rnd.randint(0, 20))
        shut = rnd.sample(urls, 3)
        edges += [(f"o{n}", s, d, True) for s, d in links] + [(f"o{n}", urls[0], "http://else.test/", False)]
        starts.append((f"o{n}", urls[0]))
        entries += [(f"o{n}", u, i) for i, u in enumerate(listed)]
        denied += [(u,) for u in shut]
        want[f"o{n}"] = crawled(links, urls[:1], listed, shut, 14)
    frames = (
        spark.createDataFrame(edges + edges[:5], "origin string, src string, dst string, internal boolean"), spark.createDataFrame(starts, "origin string, url string"),
        spark.createDataFrame(entries, "origin string, url string, pos bigint"), spark.createDataFrame(denied, "url string"),
    )
    order = crawl.crawl_order(*frames, most=14)
    got = {}
    for r in sorted(order.collect(), key=lambda r: r["place"]):
        got.setdefault(r["origin"], []).append(r["url"])
    assert got == {k: v for k, v in want.items() if v}
    rest = {r["origin"]: (r["crawled"], r["truncated"]) for r in crawl.crawl_rest(order, frames[0], frames[2], frames[3]).collect()}
    assert all(rest[k][0] == len(v) for k, v in want.items() if v) and any(t for _, t in rest.values()) and not all(t for _, t in rest.values())
    with pytest.raises(ValueError):
        crawl.crawl_order(*frames, most=201)


def test_ledger_refuses_what_it_cannot_keep(spark):
    fields = ", ".join(f"{c} {'double' if c in ('position', 'clicks', 'impressions') else 'string'}" for c in ledger.IDENTITY)
    good = ("2026-02-03T04:05:06Z", "search", "  Some  Words ", "/p", None, 1.0, 2.5, "2026-01-01", "2026-01-31", "US", "mobile", None)
    change = lambda i, v: (*good[:i], v, *good[i + 1 :])
    rows = spark.createDataFrame([good, good, change(0, "x"), change(2, " "), change(5, -1.0), change(7, "2026-02-31"), change(8, "2025-01-01"), change(3, "/q")], fields)
    none = spark.createDataFrame([], "observation_id string")
    accepted, refused = ledger.record_observations(rows, none)
    import hashlib

    text = '{"observedAt":"2026-02-03T04:05:06.000Z","source":"search","keyword":"Some Words","targetPath":"/p","position":null,"clicks":1,"impressions":2.5,"startDate":"2026-01-01","endDate":"2026-01-31","country":"US","device":"mobile","searchType":"web"}'
    ids = {r["targetPath"]: r["observation_id"] for r in accepted.collect()}
    assert len(ids) == 2 and ids["/p"] == hashlib.sha256(text.encode()).hexdigest()[:16]
    assert sorted(r["reason"] for r in refused.collect()) == ["date", "date-order", "empty-text", "number", "timestamp"]
    again, known = ledger.record_observations(rows, accepted.select("observation_id"))
    assert again.count() == 0 and [r["reason"] for r in known.where("reason = 'known'").collect()] == ["known"] * 3


def test_readiness_gate_and_evidence(spark):
    report = "k int, scoring_version string, page_urls array<string>, report_ts timestamp"
    after = spark.createDataFrame([(1, "v", ["/a", "/b"], ts(5)), (2, None, [], ts(5)), (3, "v", ["/a"], ts(1))], report)
    before = spark.createDataFrame([(1, "v", ["/b", "/a"], ts(4)), (2, None, ["/a"], ts(4)), (3, "v", ["/a", "/a"], ts(4))], report)
    gate = compare.readiness_gate(after, before, "k")
    assert {r["k"]: r["reasons"] for r in gate.collect()} == {1: [], 2: ["scoring-version", "no-pages", "page-set"], 3: ["page-set", "baseline-newer"]}
    pages = lambda *rows: spark.createDataFrame(rows, "k int, url string, total int")
    pairs = compare.page_pairs(gate, pages((1, "/a", 7), (3, "/a", 1)), pages((1, "/a", 4), (1, "/z", 4), (3, "/a", 1)), "k")
    assert [tuple(r) for r in pairs.collect()] == [(1, "/a", 7, 4, 3)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('x {"score": 81.5, "structure": 30, "schema": "4", "aiMetadata": [], "insight": 7} y', (82, 25, 4, None, "7")),
        ('{"a": {"score": 5}}', (5, 0, 0, 0, "No insight provided")),
        ('{"dims": {"structure": 2}, "score": 5}', None),
        ('{"score": "5"}', None),
        ('{"score": 5', None),
        ("nothing", None),
        (None, None),
    ],
)
def test_reviews(text, want):
    from pagegauge.functions.reviews import read_review

    got = read_review(text)
    assert (got and (got["score"], got["structure"], got["schema"], got["aiMetadata"], got["insight"])) == want


def test_a_response_of_any_length_is_parsed(spark):
    rows = [page(1, "/long", "<p>" + "x" * (5 * 1024 * 1024) + "</p><a href=/last>l</a>")]
    parsed = parsed_pages(spark.createDataFrame(rows, FETCH))
    assert [r["dst"] for r in site.link_edges(parsed).select("dst").collect()] == ["http://s.test/last"]


def test_translations_share_a_title(spark):
    def lang(i, path, code, others):
        head = "".join(f"<link rel=alternate hreflang={c} href='http://s.test{p}'>" for c, p in others)
        url = f"http://s.test{path}"
        return (i, url, url, 200, [], "text/html", None, f"<html lang={code}><head><title>Same</title>{head}</head></html>", ts(1), ts(1))

    def titles(rows):
        p = parsed_pages(spark.createDataFrame(rows, FETCH))
        return site.duplicate_titles(p, site.page_lookup(p)).count()

    assert titles([lang(1, "/en", "en", [("de", "/de")]), lang(2, "/de", "de", [("en", "/en")])]) == 0
    assert titles([lang(1, "/en", "en", [("de", "/de")]), lang(2, "/de", "de", [])]) == 1
    assert titles([lang(1, "/en", "en", [("de", "/de")]), lang(2, "/de", "de", [("en", "/en")]), lang(3, "/fr", "fr", [])]) == 1


def test_documents_without_http(spark):
    from pagegauge.functions.documents import parsed_html, parsed_markdown

    rows = spark.createDataFrame([(1, "markdown", "# T\n\n[a](/b)", None), (2, "markdown", "---\ntitle: 'T'\ndescription: d\ncanonical: /x\nlang: en\n---\ntext", None), (3, "html", "<p>x", None),
                                  (4, "html", "<link rel=canonical href=/x><title>t</title>", "http://s.test/x"), (5, "html", "<link rel=canonical href='http://s.test/x'>", None)], "i int, rendering string, text string, base string")
    docs = rows.where("rendering = 'html'").withColumn("doc", parsed_html("text")).unionByName(rows.where("rendering = 'markdown'").withColumn("doc", parsed_markdown("text")))
    r = {x["i"]: x for x in audit.document_checks(docs).collect()}
    assert (r[1]["document_title"], r[1]["meta_description"], r[1]["document_language"], r[1]["canonical_link"], r[1]["http_status"]) == ("PASS", "N/A", "N/A", "N/A", "N/A")
    assert (r[2]["document_title"], r[2]["meta_description"], r[2]["document_language"], r[2]["canonical_link"]) == ("PASS", "PASS", "PASS", "N/A")
    assert (r[3]["document_title"], r[3]["meta_description"], r[3]["canonical_link"]) == ("FAIL", "WARNING", "WARNING")
    assert (r[4]["canonical_link"], r[5]["canonical_link"]) == ("PASS", "WARNING")


def test_audits(pages):
    r = {x["fetch_id"]: x for x in audit.page_checks(pages).collect()}
    assert (r[1]["canonical_link"], r[2]["canonical_link"], r[4]["canonical_link"], r[6]["canonical_link"]) == ("PASS", "WARNING", "FAIL", "WARNING")
    assert (r[5]["robots_directives"], r[1]["robots_directives"], r[1]["image_alternatives"], r[4]["link_discovery"]) == ("WARNING", "PASS", "N/A", "WARNING")
    b = {x["fetch_id"]: x for x in audit.build_checks(pages, expect_indexable=True).collect()}
    assert (b[5]["b_indexing_directives"], b[4]["b_canonical"], b[1]["b_canonical"], b[6]["b_document_title"]) == ("FAIL", "FAIL", "PASS", "WARNING")


def test_redirect_loops_end(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "from_url string, to_url string")
    got = {r["start_url"]: (r["final_url"], r["n_hops"]) for r in crawl.follow_redirects(hops).collect()}
    assert got["a"] == ("c", 2) and got["x"][1] == 10


def test_ledger(spark):
    rows = spark.createDataFrame([(1, "q", ts(1), 5), (2, "q", ts(2), 6), (3, "q", ts(2), 7)], "seq bigint, query string, observed_at timestamp, position int")
    assert ledger.latest_observations(rows, "query").collect()[0]["seq"] == 2
    checked = spark.createDataFrame([("2026-02-30",), ("2026-02-28",), ("x",)], "d string").select(ledger.is_date(F.col("d"))).collect()
    assert [r[0] for r in checked] == [False, True, False]


def test_blend_without_reviews_keeps_the_rules(spark):
    dims = {d: 5 for d in rules.DIMENSIONS}
    base = spark.createDataFrame([(1, *dims.values(), 25)], "k int, " + ", ".join(f"{d} int" for d in dims) + ", total int")
    reviews = spark.createDataFrame([(1, "s", False, 90, *dims.values())], "k int, source string, available boolean, score int, " + ", ".join(f"{d} int" for d in dims))
    row = compare.blended(base, reviews, "k").collect()[0]
    assert (row["consensus"], row["structure"], row["n_reviews"]) == (25, 5, 0)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", ts(1)), ("a", ts(1)), ("b", ts(2))], "observation_id string, observed_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("once", distinct_observations(stream)), ("counts", windowed_counts(stream))):
        mode = "append" if name == "once" else "update"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("once").count() == 2 and spark.table("counts").agg(F.sum("n")).collect()[0][0] == 3


def test_ledger_files(spark, tmp_path):
    from pagegauge.sources import ledger_files

    folder = str(tmp_path / "ledger")
    ledger_files.create_ledger(folder)
    with pytest.raises(FileExistsError):
        ledger_files.create_ledger(folder)
    parts = ledger_files.read_ledger(spark, folder)
    assert {k: v.count() for k, v in parts.items()} == {"queries": 0, "observations": 0, "experiments": 0}
    rows = spark.createDataFrame([("a b", "/p", "high", "eligible", None)], parts["queries"].schema)
    ledger_files.save_ledger({**parts, "queries": rows}, folder)
    assert [tuple(r) for r in ledger_files.read_ledger(spark, folder)["queries"].collect()] == [("a b", "/p", "high", "eligible", None)]
    (tmp_path / "ledger" / "queries.json").write_text('{"version": "9", "queries": []}')
    with pytest.raises(ValueError):
        ledger_files.read_ledger(spark, folder)


def test_report_violations(spark, tmp_path):
    import json

    from pagegauge.sources import reports

    scores = {"structure": 20, "citability": 10, "schema": 10, "aiMetadata": 5, "contentDensity": 5, "total": 50}
    good = {"scoringVersion": reports.SCORING_VERSIONS[0], "timestamp": "2026-01-01T00:00:00Z", "overall": scores, "pages": [{"url": "/a", "title": "A", "scores": scores, "ruleResults": [{"id": "r", "score": 1, "maxScore": 2, "issues": []}]}]}
    page = good["pages"][0]
    bad = {**good, "scoringVersion": "x", "timestamp": "soon", "pages": [
        {**page, "ruleResults": [{"id": "r", "score": 3, "maxScore": 2, "issues": [{"message": "m", "severity": "bad"}]}] * 2, "sourcePreview": {"text": "t", "truncated": False, "format": "html", "capture": "markdown"}}, {**page}]}
    for name, report in (("good", good), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(report))
    found = lambda name: {r["violation"] for r in reports.scan_violations(reports.read_scan_reports(spark, str(tmp_path / f"{name}.json"))).collect()}
    assert found("good") == set()
    assert found("bad") == {"version", "timestamp", "repeated-url", "rule-score", "rule-issue", "rule-repeated", "preview"}
    site_good = {"contractVersion": "1.0", "metricEvidenceVersion": "1.1", "startUrl": "http://s.test/", "origin": "http://s.test", "maxPages": 20, "crawledPages": 1, "truncated": False, "timestamp": "2026-01-01T00:00:00Z",
                 "pages": [{"requestedUrl": "http://s.test/", "status": 200}], "findings": [{"kind": "http-error", "target": "x"}], "checks": [{"id": "a", "status": "PASS"}]}
    site_bad = {**site_good, "metricEvidenceVersion": "2", "origin": "s", "maxPages": 900, "pages": [{"requestedUrl": "http://s.test/", "status": 20}], "findings": [{"kind": "odd", "target": "x"}], "checks": [{"id": "a", "status": "OK"}, {"id": "a", "status": "PASS"}]}
    for name, report in (("site_good", site_good), ("site_bad", site_bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(report))
    seen = lambda name: {r["violation"] for r in reports.site_violations(reports.read_site_reports(spark, str(tmp_path / f"{name}.json"))).collect()}
    assert seen("site_good") == set() and seen("site_bad") == {"version", "address", "limit-range", "status", "finding", "check", "check-status"}


def test_files_and_scan_summary(spark, tmp_path):
    from pagegauge import cli, report
    from pagegauge.sources import files

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "up").symlink_to(tmp_path)
    (tmp_path / "sub" / "a.md").write_text("# T\n\ntext")
    assert files.scan(str(tmp_path)) == [str(tmp_path / "sub" / "a.md")]
    assert files.single_page(str(tmp_path / "sub" / "a.md")) and pytest.raises(ValueError, files.single_page, str(tmp_path / "sub"))
    summary = cli.scan_summary(cli.scanned(spark, str(tmp_path)))
    assert summary["pageCount"] == 1 and summary["overall"]["total"] == sum(v for k, v in summary["overall"].items() if k != "total")
    assert cli.scan_summary(cli.scanned(spark, str(tmp_path)).limit(0)) == {"pageCount": 0, "overall": {k: 0 for k in summary["overall"]}}
    assert report.preview_markup("<b>" * 3000).count("&lt;b&gt;") == 2000 and "9000 characters" in report.preview_markup("<b>" * 3000)
    rows = report.rule_rows([{"id": "b", "score": 5, "max_score": 5, "issues": [], "suggestions": []}, {"id": "a<", "score": 1, "max_score": 5, "issues": ["x"], "suggestions": ["y", "z"]}])
    assert rows.index("a&lt;") < rows.index(">b<") and "y; z" in rows


def test_corrections_without_a_time_or_at_the_same_time_do_not_depend_on_the_order(spark):
    schema = "site_id int, snapshot_no int, kind string, target string, severity string, observed string, occurrences int, delivered_at timestamp"
    row = lambda s, n, at, target="x": (1, n, "k", target, s, None, None, at)
    rows = [row("a", 1, ts(1)), row("a", 2, None), row("b", 2, None), row("a", 3, ts(3)), row("b", 3, ts(3)), row("a", 3, ts(2)), row("z", 3, None), row("a", 1, None, None), row("a", 2, ts(1), None), row("b", 3, ts(1), None)]
    calendar = spark.createDataFrame([(1, n) for n in (1, 2, 3)], "site_id int, snapshot_no int")
    got = {tuple(sorted(map(repr, snapshot_changes(spark.createDataFrame(part, schema).repartition(n), calendar).collect()))) for n in (1, 3) for part in (rows, rows[::-1])}
    assert len(got) == 1
    changed = {(r["snapshot_no"], r["target"]): r["change_kind"] for r in snapshot_changes(spark.createDataFrame(rows, schema), calendar).collect()}
    assert (2, None) not in changed and changed[3, None] == "changed"

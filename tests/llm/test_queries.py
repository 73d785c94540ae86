"""The llm operators on small tables with nulls, repeats, ties, empty tables and extra columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagegauge.llm import confusables, mainbody, mixing, queries, quality, repetition, residue, tokenise, wrappers

DOC = "fixture_id bigint, url string, html string, markdown string, headings array<struct<level:int,text:string>>, text string"


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    words = spark.createDataFrame([("en", w) for w in "the a of and is to in on for with it was that this".split()], "lang string, word string")
    rep = "The cat is in the house of the old king. " * 6
    docs = spark.createDataFrame(
        [
            (1, "http://a.test/1", "<html><body><h1>One</h1><p>" + rep + "</p></body></html>", "# One\n\nThe cat is in the house.", [(1, "# One")], "x"),
            (1, "http://a.test/1", "<html><body><h1>One</h1><p>" + rep + "</p></body></html>", "# One\n\nThe cat is in the house.", [(1, "# One")], "x"),
            (2, None, "", "a,b\n1,2\n3,4", [], "x"),
            (3, "http://a.test/3", "<p>The dog was in the garden of a friend today.</p>", None, None, "x"),
            (None, None, None, None, None, None),
        ],
        DOC,
    )
    fetches = spark.createDataFrame(
        [
            (1, "<html><body><main><h1>A title</h1><p>" + "The first paragraph of this page is long enough. " * 2 + "</p></main></body></html>", "x"),
            (2, "<html><body><p>Please enable JavaScript to view this page.</p></body></html>", "x"),
            (3, "", "x"),
            (4, None, "x"),
            (1, "<html><body><main><h1>A title</h1><p>" + "The first paragraph of this page is long enough. " * 2 + "</p></main></body></html>", "x"),
        ],
        "fetch_id bigint, html string, label string",
    )
    issues = spark.createDataFrame([(1, "The page is closed to the team today."), (2, "{\"a\": 1}"), (3, ""), (4, None), (2, "{\"a\": 1}")], "issue_id bigint, message string")
    texts = [(1, "ab", "s"), (2, "аb", "s"), (3, None, "s"), (4, "", "t"), (5, "ab", None), (6, "long text " * 3000, "t"), (7, "one two three", "t"), (8, "four five", "zzz")]
    documents = spark.createDataFrame([(i, t, s, None if t is None else len(t)) for i, t, s in texts], "doc_id bigint, text string, source string, n_chars int")
    targets = spark.createDataFrame([("s", 0.5, 3), ("t", 0.5, 1), ("none", 0.2, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    return write(spark, tmp_path_factory.mktemp("data"), common_words=words, fixture_docs=docs, fetches=fetches, issues=issues, documents=documents, mix_targets=targets)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_runs_on_edge_cases(spark, folder, name):
    queries.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_runs_on_empty_tables(spark, folder, tmp_path, name):
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet").limit(0) for n in ("common_words", "fixture_docs", "fetches", "issues", "documents", "mix_targets")}
    df = queries.QUERIES[name](spark, write(spark, tmp_path, **tables))
    assert name == "p8_shares" or df.count() == 0


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_found_rows(spark, folder):
    run = lambda name: rows(queries.QUERIES[name](spark, folder))
    assert run("p1_found") == [(1, "headings", "heading", "One"), (1, "html", "heading", "One"), (1, "markdown", "heading", "One")]
    assert run("p2_found") == [(2,)]
    assert run("p3_found") == [("fixture_docs", 2), ("issues", 2)]
    assert run("p4_found") == [(1, "html")]
    assert run("p5_found") == [
        ("fetches", 1, "The first paragraph of this page is long"), ("fixture_docs", 1, "The cat is in the house of the old king."),
    ]
    assert run("p9_found") == [(1, 2), (2, 5)]
    ids = dict(run("p7_ids"))
    assert ids[3] == [] and ids[4] == [] and len(ids) == 8


def test_markdown_is_left_out_by_the_model_of_p3(spark, folder, monkeypatch):
    flat = [[[1 / n] * n for n in quality.SIZES] for _ in quality.STATES]
    monkeypatch.setattr(quality, "fit_line_model", lambda texts, common: quality.LineModel(common, [0.01, 0.01, 0.01, 0.97], None, flat))
    run = lambda name: rows(queries.QUERIES[name](spark, folder))
    assert ("fixture_docs", 1) in run("p3_found")
    assert (1, "markdown", "heading", "One") not in run("p1_found")
    assert "markdown" not in {r[1] for r in run("p4_shares")}


def test_the_fitted_line_model_explains_other_texts_better(spark):
    import numpy as np

    common = frozenset("the a of and is to in on for with it was that this".split())
    prose = [f"The garden of house {i} is open to the town. It was closed in the winter of the year {i}.\nThis is a note on it." for i in range(40)]
    tables = [f"a{i} | b{i} | {i}\nc{i} | d{i} | {i + 1}" for i in range(40)]
    salad = ["Iron green seven walk lamp river often blue stone table."] * 3
    texts = [("fixture_docs", t) for t in (prose + tables + salad)]
    fit = lambda rows_: quality.fit_line_model(spark.createDataFrame(rows_, "src_table string, text string"), common)
    one, held = texts[::2], texts[1::2]
    sequences = [np.array(quality.line_codes(quality.judged_lines(t), common)) for _, t in held]
    value = lambda model: quality.posterior_counts(sequences, np.ones(len(sequences)), model)[3]
    fitted = fit(one)
    assert value(fitted) > value(quality.LineModel(common)) + 20
    assert fitted.emit[0][0][3:] == [0.0, 0.0] and all(abs(sum(f) - 1) < 1e-9 for s in fitted.emit for f in s)
    assert [quality.is_not_prose(t, fitted) for t in (prose[1], tables[1], salad[0])] == [False, True, True]
    assert fit(one * 2).emit != fitted.emit and fit([]).emit == quality.LineModel(common).emit


def test_look_alike_pairs_against_brute_force(spark):
    texts = ["cop", "сор", "cоp", "cop", "Cop", "c op", "cop​", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("form", F.lit(1))
    form = confusables.LookAlikes(confusables.load_look_alikes(spark)).form
    want = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and form(a) == form(b)]
    assert rows(confusables.look_alike_pairs(df)) == want
    classes = {r.doc_id: (r.class_id, r.n_links) for r in confusables.look_alike_classes(df).collect()}
    assert classes == {i: (0, 3) for i in (0, 1, 2, 3, 6)}


def test_mix_reaches_the_targets_within_the_caps(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (1 + i % 7), "abc"[i % 3]) for i in range(600)] + [(9999, "x y", None)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    used, report = mixing.hard_mix(docs, targets)
    for r in report.collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.01 and r["most_copies"] <= r["max_repeats"]
    assert used.where("source IS NULL").count() == 0 and used.groupBy("doc_id").count().where("count > 1").count() == 0
    soft, shares = mixing.soft_rates(docs, targets)
    assert soft.count() == 601 and soft.agg(F.min("rate")).collect()[0][0] >= 0


def test_soft_mix_stays_within_the_caps_of_each_documents_source(spark):
    shapes = {"log": "2025-01-0{0} INFO x{0}\n2025-01-0{0} WARN y", "doc": "# Title {0}\n\nSome words here.", "chat": "user{0} wrote:\nhello there", "none": "key={0}; key={0}"}
    docs = spark.createDataFrame([(i, t.format(i % 9), s) for i, (s, t) in enumerate(list(shapes.items()) * 90)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("log", 0.6, 2), ("doc", 0.3, 1), ("chat", 0.1, 1)], "source string, target_share double, max_repeats int")
    soft, shares = mixing.soft_rates(docs, targets)
    most = {"log": 2.0, "doc": 1.0, "chat": 1.0, "none": 0.0}
    assert all(0 <= r["rate"] <= most[r["source"]] for r in soft.collect())
    for r in shares.collect():
        assert r["fit_error"] < mixing.TOLERANCE and abs(r["expected_share"] - r["target_share"]) < 0.002 and abs(r["actual_share"] - r["target_share"]) < 0.02
    # posteriors that cannot tell the domains apart cannot reach the targets: the report says so
    same = spark.createDataFrame([(i, "same", "ab"[i % 2]) for i in range(40)], "doc_id bigint, text string, source string")
    two = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    assert all(r["fit_error"] > mixing.TOLERANCE for r in mixing.soft_rates(same, two)[1].collect())


def test_classifier_holds_out(spark):
    shapes = {"log": "2025-01-0{0} INFO x{0}\n2025-01-0{0} WARN y", "doc": "# Title {0}\n\nSome words here.", "chat": "user{0} wrote:\nhello there"}
    rows_ = [(i, t.format(i % 9), s) for i, (s, t) in enumerate(list(shapes.items()) * 60)]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string, source string")
    model = mixing.fit_classifier(docs.where("doc_id % 4 <> 0"), sorted(shapes))
    import numpy as np

    scores = model.scores([t for _, t, _ in rows_[::4]])
    assert np.mean([model.domains[g] == s for g, (_, _, s) in zip(model.posteriors(scores).argmax(axis=1), rows_[::4])]) > 0.95
    alone = np.concatenate([model.scores([t]) for _, t, _ in rows_[::4]])
    assert np.allclose(scores, alone)


def test_kneser_ney_is_a_distribution_and_prefers_what_it_saw(spark):
    docs = spark.createDataFrame([(i, None, "the cat sat on the mat . the dog sat on the rug") for i in range(5)], "fixture_id bigint, html string, markdown string")
    common = {"en": frozenset(["the", "on"])}
    model = repetition.fit_kneser_ney(docs, common)
    score = lambda text: repetition.perplexities(spark.createDataFrame([(1, None, text)], "fixture_id bigint, html string, markdown string"), common, model).collect()[0]["perplexity"]
    assert score("the cat sat on the mat") < score("mat the on sat cat the") < score("zzz yyy xxx www the")
    assert all(p <= 1e-6 for p in model.log_p[model.log_p == model.log_p])


def test_rare_grams_leave_their_share_to_the_back_off(spark):
    import numpy as np

    texts = ["the cat sat on the mat", "the cat sat on the rug", "the cat ran off", "the dog sat down", "on the cat sat"]
    docs = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "fixture_id bigint, html string, markdown string")
    common = {"en": frozenset(["the", "on"])}
    model = repetition.fit_kneser_ney(docs, common)
    hashes = repetition.WordHashes()
    known = sorted({w for t in texts for w in t.split()})
    ends = [hashes.words("en", [w])[2] for w in [*known, "unseen"]] + [hashes.words("en", [])[-1]]
    for before in (["the", "cat"], ["cat", "sat"], ["on", "the"], ["the", "zzz"]):
        a, b = hashes.words("en", before)[2:4]
        grams = [np.concatenate(x) for x in zip(*(hashes.grams([np.array([a, b, e], dtype=np.uint64)]) for e in ends))]
        logs = model.log_probabilities(np.full(len(ends), model.unknown["en"]), *(g.view(np.int64) for g in grams[1:]))
        assert abs(np.exp(logs).sum() - 1) < 1e-6


def test_joined_perplexities_are_those_of_the_model_in_memory(spark):
    texts = ["the cat sat on the mat", "the cat sat on the rug", "the cat ran off", "the dog sat down", "on the cat sat", "the the the", "zzz"]
    docs = spark.createDataFrame([(i % 6, f"<p>{t}</p>" if i % 2 else None, t) for i, t in enumerate(texts + texts[:2])] + [(None, None, "the end")], "fixture_id bigint, html string, markdown string")
    common = {"en": frozenset(["the", "on"])}
    want = repetition.perplexities(docs, common, repetition.fit_kneser_ney(docs, common)).distinct()
    got = repetition.corpus_perplexities(docs, common).distinct()
    assert [r[:4] for r in rows(got)] == [r[:4] for r in rows(want)]
    assert all(abs(a[4] - b[4]) <= 2e-4 for a, b in zip(rows(got), rows(want)))


def test_fitted_line_model_keeps_the_labels(spark):
    texts = spark.createDataFrame([("fixture_docs", "The house is in the garden of a king.\n- red\n- blue\n1 | 2 | 3")] * 20, "src_table string, text string")
    common = frozenset("the is in of a".split())
    model = quality.fit_line_model(texts, common)
    assert not quality.is_not_prose("The house is in the garden of a king.", model)
    assert abs(sum(model.start) - 1) < 1e-9 and all(abs(sum(r) - 1) < 1e-9 for r in model.move)


FIELDS = "url string, html string, markdown string, headings array<struct<level:int,text:string>>"


def test_wrappers_of_a_hot_host(spark):
    pages = [(f"http://h.test/{i}", f"<html><body><nav>m</nav><p>t{i}</p>" + "<p>x</p>" * (i % 3) + "</body></html>", f"# T{i}\n\n- a\n- b", [(1, f"T{i}")]) for i in range(300)]
    odd = [("::", "<body>lost</body>", None, None), (None, None, "lost", []), ("http://h.test/x", None, "", None), ("http://g.test/x", "<p>one", None, [(None, None)])]
    df = spark.createDataFrame(pages + pages[:50] + odd, FIELDS)
    for parts in (1, 3, 8):
        got = {(r["host"], r["form"]): (r["n_streams"], r["wrapper"]) for r in wrappers.infer_wrappers(df.repartition(parts)).collect()}
        assert got == {
            ("h.test", "page"): (300, '<html><body><nav>"m"</nav>(<p>SLOT</p>)+</body></html>'), ("h.test", "markdown"): (300, "<#>SLOT</#>(<->SLOT</->)+"),
            ("h.test", "headings"): (300, "<h1>SLOT</h1>"), ("g.test", "fragment"): (1, '<p>"one"</p>'), ("g.test", "headings"): (1, "<h></h>"),
            (None, "page"): (1, None), (None, "markdown"): (1, None),
        }


def test_wrappers_read_whole_pages_at_any_depth(spark):
    deep = [(f"http://h.test/{i}", "<body>" + "<div>" * 3000 + "w" * 500 + str(i), None, None) for i in range(2)]
    got = wrappers.infer_wrappers(spark.createDataFrame(deep, FIELDS)).first()
    assert got["wrapper"].count("<div>") == 3000 and got["n_slots"] == 1


def test_terms_of_every_page_are_counted(spark):
    pages = spark.createDataFrame([(1, "<p>Lorem ipsum</p>"), (2, "<p class='ipsum'>lorem</p>"), (3, None), (4, "<p>The cat sat there.</p>")], "fetch_id bigint, html string")
    scanned, index = residue.scan(pages)
    assert sorted(r["fetch_id"] for r in scanned.collect()) == [1, 2]
    want = residue.ExemplarIndex(residue.EXEMPLARS, {"lorem": 2, "ipsum": 1, "there": 1, "the": 1}, 3)
    assert index.weight["lorem"] == want.weight["lorem"] and index.weight["ipsum"] == want.weight["ipsum"] and index.unknown == want.unknown


def test_long_and_odd_inputs(spark):
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long), (2, "x" * 300_000)], "doc_id bigint, text string")
    assert [r["ids"][:1] != [] for r in tokenise.token_ids(docs).collect()] == [True, True]
    page = spark.createDataFrame([(1, "<body>" + "<div>" * 3000 + "deep" + "</div>" * 3000)], "fetch_id bigint, html string")
    assert "deep" in mainbody.rendered_pages(page, "fetches", "fetch_id", True).first()["rendered_text"]

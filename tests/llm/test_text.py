"""Pure functions of the llm operators, against examples and brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagegauge.llm import confusables, markup, mixing, quality, render, repetition, residue, tokenise, wrappers

MODEL = quality.LineModel(frozenset("the a of and is to in on for with it was that this la le de der die das el que".split()))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("# A *b* `c*d` #", [("heading", "A b c*d")]),
        ("Title\n=====\n\ntext", [("heading", "Title")]),
        ("- one [two](/x \"t\")\n- **three**\nfour\n", [("list_item", "one two"), ("list_item", "three four")]),
        ("1) a_b_c\n2) _d_", [("list_item", "a_b_c"), ("list_item", "d")]),
        ("```py\nx = 1\n# no\n```\n", [("code", "x = 1 # no")]),
        ("~~~~\n- no item", [("code", "- no item")]),
        ("$$\nx^2\n$$\n\nand \\(y\\) or $z_1$ but $5 to $6.", [("formula", "x^2"), ("formula", "y"), ("formula", "z_1")]),
        ("== A ''b'' ==\n*x\n* [[p|y]]\n[[Category:Z]]", [("heading", "A b"), ("list_item", "x"), ("list_item", "y")]),
        ("\\section*{A \\& \\textbf{b}}\\label{s}\n\\begin{itemize}\n  \\item c~\\cite{k}\n\\end{itemize}\n% no", [("heading", "A & b"), ("list_item", "c")]),
        ("\\begin{verbatim}\n# x\n\\end{verbatim}\n<math>a+b</math>", [("code", "# x"), ("formula", "a+b")]),
        ("---\ntitle: x\n---\n<!-- # no -->\n<h2>A &amp; <i>b</i></h2>\n<ul><li>c<li>d</ul>", [("heading", "A & b"), ("list_item", "c"), ("list_item", "d")]),
        ("> - quoted", [("list_item", "quoted")]),
        ("12\\*3 # not a heading", []),
        ("", []),
        (None, []),
    ],
)
def test_markdown_elements(text, expected):
    assert sorted(markup.markdown_elements(text)) == sorted(expected)


def test_html_elements_and_headings():
    html = "<h1>C# &amp; <b>x</b></h1><p>In max_page_count 12*3 and 4* $$a_b$$</p><pre><code>1 &lt; 2</code></pre><script type='math/tex'>k</script>"
    assert sorted(markup.html_elements(html)) == [("code", "1 < 2"), ("formula", "a_b"), ("formula", "k"), ("heading", "C# & x")]
    assert [markup.heading_text(t) for t in ("## A `b`", "==C==", "\\section{D}", "<b>E</b> &amp; f", None, "")] == ["A b", "C", "D", "E & f", "", ""]


def test_clean_text_keeps_structure():
    assert markup.clean_text("# A\n\nb *c*\n\n- d\n\n```\ne\n```\n\n$$f$$", False) == "# A\n\nb c\n\n- d\n\n```\ne\n```\n\n$$f$$"
    assert markup.clean_text(None, True) is None and markup.clean_text("", True) == ""


PAGE = (
    "<html><body><header><nav><a href=/>Home</a></nav></header><noscript>Turn it on</noscript><main><article><h1>Title of the page</h1><p>First text."
    "<p>Second <b>text</b>.<aside><p>Teaser</p></aside><table><tr><td>a</td><td>b</td></tr></table></article></main><div class='sidebar'><p>Side</p></div>"
    "<footer>Foot</footer></body></html>"
)


def test_main_body_and_rendering():
    assert [(b.kind, b.text) for b in render.blocks(PAGE, True)] == [("heading", "Title of the page"), ("paragraph", "First text."), ("paragraph", "Second text."), ("cell", "a  b")]
    assert "Side" in render.render_text(PAGE, False) and "Foot" in render.render_text(PAGE, False)
    table = "<body><table><tr><td colspan=2><a href=/1>A</a> | <a href=/2>B</a></td></tr><tr><td width=160><p>side</p></td><td><h1>x</h1><p>main</p></td></tr></table>"
    assert [b.text for b in render.blocks(table, True)] == ["x", "main"]
    assert render.blocks("", True) == [] and render.blocks("<body></body>", True) == []
    assert [b.text for b in render.blocks("<body><div id=app></div><noscript>Scripts, please</noscript></body>", True)] == ["Scripts, please"]


@given(st.text(alphabet="<>/ab=\"'pdivlu! -&;#\n", max_size=200))
@settings(max_examples=150, deadline=None)
def test_renderer_survives_any_markup(text):
    render.blocks(text, True)
    render.blocks("<body>" + text, True)
    markup.markdown_elements(text)


@pytest.mark.parametrize("tag", ["font", "div"])
def test_text_at_any_depth_is_rendered(tag):
    html = "<html><body><p>First.</p>" + f"<{tag}>" * 3000 + "deep"
    for main_only in (True, False):
        assert "deep" in render.render_text(html, main_only)
    assert "deep" in " ".join(v for _, v in markup.clean_blocks("List<String> " * 500 + "deep", False))


def test_residue_labels():
    index = residue.ExemplarIndex()
    label = lambda body: residue.residue_label(render.blocks(f"<body>{body}</body>", True), index)
    assert label("<h1>{{ title }}</h1><p>Hello {{ name }}, your {{ item }} is ready.</p>") == "template"
    assert label("<h1>Page not found</h1><p>The link you followed may be broken. Error code 7.</p>") == "error"
    assert label("<p>Lorem ipsum dolor sit amet elit.</p>") == "filler"
    assert label("<p>Please enable JavaScript to view this page.</p>") == "scripts"
    real = "<h1>On errors</h1><p>A page that answers with 404 should still help its readers. The words page not found are not enough for most of them.</p>"
    assert label(real) is None and label(real + "<p>{{ title }}</p>") is None and label("") is None
    # a placeholder weighs as many words, it does not override the rest
    assert label("<p>" + "Iron bridges were painted red by hand " * 20 + "[draft].</p>") is None


@given(st.lists(st.sampled_from("page not found error lorem ipsum iron bridge red {{x}} server. please javascript enable".split()), min_size=1, max_size=12), st.data())
def test_what_may_be_residue_bounds_what_is(words, data):
    plain = residue.ExemplarIndex()
    counts = {w: data.draw(st.integers(0, 50)) for w in words}
    index = residue.ExemplarIndex(residue.EXEMPLARS, counts, 50)
    found = [render.Block("paragraph", " ".join(words))]
    if residue.residue_label(found, index) is not None:
        assert residue.may_be_residue(found, plain)


@pytest.mark.parametrize(
    ("text", "case"),
    [
        ("The team is in the office and it was closed.", False),
        ("a,b,c\n1,2,3\n4,5,6", True),
        ("- red apple\n- blue pear\n- old tree\n- new leaf", True),
        ("- It is the first of the rules to read.\n- This was a note for the team to see.", False),
        ("", False),
        (None, False),
        ("  \n ", False),
        ("x=1\ny=2\nz=3", True),
    ],
)
def test_prose(text, case):
    assert quality.is_not_prose(text, MODEL) is case


def test_posterior_counts_against_all_paths():
    import itertools
    import math

    import numpy as np

    sequences = [np.array(x) for x in ([3, 500, 17], [800], [3, 3, 900, 41, 5], [500, 17])]
    weights = np.array([2.0, 1.0, 3.0, 1.0])
    n = len(quality.STATES)
    values = lambda c: [int(v) for v in np.unravel_index(c, quality.SIZES)]
    emit = lambda s, c: math.prod(max(MODEL.emit[s][f][v], quality.IMPOSSIBLE) for f, v in enumerate(values(c)))
    firsts, moves, codes, likelihood = np.zeros(n), np.zeros((n, n)), np.zeros((quality.N_CODES, n)), 0.0
    for x, w in zip(sequences, weights):
        paths = {p: MODEL.start[p[0]] * math.prod(MODEL.move[a][b] for a, b in zip(p, p[1:])) * math.prod(emit(s, c) for s, c in zip(p, x)) for p in itertools.product(range(n), repeat=len(x))}
        total = sum(paths.values())
        likelihood += w * math.log(total)
        for p, v in paths.items():
            firsts[p[0]] += w * v / total
            for a, b in zip(p, p[1:]):
                moves[a, b] += w * v / total
            for s, c in zip(p, x):
                codes[c, s] += w * v / total
    got = quality.posterior_counts(sequences, weights, MODEL)
    assert np.allclose(got[0], firsts) and np.allclose(got[1], moves) and np.allclose(got[2], codes) and abs(got[3] - likelihood) < 1e-9


def test_one_sentence_is_enough_for_a_message():
    assert not quality.is_not_prose("The page is closed to the team of readers today.\nkey=1; k=2", MODEL, True)
    assert quality.is_not_prose("h1 + h2 > a[href] > ul li", MODEL, True)


def brute_repeated(words, k=5):
    marked = [False] * len(words)
    for i in range(len(words) - k + 1):
        if any(words[j : j + k] == words[i : i + k] for j in range(i)):
            marked[i : i + k] = [True] * k
    return sum(marked)


@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40))
@settings(max_examples=150, deadline=None)
def test_repetition_against_brute_force(words):
    text = " ".join(words)
    expected = len(words) and brute_repeated(words)
    repeated, n = repetition.repeated_words([text])
    assert n == len(words) and repeated == (expected or 0)


def test_short_sentences_that_repeat():
    assert repetition.repeated_words(["Tbd. Tbd. Tbd."]) == (2, 3)
    assert repetition.repeated_words([]) == (0, 0)


PAIRS, CACHE = tokenise.encoder()


def reference_ids(text):
    import tokenizers

    if not hasattr(reference_ids, "t"):
        reference_ids.t = tokenizers.Tokenizer.from_file(f"{tokenise.FOLDER}/{tokenise.BYTE_BPE_50K}")
        reference_ids.t.encode_special_tokens = True
    return reference_ids.t.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=120))
@settings(max_examples=200, deadline=None)
def test_encoding_round_trip_and_library(text):
    ids = tokenise.encode(text, PAIRS, CACHE)
    assert ids == reference_ids(text)
    assert tokenise.decode(ids, PAIRS) == text


def test_streaming_with_any_cuts():
    random.seed(3)
    for _ in range(40):
        text = "".join(random.choice("ab eé日\n'tre<|endoftext|>12") for _ in range(random.randint(0, 2500)))
        if random.random() < 0.5:
            text = random.choice(["a", "ab", " ", "\n", "é", "1"]) * random.randint(1, 6000) + text
        t, out, at = tokenise.Transducer(PAIRS, CACHE), [], 0
        while at < len(text):
            n = random.randint(1, 700)
            out += t.feed(text[at : at + n])
            at += n
            assert len(t.open) + len(t.text) < 4 * PAIRS.lookahead + 1500
        assert out + t.finish() == reference_ids(text)
    assert tokenise.encode(None, PAIRS, CACHE) == [] and tokenise.encode("", PAIRS, CACHE) == []


def test_decoder_replaces_invalid_bytes():
    d = tokenise.Utf8Decoder()
    assert d.feed(b"a\xff\xc3") + d.feed(b"\xa9\xe2\x82") + d.finish() == "a�é�"


@pytest.fixture(scope="module")
def looks(spark):
    return confusables.LookAlikes(confusables.load_look_alikes(spark))


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("scope", "ѕсоре", True),
        ("Ｆｕｌｌ　１", "Full 1", True),
        ("é", "é", True),
        ("a​b­c", "abc", True),
        ("a b", "a b", True),
        ("a  b", "a b", False),
        ("a\nb", "a b", False),
        ("A", "a", False),
        ("x²", "x2", False),
        ("①", "1", False),
        ("résumé", "resume", False),
        ("l", "I", False),
        ("cӀub pӏn", "cIub pin", True),
        ("Ꭱead", "Read", True),
        ("ｶﾞ", "ガ", True),
        ("ɡo ᴄat", "go cat", True),
        ("ıf", "if", False),
        ("𝐛old", "bold", False),
        ("привет сор", "привет cop", True),
        ("", "​", True),
    ],
)
def test_look_alikes(looks, a, b, same):
    assert (looks.form(a) == looks.form(b)) is same


def test_consistent_spelling_follows_the_document(looks):
    assert looks.form("привет мир, cop") == "привет мир, сор"
    assert looks.form("the tеam") == "the team"
    assert looks.form("σοφος φως") == "σοφος φως"


@given(st.text(alphabet="aеоcxр bгωσοӀI", max_size=30))
def test_form_is_stable(looks, text):
    form = looks.form(text)
    assert looks.form(form) == form


@given(st.text(alphabet="acopxi ж", max_size=20), st.data())
def test_replaced_letters_have_one_form(looks, text, data):
    swap = {"a": "aа", "c": "cсϲ", "o": "oоο", "p": "pрρ", "x": "xх", "i": "iі"}
    other = "".join(data.draw(st.sampled_from(swap[c])) if c in swap else c for c in text)
    assert looks.form(text) == looks.form(other)


def test_wrappers():
    from pagegauge.functions.htmltree import parse

    pages = [f"<ul><li>a{i}</li><li>b</li></ul><h1>t{i}</h1>" + "<p>x</p>" * (i + 1) + ("<aside>q</aside>" if i else "") for i in range(3)]
    wrapper = None
    for page in pages:
        items = wrappers.page_items(parse(page))
        wrapper = items if wrapper is None else wrappers.align(wrapper, items)
    assert wrappers.as_expression(wrapper) == '<ul>(<li>SLOT</li>)+</ul><h1>SLOT</h1>(<p>"x"</p>)+(<aside>"q"</aside>)?'


TAGS = st.lists(st.sampled_from("a b c d".split()), max_size=9)


@given(TAGS, TAGS)
def test_alignment_keeps_a_longest_common_subsequence(a, b):
    item = lambda tag: wrappers._item(wrappers.ELEMENT, tag, None, [])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(wrappers, "fold", lambda items: items)
        out = wrappers.align([item(t) for t in a], [item(t) for t in b])
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len([x for x in out if not x[4]]) == best[-1][-1] and len(out) == len(a) + len(b) - best[-1][-1]


@given(st.recursive(st.just("x"), lambda kids: st.lists(kids, max_size=4), max_leaves=20))
def test_packed_items_come_back(tree):
    build = lambda t: wrappers._item("e", "k", None, [build(k) for k in t]) if isinstance(t, list) else wrappers._item("t", "#", t, [])
    items = [build(tree)]
    assert wrappers.unpacked(wrappers.packed(items)) == items


def test_a_wrapper_does_not_grow_with_its_streams():
    import random

    random.seed(2)
    wrapper = None
    sizes = []
    for n in range(200):
        items = wrappers.fold([wrappers._item("e", random.choice("pqrstuv"), None, []) for _ in range(40)])
        wrapper = items if wrapper is None else wrappers.align(wrapper, items)
        sizes.append(len(wrappers.as_expression(wrapper)))
    assert sizes[-1] <= 2 * max(sizes[:20])


def test_features_read_the_whole_text():
    same = "The report of the week begins with the same words "
    a, b = (mixing.features(same + end) for end in ("and goes on about iron and coal.", "and goes on about milk and corn."))
    assert set(a) != set(b)
    assert set(mixing.features("one\ntwo three four")) != set(mixing.features("one\ntwo three five"))


@given(st.lists(st.text(alphabet="ab 1\n.é", max_size=20), max_size=6))
def test_features_of_many_texts_are_those_of_each(texts):
    number, feature = mixing.text_features(texts)
    for i, text in enumerate(texts):
        assert feature[number == i].tolist() == mixing.features(text).tolist()


def test_features_and_rates():
    import numpy as np

    assert all(0 <= f < mixing.FEATURES for f in mixing.features("")) and len(mixing.features("")) < 20
    q = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert mixing.rates(q, np.array([1.0, 2.0]), [np.array([-0.5, -0.5]), np.array([-1.0, 5.0])]).tolist() == [1.0, 0.0]

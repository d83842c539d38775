import os
import re
from html import unescape

import pytest

from plumbline.llm import html_crf
from plumbline.llm.html_blocks import blocks

SF = "/root/testdata/sf0.01"


def texts(html):
    return [b.text for b in blocks(html)]


def test_blocks():
    assert texts(None) == texts("") == texts("<p> </p><script>var t='<p>x</p>';</script>") == []
    assert texts("<p>a<p>b <b>c\n d<br>e</p>f") == ["a", "b c d e", "f"]
    assert texts("a &amp; b &lt;p&gt; &copy; &am &#228; <!-- <p>no --> c") == ["a & b <p> © &am ä c"]
    assert texts("<ul><li>x<li>y<ul><li>z</ul>w</ul>") == ["x", "y", "z", "w"]
    assert texts("<style>p{}</style><title>T</p></title>1 < 2 <p class='q>r' id=x>s<textarea><p>in</textarea>") == ["T</p>", "1 < 2", "s", "<p>in"]
    assert texts('<div class="a>open <p>x') == ["x"] or texts('<div class="a>open <p>x') == ["open", "x"]
    assert texts("<script>never closed <p>x") == []
    b = blocks('<div class="Side-bar" id=k><p>t <a href=#>link</a></p></div>')[0]
    assert b.tags[:2] == ("div", "p") and {"side", "bar", "k"} <= b.names and b.linked == 4
    assert len(blocks("<p>" * 3000 + "x" + "<div>" * 3000 + "y")) == 2


def test_foreign_and_hidden_elements_lose_no_text():
    assert texts("<p>a <svg class='icon'/>b</p><p>c") == ["a b", "c"]
    assert texts("<p>a</p><svg class=icon><p>b</p><p>c") == ["a", "b", "c"]
    assert texts("<p>a <svg><g><path d='M0'/></g><script/></svg>b <script>x</script>c<style>y</style></p>") == ["a b c"]
    assert texts("<p>sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> ok</p><p>d") == ["sum x+1 ok", "d"]
    assert texts("<p>see <object data=x>the film</object> now</p><object><p>e</p></object>f") == ["see the film now", "e", "f"]
    assert texts("<div><svg>t</div>u") == ["t", "u"]
    assert len(blocks("<svg>" * 3000 + "x" + "<p>y")) == 2


def test_viterbi_is_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        u, move, start = rng.normal(size=n), rng.normal(size=(2, 2)), rng.normal(size=2)
        score = lambda y: start[y[0]] + sum(u[t] * y[t] for t in range(n)) + sum(move[y[t - 1], y[t]] for t in range(1, n))
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert html_crf.viterbi(u, move, start) == list(best)
    assert html_crf.viterbi(np.zeros(0), move, start) == []


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir(SF):
        pytest.skip("given tables not present")
    return html_crf.train(spark.read.parquet(f"{SF}/pages.parquet"))


def article(html):
    """The text of the given pages' article by their own markup."""
    inner = html[html.index("<article>") + 9:html.index("</article>")]
    parts = [" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in parts if x)


def test_given_pages(spark, model):
    out = html_crf.extract_main_text(spark.read.parquet(f"{SF}/pages.parquet"), model).collect()
    assert all(r.text == article(r.html) and r.n_chars == len(r.text) for r in out) and len(out) == 250


def test_other_layouts(model):
    rows = [r for r in OTHER]
    for html, want in rows:
        assert html_crf.main_text(model, html) == "\n\n".join(want)


PROSE = ["The river rose by two metres in the night and closed both bridges.", "Engineers expect it to fall again by Friday, said the mayor.", "Schools stay closed, but shops will open."]
OTHER = [
    ("<html><body><div class='menu'><a href=/>Home</a> <a href=/n>News</a></div><main><h1>Flood</h1>" + "".join(f"<p>{p}</p>" for p in PROSE)
     + "</main><div id='comments'><p>I saw it too, it was quite a sight from the hill.</p></div><footer>© 2024 Paper</footer></body></html>", ["Flood", *PROSE]),
    ("<body><header><p>Daily Paper</p></header><div class='cookie-notice'><p>We use cookies to make this site better for you.</p></div><div class='content'><h1>Flood</h1>"
     + "".join(f"<p>{p}</p>" for p in PROSE) + "</div><aside><p>Related: the bridge of 1950 and how it was built.</p></aside><form><p>Subscribe to our newsletter</p></form></body>", ["Flood", *PROSE]),
]


def test_edge_rows(spark, model):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "<p>", "y")], "page_id long, html string, text string")
    assert [tuple(r) for r in html_crf.extract_main_text(df, model).select("text", "n_chars").collect()] == [("", 0)] * 4
    assert html_crf.extract_main_text(df.limit(0), model).collect() == []
    assert html_crf.train(df.limit(0)).labels(blocks("<p>a")) in ([0], [1])


def test_quotes_inside_unquoted_values():
    page = "<article><p title=it's>One text here</p><p>Second</p><p>don't two > three</p><p title = 'a > b' class=\"x > y\">Fourth</p><p a='>Fifth</p></article>"
    assert [b.text for b in blocks(page)][:4] == ["One text here", "Second", "don't two > three", "Fourth"]
    assert blocks("<div class=it's-main><p>x")[0].names >= {"main"}


@pytest.mark.parametrize("wrap", ["div class=content", "div id=story", "td"])
def test_tables_without_named_articles(spark, wrap):
    prose = ["The water rose again during the night and reached the doors of the old mill.", "By noon the road to the north had been opened for cars, but not for trucks."]
    html = f"<body><div class=menu><a href=/>Home</a> <a href=/x>News</a></div><{wrap}>" + "".join(f"<p>{p}</p>" for p in prose) + f"</{wrap.split()[0]}><footer>© 2024</footer></body>"
    df = spark.createDataFrame([(i, html) for i in range(20)], "page_id long, html string")
    out = html_crf.extract_main_text(df, html_crf.train(df)).collect()
    assert all(r.text == "\n\n".join(prose) for r in out)

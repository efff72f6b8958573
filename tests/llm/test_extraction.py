import html as escapes

import numpy as np
import pytest
from pyspark.sql import functions as F
from util import same_as_sql

from recollect.llm import dom, extraction as m
from recollect.llm import layouts, sql

GIVEN = "/root/testdata/sf0.01"
PROSE = [
    "The harbour froze early that year, and the boats stayed in until the middle of March. Nobody had expected it.",
    "Fishermen mended their nets in the long hall, drank tea, and told the same three stories again, as they did every winter.",
    "When the ice broke, it went in a night. By morning the water was open, grey and quiet.",
    "Short.",
]
SAID = ["I was there in that winter and remember it well. My father lost his boat, and we walked over the ice to the island.", "Great piece, thank you! I would read more about the nets, if you have it."]


@pytest.fixture(scope="module")
def model(spark):
    return m.fit(spark.read.parquet(f"{GIVEN}/pages.parquet"))


def paragraphs(tag="p"):
    return "".join(f"<{tag}>{escapes.escape(x)}</{tag}>" for x in PROSE)


MENU = '<ul>{}</ul>'.format("".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Weather", "About us")))
WANT = "\n\n".join(["Ice in the harbour", *PROSE])

PAGES = {
    "semantic": f"<html><head><title>x</title></head><body><header><h2>The Paper</h2><nav>{MENU}</nav></header><main><article><h1>Ice in the harbour</h1>{paragraphs()}</article></main><aside><h3>More to read</h3>{MENU}</aside><footer><p>&copy; 2024 The Paper. All rights reserved.</p></footer></body></html>",
    "class names": f'<body><div id="wrapper"><div class="site-header"><a href="/">The Paper</a></div><div class="main-menu">{MENU}</div><div class="row"><div class="post-content"><h1>Ice in the harbour</h1>{paragraphs()}</div><div class="sidebar"><h3>Popular</h3>{MENU}<p>We are a small paper by the sea. Write to us.</p></div></div><div class="footer">Imprint and privacy. All rights reserved.</div></div></body>',
    "notice and comments": f'<body><div class="cookie-banner"><p>We use cookies to give you the best experience. By staying on this site you agree to our terms, which you can read below.</p><button>Accept</button></div><nav>{MENU}</nav><article><h1>Ice in the harbour</h1>{paragraphs()}</article><section id="comments"><h3>2 comments</h3>'
    + "".join(f'<div class="comment"><span>Ann</span><p>{x}</p></div>' for x in SAID)
    + '<form action="/say"><label>Your comment</label><textarea>text</textarea><button>Send</button></form></section></body>',
    "adverts inside": f'<body><article><h1>Ice in the harbour</h1><p>{PROSE[0]}</p><div class="ad">Buy new nets now. They are strong and cheap.</div><p>{PROSE[1]}</p><p>{PROSE[2]}<aside class="promo"><p>Subscribe today and read every story of the winter for one coin a week.</p></aside><p>{PROSE[3]}</p></article><form><p>Sign up for our letter and never miss a story.</p><input><input type=submit></form></body>',
    "unclosed": f'<body><ul class=menu><li><a href=/>Home<li><a href=/n>News<li><a href=/s>Sport</ul><div class=content><h1>Ice in the <b>harbour</h1><p>{PROSE[0]}<p><b>{PROSE[1]}<br><p>{PROSE[2]}<p>{PROSE[3]}</div><div class=footer>The Paper, Harbour Road 1',
    "scripts": f"<body><script>var x = '<p>not this</p>';</script><nav>{MENU}</nav><article><h1>Ice in the harbour</h1><style>p > b {{color: red}}</style>{paragraphs()}<script type='a'>if (a < b) {{ c(); }}</script><noscript><p>Turn scripts on.</p></noscript><!-- <p>nor this</p> --></article></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_other_layouts(model, name):
    assert m.extract([PAGES[name]], model) == [WANT]


def test_pages_without_an_article(model):
    menu = f"<body><header><h1>The Paper</h1><nav>{MENU}</nav></header><footer><p>&copy; 2024 The Paper.</p></footer></body>"
    assert m.extract([menu, f"<nav>{MENU}</nav>", "<p>One plain paragraph, and nothing else on the page.</p>", "Plain text alone."], model) == ["", "", "One plain paragraph, and nothing else on the page.", "Plain text alone."]


def test_given_pages(spark):
    found = m.op12_html_extraction(spark, GIVEN)
    same_as_sql(found, GIVEN, sql.OP12.replace("FROM pages", f"FROM '{GIVEN}/pages.parquet'"), [])


def test_held_out_layouts(model):
    trees = [dom.parsed(p) for p in layouts.pages(77, 150, [], [])]
    right = total = kept_right = kept = 0
    for t in trees:
        keep = m.decoded(t, np.clip(model.score(dom.features([t])), -8, 8))
        for tag, truth, k in zip(t.tag, t.truth, keep, strict=True):
            if tag == "#block" and truth >= 0:
                right += k and truth == 1
                total += truth == 1
                kept += k
        assert all(not k or t.parent[i] < 0 or keep[t.parent[i]] for i, k in enumerate(keep))
    assert right / total > 0.97 and right / kept > 0.97


def test_choice_is_the_likeliest_of_all():
    """Against every choice of nodes of small trees."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 10))
        t = dom.Tree(parent=[-1] + [int(rng.integers(k)) for k in range(1, n)])
        t.tag = ["#block" if k not in t.parent and rng.random() < 0.8 else "div" for k in range(n)]
        s = rng.normal(0, 1, n)
        def value(kept):
            for k in range(n):
                if kept[k] and t.parent[k] >= 0 and not kept[t.parent[k]]:
                    return -1e9
                if kept[k] and t.tag[k] != "#block" and not any(kept[c] for c in range(n) if t.parent[c] == k):
                    return -1e9
            return sum(x if k else -x for x, k in zip(s, kept, strict=True))
        best = max(value([bool(c >> k & 1) for k in range(n)]) for c in range(1 << n))
        assert value(m.decoded(t, s)) == pytest.approx(best)


def blocks(page):
    t = dom.parsed(page)
    return [x for x in t.text if x]


def test_blocks_of_odd_pages():
    assert blocks(None) == blocks("") == blocks("  \n ") == blocks("<") * 0 == []
    assert blocks("plain &amp; simple < text &lt;b&gt; &am &eacute;&#233;&#x1F642; &nbsp; end") == ["plain & simple < text <b> &am éé🙂 end"]
    assert blocks("<p>one <b>two</b> three<i>four</i></p>five") == ["one two threefour", "five"]
    assert blocks("<div>a<p>b<div>c</div>d</p>e</div>") == ["a", "b", "c", "d", "e"]
    assert blocks("<table><tr><td>1<td>2<tr><td>3</table>x") == ["1", "2", "3", "x"]
    assert blocks("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert blocks('<p title="a > b">x</p><p title=\'>\'>y</p><!-- -- > <p>no</p> --><p>z<!-- open') == ["x", "y", "z"]
    assert blocks("<p>a<br>b<br/>c</p><pre>  d\n  e </pre>") == ["a b c", "d e"]
    assert blocks("<title>no</title><script>no</script><STYLE>no</STYLE><p>yes<script>no</p>") == ["yes"]
    assert blocks("<p>yes</p><a href='") == ["yes"] and blocks("<p data-truth=x>a</p></p></div></nothing>b") == ["a", "b"]


def test_very_long_and_very_deep_pages(model):
    long = "<article>" + "<p>A sentence that is said again and again, for as long as it takes.</p>" * 30_000 + "</article>"
    deep = "<div>" * 20_000 + "<p>At the bottom.</p>"
    open_ = "<b>" * 50_000 + "</i>" * 50_000 + "<a " * 50_000
    found = m.extract([long, deep, open_, "<p>" * 100_000], model)
    assert found[0].count("\n\n") == 29_999 and found[2:] == ["", ""]


def test_odd_rows(spark, model):
    schema = "page_id bigint, url string, html string, text string, score double"
    rows = [(1, "u", None, "x", 1.0), (1, "u", "", "x", 1.0), (None, None, PAGES["semantic"], None, None), (2, "u", PAGES["semantic"], "x", 1.0), (2, "u", PAGES["semantic"], "x", 1.0), (3, "v", PAGES["unclosed"], None, 0.0)]
    found = m.main_texts(spark.createDataFrame(rows, schema), model)
    assert found.columns == ["page_id", "url", "html", "text", "score"]
    assert sorted((str(r.page_id), r.text) for r in found.collect()) == sorted([("1", ""), ("1", ""), ("None", WANT), ("2", WANT), ("2", WANT), ("3", WANT)])


def test_a_table_without_pages(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert m.main_texts(empty, m.fit(empty)).count() == 0


def test_trees_learn_a_pair_of_features():
    """Neither feature tells alone, both together do."""
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = m.boosted(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0) == y[3000:]).mean() > 0.95
    assert m.boosted(x[:0], y[:0]).score(x[:2]).tolist() == [0.0, 0.0]

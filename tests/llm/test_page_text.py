"""Main text of pages: given tables, layouts written by hand, held-out layouts, and decoding against enumeration."""

import html
import itertools
import re

import numpy as np
import pytest

from lexigrove.llm import page_text
from tests.conftest import SMALL

P1 = "The council met on Tuesday to decide whether the old bridge should be repaired or replaced, a question that has divided the town for years."
P2 = "Engineers told the members that repairs would cost less at first, but that the steel would have to be inspected every spring."
P3 = "No vote was taken."
LAYOUTS = {
    'div content+sidebar+comments': (f"""<html><body><div id="header"><a href="/">Daily Post</a><ul class="menu"><li><a href="/a">News</a><li><a href="/b">Sport</a></ul></div>
<div class="cookie-notice">We use cookies to make this site better. <button>Accept</button></div>
<div id="wrapper"><div class="post-content"><h1>Bridge debate</h1><p>{P1}</p><p>{P2}</p><div class="ad">Buy shoes now, cheap and fast.</div><p>{P3}</p></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Storm hits coast</a></li><li><a href="/2">Market up</a></li></ul></div></div>
<div id="comments"><h2>2 comments</h2><div class="comment"><p>I think the bridge should be replaced, as it has been unsafe for years and nobody cares.</p></div><div class="comment"><p>Repair it!</p></div></div>
<div id="footer"><p>Copyright 2020 Daily Post. All rights reserved.</p></div></body></html>""", ["Bridge debate",P1,P2,P3]),
    'main+aside+form': (f"""<!doctype html><body><header><nav><a href=/>Home</a> <a href=/x>About</a></nav></header><main><h1>Bridge &amp; debate</h1><p>{P1}</p><ul><li>repair</li><li>replace</li></ul><p>{P2}</p><form action=/s><label>Email</label><input name=e><button>Subscribe</button></form></main><aside><p>Related: {P3}</p></aside><footer>&copy; 2021 Town</footer>""", ["Bridge & debate",P1,"repair","replace",P2]),
    'no markup names': (f"""<html><body><div><div><a href=/>Home</a><a href=/1>News</a><a href=/2>Sport</a><a href=/3>Contact us</a></div><div><h1>Bridge debate</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p><p>{P1}</p></div><div>Copyright 2020. All rights reserved. <a href=/p>Privacy</a> <a href=/t>Terms</a></div></div></body></html>""", ["Bridge debate",P1,P2,P3,P1]),
    'article w/ comments inside': (f"""<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article class="post"><header><h1>Bridge</h1></header><p>{P1}<p>{P2}<table><tr><td>1</td><td>two</td></tr></table><section class="comments"><h3>Comments</h3><ul><li>{P2}</li><li>Nice one.</li></ul></section></article><footer>foot</footer></body>""", ["Bridge",P1,P2,"1","two"]),
    'bare': (f"<p>{P1}</p><p>{P2}</p>", [P1,P2]),
    'text only': (P1, [P1]),
    'nav only': ("<html><body><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav></body></html>", []),
    'aspnet form': (f"""<body><form id="aspnetForm"><div class="nav"><a href=1>One</a><a href=2>Two</a></div><div class="article"><h1>Bridge</h1><p>{P1}</p><p>{P2}</p></div><div class=footer>foot</div></form></body>""", ["Bridge",P1,P2]),
    'role main, banner': (f"""<body><div role="banner">My Site</div><div role="navigation"><a href=1>One</a></div><div role="main"><h1>Bridge</h1><p>{P1}</p><p>{P3}</p><p>{P2}</p></div><div role="contentinfo">Imprint</div></body>""", ["Bridge",P1,P3,P2]),
    'newsletter+share+related after': (f"""<body><div class="site-header">Site</div><div class="entry-content"><h2>Bridge</h2><p>{P1}</p><pre>x = 1
y = 2</pre><p>{P2}</p></div><div class="share-buttons"><a href=#>Tweet</a><a href=#>Like</a></div><div class="related-posts"><h3>You may also like</h3><p>{P3}</p><p>{P2}</p></div><div class="newsletter"><p>Sign up for our weekly letter and never miss a story.</p></div></body>""", ["Bridge",P1,"x = 1 y = 2",P2]),
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SMALL}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return page_text.learn(pages)


def texts(model, *htmls):
    forest = page_text.Forest([page_text.parse(h) for h in htmls])
    return page_text.texts_of(forest, page_text.decode(forest, model.log_odds(page_text.measure(forest, model.odds))))


def test_given_pages(pages, model):
    got = page_text.extracted(pages, model).select("page_id", "html", "text", "n_chars").collect()
    assert len(got) == pages.count()
    for row in got:
        article = row["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", b)).split()) for b in re.split("</?p>|</?h1>", article)]
        assert row["text"] == "\n\n".join(b for b in blocks if b) and row["n_chars"] == len(row["text"])


def test_layouts_by_hand(model):
    wrong = [name for name, (page, blocks) in LAYOUTS.items() if texts(model, page) != ["\n\n".join(blocks)]]
    assert len(wrong) <= 1, wrong


def test_held_out_layouts(pages, model):
    rows = pages.select("html").collect()
    made = [p for i, r in enumerate(rows) for p in page_text.training_pages(r["html"], 10 ** 6 + i)[1:]]
    forest = page_text.Forest(made)
    kept = page_text.decode(forest, model.log_odds(page_text.measure(forest, model.odds)))
    run = np.array([t == "#text" for t in forest.tags])
    chars, truth = np.array([len(t) for t in forest.texts]), forest.kept.astype(bool)
    assert (chars * (kept & truth)).sum() >= 0.97 * (chars * kept).sum()
    assert (chars * (kept & truth)).sum() >= 0.97 * (chars * truth).sum()
    assert (kept[run] == truth[run]).mean() >= 0.97


def test_decoding_against_enumeration():
    rng = np.random.default_rng(12)
    for _ in range(20):
        page = page_text.Page()
        for i in range(9):
            parent = int(rng.integers(0, i)) if i else -1
            for values, value in ((page.tags, "div"), (page.parents, parent), (page.last, i), (page.names, ()), (page.texts, ""), (page.linked, 0),
                                  (page.links, 0), (page.controls, 0), (page.kept, 0)):
                values.append(value)
        forest = page_text.Forest([page])
        scores = np.round(rng.normal(size=9), 3)
        own = scores.copy()
        for level in forest.levels[1:]:
            own[level] += page_text.INHERITED * np.maximum(own[forest.parent[level]], 0.0)
        allowed = [c for c in itertools.product([False, True], repeat=9) if c[0] and all(not c[i] or c[page.parents[i]] for i in range(1, 9))]
        best = max(allowed, key=lambda c: sum(own[i] for i in range(1, 9) if c[i]))
        assert page_text.decode(forest, scores).tolist() == list(best)


def test_parsing():
    def runs(text):
        page = page_text.parse(text)
        return [(page.tags[page.parents[i]], t) for i, t in enumerate(page.texts) if t]

    assert runs("<p>a<p>b<b>c</p>d") == [("p", "a"), ("p", "bc"), ("#page", "d")]
    assert runs("<ul><li>a<li>b<ul><li>c</ul>d</ul>") == [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]
    assert runs("a &amp; b&nbsp;&#233; &lt;p&gt;") == [("#page", "a & b é <p>")]
    assert runs('<div title="a>b">x</div><!-- <p>y</p> --><script>var t="</p>z";</script>w') == [("div", "x"), ("#page", "w")]
    assert runs("<div hidden><p>x</p></div><p style='display: none'>y</p>z<noscript>q</noscript>") == [("#page", "z")]
    assert runs("<head><title>t</title><meta x><body>a</div></span>b<p") == [("body", "ab")]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table>") == [("td", "a"), ("td", "b"), ("td", "c")]
    assert runs(None) == runs("") == runs("<") [:0]


def test_odd_tables(spark, model):
    schema = "page_id long, url string, html string, text long, n_chars string, features string, node string"
    long = "<article>" + "<p>some words, again and again.</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "<p>deep words, a whole sentence of them.</p>"
    rows = [(1, "u", None, 1, "x", "x", "x"), (2, "u", "", 1, "x", "x", "x"), (None, None, P1, 1, "x", "x", "x"), (3, "u", long, 1, "x", "x", "x"),
            (3, "u", long, 1, "x", "x", "x"), (4, "u", deep, 1, "x", "x", "x"), (5, "u", "<p '" * 5000, 1, "x", "x", "x")]
    got = page_text.extracted(spark.createDataFrame(rows, schema), model)
    assert set(got.columns) == {"page_id", "url", "html", "text", "n_chars", "features", "node"}
    found = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()))
    assert [f[0] for f in found] == [0, 1, 2, 3, 3, 4, 5]
    assert found[0][1] == P1 and found[1][1:] == found[2][1:] == ("", 0)
    assert found[3] == found[4] and found[3][1].count("\n\n") == 19_999
    assert page_text.main_texts(spark.createDataFrame([], schema)).collect() == []

"""op2: the linear scan against brute force, hand-made pages, and the pages whose article element gives the answer."""

import html
import random
import re

import pyarrow.parquet as pq
import pytest

from docmill.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/x">menu one</a></li></ul></nav><div class="cookie-notice">We use cookies on this site</div>
<div class="sidebar">links and more links</div><article><h1>Head &amp; line</h1><p>First  para<b>graph</b>
goes on.<div class="ad">Buy now</div><p>Second &lt;one&gt; &#233;&nbsp;x<aside>by the way</aside></article>
<section id="comments"><p>I like this very much indeed, said a reader</p></section><form>Name <input> <button>Send</button></form><footer>&copy; all of it</footer></body></html>"""


def test_hand_made_page():
    weights = H.Weights()
    assert H.main_text(PAGE, weights) == "Head & line\nFirst paragraph goes on.\nSecond <one> é x"


@pytest.mark.parametrize("page", ["", "   ", "<p>", "<nav>only menus here</nav>", "<!-- never closed", "<script>x", "<a href='unclosed>text</a>", "<p class=\"x", "a < b", "<>", "</p></div>"])
def test_odd_pages_do_not_crash(page):
    assert isinstance(H.main_text(page, H.Weights()), str)


def test_long_page_is_linear():
    text = H.main_text("<div>" * 2000 + "<p>word " * 50_000 + "<" * 20_000 + "'\"" * 5000, H.Weights())
    assert text.count("word") == 50_000


def test_region_is_the_best(monkeypatch):
    r = random.Random(1)
    weights = H.Weights()
    for _ in range(200):
        weights.tag = {"i": -r.random() * 3, "/i": -r.random() * 3, "b": -5.0}
        page = "".join(r.choice(["<i>", "</i>", "<b>", f" w{k} ", f" w{k} v{k} "]) for k in range(r.randint(1, 14)))
        items = [(weights.tag.get(key, H.TAG_COST) if kind != "text" else len(v.split()), v if kind == "text" else "") for kind, key, v, _ in H.walk(page)]
        best = max([(sum(s for s, _ in items[a:b]), -a, b - a) for a in range(len(items)) for b in range(a + 1, len(items) + 1)], default=(0, 0, 0))
        got = H.main_text(page, weights).split()
        score = lambda words: max([sum(s for s, _ in items[a:b]) for a in range(len(items)) for b in range(a + 1, len(items) + 1) if " ".join(v for _, v in items[a:b]).split() == words], default=0)  # noqa: B023, E731
        assert max(best[0], 0) == pytest.approx(max(score(got), 0))


def want(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract_main_text(df).collect()}
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]].text == want(r["html"])
        assert (got[r["page_id"]].url, got[r["page_id"]].n_chars) == (r["url"], len(want(r["html"])))


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>kept", 2), (2, "u", "<p>a", 3), (2, "u", "<p>b", 4)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in H.extract_main_text(df).collect())
    assert got == [(0, "u", "kept", 4), (1, None, "", 0), (2, "u", "b", 1)]
    assert H.extract_main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["discussion", "replies", "adsbygoogle", "usercomments"])
def test_labelled_pages_judge_divs_of_a_class(spark, name):
    """Reader comments behind the article in a div or section whose name is not in the list; a bare div and one inside the article stay text."""
    body = "<div><p>" + "word " * 120 + f"</p></div><div class='lead'>{'more ' * 60}</div>"
    page = lambda tag: f"<article>{body}</article><{tag} class='{name}'>{'reader ' * 80}</{tag}>"
    assert name not in H.ASIDE_NAMES
    df = spark.createDataFrame([(k, "u", page(("div", "section")[k % 2])) for k in range(6)], "page_id long, url string, html string")
    got = [r.text.split() for r in H.extract_main_text(df).collect()]
    assert got == [["word"] * 120 + ["more"] * 60] * 6


def test_every_key_is_learned(spark):
    """12,000 classes, each with 60 words outside the article and 2 inside: none is cut off, and none loses a side."""
    outside = "".join(f"<div class='k{k}'>{'out ' * 60}</div>" for k in range(12_000))
    inside = "".join(f"<div class='k{k}'>in in</div>" for k in range(12_000))
    df = spark.createDataFrame([(1, f"<article>{inside}</article>{outside}")], "page_id long, html string")
    weights = H.learn_weights(df)
    assert all(weights.aside[f"div.k{k}"] is False for k in range(12_000))
    assert sum(key.startswith("div.k") for key in weights.tag) == 12_000


def test_a_page_does_not_depend_on_those_before_it(spark):
    """A header of the site and a header within the article, in either order and in any partitioning."""
    words = " ".join(f"word{i}" for i in range(80))
    own = f"<body><article><header><h1>My Title Here</h1></header><p>{words}</p></article></body>"
    site = f"<body><header>The Site</header><article><p>{words}</p></article></body>"
    rows = [(k, "u", (own, site)[k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    of = lambda n, order: {r.page_id: r.text for r in H.extract_main_text(df.repartition(n).sortWithinPartitions(order), H.Weights()).collect()}
    want = {k: words if k % 2 else f"My Title Here\n{words}" for k in range(60)}
    assert of(1, "page_id") == of(50, "page_id") == of(3, "html") == want


def test_small_unknown_containers_beside_an_article_are_no_main_text():
    """A class of which nothing was learned: outside the page's own article it goes, within it, around it or without one it stays."""
    body, talk = "words of the article " * 20, "reader says this " * 10
    text = lambda page: H.main_text(page, H.Weights())
    assert text(f'<article><p>{body}</p></article><div class="discussion"><p>{talk}</p></div>') == body.strip()
    assert text(f'<div class="discussion">{talk}</div><main><p>{body}</p></main>') == body.strip()
    assert text(f'<article><p>{body}</p><div class="discussion"><p>{talk}</p></div></article>') == f"{body.strip()}\n{talk.strip()}"
    assert text(f'<div class="page"><article><p>{body}</p></article></div>') == body.strip()
    assert text(f'<div class="story"><p>{body}</p></div>') == body.strip()
    assert text(f'<article><p>{talk}</p></article><div class="story"><p>{body}</p></div>').endswith(body.strip())
    learned = H.Weights([("in", "div.discussion", True, 60), ("in", "div.discussion", False, 40)])
    assert H.main_text(f'<article><p>{body}</p></article><div class="discussion"><p>{talk}</p></div>', learned) == f"{body.strip()}\n{talk.strip()}"

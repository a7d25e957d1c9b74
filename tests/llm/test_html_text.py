"""HTML extraction: exact marginals, held-out pages, repaired markup, defined cases."""

import html
import itertools
import re

import numpy as np
import pytest

from lethe.llm import html_text as H


@pytest.fixture(scope="module")
def model():
    return H.train(H.labelled_pages())


def test_marginals_are_exact(model):
    nodes = H.parse("<body><nav><a>x</a></nav><article><h1>T</h1><p>One two.</p></article></body>")
    x, kinds = H.features(nodes)
    own = x @ model.weights
    total, content = 0.0, np.zeros(len(nodes))
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        score = sum(own[i] for i, y in enumerate(labels) if y)
        score += sum(model.pair[kinds[i], labels[nodes[i].parent], labels[i]] for i in range(1, len(nodes)))
        total += np.exp(score)
        content += np.exp(score) * np.array(labels)
    assert np.allclose(model.marginals(nodes), content / total)


def test_held_out_labelled_pages(model):
    held = H.labelled_pages(150, seed=77)
    assert sum(model.extract(page) == "\n".join(texts) for page, texts in held) >= 147


def test_sample_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in H.extract_text(pages, model).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_repairs(model):
    page = "<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><article><h1>A &amp; B</h1><p>One <b>bold\n word<p>Two<br>lines &lt;here&gt;.<div>Three &#233;</div></article><footer>&copy; Me</footer>"
    assert model.extract(page) == "A & B\nOne bold word\nTwo lines <here>.\nThree é"
    assert model.extract('<article><h1>T</h1><p class="x>Unclosed quotes stay markup.</p></article>') == "T\nUnclosed quotes stay markup."
    side = "<article><p>The story itself is here, at length.</p></article><aside><p>Read also this other story of ours.</p></aside><div class='comments'><p>Nice article, I liked it.</p></div><form><p>Your mail</p><button>Send</button></form>"
    assert model.extract(side) == "The story itself is here, at length."
    assert model.extract("<article><p>Text.<script>var a='<p>no</p>'</script><style>p{}</style><!-- no --></p></article>") == "Text."


def test_names_of_wrappers_and_own_headers(model):
    page = """<html><body class="single has-sidebar menu-open"><div id="page" class="with-sidebar"><header class="masthead"><p>The Site</p></header>
    <main><article><header><h1>The title</h1></header><p>A paragraph of the story, long enough to be one.</p><figure><figcaption>A caption.</figcaption></figure>
    <div class="share">Share this</div><p style="display:none">Hidden words of no use.</p></article></main>
    <div role="navigation"><a href="/">Home</a> <a href="/a">About us</a></div><div id="cookie-banner"><p>We use cookies here.</p></div></div></body></html>"""
    assert model.extract(page).split("\n") == ["The title", "A paragraph of the story, long enough to be one.", "A caption."]


def test_defined_cases(spark, model):
    for text in (None, "", "   ", "<html></html>", "<script>x", "<!-- open", "<"):
        assert model.extract(text) in ("", "<")
    assert "\n" not in model.extract("<div>" * 5000 + "deep" + "</div>" * 5000)
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article><p>Some text here.</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = H.extract_text(pages.selectExpr("*", "1 AS text"), model).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("", 0), ("Some text here.", 15)]
    assert H.extract_text(pages.limit(0), model).count() == 0


@pytest.mark.parametrize("depth", [1, 10, 250, 5000])
def test_depth_changes_nothing(model, depth):
    deep, shallow = "<div>" * depth, "</div>" * depth
    page = (
        f"<body><article><h1>Title here</h1><p>One sentence of the article that is long enough to be text.</p><p>Another sentence of the article follows it.</p></article>"
        f"<div class=comments>{deep}<p>A reader says so.</p>{shallow}</div>{deep}<div class=sidebar><p>Related things.</p></div>{shallow}</body>"
    )
    assert model.extract(page) == "Title here\nOne sentence of the article that is long enough to be text.\nAnother sentence of the article follows it."


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a "', "<!", "<!--", "<", "<div", "</p", "<p><table><td><ul>", "<x>", "<![CDATA[", "<script", "<p><foo><li>"])
def test_tags_that_never_end_take_linear_time(model, piece):
    import time

    began = time.time()
    H.parse("<p>text</p>" + piece * (300_000 // len(piece)))
    assert time.time() - began < 4


def test_what_follows_the_last_tag():
    texts = lambda page: [n.text[0] for n in H.parse(page) if n.text]
    assert texts("<p>a</p>b <i") == ["a", "b <i"]
    assert texts("<p>a</p>b <!-- c <i") == ["a", "b"]
    assert texts("<p>a</p>b <!-- c <i> d") == ["a", "b"]
    assert texts("a <!-- b --> c") == ["a c"]

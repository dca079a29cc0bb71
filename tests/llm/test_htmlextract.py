import pytest

from tidewatch.llm import htmlextract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="top"><a href="/">Home</a></header><nav><ul><li><a>One</a></li><li>Two</li></ul></nav>
<div class="cookie-notice">We use cookies, please agree.</div>
<article><h1>The&nbsp;title &amp; more</h1><p>First   paragraph, with <b>bold</b> text&#8212;and a
line break.<br>Next line.</p><ul><li>An item, too.</li></ul><blockquote><p>Quoted words.</p></blockquote>
<div class="ad">Buy now!</div><form>Sign up <input name=x></form></article>
<aside class="sidebar"><p>Related things to read, all of them good.</p></aside>
<section class="comments"><h2>Comments</h2><p>Great article, thank you so much for it.</p></section>
<footer>Copyright, all rights reserved.</footer></body></html>"""


def test_article():
    assert h.main_text(PAGE) == "The title & more First paragraph, with bold text—and a line break. Next line. An item, too. Quoted words."


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>One, two.", "One, two."), ("<p>a &lt;b&gt; c</p>", "a <b> c"), ("<script>x</script>", ""), ("<!-- <p>no</p> --><p>Yes.</p>", "Yes."), ("<p>Cut off <a href=", "Cut off")])
def test_small_pages(html, text):
    assert h.main_text(html) == text


@pytest.mark.parametrize("html", ["<" * 2000, "<div>" * 3000 + "deep", "<p" * 500, "&#xFFFFFFFF; &bogus; &#0;", "</div></p>text</html>", "<table><tr><td>a<td>b<tr><td>c", "<a b='" + "x" * 10000])
def test_malformed_pages_dont_fail(html):
    assert isinstance(h.main_text(html), str)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = h.op6(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["n_chars"] > 0 for r in rows) > 0.9 * len(rows)


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None, None, "kept", 1), (None, "u", "<p>x, y.</p>", "kept", 1), (2, "u", "", "kept", 1), (2, "u", "", "kept", 1)], "page_id long, url string, html string, text string, n_chars int")
    rows = h.extract(d).collect()
    assert sorted(r["text"] for r in rows) == ["", "", "", "x, y."]
    assert h.op6(d.limit(0)).count() == 0


ARTICLE = "<article><h1>Title</h1><p>Once upon a time, there was a story. It was long, and it had many words; so it goes on.</p>{}<p>And more, of course. It never ends, does it?</p></article>"
WHOLE = h.main_text(ARTICLE.format(""))


@pytest.mark.parametrize("inside", ["<p class=a\">One two.</p>", "<p title=it's>One two.</p>", "<p><a href=\"x>One two.</p>", "<p class='x y' data-a = b>One two.</p>"])
def test_no_markup_leaks(inside):
    assert h.main_text(ARTICLE.format(inside)) == WHOLE.replace("And more", "One two. And more")


@pytest.mark.parametrize("inside, text", [("<p class='search'>A search, it was.</p>", "A search, it was."), ("<div class='text-share'>It has words, and more. It goes on, and on.</div>", "It has words, and more. It goes on, and on."), ("<section class='related-work'><p>It was done before, by others.</p></section>", "It was done before, by others."), ("<h2>Sub</h2><p>Of.</p>", "Sub Of."), ("<ul><li>Milk</li><li>Eggs</li></ul>", "Milk Eggs")])
def test_stays(inside, text):
    assert h.main_text(ARTICLE.format(inside)) == WHOLE.replace("And more", f"{text} And more")


@pytest.mark.parametrize("inside", ["<div class='qq'>Click here</div>", "<div>12</div>", "<div class='ad'>Buy now, it is cheap.</div>", "<ul><li><a href=x>Another story of it</a></li></ul>", "<section class='comments'><h3>Comments</h3><p>I think, as a reader, that this is nice. Thank you!</p></section>", "<div hidden>Not to be seen, by anyone.</div>", "<div style='display: none'>Not to be seen, by anyone.</div>"])
def test_goes(inside):
    assert h.main_text(ARTICLE.format(inside)) == WHOLE


def test_an_ad_beside_an_empty_article():
    assert h.main_text("<nav>x</nav><div class=ad>Buy it, now.</div><article></article><footer>f</footer>") == ""
    assert h.main_text("<div class='story-ad-free'><p>One two.</p></div>") == "One two."
    assert h.main_text("<h1>Out</h1><article><p>One, two.</p></article>") == "Out One, two."


def test_time_is_linear_in_depth():
    import time

    for unit in ("<div>x", "<h2>x", "<ul><li>x", "<div></x>"):
        took = []
        for n in (5_000, 20_000):
            began = time.process_time()
            h.main_text(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.3


def test_path_scores_by_brute_force():
    import math

    page = "<main><p>One, two.</p><p>Three four five.</p><div>x<a>y</a></div><p>Six, seven; eight.</p><ul class='tags'><li>z</li></ul></main><p>Out.</p>"
    paths, found = h.blocks(page)

    def label(p):
        return label(paths.parent[p]) + [paths.tag[p]] if p else []

    where = ["/".join(label(b.path)) for b in found]
    assert where == ["main/p", "main/p", "main/div", "main/p", "main/ul/li", "p"]
    mean = lambda xs: sum(xs) / len(xs)
    ratio = {}
    for w in where:
        own = [b.text for b, x in zip(found, where) if x == w]
        c, d = mean([len(t) for t in own]), mean([sum(t.count(x) for x in ",.;:!?") for t in own])
        ratio[w] = c / (c + 80) * (0.25 + d) / (1 + d)
    weight = [math.exp(-0.5 * k * k) for k in range(-2, 3)]
    at = lambda i: ratio[where[min(max(i, 0), len(where) - 1)]]
    fused = [math.sqrt(at(i) * sum(w * at(i + k - 2) for k, w in enumerate(weight)) / sum(weight)) for i in range(len(where))]
    score = h.path_scores(paths, found)
    lower = {"main/p": 1, "main/div": (1 / 2) ** 2, "main/ul/li": 0.3, "p": 0.3}
    for b, w in zip(found, where):
        assert score[b.path] == pytest.approx(mean([f for f, x in zip(fused, where) if x == w]) * lower[w])


def test_paths_decide_on_the_table_without_the_word_lists(monkeypatch):
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    usual = [h.main_text(x) for x in pages]
    monkeypatch.setattr(h, "HARD", frozenset())
    monkeypatch.setattr(h, "SOFT", frozenset())
    assert sum(h.main_text(x) == u for x, u in zip(pages, usual)) > 0.9 * len(pages)

import html
import re

import pytest

from eventloom.llm.dom import read_page
from eventloom.llm.html_content import extract_text, labelled_pages, main_text, marginals, shown_document, train

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    pages, docs = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("pages", "documents"))
    return train(labelled_pages(pages, docs))


def article(source):
    inner = re.search(r"(?s)<article>(.*)</article>", source)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_all_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(pages, model).collect()}
    for page in pages.collect():
        text = article(page.html)
        assert got[page.page_id] == (text, len(text))


def test_what_is_no_content(model):
    source = """<!doctype html><html><head><title>t</title><script>if (a < b) "<p>no</p>"</script><body><header><h1>Site</h1><nav><a href=/>Home</a>
      </nav></header><main><article><h1>Storm at  sea</h1><p>The ship &amp; the crew<br>were lost.<p>Short.<ul><li>one thing<li>two things</ul>
      <aside><p>Read also our other story.</p></aside><!-- <p>never</p> --><p>The end &mdash; was <b>n</b>ear.</article>
      <section id="comments"><h2>3 comments</h2><p>I disagree with every word of this, which is silly.</p></section></main>
      <aside class="sidebar"><p>Popular stories that you may like.</p></aside><div class="cookie-notice">We use cookies.</div>
      <form><p>Sign up for news</p><textarea>write here</textarea></form><div class="ad">Buy now, it is cheap.</div>
      <style>p {}</style><footer>(c) me</footer>"""
    assert main_text(source, model).split("\n\n") == [
        "Storm at sea", "The ship & the crew were lost.", "Short.", "one thing", "two things", "The end — was near."]


def test_pages_without_usual_marks(model):
    assert main_text("<p>Just a paragraph.</p><p>And a second one.</p>", model) == "Just a paragraph.\n\nAnd a second one."
    assert main_text("plain text only", model) == "plain text only"
    assert main_text("<div class='advert'>Buy now, it is cheap.</div>", model) == ""
    assert main_text('<div id="content"><h2>Title</h2><div>One part of it</div><table><tr><td>a cell<td>another</table></div>', model) == (
        "Title\n\nOne part of it\n\na cell\n\nanother")


def test_tree():
    page = read_page("<ul><li>a<li>b<ul><li>c</ul></ul><p>d<div>e</p>f</div></nav>g<img alt='>'><br/>h < i &lt;b&gt;")
    assert page.runs == [(2, "a"), (3, "b"), (5, "c"), (6, "d"), (7, "e"), (7, "f"), (0, "g h < i <b>")]
    assert [page.tags[i] for i in range(1, 8)] == ["ul", "li", "li", "ul", "li", "p", "div"]
    assert read_page("").runs == [] and read_page("<!-- never closed").runs == []
    assert read_page("<head><p>x").runs == [(1, "x")]


def test_marginals_are_those_of_all_labellings(model):
    """Sum-product against the sum over every labelling of a small tree."""
    from itertools import product
    from math import exp

    from eventloom.llm.html_content import _features, _in_parent

    page = read_page('<div class="content"><h1>A title</h1><p>Some text.</p></div><nav><ul><li><a>x</a></ul></nav>')
    n, within = len(page.tags), _in_parent(page, model)
    own = [exp(max(-30, min(30, sum(model["odds"].get(f, 0.0) for f in places)))) for places in _features(page)]
    total, content = 0.0, [0.0] * n
    for labels in product((0, 1), repeat=n):
        p = model["root"] if labels[0] else 1 - model["root"]
        for i, label in enumerate(labels):
            p *= own[i] if label else 1.0
            if i:
                share = within[i][labels[page.parents[i]]]
                p *= share if label else 1 - share
        total += p
        for i, label in enumerate(labels):
            content[i] += p * label
    assert marginals(page, model) == pytest.approx([c / total for c in content], rel=1e-6, abs=1e-9)


def test_nulls_long_pages_and_clashing_columns(spark, model):
    long = "<article>" + "<p>A line of it.</p>" * 30_000 + "</article>"
    deep = "<div>" * 20_000 + "x"
    rows = [(1, "http://a/1", None), (1, None, ""), (None, "u", "<article><p>Same.</p></article>"), (None, "u", "<article><p>Same.</p></article>"),
            (4, "u", long), (5, "u", deep)]
    pages = spark.createDataFrame([(*r, "text", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = extract_text(pages, model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((str(r.page_id), r.url, r.n_chars) for r in out.collect() if r.page_id != 5 and r.url)
    assert got == [("1", "http://a/1", 0), ("4", "u", 30_000 * 13 + 29_999 * 2), ("None", "u", 5), ("None", "u", 5)]
    assert extract_text(pages.limit(0), model).count() == 0
    assert train(pages.select("html", "text").limit(0))["root"] == train(None)["root"]


def test_document_numbers_in_urls(spark):
    urls = ["http://a.b/en/25#top", "https://a/fr/825?page=2", "https://a/853/", "https://a/148.html", "https://a/x", "no", None, "http://1/?q=5"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", shown_document("url").alias("n"))
    assert [r.n for r in df.orderBy("i").collect()] == [25, 825, 853, 148, None, None, None, None]

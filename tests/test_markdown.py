import random
import re

from pyspark.sql import functions as F

from eventloom.operators import discovery
from eventloom.sources import html_feeds
from eventloom.sources.markdown import to_markdown


def test_structure():
    assert to_markdown("<h2>Two <b>words</b></h2>text <i>it</i> <code>a_b*c</code> a_b*") == "## Two **words**\n\ntext *it* `a_b*c` a\\_b\\*"
    assert to_markdown("one<br>two<hr>three") == "one  \ntwo\n\n---\n\nthree"
    assert to_markdown('<a href="/x">y</a> <a href="http://a.b/c_d">http://a.b/c_d</a> <a>z</a> <a href="/e"> </a>!') == "[y](/x) <http://a.b/c_d> z !"
    assert to_markdown("<pre>a\n  b *c*</pre><p>d") == "```\na\n  b *c*\n```\n\nd"
    assert to_markdown("<blockquote><p>a<p>b</blockquote>") == "> a\n>\n> b"


def test_lists_and_tables():
    assert to_markdown("<ul><li>a<ul><li>b<ol start=4><li>c<li>d</ol></ul><li>e</ul>") == "* a\n  + b\n    4. c\n    5. d\n* e"
    assert to_markdown("<ol><li><p>a</p><p>b</p></li></ol>") == "1. a\n\n   b"
    assert to_markdown("<table><thead><tr><th>x<th>y</thead><tr><td>1|2<td>3 <br> 4</table>") == "| x | y |\n| --- | --- |\n| 1\\|2 | 3 4 |"
    assert to_markdown("<li>alone<td>cell") == "* alone cell"


def test_broken_pages():
    assert to_markdown("<p><b>bold<br><p>next</i></div>") == "**bold**\n\nnext"
    assert to_markdown("") == "" and to_markdown("a < b &amp; c &lt;d&gt;") == "a < b & c <d>"
    assert to_markdown("<div>" * 3000 + "deep") == "deep"
    assert to_markdown("<img src=x alt=y><script>z</script><p>w<!-- v -->") == "w"


def test_any_page_keeps_its_words_and_loses_its_tags():
    rnd = random.Random(2)
    tags = ["p", "div", "b", "i", "h1", "h3", "ul", "ol", "li", "table", "tr", "td", "blockquote", "a", "span", "pre", "br", "hr", "section"]
    for _ in range(400):
        words, source = [], []
        for n in range(rnd.randrange(1, 40)):
            if rnd.random() < 0.5:
                tag = rnd.choice(tags)
                source.append(f"<{'/' * (rnd.random() < 0.4)}{tag}>")
            else:
                words.append(f"w{n}x")
                source.append(rnd.choice(["", " ", "\n"]) + words[-1] + " ")
        made = to_markdown("".join(source))
        kept = re.findall(r"w\d+x", made)
        if "<t" in "".join(source):  # cells end before the text around them does
            assert sorted(kept) == sorted(words)
        else:
            assert kept == words
        assert "\n\n\n" not in made and not re.search(r"</?\w", made) and made == made.strip()


def test_pages_are_cut_and_marked(spark):
    pages = ["<body><nav>n</nav><h1>Title</h1><header>h</header><p>text</p><aside>a</aside></body>", None, "<p>" + "x" * 300_000 + "</p>"]
    raw = spark.createDataFrame([(i, p, "m") for i, p in enumerate(pages)], "page int, content string, made string")
    out = html_feeds.clean_markdown(raw, "content", max_chars=9)
    assert out.columns == raw.columns
    assert [r.content for r in out.orderBy("page").collect()] == [
        "# Title\n\n\n\n<!-- truncated -->", "", "xxxxxxxxx\n\n<!-- truncated -->"]
    whole = html_feeds.clean_markdown(raw, "content").orderBy("page").collect()
    assert whole[0].content == "# Title\n\ntext" and len(whole[2].content) == 300_000
    assert html_feeds.clean_markdown(raw.limit(0), "content").count() == 0


def test_the_model_budget_goes_to_the_best_scores(spark):
    rows = [("a", f"d{i}", s, i % 2 == 0) for i, s in enumerate([5, 9, 9, None, 7, 9, 1])] + [(None, "n1", 3, False), (None, "n2", 4, False)]
    domains = spark.createDataFrame(rows, "city string, domain string, score long, structured boolean").withColumn("changed", F.lit(True))
    found = discovery.budgeted_domains(domains, "changed", "structured", 1)
    assert found.columns == [*domains.columns, "reading"]
    assert {r.domain for r in found.filter("reading = 'model'").collect()} == {"d1", "n2"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    none = discovery.budgeted_domains(domains, "changed", "structured", 0).filter("reading = 'model'")
    assert none.count() == 0

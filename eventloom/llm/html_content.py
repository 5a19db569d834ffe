"""Main text of web pages by a tree-structured graphical model.

1. A page becomes a tree of block elements (`dom.py`). Every node is content or not.
2. A node's own potential comes from what is seen of it: the words of its class, id and role, how much
   text it holds itself, how much of that is links, and whether it ends like a sentence. The potential
   between parent and child says how often a node of that tag, in a parent of that tag, is content when the
   parent is, and when it isn't; pairs of tags that are seldom seen lean on the child's tag, and that on all.
   Siblings that look alike are no evidence by themselves: together they weigh as much as one.
3. Messages pass up the tree and down again (sum-product), which on a tree gives every node's exact
   marginal. The text runs of the nodes that are likelier content than not are the page's text.

Potentials are counts over labelled pages, smoothed: a table of (html, text) rows, of which `SAMPLE_PAGES`
at most are used, and a small set of written examples of what such a table may not hold (sidebars,
notices, forms, comments). A run of a labelled page is content if it is a line of its text, or a long part
of one. A container is content if it holds any. Both kinds of labelled pages count alike in the whole,
however many there are of each. Features are hashed into `FEATURES` places, which
bounds the model.

Nulls and ties: a null page counts as empty, and a page without content has an empty text. Labelled rows
in which either side is null teach nothing. Equal urls and ids are no matter: rows are judged one by one.
A node that is exactly as likely content as not is content. An empty table gives an empty table. Memory
follows the longest page.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import by_bytes, cut
from .dom import Page, read_page

#: Labelled pages that are learned from, those of the least hash.
SAMPLE_PAGES = 400
#: Places that features are hashed into.
FEATURES = 1 << 18
#: Places of all nodes, of roots, and of nodes in a parent that is no content and in one that is.
NODES, ROOTS, IN_PARENT = FEATURES, FEATURES + 1, (FEATURES + 2, FEATURES + 3)
#: Times every written part comes up, each time with other texts and in other surroundings.
EXAMPLE_ROUNDS = 6
#: Weight, in nodes, of what a pair of tags, and a tag, lean on.
LEAN = 4.0
#: Characters of a line from which a part of it counts as the line.
PART_CHARS = 40
#: The first letter of each text between tags.
_LETTER = re.compile(r"(?<=>)[^<>\s](?=[^<>]*<)")


def _mark(inner: str) -> str:
    return f"<!--+-->{inner}<!---->"


_MARKS = re.compile(r"<!--([+]?)-->")
#: Texts of the examples, of all lengths, so that it is place and names that tell.
SENTENCES = [
    "The river rose again in the night, and by noon the lower road was closed to all but carts.", "Nobody had seen the letter",
    "It was the third winter of the new bridge. Ships passed under it at all hours, and the keeper wrote down every one of them, by "
    "name and by hour, in a book that nobody asked for until the lawsuit came.", "They left early; the others stayed!", "What now?",
    "All shops are open until six, the market until noon", "One hour from the station by foot.", "first", "Thank you very much",
]
SHORTS = ["It rained.", "one thing", "Two", "See below", "Yes!", "In the year 1874", "Salt and bread, twice a day"]
#: Written examples: (parts of a page that are content, parts that are not), each part one way of writing it.
CONTENT_PARTS = [
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<article><section>{}</section></article>",
    '<div class="content">{}</div>', '<div id="main" class="post body">{}</div>', '<section class="entry text">{}</section>',
    '<div class="article story"><div>{}</div></div>',
]
WRAPPERS = [
    "<div>{}</div>", '<div id="page">{}</div>', '<div class="wrapper"><div class="container">{}</div></div>', '<div class="site layout">{}</div>',
    '<div class="row"><div class="col">{}</div></div>', "<table><tr><td>{}</td></tr></table>", '<section class="inner">{}</section>',
]
CONTENT_INSIDE = [
    "<h2>{k}</h2><div>{s}</div><div>{k}</div><div>{s} {s}</div>", "<h2>Title</h2>{s}<h3>Part</h3>{s} {s}", "<h3>Title</h3><p>{s}</p><h4>Part</h4><p>{k}</p>",
    "<h1>Title</h1><p>{s}</p><p>{s}</p>", "<h1>{s}</h1><p>{s}</p><p>{k}</p>", "<p>{s}</p><ul><li>{s}</li><li>{k}</li></ul>",
    "<h2>Part</h2><p>{k}</p><blockquote><p>{s}</p></blockquote>", "<p>{s}</p><table><tr><td>{k}</td><td>12</td></tr></table>",
    "<h1>Title</h1><p>{k}</p>", "<p>{s} {s} {s}</p><pre>{s}</pre><p>{k}</p>", "<h1>Title</h1><ol><li>{k}</li><li>{k}</li></ol><p>{s}</p>",
    "<p>{s}</p><figure><figcaption>{k}</figcaption></figure><dl><dt>Word</dt><dd>{s}</dd></dl>",
]
OTHER_PARTS = [
    '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>', '<ul class="menu"><li><a href="/">Home</a></li></ul>',
    '<div id="menu" role="navigation"><a href="/">Home</a> <a href="/b">Blog</a></div>', "<header><h1>Site</h1><p>{s}</p></header>",
    '<div class="header top"><h2>Site</h2><p>{k}</p></div>', '<div class="breadcrumb"><a href="/">Home</a> / <a href="/n">News</a></div>',
    "<footer><p>{s}</p><ul><li><a href='/i'>Imprint</a></li></ul></footer>", '<div id="footer">&copy; 2020 {k}</div>',
    '<aside><h3>More</h3><ul><li><a href="/1">{s}</a></li></ul><p>{s}</p></aside>', '<div class="sidebar"><p>{s}</p><p>{k}</p></div>',
    '<div class="related"><h3>Related</h3><ul><li><a href="/2">{s}</a></li></ul></div>', '<div class="widget side"><p>{k}</p></div>',
    '<div class="cookie notice"><p>{s}</p></div>', '<div id="cookie-banner" role="alert">{s}</div>', '<div class="consent popup modal">{s}</div>',
    '<div class="notice">{s}</div>', '<div class="ad">{s}</div>', '<div class="ads advert banner"><p>{s}</p></div>',
    '<div class="sponsored promo advertisement">{s} {k}</div>', '<section class="newsletter subscribe"><p>{s}</p></section>',
    "<form><p>{s}</p><fieldset><legend>Name</legend></fieldset></form>", '<form class="search">Search</form>', '<form id="login">{k}</form>',
    '<section id="comments"><h2>2 comments</h2><div class="comment"><p>{s}</p></div><div class="comment"><p>{s} {s}</p></div></section>',
    '<div class="comments"><ol><li class="comment reply"><p>{s}</p></li><li class="comment"><p>{k}</p></li></ol></div>',
    '<div class="share social"><a href="/s">Share</a></div>', "<menu><li><a href='/e'>Edit</a></li></menu>",
    "<dialog><p>{s}</p></dialog>", '<div class="pagination pager"><a href="/2">Next</a></div>', "<search>{k}</search>",
]


def examples() -> Iterator[str]:
    """Pages in which the content is marked by comments, made by pairing every way of writing with the others."""
    for i in range(EXAMPLE_ROUNDS * len(OTHER_PARTS)):
        fill = {"s": SENTENCES[i * 5 % len(SENTENCES)], "k": SHORTS[i * 3 % len(SHORTS)]}
        outer, inner = CONTENT_PARTS[i % len(CONTENT_PARTS)], CONTENT_INSIDE[i % len(CONTENT_INSIDE)]
        content = _mark(outer.format(inner.format(**fill)))
        rest = OTHER_PARTS[i % len(OTHER_PARTS)].format(s=SENTENCES[i * 4 % len(SENTENCES)], k=SHORTS[i * 2 % len(SHORTS)])
        more = OTHER_PARTS[(i * 7 + 3) % len(OTHER_PARTS)].format(s=SENTENCES[(i + 1) % len(SENTENCES)], k=SHORTS[(i + 2) % len(SHORTS)])
        inside = _mark(outer.format(inner.format(**fill)).replace("</p>", f"</p><!---->{rest}<!--+-->", 1))
        wrapper = WRAPPERS[i % len(WRAPPERS)]
        yield f"<html><body>{rest}{content}{more}</body></html>"
        yield f"<html><body>{more}{wrapper.format(content + rest)}</body></html>"
        yield f"<html><body>{wrapper.format(rest + content + more)}</body></html>"
        yield f"<html><body>{inside}{more}</body></html>"


def _labelled_example(source: str) -> tuple[Page, list[bool]]:
    """The page of an example and which of its runs are content."""
    marked, parts = [], _MARKS.split(source)
    for i in range(0, len(parts), 2):
        on = i > 0 and parts[i - 1] == "+"
        marked.append(_LETTER.sub(lambda m: "\x01" + m[0], parts[i]) if on else parts[i])
    page = read_page("".join(marked))
    content = [text.startswith("\x01") for _, text in page.runs]
    page.runs = [(node, text.replace("\x01", "")) for node, text in page.runs]
    return page, content


def _place(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


def _features(page: Page) -> list[list[int]]:
    """The places of each node's features."""
    n = len(page.tags)
    chars, linked, ends = [0] * n, [0] * n, [False] * n
    for (node, text), links in zip(page.runs, page.linked):
        chars[node] += len(text)
        linked[node] += links
        ends[node] = text[-1] in ".!?:;…\"”»)"
    out, places = [], {}

    def place(feature: str) -> int:
        if feature not in places:
            places[feature] = _place(feature)
        return places[feature]

    for i in range(n):
        links = 4 * linked[i] // chars[i] if chars[i] else 0
        out.append([place(f"text {min(chars[i].bit_length(), 12)} {links} {ends[i]}"), *(place("name " + w) for w in page.names[i])])
    return out


def _labels(page: Page, content: list[bool]) -> list[int]:
    """Each node's label: whether any text in it is content; -1 where there is no text."""
    labels = [-1] * len(page.tags)
    for (node, _), is_content in zip(page.runs, content):
        labels[node] = max(labels[node], int(is_content))
    for i in range(len(page.tags) - 1, 0, -1):
        labels[page.parents[i]] = max(labels[page.parents[i]], labels[i])
    return labels


def _tally(page: Page, content: list[bool], counts: dict) -> None:
    """Add a labelled page: features by label, labels by the parent's label."""
    labels = _labels(page, content)
    for i, places in enumerate(_features(page)):
        if labels[i] < 0:
            continue
        own = [*places, NODES]
        if i:
            above = labels[page.parents[i]]
            own += [IN_PARENT[above], *(_place(f"{above} {name}") for name in _edges(page, i))]
        else:
            own.append(ROOTS)
        for place in own:
            counts[place, labels[i]] = counts.get((place, labels[i]), 0) + 1


def _edges(page: Page, i: int) -> tuple[str, str]:
    """What a node's potential with its parent is looked up by, the wider first."""
    tag = page.tags[i]
    return f"in any {tag}", f"in {page.tags[page.parents[i]]} {tag}"


def _matches(page: Page, text: str) -> list[bool]:
    """Which runs are lines of a text, or long parts of one."""
    lines = [" ".join(line.split()) for line in text.split("\n")]
    whole, joined = set(lines), "\n".join(lines)
    return [run in whole or len(run) >= PART_CHARS and run in joined for _, run in page.runs]


def _tallier(batches):
    counts: dict = {}
    for batch in batches:
        for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = read_page(source)
            _tally(page, _matches(page, text), counts)
    keys = list(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
         pa.array([counts[k] for k in keys], pa.int64())], names=["place", "label", "n"])


def train(labelled: DataFrame | None, html_col: str = "html", text_col: str = "text", sample_pages: int = SAMPLE_PAGES) -> dict:
    """The model: log odds of every place, smoothed shares of labels by the parent's label.

    At most `sample_pages` rows are used; what reaches the driver is one count per place and label.
    """
    counts: dict = {}
    for source in examples():
        _tally(*_labelled_example(source), counts)
    if labelled is None:
        return _model(counts)
    pairs = labelled.select(F.col(html_col).alias("_html"), F.col(text_col).alias("_text")).dropna()
    sample = least_hashed(pairs, ["_html", "_text"], sample_pages)
    sums = sample.mapInArrow(_tallier, "place int, label int, n long").groupBy("place", "label").agg(F.sum("n").alias("n"))
    return _model(counts, {(row.place, row.label): row.n for row in sums.collect()})


def least_hashed(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Of the rows that differ in some columns the `n` of the least hash; only hashes are sorted for that."""
    hashed = rows.withColumn("_hash", F.xxhash64(*columns))
    most = hashed.select("_hash").distinct().orderBy("_hash").limit(n).agg(F.max("_hash").alias("most")).first().most
    return hashed.filter(F.col("_hash") <= F.lit(most)).dropDuplicates(["_hash"]).drop("_hash")


def _model(examples: dict, given: dict | None = None) -> dict:
    """Counts (not content, content) of every place seen; the examples count as much as the given pages."""
    given, seen = given or {}, {}
    size = lambda counts: sum(counts.get((NODES, label), 0) for label in (0, 1))
    weight = max(1.0, size(given) / size(examples))
    for counts, times in ((examples, weight), (given, 1.0)):
        for (place, label), n in counts.items():
            seen.setdefault(place, [0.0, 0.0])[label] += n * times
    no, yes = seen[NODES]
    odds = {place: math.log((n[1] + 0.5) / (yes + 1) * (no + 1) / (n[0] + 0.5)) for place, n in seen.items()}
    share = lambda place: (seen.get(place, (0, 0))[1] + 1) / (sum(seen.get(place, (0, 0))) + 2)
    return {"odds": odds, "seen": seen, "below": [share(place) for place in IN_PARENT], "root": share(ROOTS)}


def _in_parent(page: Page, model: dict) -> list[tuple[float, float]]:
    """For every node the probability to be content in a parent that is none, and in one that is."""
    known: dict = {}

    def look(names: tuple[str, str]) -> tuple[float, float]:
        out = []
        for above in (0, 1):
            p = model["below"][above]
            for name in names:
                no, yes = model["seen"].get(_place(f"{above} {name}"), (0.0, 0.0))
                p = (yes + LEAN * p) / (no + yes + LEAN)
            out.append(min(max(p, 1e-6), 1 - 1e-6))
        return tuple(out)

    table = [(0.5, 0.5)]
    for i in range(1, len(page.tags)):
        names = _edges(page, i)
        if names not in known:
            known[names] = look(names)
        table.append(known[names])
    return table


def marginals(page: Page, model: dict) -> list[float]:
    """The probability of each node to be content, by messages up the tree and down again."""
    n = len(page.tags)
    odds, parents, within = model["odds"], page.parents, _in_parent(page, model)
    # Potentials as shares of both labels; products are scaled so that nothing runs out of range.
    up1, looks = [], [(p, tag, *own) for p, tag, own in zip(parents, page.tags, _features(page))]
    alike = Counter(looks)
    for look in looks:
        x = max(-30.0, min(30.0, sum(odds.get(place, 0.0) for place in look[2:]) / alike[look]))
        up1.append(1.0 / (1.0 + math.exp(-x)))
    up0 = [1.0 - p for p in up1]
    sent1, sent0 = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        in0, in1 = within[i]
        a, b = (1 - in0) * up0[i] + in0 * up1[i], (1 - in1) * up0[i] + in1 * up1[i]
        sent0[i], sent1[i] = a / (a + b), b / (a + b)
        p = parents[i]
        a, b = up0[p] * sent0[i], up1[p] * sent1[i]
        up0[p], up1[p] = a / (a + b), b / (a + b)
    out0, out1 = [0.0] * n, [0.0] * n
    a, b = up0[0] * (1 - model["root"]), up1[0] * model["root"]
    out0[0], out1[0] = a / (a + b), b / (a + b)
    for i in range(1, n):
        in0, in1 = within[i]
        p = parents[i]
        # What the parent believes without this child's own message.
        a, b = out0[p] / sent0[i], out1[p] / sent1[i]
        a, b = a / (a + b), b / (a + b)
        a, b = up0[i] * ((1 - in0) * a + (1 - in1) * b), up1[i] * (in0 * a + in1 * b)
        out0[i], out1[i] = a / (a + b), b / (a + b)
    return out1


def main_text(source: str | None, model: dict) -> str:
    """The text of a page's content, its runs in page order, two line feeds between them."""
    if not source:
        return ""
    page = read_page(source)
    if not page.runs:
        return ""
    likely = marginals(page, model)
    return "\n\n".join(text for node, text in page.runs if likely[node] >= 0.5)


def _extractor(model: dict):
    def extract(batches):
        for whole in batches:
            for batch in by_bytes(whole, 2):
                texts = [main_text(source, model) for source in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["_id", "_url", "text", "n_chars"])

    return extract


def extract_text(pages: DataFrame, model: dict, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, `text` and `n_chars`."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    schema = T.StructType([rows.schema["_id"], rows.schema["_url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(_extractor(model), schema).select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")


def shown_document(url: Column) -> Column:
    """The number a page's path ends with: that of the document it shows; null if there is none."""
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*/([^?#]*)", 1)
    return F.regexp_extract(path, r"(\d{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long")


def labelled_pages(pages: DataFrame, docs: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(html, text) of pages and the documents that their urls number, `sample_pages` at most.

    The ids of these few pages reach the driver, so that the documents are read by a pushed-down filter.
    """
    found = pages.select("html", shown_document(F.col("url")).alias("_doc")).dropna()
    sample = cut(least_hashed(found, ["html", "_doc"], sample_pages))
    ids = sorted({row._doc for row in sample.select("_doc").collect()})
    texts = docs.filter(F.col("doc_id").isin(ids)).select(F.col("doc_id").alias("_doc"), "text").dropDuplicates(["_doc"])
    return sample.join(texts, "_doc").select("html", "text")

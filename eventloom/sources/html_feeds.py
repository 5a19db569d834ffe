"""Feeds landed as HTML pages.

Partitions of landed pages go through `mapInArrow`, one page to many small rows; filters
on other columns belong before these calls, since Spark does not move them inside.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import vocab
from ..functions import dates, predicates
from ..functions.text import clean, present
from ..functions.urls import url_join
from ..operators.ranking import drop_repeats, last_n
from ..schemas import arrival, card_columns
from . import htmltree
from .markdown import to_markdown

#: Characters of pages that are converted before they are passed on.
BATCH_CHARS = 4_000_000
KEPT = ["source", "city", "url", "page"]


def short_runs(batch: pa.RecordBatch, place: int):
    """A batch in runs of rows whose texts in one column have `BATCH_CHARS` characters together, or of one longer row."""
    sizes = pc.utf8_length(batch.column(place)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    first = 0
    while first < batch.num_rows:
        most = (sizes[first - 1] if first else 0) + BATCH_CHARS
        last = max(first + 1, int(sizes.searchsorted(most, "right")))
        yield batch.slice(first, last - first)
        first = last


def map_pages(raw: DataFrame, read, layout: str) -> DataFrame:
    """Apply `read(html) -> rows` to each page; rows keep the page's columns and get `pos`.

    Batches are cut into short runs, whose rows are passed on before the next one is read, so that memory
    follows the longest page.
    """
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string())}
    fields = [part.split() for part in layout.split(", ")]
    names, types = ["pos", *[name for name, _ in fields]], [pa.int64(), *[kinds[kind] for _, kind in fields]]

    def run(batches):
        for batch in batches:
            for part in short_runs(batch, len(KEPT)):
                at, found = [], []
                for place, html in enumerate(part.column(len(KEPT)).to_pylist()):
                    for pos, values in enumerate(read(html)):
                        at.append(place)
                        found.append((pos, *values))
                pages = [part.column(i).take(pa.array(at, pa.int64())) for i in range(len(KEPT))]
                rows = zip(*found) if found else [()] * len(names)
                made = [pa.array(list(values), kind) for values, kind in zip(rows, types)]
                yield pa.RecordBatch.from_arrays([*pages, *made], names=[*KEPT, *names])

    schema = f"source string, city string, url string, page bigint, pos bigint, {layout}"
    pages = raw.select(
        *KEPT[:3], F.col("page").cast("bigint").alias("page"), F.coalesce("content", F.lit("")).alias("content"))
    return pages.mapInArrow(run, schema)


def playbill_cards(
    raw: DataFrame, event_type: str, venue_name: str, address: str, as_of: Column,
    marks: dict = vocab.PLAYBILL_MARKS,
) -> DataFrame:
    """Month pages of a theatre: cards of HTML inside a JSON field; past shows are dropped."""

    def read(html):
        for card in htmltree.parse(html).all("article", data_element=marks["card"]):
            stamp = card.first("link", data_element=marks["date"])
            link = next(
                (a for a in card.all("a") if marks["path"] in (a.attrs.get("href") or "")), None
            )
            if link is None:
                continue
            picture = card.first("img")
            yield (
                stamp.attrs.get("content") if stamp else None,
                card.attrs.get(marks["fallback_date"]),
                " ".join(link.text().split()),
                link.attrs.get("href"),
                picture.attrs.get("src") if picture else None,
            )

    pages = raw.withColumn("content", F.get_json_object("content", "$.content"))
    cards = map_pages(
        pages, read, "stamp string, fallback string, title string, href string, image string"
    )
    timed = F.col("stamp").contains("T")
    date = F.when(timed, F.split_part("stamp", F.lit("T"), F.lit(1))).otherwise(F.col("fallback"))
    clock = F.when(timed, present(F.substring(F.substring_index("stamp", "T", -1), 1, 5)))
    kept = cards.withColumn("_date", date).withColumn("_time", clock).filter(
        present(F.col("title")).isNotNull() & present(F.col("href")).isNotNull()
        & present(F.col("_date")).isNotNull() & ~predicates.is_past(F.col("_date"), as_of)
    )
    kept = drop_repeats(kept.withColumn("seq", arrival("page", "pos")), ["source", "city", "href"], "seq")
    return kept.select(
        *card_columns({
            "title": F.substring("title", 1, vocab.TITLE_LENGTH),
            "type": F.lit(event_type),
            "date": F.col("_date"),
            "time_start": F.col("_time"),
            "venue_name": F.lit(venue_name),
            "address": F.lit(address),
            "price_min": F.lit(0),
            "price_max": F.lit(0),
            "price_text": F.lit(vocab.PRICE_BY_TICKET),
            "image_url": F.col("image"),
            "organizer": F.lit(venue_name),
        }),
        "source", "city", F.col("href").alias("source_url"), "seq",
    )


def channel_posts(raw: DataFrame, count: int | None = None, classes: dict = vocab.CHANNEL_CLASSES) -> DataFrame:
    """Channel pages to posts, with `count` the last ones of each channel; posts without text or link go."""

    def read(html):
        for message in htmltree.parse(html).all(cls=classes["message"]):
            body = message.first(cls=classes["text"])
            text = body.text("\n", strip=True) if body else ""
            link = message.first("a", cls=classes["link"])
            href = link.attrs.get("href") if link else None
            if text and href:
                stamp = message.first("time")
                yield text, href, stamp.attrs.get("datetime") if stamp else None

    posts = map_pages(raw, read, "text string, href string, stamp string")
    kept = last_n(posts, ["source", "city", "url"], ["page", "pos"], count)
    return kept.select(
        "source", "city", F.col("url").alias("group_url"), "text", F.col("href").alias("url"),
        dates.iso_to_unix(F.col("stamp")).alias("date_unix"), arrival("page", "pos"),
    )


def background_image(style: Column) -> Column:
    """Picture of a CSS background: the double-size one if given, else the first."""
    url = r"""url\(["']?(https://[^"')\s]+)["']?\)"""
    return F.coalesce(
        present(F.regexp_extract(style, url + r"\s*2x", 1)), present(F.regexp_extract(style, url, 1))
    )


def address_line(lines: Column) -> Column:
    """The first line that is an address: branch counts cut off, opening hours skipped."""
    trimmed = F.transform(
        lines, lambda l: F.trim(F.regexp_replace(l, f"(?U){vocab.BRANCH_SUFFIX_PATTERN}", ""))
    )
    kept = F.filter(trimmed, lambda l: (l != "") & ~predicates.is_status_line(l))
    return F.try_element_at(kept, F.lit(1))


def venue_cards_html(
    raw: DataFrame, event_type: Column | str, classes: dict = vocab.VENUE_CARD_CLASSES
) -> DataFrame:
    """Place search pages: name, address and picture of each card, repeats dropped."""

    def read(html):
        for card in htmltree.parse(html).all("div", cls=classes["card"]):
            link = card.first("a", cls=classes["link"])
            picture = card.first("div", cls=classes["image"])
            yield (
                link.text(strip=True).replace("\xa0", " ").strip() if link else None,
                [
                    line.text(strip=True).replace("\xa0", " ").strip()
                    for line in card.all("div", cls=classes["address"])
                ],
                picture.attrs.get("style") if picture else None,
            )

    cards = map_pages(raw, read, "name string, lines array<string>, style string")
    kept = cards.withColumn("_address", address_line(F.col("lines"))).filter(
        clean(F.col("name")).isNotNull() & F.col("_address").isNotNull()
    )
    kept = kept.withColumn("seq", arrival("page", "pos"))
    kept = drop_repeats(kept, ["source", "city", "url", "name", "_address"], "seq")
    return kept.select(
        *card_columns({
            "title": F.col("name"),
            "type": F.lit(event_type) if isinstance(event_type, str) else event_type,
            "date": F.lit(vocab.ALWAYS),
            "price_min": F.lit(0),
            "price_max": F.lit(0),
            "price_text": F.lit(vocab.PRICE_BY_VENUE),
            "address": F.col("_address"),
            "venue_name": F.col("name"),
            "image_url": background_image(F.col("style")),
        }),
        "source", "city", F.col("url").alias("source_url"), "seq",
    )


# The entities that occur in links; `&amp;` is resolved last so that nothing is read twice.
_LINK_ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def page_links(html: Column) -> Column:
    """Targets of all anchors of a page, in page order, as written."""
    live = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>", "")
    anchors = F.regexp_extract_all(live, F.lit(r"(?is)<a\s[^>]*>"), F.lit(0))
    attribute = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def target(anchor):
        href = F.concat(*[F.regexp_extract(anchor, attribute, group) for group in (1, 2, 3)])
        for entity, char in _LINK_ENTITIES:
            href = F.replace(href, F.lit(entity), F.lit(char))
        return href

    return F.filter(F.transform(anchors, target), lambda h: h != "")


def listing_links(raw: DataFrame, pattern: str) -> DataFrame:
    """Distinct absolute links of listing pages whose written form matches the pattern."""
    found = F.filter(page_links(F.col("content")), lambda h: h.rlike(pattern))
    links = raw.select(
        "source", "city", "page", F.col("url").alias("_base"), F.posexplode(found).alias("pos", "href")
    ).select(
        "source", "city", F.col("_base").alias("listing_url"),
        url_join(F.col("_base"), F.col("href")).alias("url"),
        arrival("page", "pos"),
    )
    return drop_repeats(links, ["source", "city", "listing_url", "url"], "seq")


def clean_html(
    pages: DataFrame, column: str, dropped: list[str] = vocab.HTML_DROPPED_TAGS, max_chars: int | None = None
) -> DataFrame:
    """Replace page source by what matters for extraction: its body without some elements.

    An element that is opened and never closed costs its tag only. With `max_chars` text beyond
    is cut and marked as cut; the uncut page stays in the raw archive.
    """
    names = "|".join(dropped)
    # An element goes with its content up to its first end tag; what is left of nested ones are stray tags.
    element = rf"(?is)<({names})\b[^>]*>.*?</\1\s*>"
    bare = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), element, "")
    bare = F.regexp_replace(bare, rf"(?is)</?(?:{names})\b[^>]*>", "")
    body = F.greatest(F.regexp_instr("_text", F.lit(r"(?i)<body\b")), F.lit(1))
    cleaned = pages.withColumn("_text", bare).withColumn("_at", body)
    cleaned = cleaned.withColumn("_text", F.expr("substring(_text, _at)"))
    end = F.length("_text") - F.locate(">ydob/<", F.lower(F.reverse("_text"))) + 1
    whole = F.when(F.lower("_text").contains("</body>"), F.expr("substring(_text, 1, _end)")).otherwise(F.col("_text"))
    cleaned = cleaned.withColumn("_end", end).withColumn("_text", whole)
    return cleaned.withColumn(column, shortened(F.col("_text"), max_chars, vocab.HTML_TRUNCATED)).select(*pages.columns)


def shortened(text: Column, max_chars: int | None, mark: str) -> Column:
    """Text cut after some characters and marked as cut; None cuts nothing."""
    if max_chars is None:
        return text
    return F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit(mark))).otherwise(text)


def clean_markdown(
    pages: DataFrame, column: str, dropped: list[str] = vocab.MARKDOWN_DROPPED_TAGS, max_chars: int | None = None
) -> DataFrame:
    """Replace page source by Markdown of its body without some elements and images; a null page is empty.

    Elements are dropped in the JVM; what is left goes through Python in Arrow batches, cut into runs of
    `BATCH_CHARS`, so that memory follows the longest page.
    """
    place = pages.columns.index(column)

    def convert(batches):
        for batch in batches:
            for part in short_runs(batch, place):
                made = pa.array([to_markdown(html) for html in part.column(place).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [made if i == place else part.column(i) for i in range(part.num_columns)], names=part.schema.names)

    cleaned = clean_html(pages, column, dropped).withColumn(column, F.coalesce(column, F.lit("")))
    made = cleaned.mapInArrow(convert, T.StructType([T.StructField(f.name, f.dataType) for f in cleaned.schema]))
    return made.withColumn(column, shortened(F.col(column), max_chars, vocab.MARKDOWN_TRUNCATED))

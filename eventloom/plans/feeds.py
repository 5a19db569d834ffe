"""One feed from landed input to settled cards.

A feed is lazy: it returns frames, and the job that calls it writes them. Answers of a
model are landed input like any other: a job first writes the documents to ask about, and
a later run reads the answers by document hash or page url.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, predicates, text, urls
from ..operators import cards as card_ops, discovery, posts as post_ops
from ..operators.ranking import number_rows
from ..sources.json_feeds import is_readable_answer, model_responses, unreadable
from ..sources.structured import jsonld_events, structured_or_model
from ..schemas import CARD
from ..session import staged


@dataclass
class FeedRun:
    """Settled cards, the counters they do not tell, and documents to archive.

    `discovered` and `new` say whether those counters follow from the settled cards.
    """

    settled: DataFrame
    extra: list[DataFrame] = field(default_factory=list)
    archive: DataFrame | None = None
    discovered: bool = True
    new: bool = True

    def tally(self, settled: DataFrame | None = None) -> DataFrame:
        """(source, city, counter, n); `settled` is the staged form of the cards, if there is one."""
        counted = count_settled(
            self.settled if settled is None else settled, self.discovered, self.new
        )
        return reduce(DataFrame.unionByName, [counted, *self.extra])


def settle(cards: DataFrame, as_of: Column | None = None, direct: bool = False) -> DataFrame:
    """Checked cards with what becomes of them in `outcome`.

    rejected (`failed` names the rules), past, venue, skipped_always or extracted.
    """
    checked = card_ops.check_cards(cards)
    date, kind, source = F.col("date"), F.col("type"), F.col("source")
    outcome = F.when(F.size("failed") > 0, "rejected")
    if as_of is not None:
        outcome = outcome.when(predicates.is_past(date, as_of), "past")
    if direct:
        outcome = outcome.when(dates.is_always(date), "venue")
    outcome = outcome.when(predicates.is_spurious_always(date, kind, source), "skipped_always")
    kept = [*CARD, "source", "city", "source_url", "seq", "failed"]
    return checked.select(*kept, outcome.otherwise("extracted").alias("outcome"))


def count_as(df: DataFrame, counter: str) -> DataFrame:
    """Rows of a frame counted under a name, per source and city."""
    return df.groupBy("source", "city").agg(
        F.lit(counter).alias("counter"), F.count(F.lit(1)).alias("n")
    )


def count_settled(settled: DataFrame, discovered: bool, new: bool) -> DataFrame:
    """Counters that follow from the settled cards, in one pass."""
    is_extracted = F.col("outcome") == "extracted"
    named = {"extracted": is_extracted, "skipped_always": F.col("outcome") == "skipped_always"}
    if new:
        named["new"] = is_extracted
    if discovered:
        named["discovered"] = F.lit(True)
    wide = settled.groupBy("source", "city").agg(
        *[F.count_if(test).alias(name) for name, test in named.items()]
    )
    return wide.unpivot(["source", "city"], list(named), "counter", "n")


def _failed_pages(raw: DataFrame | None) -> list[DataFrame]:
    return [] if raw is None else [count_as(unreadable(raw), "failed")]


def direct_feed(cards: DataFrame, raw: DataFrame | None = None) -> FeedRun:
    """A feed that gives cards itself: undated ones become venues, the rest events.

    Landed JSON pages given as `raw` that can't be read count as failed.
    """
    return FeedRun(settle(cards, direct=True), _failed_pages(raw))


def group_event_feed(cards: DataFrame, raw: DataFrame | None = None) -> FeedRun:
    """Communities that are events."""
    return FeedRun(settle(cards), _failed_pages(raw))


def post_documents(
    posts: DataFrame, now: Column, hashes: DataFrame | None = None,
    source_type: Column | str = predicates.SOCIAL, size: int = 5, limit: int | None = None,
    staging: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(posts taken, documents to ask about). Documents are keyed by `doc_hash`.

    Posts are numbered page by page, so no group is sorted as a whole. With `staging` the
    posts taken are written there once and read from there after.
    """
    group = ["source", "city", "group_url"]
    taken = post_ops.candidate_posts(posts, now, hashes, source_type, group, limit=limit)
    placed = number_rows(taken, group, "seq", "place", F.col("seq.page"))
    placed = placed.withColumn("chunk", F.floor((F.col("place") - 1) / size))
    placed = staged(placed, staging and f"{staging}/posts")
    documents = post_ops.assemble_posts(placed.drop("chunk"), group, "place", size)
    documents = documents.withColumn("doc_hash", F.sha2("document", 256))
    return placed, documents


def post_feed(
    taken: DataFrame, documents: DataFrame, answers: DataFrame, as_of: Column
) -> FeedRun:
    """Posts with the answers to their documents (doc_hash, content).

    A document without a readable answer counts as failed and its posts are not archived, so
    they are tried again in the next run.
    """
    usable = answers.filter(is_readable_answer(F.col("content"))).select("doc_hash", "content")
    asked = documents.join(usable, "doc_hash", "left")
    answered = asked.filter(F.col("content").isNotNull())
    raw = answered.select(
        "source", "city", F.col("group_url").alias("url"), "content", F.col("chunk").alias("page")
    )
    cards = model_responses(raw).withColumn(
        "source_url", urls.resolve_url(F.col("event_url"), F.col("source_url"))
    )
    settled = settle(cards, as_of)
    key = ["source", "city", "group_url", "chunk"]
    done = taken.join(answered.select(*key), key, "left_semi")
    extra = [
        count_as(taken, "discovered"),
        count_as(asked.filter(F.col("content").isNull()), "failed"),
    ]
    archive = done.select(
        "source", "url", F.col("text").alias("content"), "hash", F.lit("post").alias("content_type")
    )
    return FeedRun(settled, extra, archive, discovered=False)


def listing_feed(
    pages: DataFrame, answers: DataFrame, as_of: Column, hashes: DataFrame | None = None,
    staging: str | None = None,
) -> FeedRun:
    """Listing pages read whole: structured data first, else the landed answer of the page.

    `pages` are landed rows with `event_type` (null: no structured data is tried) and
    `rendered` (hash the visible text only). Unchanged pages are skipped before anything
    is read; pages that gave nothing are not archived. With `staging` the structured cards
    are written there once, so that pages are parsed once.
    """
    hashed = pages.withColumn("hash", text.content_hash(F.col("content"), F.col("rendered")))
    changed = hashed if hashes is None else card_ops.changed_docs(hashed, hashes)
    structured = jsonld_events(
        changed.filter(F.col("event_type").isNotNull()), F.col("event_type")
    )
    structured = staged(structured, staging and f"{staging}/structured")
    usable = answers.filter(is_readable_answer(F.col("content"))).select("url", "content")
    asked = changed.select("source", "city", "url", "page").join(usable, "url")
    both = structured_or_model(structured, model_responses(asked))
    settled = settle(
        both.withColumn("source_url", urls.resolve_url(F.col("event_url"), F.col("source_url"))),
        as_of,
    )
    read = structured.select("source", "city", F.col("source_url").alias("url")).unionByName(
        asked.select("source", "city", "url")
    ).distinct()
    key = ["source", "city", "url"]
    done = changed.join(read, key, "left_semi")
    extra = [count_as(changed.join(read, key, "left_anti"), "failed")]
    archive = done.select("source", "url", "content", "hash", F.lit("html").alias("content_type"))
    return FeedRun(settled, extra, archive)


def per_url_feed(
    found: DataFrame, events: DataFrame, pages: DataFrame, answers: DataFrame
) -> FeedRun:
    """One page and one answer per event url; urls already known are not read again.

    `found` is (url, source, city, seq) of site maps or listings, `pages` and `answers`
    are landed by url. A url without a usable answer counts as failed.
    """
    fresh = card_ops.new_urls(found, events)
    usable = answers.filter(is_readable_answer(F.col("content"), batch=False)).select("url", "content")
    asked = fresh.join(usable, "url", "left")
    raw = asked.filter(F.col("content").isNotNull()).select(
        "source", "city", "url", "content", F.col("seq.page").alias("page")
    )
    settled = settle(model_responses(raw, batch=False))
    ok = settled.filter(F.col("outcome").isin("extracted", "skipped_always"))
    good = ok.select(F.col("source_url").alias("url")).distinct()
    done = settled.filter(F.col("outcome") == "extracted").select(
        F.col("source_url").alias("url")
    ).distinct()
    archive = pages.join(done, "url", "left_semi").select(
        "source", "url", "content", F.lit("html").alias("content_type")
    )
    extra = [
        count_as(found, "discovered"),
        count_as(fresh, "new"),
        count_as(fresh.join(good, "url", "left_anti"), "failed"),
    ]
    return FeedRun(settled, extra, archive, discovered=False, new=False)


def generic_feed(
    candidates: DataFrame,
    probes: DataFrame,
    pages: DataFrame,
    answers: DataFrame,
    hashes: DataFrame,
    now: Column,
    domain_budget: int | None = None,
    model_budget: int | None = None,
    staging: str | None = None,
) -> tuple[FeedRun, DataFrame]:
    """The long tail: one page of each approved domain, with budgets of the best domains only.

    Pages beyond a model budget are counted as `over_budget`; they are read in a later run.
    Returns the feed and the domains with the page chosen for each, for the listing cache.
    Each domain is a source of its own, `generic:{domain}`.
    """
    best = discovery.approved_domains(candidates, domain_budget)
    chosen = discovery.pick_listing_url(best, probes, now)
    # The source names the cards too, so each domain has its own health.
    source = F.concat(F.lit("generic:"), F.col("domain"))
    # Only the chosen pages move and are hashed.
    landed = pages.select(F.col("url").alias("listing_url"), "content").join(
        chosen.select("listing_url").distinct(), "listing_url", "left_semi"
    ).withColumn("hash", F.sha2("content", 256))
    reading = chosen.withColumn("source", source).join(landed, "listing_url", "left")
    same = hashes.select(F.col("url").alias("listing_url"), "hash", F.lit(True).alias("_same"))
    reading = reading.join(same, ["listing_url", "hash"], "left").withColumn(
        "changed", F.col("content").isNotNull() & F.col("_same").isNull()
    )
    raw = reading.filter("changed").select(
        "source", "city", F.col("listing_url").alias("url"), "content", F.col("place").alias("page")
    )
    structured = staged(jsonld_events(raw, "other"), staging and f"{staging}/structured")
    with_data = structured.select(F.col("source_url").alias("listing_url")).distinct().withColumn(
        "_structured", F.lit(True)
    )
    planned = discovery.budgeted_domains(
        reading.join(with_data, "listing_url", "left").withColumn(
            "structured", F.coalesce("_structured", F.lit(False))
        ),
        "changed", "structured", model_budget,
    )
    turns = planned.filter(F.col("reading") == "model").select(
        "source", "city", F.col("listing_url").alias("url"), F.col("place").alias("page"), "content", "hash"
    )
    usable = answers.filter(is_readable_answer(F.col("content"))).select("url", "content")
    asked = turns.drop("content").join(usable, "url")
    cards = structured.unionByName(model_responses(asked.drop("hash")))
    settled = settle(
        cards.withColumn("source_url", urls.resolve_url(F.col("event_url"), F.col("source_url")))
    )
    unread = planned.filter(F.col("content").isNull())
    unanswered = turns.join(asked.select("url"), "url", "left_anti")
    done = planned.filter(F.col("reading") == "structured").select(
        "source", F.col("listing_url").alias("url"), "content", "hash"
    ).unionByName(
        turns.join(asked.select("url"), "url", "left_semi").select("source", "url", "content", "hash")
    )
    extra = [
        count_as(unread, "failed"), count_as(unanswered, "failed"),
        count_as(planned.filter(F.col("reading") == "over_budget"), "over_budget"),
    ]
    archive = done.withColumn("content_type", F.lit("html"))
    return FeedRun(settled, extra, archive), chosen

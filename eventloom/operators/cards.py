"""Cards to rows: validation, routing, keys, links, and the check against what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import dates, predicates, text, types, urls
from ..schemas import EVENT, REQUIRED, VENUE, shape


def failed_rules(df: DataFrame) -> Column:
    """Names of the rules a card breaks."""
    c = F.col
    rules = {f"{name}_missing": c(name).isNull() for name in REQUIRED}
    rules |= {
        "title_length": ~F.length("title").between(3, vocab.TITLE_LENGTH),
        "type_unknown": ~c("type").isin(vocab.EVENT_TYPES),
        "date_format": dates.padded_date(c("date")).isNull() & c("date").isNotNull(),
        "time_start_format": dates.padded_time(c("time_start")).isNull() & c("time_start").isNotNull(),
        "time_end_format": dates.padded_time(c("time_end")).isNull() & c("time_end").isNotNull(),
        "price_min_negative": c("price_min") < 0,
        "price_max_negative": c("price_max") < 0,
        "price_order": c("price_max") < c("price_min"),
        "description_length": F.length("description") > vocab.DESCRIPTION_LENGTH,
    }
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))


def check_cards(cards: DataFrame) -> DataFrame:
    """Cards with `failed` rules; dates, times and tags in their stored form where valid."""
    return cards.withColumn("failed", failed_rules(cards)).withColumns({
        "date": F.coalesce(dates.padded_date(F.col("date")), F.col("date")),
        "time_start": F.coalesce(dates.padded_time(F.col("time_start")), F.col("time_start")),
        "time_end": F.coalesce(dates.padded_time(F.col("time_end")), F.col("time_end")),
        "tags": types.filter_tags(F.coalesce("tags", F.array().cast("array<string>"))),
    })


def validate_cards(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): two filters of one checked frame; rejected rows keep `failed`."""
    checked = check_cards(cards)
    ok = F.size("failed") == 0
    return checked.filter(ok).drop("failed"), checked.filter(~ok)


def route_always(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, venues) of a direct feed: undated cards are places."""
    undated = dates.is_always(F.col("date"))
    return cards.filter(~undated), cards.filter(undated)


def to_event_rows(
    cards: DataFrame, parsed_at: Column, city: str = "city", source: str = "source",
    keep: list[str] = ("seq",),
) -> DataFrame:
    """Valid cards as stored rows; undated cards of social sources are dropped."""
    title, date, venue = F.col("title"), F.col("date"), F.col("venue_name")
    rows = cards.filter(~predicates.is_spurious_always(date, F.col("type"), F.col(source)))
    rows = rows.withColumn("slug", text.slugify(title, date)).withColumns({
        "id": text.event_id(F.col(city), F.col("slug")),
        "tags": types.fill_tags(F.col("tags"), F.col("type")),
        "tags_version": F.lit(vocab.TAGS_VERSION),
        "fingerprint": text.fingerprint(title, date, venue),
        "parsed_at": parsed_at,
    })
    kept = [name for name in keep if name in rows.columns]
    return shape(rows, EVENT, kept)


def to_venues(
    cards: DataFrame, source: Column, updated_at: Column, city: str = "city"
) -> DataFrame:
    """Undated cards as venue rows, keyed by the place's name."""
    rows = cards.withColumns({
        "id": text.event_id(F.col(city), text.slugify(F.col("venue_name"))),
        "name": F.col("venue_name"),
        "address": text.present(F.col("address")),
        "source": source,
        "updated_at": updated_at,
    })
    return shape(rows, VENUE, [n for n in ("seq",) if n in rows.columns])


def event_rows_to_venues(
    events: DataFrame, updated_at: Column, source: str = "twogis"
) -> DataFrame:
    """Stored undated rows as venue rows under the same id."""
    rows = events.withColumns({
        "name": F.col("venue_name"),
        "address": text.present(F.col("address")),
        "source": F.lit(source),
        "updated_at": updated_at,
    })
    return shape(rows, VENUE)


def attach_post_url(events: DataFrame, group_url: str = "group_url") -> DataFrame:
    """Events of a batch of posts get the link of their post, else that of the group."""
    return events.withColumn("source_url", urls.resolve_url(F.col("event_url"), F.col(group_url)))


def split_posts(documents: DataFrame, column: str = "document") -> DataFrame:
    """Assembled documents back to one row per post (url, text), by their markers."""
    head, tail = vocab.POST_MARKER.rstrip("\n").split("%s")
    parts = F.filter(F.split(column, rf"(?:^|\n\n)\Q{head}\E"), lambda p: p != "")
    rows = documents.withColumn("_part", F.explode(parts))
    end = f"{tail}\n"
    return rows.withColumns({
        "url": F.substring_index("_part", end, 1),
        "text": F.expr(f"substring(_part, locate('{tail}', _part) + {len(end)})"),
    }).drop("_part", column)


# --- against what is stored -------------------------------------------------------------


def new_urls(urls_df: DataFrame, events: DataFrame) -> DataFrame:
    """Urls no stored event came from. Order columns of the input stay usable."""
    known = events.select(F.col("source_url").alias("url")).distinct()
    return urls_df.join(known, "url", "left_anti")


def changed_docs(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose hash differs from the stored one of the same url (or that are new)."""
    last = stored.select("url", "hash")
    return docs.join(last, ["url", "hash"], "left_anti")


def stored_peers(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Stored rows under an id of this run."""
    return events.join(rows.select("id").distinct(), "id", "left_semi")


def manual_guard(venues: DataFrame, stored: DataFrame) -> DataFrame:
    """Venues except those entered by hand."""
    manual = stored.filter(F.col("source") == "manual").select("id")
    return venues.join(manual, "id", "left_anti")


def drop_known_domains(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Hits of domains neither configured nor rejected; `known` has one column `domain`."""
    return hits.join(known.select("domain").distinct(), "domain", "left_anti")

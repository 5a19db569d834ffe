"""Rows to keep and rows to drop. Each function returns a frame; writing it is the table's part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import dates
from .cards import event_rows_to_venues


def split_rows(df: DataFrame, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted); a row whose test is unknown is kept."""
    sure = F.coalesce(doomed, F.lit(False))
    return df.filter(~sure), df.filter(sure)


def purge_past(
    events: DataFrame, as_of: Column, city: str | None = None, keep_days: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Dated events older than `keep_days` before `as_of` go."""
    doomed = dates.event_date(F.col("date")) < F.date_sub(as_of, keep_days)
    if city:
        doomed = doomed & (F.col("city") == city)
    return split_rows(events, doomed)


def purge_raw(raw: DataFrame, now: Column, keep_days: int = 120) -> tuple[DataFrame, DataFrame]:
    """Archived documents fetched too long ago go."""
    return split_rows(raw, F.col("fetched_at") < now - F.make_dt_interval(F.lit(keep_days)))


def sync_snapshot(
    events: DataFrame, current: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Future rows that a full-snapshot source no longer reports go.

    `current` has (source, city, id) of this run for full-snapshot sources only. A source
    that returned nothing has no row there, so nothing of it is dropped: an empty answer
    is more likely a failed one.
    """
    reporting = current.select("source", "city").distinct().withColumn("_reports", F.lit(True))
    reported = current.select("source", "city", "id").distinct().withColumn("_again", F.lit(True))
    keys = ["source", "city"]
    flagged = events.join(reporting, keys, "left").join(
        reported, [*keys, "id"], "left"
    )
    doomed = (
        F.col("_reports") & F.col("_again").isNull()
        & (dates.event_date(F.col("date")) >= as_of)
    )
    kept, deleted = split_rows(flagged, doomed)
    return kept.select(*events.columns), deleted.select(*events.columns)


def purge_always(
    events: DataFrame,
    now: Column,
    keep_types: list[str] = vocab.PLACE_TYPES,
    min_age_days: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Undated rows of social sources older than a day go, except kinds of places."""
    source = F.col("source")
    social = (
        source.startswith("vk-") | source.startswith("telegram-") | source.startswith("generic:")
        | (source == "generic")
    )
    old = F.col("parsed_at") < now - F.make_dt_interval(F.lit(min_age_days))
    doomed = dates.is_always(F.col("date")) & social & ~F.col("type").isin(keep_types) & old
    return split_rows(events, doomed)


def purge_always_places(events: DataFrame, prefix: str = "twogis-") -> tuple[DataFrame, DataFrame]:
    """Undated rows of the place catalog go: they live in the venue table."""
    return split_rows(events, dates.is_always(F.col("date")) & F.col("source").startswith(prefix))


def venues_from_events(
    events: DataFrame, updated_at: Column, city: str | None = None, prefix: str = "twogis-"
) -> DataFrame:
    """Venue rows out of undated stored events of the place catalog."""
    rows = events.filter(dates.is_always(F.col("date")) & F.col("source").startswith(prefix))
    if city:
        rows = rows.filter(F.col("city") == city)
    return event_rows_to_venues(rows, updated_at)


def bootstrap_venues(venues: DataFrame, events: DataFrame, updated_at: Column) -> DataFrame:
    """Venue rows for cities that have none yet, to be inserted only."""
    filled = venues.select("city").distinct()
    fresh = venues_from_events(events, updated_at).join(filled, "city", "left_anti")
    return fresh.select(*venues.columns)


def backfill_venues(venues: DataFrame, events: DataFrame, updated_at: Column) -> DataFrame:
    """The venue table after inserting places out of events; rows entered by hand stay."""
    fresh = venues_from_events(events, updated_at)
    columns = [c for c in venues.columns if c != "id"]
    f = fresh.select("id", F.struct(*columns).alias("f"))
    s = venues.select("id", F.struct(*columns).alias("s"))
    joined = s.join(f, "id", "full_outer")
    replace = F.col("f").isNotNull() & ~F.coalesce(
        F.col("s.source").eqNullSafe("manual"), F.lit(False)
    )
    return joined.select(
        "id",
        *[F.when(replace, F.col(f"f.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in columns],
    )


def purge_stale_candidates(
    candidates: DataFrame, now: Column, days: int = 90
) -> tuple[DataFrame, DataFrame]:
    """Unmoderated candidates not seen for `days` go."""
    old = F.col("last_seen") < now - F.make_dt_interval(F.lit(days))
    return split_rows(candidates, (F.col("status") == "new") & old)


def stale_tags(events: DataFrame, raw: DataFrame, version: int = vocab.TAGS_VERSION) -> DataFrame:
    """Archived documents of events tagged under an older version, to be extracted again.

    Only the stale urls take part in the join, so the archive is read once and filtered.
    """
    stale = events.filter(F.col("tags_version") < version).select(
        F.col("source_url").alias("url")
    ).distinct()
    return raw.join(stale, "url", "left_semi")

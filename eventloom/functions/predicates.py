"""Row tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from . import dates, urls
from .text import contains_any

SOCIAL, AGGREGATOR = "social", "aggregator"


def is_event_candidate(
    text: Column,
    source_type: Column | str = SOCIAL,
    markers: list[str] = vocab.EVENT_MARKERS,
    hosts: list[str] = vocab.TICKET_HOSTS,
    date_pattern: str = vocab.DATE_PATTERN,
) -> Column:
    """Whether a text looks like an announcement.

    An aggregator needs a date and one more sign; for other sources any sign will do.
    """
    kind = F.lit(source_type) if isinstance(source_type, str) else source_type
    low = F.lower(F.coalesce(text, F.lit("")))
    dated = low.rlike(f"(?Uiu){date_pattern}")
    other = contains_any(low, markers) | contains_any(low, hosts)
    return F.when(kind == AGGREGATOR, dated & other).otherwise(dated | other)


def within_days(unix_seconds: Column, days: int, now: Column) -> Column:
    """Posted no longer than `days` before `now`; a missing time is not."""
    cutoff = F.unix_micros(now) / F.lit(1e6) - days * 86400
    return F.coalesce(unix_seconds >= cutoff, F.lit(False))


def is_past(date: Column, as_of: Column) -> Column:
    """Dated before `as_of`; undated and invalid dates are not past."""
    return F.coalesce(dates.event_date(date) < as_of, F.lit(False))


def has_social_source(source: Column, prefixes: list[str] = vocab.SOCIAL_PREFIXES) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | source.startswith(prefix)
    return hit


def is_spurious_always(date: Column, event_type: Column, source: Column) -> Column:
    """Undated, from a social source, and not a kind of place that is open every day."""
    return (
        dates.is_always(date)
        & has_social_source(source)
        & ~event_type.isin(vocab.PLACE_TYPES)
    )


def is_jsonld_event(types: Column) -> Column:
    """Whether an array of schema.org types names an event."""
    known = F.array(*[F.lit(t) for t in vocab.SCHEMA_EVENT_TYPES])
    return F.coalesce(F.arrays_overlap(types, known), F.lit(False))


def has_jsonld_event(html: Column) -> Column:
    return F.coalesce(html.rlike(vocab.JSONLD_EVENT_PATTERN), F.lit(False))


def has_event_path(sample_urls: Column, hints: list[str] = vocab.EVENT_PATHS) -> Column:
    return urls.has_path(sample_urls, hints)


def auto_approve(
    domain: Column, has_jsonld: Column, sample_urls: Column, query_count: Column,
    hints: list[str] = vocab.EVENT_PATHS,
    excluded: list[str] = vocab.AGGREGATOR_DOMAINS + vocab.BUILDER_DOMAINS,
) -> Column:
    """A first-hand source with every strong sign; platforms that host many sites are excluded."""
    return (
        has_jsonld
        & has_event_path(sample_urls, hints)
        & (query_count >= 3)
        & ~urls.domain_in_set(domain, excluded)
    )


def listing_fresh(last_verified: Column, now: Column, days: int = 30) -> Column:
    """Checked within the last `days`; text that is no time is not fresh."""
    checked = F.try_to_timestamp(last_verified.cast("string"))
    return F.coalesce(checked > now - F.make_dt_interval(F.lit(days)), F.lit(False))


def usable_image(url: Column) -> Column:
    """A picture that can be shown on a card: drawings in SVG cannot."""
    return F.coalesce((url != "") & ~F.lower(url).endswith(".svg"), F.lit(False))


def is_status_line(text: Column) -> Column:
    """Opening hours or another status instead of an address."""
    return text.rlike(f"(?iu){vocab.STATUS_PATTERN}")

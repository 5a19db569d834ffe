"""Column layout of cards, tables and landed input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CARD = {
    "title": "string", "type": "string", "category": "string", "date": "string",
    "time_start": "string", "time_end": "string", "price_min": "int", "price_max": "int",
    "price_text": "string", "price_note": "string", "address": "string",
    "venue_name": "string", "district": "string", "image_url": "string",
    "description": "string", "organizer": "string", "event_url": "string",
    "tags": "array<string>",
}
EVENT = {
    "id": "string", "city": "string", "slug": "string",
    **{name: kind for name, kind in CARD.items() if name != "event_url"},
    "tags_version": "int", "fingerprint": "string", "source_url": "string",
    "source": "string", "parsed_at": "timestamp",
}
VENUE = {
    "id": "string", "city": "string", "name": "string", "type": "string", "address": "string",
    "district": "string", "image_url": "string", "source": "string", "updated_at": "timestamp",
}
RAW = {
    "source": "string", "url": "string", "content": "string", "content_type": "string",
    "hash": "string", "fetched_at": "timestamp",
}
HEALTH = {
    "source": "string", "city": "string", "run_at": "timestamp", "events_found": "bigint",
    "errors": "bigint", "duration_sec": "decimal(12,3)", "last_error": "string",
}
CANDIDATE = {
    "domain": "string", "city": "string", "queries": "array<string>",
    "sample_urls": "array<string>", "score": "bigint", "has_jsonld_event": "boolean",
    "status": "string", "found_at": "timestamp", "last_seen": "timestamp",
    "first_provider": "string", "first_query": "string", "listing_url": "string",
    "last_verified": "timestamp",
}
# Landed input. `page` is the position of a page in its feed, 0 for the first.
LANDED = {
    "source": "string", "city": "string", "url": "string", "content": "string",
    "page": "bigint", "fetched_at": "timestamp",
}

REQUIRED = ["title", "type", "date", "price_min", "price_max", "price_text", "address", "venue_name"]
FILLABLE = ["time_start", "time_end", "image_url", "description", "organizer", "district"]


def ddl(layout: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in layout.items())


def shape(df: DataFrame, layout: dict[str, str], keep: list[str] = ()) -> DataFrame:
    """`df` with exactly the columns of `layout` (missing ones null), then those of `keep`."""
    have = set(df.columns)
    columns = [
        (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
        for name, kind in layout.items()
    ]
    return df.select(*columns, *[F.col(name) for name in keep if name not in layout])


def arrival(page: Column | str, *positions: Column | str) -> Column:
    """Arrival order of a row in its feed: page, then position (and position within it)."""
    named = [F.col(p) if isinstance(p, str) else p for p in (page, *positions)]
    place = F.array(*[p.cast("long") for p in named[1:]])
    return F.struct(named[0].cast("long").alias("page"), place.alias("pos")).alias("seq")


def card_columns(values: dict[str, Column]) -> list[Column]:
    """The card columns; a name without a value is null, tags default to none."""
    filled = {"tags": F.array().cast("array<string>"), **values}
    unknown = set(values) - set(CARD)
    if unknown:
        raise ValueError(f"not card columns: {sorted(unknown)}")
    return [filled.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in CARD.items()]

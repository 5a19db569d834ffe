"""What a listing site shows: filtered, ordered and labelled events and venues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import dates, types
from ..functions.text import plural_ru
from ..functions.urls import percent_encode


def upcoming(events: DataFrame, now: Column, city: str | None = None) -> DataFrame:
    """Dated events from the city's own today on."""
    rows = events.filter(F.col("city") == city) if city else events
    today = dates.local_today(now, F.col("city"))
    earliest = F.date_sub(now.cast("date"), 1)
    return not_before(rows, earliest).filter(dates.event_date(F.col("date")) >= today)


def not_before(events: DataFrame, day: Column) -> DataFrame:
    """A coarse cut by date text that the file scan can apply.

    Padded dates order as text, unpadded ones never come before their padded form, and the
    undated marker comes last, so no row dated on `day` or later is lost.
    """
    return events.filter(F.col("date") >= day.cast("string"))


def event_by_slug(events: DataFrame, city: str, slug: str) -> DataFrame:
    return events.filter((F.col("city") == city) & (F.col("slug") == slug)).limit(1)


def venue_by_slug(venues: DataFrame, city: str, slug: str) -> DataFrame:
    return venues.filter(F.col("id") == f"{city}-{slug}").limit(1)


def apply_filters(
    events: DataFrame,
    as_of: Column,
    types_chosen: list[str] | None = None,
    when: str = "any",
    price_min: int | None = None,
    price_max: int | None = None,
) -> DataFrame:
    """Reader's choice: types, day, and prices whose range meets the chosen one."""
    day = dates.event_date(F.col("date"))
    kept = events
    if price_min is not None:
        kept = kept.filter(F.col("price_max") >= price_min)
    if price_max is not None:
        kept = kept.filter(F.col("price_min") <= price_max)
    if types_chosen is not None:
        kept = kept.filter(F.col("type").isin(types_chosen))
    if when == "today":
        return not_before(kept, as_of).filter(day == as_of)
    if when == "tomorrow":
        return not_before(kept, as_of).filter(day == F.date_add(as_of, 1))
    if when == "weekend":
        weekend = dates.weekend_days(as_of)
        return not_before(kept, as_of).filter(F.array_contains(weekend, day))
    if when != "any":
        raise ValueError(f"unknown day filter {when!r}")
    return kept


def events_by_date(events: DataFrame) -> DataFrame:
    return events.orderBy(dates.event_date(F.col("date")), "id")


def venues_by_type(venues: DataFrame) -> DataFrame:
    return venues.orderBy("type", "name", "id")


def first_venues(venues: DataFrame, n: int = 8) -> DataFrame:
    """The first venues of a page with the total and whether there are more."""
    total = venues.agg(F.count(F.lit(1))).scalar()
    shown = venues_by_type(venues).limit(n)
    return shown.withColumn("total", total).withColumn("show_all", F.col("total") > n)


def sample(df: DataFrame, n: int, *order) -> DataFrame:
    """The first rows in an order, for a report."""
    return df.orderBy(*order).limit(n)


def available_types(events: DataFrame) -> DataFrame:
    """Types that occur, in display order, with their labels."""
    known = events.select("type").filter(F.col("type").isin(vocab.EVENT_TYPES)).distinct()
    return known.select(
        "type", types.type_ordinal(F.col("type")).alias("position"),
        types.type_label(F.col("type")).alias("label"),
    ).orderBy("position")


def result_count(filtered: DataFrame) -> DataFrame:
    """The line above a listing."""
    n = F.col("n")
    text = F.concat(F.lit(vocab.FOUND_PREFIX), n.cast("string"), F.lit(" "), plural_ru(n))
    return filtered.agg(F.count(F.lit(1)).alias("n")).withColumn("text", text)


def _city(mapping: dict) -> Column:
    return types.literal_map(mapping)[F.col("city")]


def event_meta(events: DataFrame) -> DataFrame:
    """Page title and description of events: those stored, else built from the card."""
    built = F.concat(
        types.type_label(F.col("type")), F.lit(" в "), _city(vocab.CITY_GENITIVE), F.lit(". "),
        F.col("price_text"), F.lit(". "), F.col("address"), F.lit("."),
    )
    title = F.concat(F.col("title"), F.lit(f" — {vocab.LISTING_TITLE} "), _city(vocab.CITY_NAMES))
    have = set(events.columns)
    stored = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    return events.withColumns({
        "page_title": F.coalesce(stored("meta_title"), title),
        "page_description": F.coalesce(stored("meta_description"), built),
    })


def venue_slug(venue_id: Column, city: Column) -> Column:
    """The id without its city prefix."""
    prefix = F.concat(city, F.lit("-"))
    return F.when(
        F.startswith(venue_id, prefix), F.substr(venue_id, F.length(prefix) + 1)
    ).otherwise(venue_id)


def venue_meta(venues: DataFrame) -> DataFrame:
    """Page title and description of venues."""
    name, address = F.col("name"), F.nullif("address", F.lit(""))
    return venues.withColumns({
        "page_title": F.concat(
            types.venue_type_label(F.col("type")), F.lit(" «"), name, F.lit("» в "),
            _city(vocab.CITY_GENITIVE), F.lit(" — адрес, фото и карта"),
        ),
        "page_description": F.concat(
            name, F.lit(", "), _city(vocab.CITY_NAMES),
            F.coalesce(F.concat(F.lit(", "), address), F.lit("")),
            F.lit(". Адрес, район, расположение на карте."),
        ),
    })


def venue_url(site: str) -> Column:
    return F.concat(
        F.lit(site), F.lit("/"), F.col("city"), F.lit("/venues/"),
        venue_slug(F.col("id"), F.col("city")), F.lit("/"),
    )


def venue_jsonld(venues: DataFrame, site: str) -> DataFrame:
    """Structured data of venue pages: the place and the breadcrumbs, as JSON text."""
    city_name = _city(vocab.CITY_NAMES)
    kind = F.coalesce(
        types.literal_map(vocab.VENUE_SCHEMA_TYPES)[F.col("type")], F.lit(vocab.VENUE_SCHEMA_FALLBACK)
    )
    context = F.lit("https://schema.org").alias("@context")
    address = F.when(
        F.nullif("address", F.lit("")).isNotNull(),
        F.struct(
            F.lit("PostalAddress").alias("@type"), F.col("address").alias("streetAddress"),
            city_name.alias("addressLocality"),
        ),
    )
    place = F.struct(
        context, kind.alias("@type"), F.col("name"), venue_url(site).alias("url"),
        city_name.alias("areaServed"), F.nullif("image_url", F.lit("")).alias("image"),
        address.alias("address"), F.col("updated_at").alias("dateModified"),
    )
    crumb = lambda position, name, item: F.struct(
        F.lit("ListItem").alias("@type"), F.lit(position).alias("position"), name.alias("name"),
        item.alias("item"),
    )
    home = F.concat(F.lit(site), F.lit("/"), F.col("city"), F.lit("/"))
    crumbs = F.struct(
        context, F.lit("BreadcrumbList").alias("@type"),
        F.array(
            crumb(1, F.concat(F.lit(f"{vocab.LISTING_TITLE} "), _city(vocab.CITY_GENITIVE)), home),
            crumb(2, F.lit(vocab.PLACES_TITLE), F.concat(home, F.lit("venues/"))),
            crumb(3, F.col("name"), F.lit(None).cast("string")),
        ).alias("itemListElement"),
    )
    crumbs_text = F.to_json(crumbs)
    return venues.withColumns({"place_json": F.to_json(place), "crumbs_json": crumbs_text})


def map_url(name: Column, address: Column, search: str = vocab.MAP_SEARCH) -> Column:
    """Map search for a place."""
    query = F.trim(F.concat_ws(" ", name, F.coalesce(address, F.lit(""))))
    return F.concat(F.lit(search), percent_encode(query))


def site_urls(
    events: DataFrame, venues: DataFrame, site: str, cities: list[str], now: Column
) -> DataFrame:
    """Every page of the site with its last change, change frequency and priority."""
    spark: SparkSession = events.sparkSession
    listed = spark.createDataFrame([(c,) for c in cities], "city string")
    home = F.concat(F.lit(site), F.lit("/"), F.col("city"), F.lit("/"))

    def pages(df, url, changed, frequency, priority):
        return df.select(
            url.alias("url"), changed.alias("last_modified"),
            F.lit(frequency).alias("change_frequency"), F.lit(priority).alias("priority"),
        )

    ahead = upcoming(events.filter(F.col("city").isin(cities)), now)
    return (
        pages(listed, home, now, "daily", 1.0)
        .unionByName(pages(listed, F.concat(home, F.lit("venues/")), now, "monthly", 0.7))
        .unionByName(
            pages(ahead, F.concat(home, F.lit("events/"), F.col("slug"), F.lit("/")),
                  F.col("parsed_at"), "weekly", 0.7)
        )
        .unionByName(
            pages(venues.filter(F.col("city").isin(cities)), venue_url(site),
                  F.col("updated_at"), "monthly", 0.5)
        )
    )

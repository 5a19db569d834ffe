"""Structured data in pages, site maps, the source list and the stored tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import vocab
from ..functions import dates, predicates, prices, types
from ..functions.text import clean, clean_description, present
from ..schemas import arrival, card_columns

_SCRIPTS = (
    r"""(?is)<script\b[^>]*\btype\s*=\s*(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json(?=[\s>]))"""
    r"""[^>]*>(.*?)</script\s*>"""
)
# Comments go, but not what only looks like one inside a script.
_COMMENTS = r"(?is)(<script\b[^>]*>.*?</script\s*>)|<!--.*?-->"
_LEVELS = 3


def sitemap_urls(raw: DataFrame, pattern: str | None = None) -> DataFrame:
    """Locations of plain site maps; an index of site maps is not followed."""
    page = F.from_xml("content", "url array<struct<loc string>>")
    urls = raw.withColumn("_page", page).select(
        "source", "city", F.posexplode("_page.url").alias("pos", "entry"), "page"
    ).select(
        "source", "city", clean(F.col("entry.loc")).alias("url"),
        arrival("page", "pos"),
    ).filter(F.col("url").isNotNull())
    return urls.filter(F.col("url").rlike(pattern)) if pattern else urls


@F.pandas_udf(T.ArrayType(T.StringType()))
def _flatten_deep(blocks: pd.Series) -> pd.Series:
    """Objects of lists and graphs nested deeper than the expressions below unfold."""

    def objects(node):
        if isinstance(node, list):
            for child in node:
                yield from objects(child)
        elif isinstance(node, dict):
            if isinstance(node.get("@graph"), list):
                yield from objects(node["@graph"])
            else:
                yield json.dumps(node, ensure_ascii=False)

    return blocks.map(lambda text: list(objects(json.loads(text))) if text else None)


def _as_list(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def jsonld_objects(raw: DataFrame, kept: list[str]) -> DataFrame:
    """Every object of the pages' JSON-LD blocks, lists and graphs unfolded, as `obj`.

    `_path` holds the position of an object in its page.
    """
    live = F.regexp_replace("content", _COMMENTS, "$1")
    blocks = F.regexp_extract_all(live, F.lit(_SCRIPTS), F.lit(1))
    rows = raw.select(*kept, F.posexplode(blocks).alias("_at", "_text"))
    rows = rows.select(
        *kept, F.array("_at").alias("_path"), F.try_parse_json("_text").alias("obj")
    ).filter(F.col("obj").isNotNull())

    inner = lambda: F.coalesce(_as_list(F.col("obj"), '$["@graph"]'), _as_list(F.col("obj")))
    for _ in range(_LEVELS):
        rows = rows.select(
            *kept, "_path", F.posexplode(F.coalesce(inner(), F.array("obj"))).alias("_at", "obj")
        ).withColumn("_path", F.concat("_path", F.array("_at"))).drop("_at")
    deep = F.when(inner().isNotNull(), F.to_json("obj"))
    # One pass over all objects: Python is given the text of those nested deeper still, and null for the others.
    rest = F.transform(_flatten_deep(F.col("_deep")), lambda t: F.try_parse_json(t))
    rows = rows.withColumn("_deep", deep).select(
        *kept, "_path", F.posexplode(F.when(F.col("_deep").isNull(), F.array("obj")).otherwise(rest)).alias("_at", "obj")
    )
    return rows.withColumn("_path", F.concat("_path", F.array("_at"))).drop("_at")


def _is(value: Column, kind: str) -> Column:
    """Whether a variant is a STRING, an OBJECT or an ARRAY."""
    return F.startswith(F.schema_of_variant(value), F.lit(kind))


def _struct_of(value: Column, *names: str) -> Column:
    """Fields of an object variant as a struct of variants, read in one pass; null for other kinds."""
    fields = ",".join(f"`{name}`:variant" for name in names)
    return F.try_variant_get(value, "$", f"struct<{fields}>")


def text_of(value: Column) -> Column:
    """Trimmed text of a JSON string; null for any other kind of value."""
    return F.when(_is(value, "STRING"), clean(F.try_variant_get(value, "$", "string")))


def _first_of(value: Column) -> Column:
    """The value itself, or the first of a list."""
    return F.when(_is(value, "ARRAY"), F.get(_as_list(value), 0)).otherwise(value)


def _address_of(place: Column) -> Column:
    parts = F.try_variant_get(
        place, "$.address", "struct<streetAddress:variant,addressLocality:variant>"
    )
    joined = F.concat_ws(", ", text_of(parts["streetAddress"]), text_of(parts["addressLocality"]))
    return F.coalesce(text_of(F.try_variant_get(place, "$.address", "variant")), present(joined))


def join_address(location: Column) -> Column:
    """Address of a location: plain text, or street and locality of an address object."""
    return _address_of(_first_of(location))


def pick_image(value: Column) -> Column:
    """Picture url: text, an object's url, or the first usable entry of a list."""
    one = lambda v: F.coalesce(text_of(v), text_of(F.try_variant_get(v, "$.url", "variant")))
    usable = F.filter(F.transform(_as_list(value), one), lambda u: u.isNotNull())
    return F.coalesce(one(value), F.try_element_at(usable, F.lit(1)))


def pick_organizer(value: Column) -> Column:
    """Organizer: text, or the name of an object, first of a list."""
    one = _first_of(value)
    return F.coalesce(text_of(F.try_variant_get(one, "$.name", "variant")), text_of(one))


def _offer_price(value: Column) -> Column:
    number = F.try_variant_get(value, "$", "double").try_cast("int")
    text = prices.whole_price(F.try_variant_get(value, "$", "string"))
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", text).when(kind != "BOOLEAN", number)


def offer_prices(offers: Column) -> Column:
    """Every price of an offer or a list of offers, null where one is not given."""
    names = ("price", "lowPrice", "highPrice")
    listed = F.transform(
        F.coalesce(_as_list(offers), F.array(offers)), lambda o: _struct_of(o, *names)
    )
    return F.flatten(F.transform(listed, lambda o: F.array(*[_offer_price(o[n]) for n in names])))


def jsonld_events(raw: DataFrame, default_type: Column | str = "other") -> DataFrame:
    """Event objects of the pages' structured data as cards.

    Objects without a name of three letters, a date, a venue and an address are dropped.
    `source_url` is the page; the event's own link stays in `event_url`. Fields are read in
    stages, and the test for complete cards sits inside the generator, so that no value is
    computed a second time for a filter.
    """
    kept = ["source", "city", "url", "page"]
    given = default_type if isinstance(default_type, Column) else F.lit(default_type)
    pages = raw.filter(F.col("content").contains("ld+json")).withColumn("_default", given)
    found = jsonld_objects(pages, [*kept, "_default"])
    fields = _struct_of(
        F.col("obj"), "@type", "name", "startDate", "endDate", "location", "offers", "url", "@id",
        "image", "description", "organizer",
    )
    f = lambda name: F.col("f").getField(name)
    # An empty url counts as none, a blank one does not.
    url = F.when(_is(f("url"), "STRING"), present(F.try_variant_get(f("url"), "$", "string")))
    opened = found.select(*kept, "_default", "_path", fields.alias("f")).select(
        *kept, "_default", "_path",
        _first_of(f("location")).alias("place"),
        F.coalesce(_as_list(f("@type")), F.array(f("@type"))).alias("kinds"),
        offer_prices(f("offers")).alias("prices"),
        text_of(f("name")).alias("name"),
        text_of(f("startDate")).alias("start"),
        text_of(f("endDate")).alias("end"),
        pick_image(f("image")).alias("image"),
        text_of(f("description")).alias("about"),
        pick_organizer(f("organizer")).alias("organizer"),
        F.coalesce(url, text_of(f("@id"))).alias("link"),
    )
    event = F.struct(
        "name", "image", "organizer", "link",
        dates.iso_date_part(F.col("start")).alias("date"),
        dates.iso_time_part(F.col("start")).alias("starts"),
        dates.iso_time_part(F.col("end")).alias("ends"),
        text_of(F.try_variant_get("place", "$.name", "variant")).alias("venue"),
        _address_of(F.col("place")).alias("address"),
        clean_description(F.col("about")).alias("about"),
        F.array_compact(F.transform("kinds", text_of)).alias("kinds"),
        prices.price_range(F.col("prices")).alias("price"),
    )
    complete = lambda e: (
        predicates.is_jsonld_event(e["kinds"]) & (F.length(e["name"]) >= 3)
        & e["date"].isNotNull() & e["venue"].isNotNull() & e["address"].isNotNull()
    )
    read = opened.select(*kept, "_default", "_path", event.alias("e"))
    events = read.select(
        *kept, "_default", "_path", F.explode(F.filter(F.array("e"), complete)).alias("e")
    )
    e = lambda name: F.col(f"e.{name}")
    return events.select(
        *card_columns({
            "title": F.substring(e("name"), 1, vocab.TITLE_LENGTH),
            "type": types.map_type_by_schema(e("kinds"), F.col("_default")),
            "date": e("date"),
            "time_start": e("starts"),
            "time_end": e("ends"),
            "price_min": e("price")["price_min"],
            "price_max": e("price")["price_max"],
            "price_text": e("price")["price_text"],
            "address": e("address"),
            "venue_name": e("venue"),
            "image_url": e("image"),
            "description": e("about"),
            "organizer": e("organizer"),
            "event_url": F.when(~e("link").startswith("#"), clean(e("link"))),
        }),
        "source", "city", F.col("url").alias("source_url"),
        F.struct("page", F.transform("_path", lambda p: p.cast("long")).alias("pos")).alias("seq"),
    )


def structured_or_model(structured: DataFrame, model: DataFrame, on: str = "source_url") -> DataFrame:
    """Cards from structured data, and for the other pages those of the landed answers."""
    keys = [on, "source", "city"]
    fallback = model.join(structured.select(*keys).distinct(), keys, "left_anti")
    return structured.unionByName(fallback)


_SOURCES = (
    "city string, sources array<struct<name:string,extraction_mode:string,priority:int,"
    "enabled:boolean,kind:string,url:string,url_pattern:string,provider:string,api_query:string,"
    "event_type:string,venue_name:string,address:string,full_snapshot:boolean,"
    "groups:array<string>,channels:array<struct<channel:string,source_type:string,priority:int,"
    "enabled:boolean>>>>"
)


def sources_dim(spark: SparkSession, path: str) -> DataFrame:
    """The source list: one JSON object per city with its sources, defaults filled in."""
    listed = spark.read.schema(_SOURCES).json(path)
    rows = listed.select("city", F.posexplode("sources").alias("feed_order", "s")).select(
        "city", "feed_order", "s.*"
    )
    return rows.withColumns({
        "extraction_mode": F.coalesce("extraction_mode", F.lit("per_url")),
        "priority": F.coalesce("priority", F.lit(0)),
        "enabled": F.coalesce("enabled", F.lit(True)),
        "full_snapshot": F.coalesce("full_snapshot", F.lit(False)),
    })


def channels_dim(sources: DataFrame) -> DataFrame:
    """The channels of the sources, defaults filled in."""
    rows = sources.select("city", F.col("name").alias("source"), F.explode("channels").alias("c"))
    return rows.select(
        "city", "source", F.col("c.channel").alias("channel"),
        F.coalesce("c.source_type", F.lit(predicates.SOCIAL)).alias("source_type"),
        F.coalesce("c.priority", F.lit(40)).alias("priority"),
        F.coalesce("c.enabled", F.lit(True)).alias("enabled"),
    )


def enabled_sources(
    sources: DataFrame, only: str | None = None, mode_override: str | None = None
) -> DataFrame:
    """Sources to run: the disabled skipped, one alone if named, the mode replaced if given."""
    kept = sources.filter(F.col("enabled"))
    if only:
        kept = kept.filter(F.col("name") == only)
    if mode_override:
        kept = kept.withColumn("extraction_mode", F.lit(mode_override))
    return kept


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.title() for part in rest)


def read_events(events: DataFrame, city: str) -> DataFrame:
    """Stored events of a city under the names the site uses."""
    hidden = ("tags_version", "fingerprint")
    shown = events.filter(F.col("city") == city)
    columns = [F.col(n).alias(_camel(n)) for n in events.columns if n not in hidden]
    return shown.select(*columns).withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>"))
    )


def read_venues(venues: DataFrame, city: str) -> DataFrame:
    """Stored venues of a city under the names the site uses, with the slug."""
    from ..operators.listing import venue_slug

    return venues.filter(F.col("city") == city).select(
        "id", "city", venue_slug(F.col("id"), F.col("city")).alias("slug"), "name", "type",
        "address", "district", F.col("image_url").alias("imageUrl"),
        F.col("updated_at").alias("updatedAt"),
    )

"""Feeds landed as JSON pages.

Each page is opened to its items first and every item is read on its own, so one bad
item costs that item only. Results carry the card columns, `source`, `city`,
`source_url` and the arrival order `seq` = (page, position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import dates, prices, types
from ..functions.text import clean, clean_description, present, strip
from ..functions.urls import unwrap_redirect
from ..operators.ranking import drop_repeats, next_date
from ..schemas import CARD, arrival, card_columns

KEPT = ["source", "city", "url", "page"]


def open_items(raw: DataFrame, envelope: str, items: Column, layout: str) -> DataFrame:
    """One row per item: the kept columns, `seq`, the item's text and its fields as `item`."""
    opened = raw.select(*KEPT, F.from_json("content", envelope).alias("_page"))
    texts = opened.select(*KEPT, F.posexplode(items).alias("_pos", "item_text")).select(
        "source", "city", "url", arrival("page", "_pos"), "item_text"
    )
    return parse_items(texts.filter(F.ltrim("item_text").startswith("{")), layout)


def parse_items(texts: DataFrame, layout: str, column: str = "item_text") -> DataFrame:
    """Rows with their text parsed as `item`.

    The parse sits in a generator: filters on fields stay above it, so each item is parsed
    once instead of once more for every filter moved below a projection.
    """
    parsed = F.explode(F.array(F.from_json(column, layout))).alias("item")
    return texts.select(*texts.columns, parsed)


def unreadable(raw: DataFrame) -> DataFrame:
    """Landed pages that are no JSON: a reader gives no item for them, so their feed counts them as failed."""
    return raw.filter(F.try_parse_json("content").isNull()).select(*KEPT)


def is_readable_answer(content: Column, batch: bool = True) -> Column:
    """Whether an answer is a list of cards or an object with `events`; without `batch`, an object."""
    kind = F.schema_of_variant(F.try_parse_json(content))
    if not batch:
        return F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    events = F.schema_of_variant(F.try_variant_get(F.try_parse_json(content), "$.events", "variant"))
    return F.coalesce(kind.startswith("ARRAY"), F.lit(False)) | F.coalesce(events.startswith("ARRAY"), F.lit(False))


def to_cards(items: DataFrame, values: dict[str, Column], source_url: Column) -> DataFrame:
    return items.select(
        *card_columns(values), "source", "city", source_url.alias("source_url"), "seq"
    )


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _variant_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _int_of(value: Column) -> Column:
    """Whole number of a JSON number (cut) or of digits given as text."""
    text = _variant_text(value)
    digits = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int"))
    number = F.try_variant_get(value, "$", "double").try_cast("int")
    return F.when(_is_text(value), digits).otherwise(number)


def _truthy(value: Column) -> Column:
    """The variant unless it is null, zero, empty or false."""
    text = _variant_text(value)
    number = F.when(~_is_text(value), F.try_variant_get(value, "$", "double"))
    return F.when(text.isNotNull() & ~text.isin("", "false") & ~F.coalesce(number == 0, F.lit(False)), value)


def quiz_games(raw: DataFrame, site: str) -> DataFrame:
    """Game schedule pages. `site` is the base of a game's page; `{city}` in it is the city."""
    layout = (
        "id string, title string, name string, date string, "
        "place struct<title:string,address_ru:string,address:string>, "
        "template struct<background_pc:string,background_tablet:string>, "
        "price variant, current_price variant, url string"
    )
    games = open_items(raw, "data struct<data:array<string>>", F.col("_page.data.data"), layout)
    games = games.withColumn("_id", F.col("item.id"))
    games = drop_repeats(games.drop("item"), ["source", "city", "_id"], "seq", blank="_id")
    games = parse_items(games, layout)
    start = dates.parse_dmy_clock(F.col("item.date"))
    price = F.coalesce(
        _int_of(F.coalesce(_truthy(F.col("item.price")), F.col("item.current_price"))), F.lit(0)
    )
    games = games.withColumn("_start", start).withColumn("_price", price)
    title = F.coalesce(present(F.col("item.title")), present(F.col("item.name")))
    base = F.replace(F.lit(site), F.lit("{city}"), F.col("city"))
    page_url = F.when(
        present(F.col("_id")).isNotNull(), F.concat(base, F.lit("/game/"), F.col("_id"))
    ).otherwise(F.concat(base, F.lit("/schedule")))
    return to_cards(
        games.filter(title.isNotNull() & F.col("_start").isNotNull()),
        {
            "title": title,
            "type": F.lit("quiz"),
            "date": F.date_format("_start", "yyyy-MM-dd"),
            "time_start": F.date_format("_start", "HH:mm"),
            "venue_name": F.coalesce(present(F.col("item.place.title")), F.lit(vocab.QUIZ_ORGANIZER)),
            "address": F.coalesce(
                present(F.col("item.place.address_ru")), present(F.col("item.place.address")), F.lit("")
            ),
            "price_min": F.col("_price"),
            "price_max": F.col("_price"),
            "price_text": F.when(
                F.col("_price") != 0, F.format_string(vocab.PRICE_FLAT, F.col("_price"))
            ).otherwise(vocab.PRICE_ASK_ORGANIZER),
            "image_url": F.coalesce(
                present(F.col("item.template.background_pc")),
                F.col("item.template.background_tablet"),
            ),
            "organizer": F.lit(vocab.QUIZ_ORGANIZER),
        },
        F.coalesce(present(F.col("item.url")), page_url),
    )


def ticket_events(raw: DataFrame, city_names: dict[str, str] = vocab.CITY_NAMES) -> DataFrame:
    """Ticket service pages: type from the category, price range from the ticket types."""
    layout = (
        "name string, starts_at string, url string, "
        "poster_image struct<default_url:string,uri:string>, description_short string, "
        "location struct<city:string,address:string>, ticket_types array<struct<price:double>>, "
        "categories array<struct<id:bigint>>, organization struct<name:string>"
    )
    items = open_items(raw, "values array<string>", F.col("_page.values"), layout)
    city_name = types.literal_map(city_names)[F.col("city")]
    amounts = F.transform(F.col("item.ticket_types"), lambda t: t["price"].try_cast("int"))
    starts = F.col("item.starts_at")
    items = (
        items.withColumn("_name", strip(F.col("item.name")))
        .withColumn("_date", F.when(F.length(starts) >= 10, dates.iso_date_part(starts)))
        .withColumn("_price", prices.price_range(amounts))
        .withColumn("_city", strip(F.coalesce(present(F.col("item.location.city")), city_name)))
        .withColumn("_address", clean(F.col("item.location.address")))
        .filter(
            city_name.isNotNull() & (F.length("_name") >= 3)
            & F.col("_date").isNotNull() & present(F.col("item.url")).isNotNull()
        )
    )
    address = (
        F.when(F.col("item.location").isNull(), city_name)
        .when(
            F.col("_address").isNotNull(),
            F.when(
                (F.col("_city") != "") & ~F.col("_address").contains(F.col("_city")),
                F.concat_ws(", ", "_city", "_address"),
            ).otherwise(F.col("_address")),
        )
        .otherwise(F.coalesce(present(F.col("_city")), city_name))
    )
    ids = F.transform(F.col("item.categories"), lambda c: c["id"].cast("int"))
    return to_cards(
        items,
        {
            "title": F.substring("_name", 1, vocab.TITLE_LENGTH),
            "type": types.map_type_by_category(ids, vocab.TICKET_CATEGORIES),
            "date": F.col("_date"),
            "time_start": dates.iso_time_part(starts),
            "price_min": F.col("_price.price_min"),
            "price_max": F.col("_price.price_max"),
            "price_text": F.col("_price.price_text"),
            "address": address,
            "venue_name": F.coalesce(F.col("_address"), F.col("_name")),
            "image_url": F.coalesce(
                present(F.col("item.poster_image.default_url")), F.col("item.poster_image.uri")
            ),
            "description": clean_description(F.col("item.description_short")),
            "organizer": F.col("item.organization.name"),
        },
        F.col("item.url"),
    )


def listing_api_events(raw: DataFrame, as_of: Column) -> DataFrame:
    """Listing API pages: the nearest date from `as_of` on, a place with an address required."""
    layout = (
        "title string, dates array<struct<start_date:string,start_time:string>>, "
        "place struct<title:string,address:string>, price variant, categories array<string>, "
        "images array<struct<image:string>>, site_url string, description string"
    )
    items = open_items(raw, "results array<string>", F.col("_page.results"), layout)
    price = F.when(_is_text(F.col("item.price")), _variant_text(F.col("item.price")))
    items = (
        items.withColumn("_title", strip(F.col("item.title")))
        .withColumn("_next", next_date(F.col("item.dates"), as_of))
        .withColumn("_venue", clean(F.col("item.place.title")))
        .withColumn("_address", clean(F.col("item.place.address")))
        .withColumn("_price", prices.price_from_text(price))
        .filter(
            (F.length("_title") >= 3) & F.col("_next").isNotNull() & F.col("_venue").isNotNull()
            & F.col("_address").isNotNull() & present(F.col("item.site_url")).isNotNull()
        )
    )
    clock = F.col("_next.start_time")
    pictures = F.filter(F.col("item.images"), lambda i: i["image"] != "")
    return to_cards(
        items,
        {
            "title": F.substring("_title", 1, vocab.TITLE_LENGTH),
            "type": types.map_type_by_category(F.col("item.categories"), vocab.LISTING_CATEGORIES),
            "date": F.col("_next.start_date"),
            "time_start": F.when(F.length(clock) >= 5, F.substring(clock, 1, 5)),
            "price_min": F.col("_price.price_min"),
            "price_max": F.col("_price.price_max"),
            "price_text": F.col("_price.price_text"),
            "address": F.col("_address"),
            "venue_name": F.col("_venue"),
            "image_url": F.try_element_at(pictures, F.lit(1))["image"],
            "description": clean_description(F.col("item.description")),
        },
        F.col("item.site_url"),
    )


def district_of(divisions: Column) -> Column:
    """Name of the first administrative division that is a district."""
    return F.try_element_at(F.filter(divisions, lambda d: d["type"] == "district"), F.lit(1))["name"]


def catalog_venues(raw: DataFrame, event_type: Column | str) -> DataFrame:
    """Catalog search pages: permanent places, undated."""
    layout = (
        "name string, name_ex struct<primary:string,name:string>, full_address_name string, "
        "address_name string, address_comment string, adm_div array<struct<type:string,name:string>>, "
        "external_content array<struct<subtype:string,main_photo_url:string,url:string>>"
    )
    items = open_items(raw, "result struct<items:array<string>>", F.col("_page.result.items"), layout)
    first = lambda *names: F.coalesce(*[present(F.col(f"item.{n}")) for n in names])
    photos = F.filter(
        F.transform(
            F.filter(
                F.col("item.external_content"), lambda c: c["subtype"].isin("main_photo", "photo")
            ),
            lambda c: F.coalesce(present(c["main_photo_url"]), present(c["url"])),
        ),
        lambda u: u.isNotNull(),
    )
    items = items.withColumn("_name", first("name_ex.primary", "name_ex.name", "name")).withColumn(
        "_address", first("full_address_name", "address_name", "address_comment")
    )
    return to_cards(
        items.filter(F.col("_name").isNotNull() & F.col("_address").isNotNull()),
        {
            "title": F.col("_name"),
            "type": F.lit(event_type) if isinstance(event_type, str) else event_type,
            "date": F.lit(vocab.ALWAYS),
            "price_min": F.lit(0),
            "price_max": F.lit(0),
            "price_text": F.lit(vocab.PRICE_BY_VENUE),
            "address": F.col("_address"),
            "venue_name": F.col("_name"),
            "district": district_of(F.col("item.adm_div")),
            "image_url": F.try_element_at(photos, F.lit(1)),
        },
        F.col("url"),
    )


def unproxied_image(media: Column, site: str) -> Column:
    """An absolute picture url: as given, embedded in a proxy path, or on the site."""
    at = F.locate("http", media)
    return (
        F.when(present(media).isNull(), None)
        .when(at >= 1, F.substr(media, at))
        .when(media.startswith("/"), F.concat(F.lit(site), media))
        .otherwise(media)
    )


def museum_items(
    raw: DataFrame, site: str, event_type: str, venue_name: str, address: str
) -> DataFrame:
    """Museum pages: flat exhibitions in `data[]`, or events in `data[].events[][]`."""
    opened = open_items(raw, "data array<string>", F.col("_page.data"), "events array<string>")
    buckets = F.transform(
        F.col("item.events"),
        lambda b: F.when(b.startswith("["), F.from_json(b, "array<string>")).otherwise(F.array(b)),
    )
    entries = opened.select(
        "source", "city", "url", F.col("seq").alias("_outer"),
        F.posexplode(
            F.when(F.col("item.events").isNotNull(), F.flatten(buckets)).otherwise(
                F.array("item_text")
            )
        ).alias("_inner", "item_text"),
    )
    layout = (
        "id string, url string, media_url_extended string, title_extended string, "
        "sub_title_extended string, starts_at string, ends_at string"
    )
    entries = entries.select(
        "source", "city", "url", arrival("_outer.page", F.col("_outer.pos")[0], "_inner"), "item_text"
    )
    entries = parse_items(entries, layout).drop("item_text").withColumn(
        "_id", F.coalesce(present(F.nullif(F.col("item.id"), F.lit("0"))), F.col("item.url"))
    )
    entries = drop_repeats(entries, ["source", "city", "_id"], "seq", blank="_id")
    start, end = dates.parse_dmy(F.col("item.starts_at")), dates.parse_dmy(F.col("item.ends_at"))
    title = clean(F.col("item.title_extended"))
    link = present(F.col("item.url"))
    return to_cards(
        entries.filter(title.isNotNull() & start.isNotNull()),
        {
            "title": F.substring(title, 1, vocab.TITLE_LENGTH),
            "type": F.lit(event_type),
            "date": dates.range_end_date(start, end),
            "venue_name": F.lit(venue_name),
            "address": F.lit(address),
            "price_min": F.lit(0),
            "price_max": F.lit(0),
            "price_text": F.lit(vocab.PRICE_BY_TICKET),
            "image_url": unproxied_image(F.col("item.media_url_extended"), site),
            "description": F.substring(
                present(F.col("item.sub_title_extended")), 1, vocab.DESCRIPTION_LENGTH
            ),
            "organizer": F.lit(venue_name),
        },
        F.when(link.startswith("/"), F.concat(F.lit(site), link)).otherwise(
            F.coalesce(link, F.lit(site))
        ),
    )


def wall_posts(raw: DataFrame, site: str) -> DataFrame:
    """Wall pages to posts: group page, owner, number, time, text and the post's link."""
    envelope = "response struct<items:array<string>>, items array<string>"
    posts = open_items(
        raw, envelope, F.coalesce(F.col("_page.response.items"), F.col("_page.items")),
        "owner_id bigint, id bigint, date double, text string",
    )
    wall = F.concat(
        F.lit(f"{site}/wall"), F.col("item.owner_id").cast("string"), F.lit("_"),
        F.col("item.id").cast("string"),
    )
    return posts.select(
        "source", "city", F.col("url").alias("group_url"),
        F.col("item.owner_id").alias("owner_id"), F.col("item.id").alias("post_id"),
        F.col("item.date").alias("date_unix"), F.coalesce("item.text", F.lit("")).alias("text"),
        wall.alias("url"), "seq",
    )


def event_groups(
    raw: DataFrame, site: str, as_of: Column, city_names: dict[str, str] = vocab.CITY_NAMES
) -> DataFrame:
    """Community pages that are events: start and finish times, place, type by keywords."""
    layout = (
        "id bigint, name string, start_date double, finish_date double, "
        "place struct<title:string,address:string>, photo_200 string, activity string, "
        "description string"
    )
    # The response is a list of groups, or an object that holds one.
    response = F.col("_page.response")
    listed = F.when(
        F.ltrim(response).startswith("{"), F.from_json(response, "groups array<string>")["groups"]
    ).otherwise(F.from_json(response, "array<string>"))
    groups = open_items(raw, "response string", listed, layout)
    city_name = F.coalesce(types.literal_map(city_names)[F.col("city")], F.col("city"))
    groups = (
        groups.withColumn("_name", strip(F.col("item.name")))
        .withColumn("_start", dates.unix_to_local(F.col("item.start_date")))
        .withColumn("_end", dates.unix_to_local(F.col("item.finish_date")))
        .withColumn("_address", clean(F.col("item.place.address")))
        .withColumn("_venue", clean(F.col("item.place.title")))
        .filter((F.length("_name") >= 3) & (F.to_date("_start") >= as_of))
    )
    return to_cards(
        groups,
        {
            "title": F.substring("_name", 1, vocab.TITLE_LENGTH),
            "type": types.infer_type(
                F.concat_ws(" ", F.col("_name"), F.coalesce("item.activity", F.lit("")))
            ),
            "date": F.date_format("_start", "yyyy-MM-dd"),
            "time_start": F.date_format("_start", "HH:mm"),
            "time_end": F.date_format("_end", "HH:mm"),
            "price_min": F.lit(0),
            "price_max": F.lit(0),
            "price_text": F.lit(vocab.PRICE_UNKNOWN),
            "address": F.coalesce("_address", "_venue", city_name),
            "venue_name": F.coalesce("_venue", "_address", city_name),
            "image_url": F.col("item.photo_200"),
            "description": clean_description(F.col("item.description")),
            "organizer": F.col("_name"),
        },
        F.concat(F.lit(f"{site}/club"), F.col("item.id").cast("string")),
    )


def search_hits(raw: DataFrame) -> DataFrame:
    """Search result pages of any of three shapes to (query, provider, rank, url).

    `raw` has `query`, `provider` and `content`. The HTML shape is read by patterns: its
    result links are anchors of one class.
    """
    envelope = "organic array<struct<link:string>>, web struct<results:array<struct<url:string>>>"
    page = F.from_json("content", envelope)
    anchors = F.filter(
        F.regexp_extract_all("content", F.lit(r"(?is)<a\b[^>]*>"), F.lit(0)),
        lambda a: a.rlike(r"""(?is)\bclass\s*=\s*["']([^"']*\s)?result__a(\s[^"']*)?["']"""),
    )
    html_links = F.transform(
        anchors,
        lambda a: unwrap_redirect(
            F.replace(
                F.regexp_extract(a, r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1),
                F.lit("&amp;"), F.lit("&"),
            )
        ),
    )
    opened = raw.withColumn("_page", page)
    links = F.coalesce(
        F.transform(F.col("_page.organic"), lambda o: o["link"]),
        F.transform(F.col("_page.web.results"), lambda r: r["url"]),
        html_links,
    )
    found = F.filter(links, lambda u: u.isNotNull() & (u != ""))
    return opened.select(
        "query", "provider", F.posexplode(found).alias("rank", "url")
    ).withColumn("rank", F.col("rank").cast("long"))


def model_responses(raw: DataFrame, batch: bool = True) -> DataFrame:
    """Landed extraction answers to cards: an array of cards or an object with `events`.

    With `batch` off each answer is one card. Answers that name no event are dropped;
    the rest still has to pass `validate_cards`. `url` is the page or group asked about.
    """
    layout = ", ".join(
        f"{name} string" if name in ("price_min", "price_max") else f"{name} {kind}"
        for name, kind in CARD.items()
    )
    if batch:
        items = F.coalesce(
            F.from_json("content", "events array<string>")["events"],
            F.when(F.ltrim("content").startswith("["), F.from_json("content", "array<string>")),
        )
    else:
        items = F.array("content")
    answers = raw.select(*KEPT, F.posexplode(items).alias("_pos", "_text"))
    answers = parse_items(answers, layout, "_text")
    whole = lambda name: F.when(
        F.col(f"item.{name}").try_cast("double") % 1 == 0,
        F.col(f"item.{name}").try_cast("double").try_cast("int"),
    )
    values = {name: F.col(f"item.{name}") for name in CARD}
    values["price_min"], values["price_max"] = whole("price_min"), whole("price_max")
    values["tags"] = F.coalesce("item.tags", F.array().cast("array<string>"))
    return answers.filter(
        F.coalesce(strip(F.col("item.title")) != vocab.NOT_AN_EVENT, F.lit(True))
    ).select(
        *card_columns(values), "source", "city", F.col("url").alias("source_url"),
        arrival("page", "_pos"),
    )

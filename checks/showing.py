"""Listings: what a site shows of the stored events and venues."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import vocab
from eventloom.operators import listing
from eventloom.plans.site import city_listing as plan_city_listing

from .base import AS_OF, NOW, SITE, query
from .views import CARDS, SOCIAL, VENUES, cards, social, venues

c, lit, expr = F.col, F.lit, F.expr
day = lambda: F.lit(AS_OF).cast("date")
now = lambda: F.lit(NOW).cast("timestamp")
late = lambda: F.lit("2024-01-20 21:30:00").cast("timestamp")

_AHEAD = "date <> 'always' AND date >= '2024-01-20'"
_LABEL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.TYPE_LABELS.items()) + " END"
_NAME = "CASE city WHEN 'perm' THEN 'Пермь' ELSE 'Сочи' END"
_IN = "CASE city WHEN 'perm' THEN 'Перми' ELSE 'Сочи' END"


@query(f"""
WITH {CARDS}, {SOCIAL} SELECT seq FROM social
WHERE date <> 'always' AND date >= CASE city WHEN 'perm' THEN '2024-01-21' ELSE '2024-01-21' END
""")
def upcoming(spark, sf_dir):
    return listing.upcoming(social(spark, sf_dir), late()).select("seq")


@query(f"""
WITH {CARDS}, {SOCIAL} SELECT seq FROM social
WHERE date <> 'always' AND date >= CASE city WHEN 'perm' THEN '2024-01-21' ELSE '2024-01-20' END
""")
def upcoming_by_zone(spark, sf_dir):
    return listing.upcoming(social(spark, sf_dir), lit("2024-01-20 20:00:00").cast("timestamp")).select("seq")


@query(f"WITH {CARDS} SELECT id, city, slug FROM cards WHERE city = 'perm' AND slug = 'user-8-2024-01-01' LIMIT 1")
def event_by_slug(spark, sf_dir):
    return listing.event_by_slug(cards(spark, sf_dir), "perm", "user-8-2024-01-01").select("id", "city", "slug")


@query(f"WITH {VENUES} SELECT id, name FROM venues WHERE id = 'sochi-place-7'")
def venue_by_slug(spark, sf_dir):
    return listing.venue_by_slug(venues(spark, sf_dir), "sochi", "place-7").select("id", "name")


@query(f"""
WITH {CARDS}, {SOCIAL},
chosen AS (
  SELECT seq, 'any' AS choice, true AS day_ok, * EXCLUDE (seq) FROM social
  UNION ALL SELECT seq, 'today', date = '2024-01-20', * EXCLUDE (seq) FROM social
  UNION ALL SELECT seq, 'tomorrow', date = '2024-01-21', * EXCLUDE (seq) FROM social
  UNION ALL SELECT seq, 'weekend', date IN ('2024-01-20', '2024-01-21'), * EXCLUDE (seq) FROM social
)
SELECT seq, choice FROM chosen WHERE day_ok AND type IN ('quiz', 'concert') AND price_max >= 5 AND price_min <= 20
""")
def apply_filters(spark, sf_dir):
    rows = social(spark, sf_dir)
    picked = [
        listing.apply_filters(rows, day(), ["quiz", "concert"], when, 5, 20).select("seq", lit(when).alias("choice"))
        for when in ("any", "today", "tomorrow", "weekend")
    ]
    return picked[0].unionByName(picked[1]).unionByName(picked[2]).unionByName(picked[3])


@query(f"WITH {CARDS} SELECT seq, price_min * 1000 AS price_min FROM cards")
def listing_unfiltered(spark, sf_dir):
    """A listing nobody filtered keeps every event, however dear."""
    dear = cards(spark, sf_dir).withColumns({"price_min": F.col("price_min") * 1000, "price_max": F.col("price_max") * 1000})
    return listing.apply_filters(dear, day()).select("seq", "price_min")


@query(f"WITH {CARDS} SELECT id, date, seq FROM cards")
def events_by_date(spark, sf_dir):
    return listing.events_by_date(cards(spark, sf_dir)).select("id", "date", "seq")


@query(f"WITH {VENUES} SELECT id, type, name FROM venues")
def venues_by_type(spark, sf_dir):
    return listing.venues_by_type(venues(spark, sf_dir)).select("id", "type", "name")


@query(f"""
WITH {VENUES} SELECT id, (SELECT count(*) FROM venues) AS total, (SELECT count(*) FROM venues) > 8 AS show_all
FROM venues ORDER BY type, name, id LIMIT 8
""")
def first_venues(spark, sf_dir):
    return listing.first_venues(venues(spark, sf_dir)).select("id", "total", "show_all")


_TYPES = str(vocab.EVENT_TYPES)


@query(f"""
WITH {CARDS} SELECT DISTINCT type, CAST(list_position({_TYPES}, type) - 1 AS INT) AS position, {_LABEL} AS label FROM cards
""")
def available_types(spark, sf_dir):
    return listing.available_types(cards(spark, sf_dir))


@query(f"""
WITH {CARDS}, k AS (SELECT count(*) AS n FROM cards WHERE date >= '2024-01-20')
SELECT n, 'Найдено: ' || n || ' ' || CASE WHEN n % 100 BETWEEN 11 AND 14 THEN 'событий' WHEN n % 10 = 1 THEN 'событие'
  WHEN n % 10 BETWEEN 2 AND 4 THEN 'события' ELSE 'событий' END AS text FROM k
""")
def result_count(spark, sf_dir):
    return listing.result_count(listing.upcoming(cards(spark, sf_dir), now()))


@query(f"""
WITH {CARDS} SELECT seq, CASE WHEN seq % 3 = 0 THEN 'Own ' || seq ELSE title || ' — Афиша ' || {_NAME} END AS page_title,
  {_LABEL} || ' в ' || {_IN} || '. ' || price_text || '. ' || address || '.' AS page_description FROM cards
""")
def event_meta(spark, sf_dir):
    rows = cards(spark, sf_dir).withColumn("meta_title", expr("if(seq % 3 = 0, concat('Own ', seq), null)"))
    return listing.event_meta(rows).select("seq", "page_title", "page_description")


_VLABEL = "CASE type WHEN 'bowling' THEN 'Боулинг' WHEN 'karting' THEN 'Картинг' WHEN 'quest' THEN 'Квест' ELSE 'Развлекательное место' END"


@query(f"""
WITH {VENUES} SELECT id, {_VLABEL} || ' «' || name || '» в ' || {_IN} || ' — адрес, фото и карта' AS page_title,
  name || ', ' || {_NAME} || coalesce(', ' || address, '') || '. Адрес, район, расположение на карте.' AS page_description FROM venues
""")
def venue_meta(spark, sf_dir):
    return listing.venue_meta(venues(spark, sf_dir)).select("id", "page_title", "page_description")


@query(f"""
WITH {VENUES} SELECT id, '{SITE}/' || city || '/venues/place-' || regexp_extract(id, '\\d+$') || '/' AS url,
  CASE type WHEN 'quest' THEN 'EntertainmentBusiness' WHEN 'museum' THEN 'LocalBusiness' ELSE 'SportsActivityLocation' END AS kind,
  address AS street, image_url AS image, 3 AS crumbs, '{SITE}/' || city || '/venues/' AS second
FROM venues
""")
def venue_jsonld(spark, sf_dir):
    made = listing.venue_jsonld(venues(spark, sf_dir), SITE)
    get = lambda column, path: F.get_json_object(column, path)
    return made.select(
        "id", get("place_json", "$.url").alias("url"), get("place_json", "$['@type']").alias("kind"),
        get("place_json", "$.address.streetAddress").alias("street"), get("place_json", "$.image").alias("image"),
        F.json_array_length(get("crumbs_json", "$.itemListElement")).alias("crumbs"),
        get("crumbs_json", "$.itemListElement[1].item").alias("second"),
    )


@query(f"WITH {VENUES} SELECT id, CASE WHEN id LIKE 'perm-%' THEN substr(id, 6) ELSE id END AS slug FROM venues")
def venue_slug(spark, sf_dir):
    return venues(spark, sf_dir).select("id", listing.venue_slug(c("id"), lit("perm")).alias("slug"))


@query(f"""
WITH {CARDS}, {SOCIAL}, {VENUES}
SELECT '{SITE}/' || c || '/' AS url, '2024-01-20' AS changed, 'daily' AS change_frequency, 1.0 AS priority FROM (VALUES ('perm'), ('sochi')) t(c)
UNION ALL SELECT '{SITE}/' || c || '/venues/', '2024-01-20', 'monthly', 0.7 FROM (VALUES ('perm'), ('sochi')) t(c)
UNION ALL SELECT '{SITE}/' || city || '/events/' || slug || '/', strftime(parsed_at, '%Y-%m-%d'), 'weekly', 0.7 FROM social WHERE {_AHEAD}
UNION ALL SELECT '{SITE}/' || city || '/venues/place-' || regexp_extract(id, '\\d+$') || '/', '2024-01-01', 'monthly', 0.5 FROM venues
""")
def site_urls(spark, sf_dir):
    pages = listing.site_urls(social(spark, sf_dir), venues(spark, sf_dir), SITE, ["perm", "sochi"], now())
    return pages.select(
        "url", F.date_format("last_modified", "yyyy-MM-dd").alias("changed"), "change_frequency", "priority"
    )


@query(f"""
WITH {CARDS} SELECT id, seq, date, price_min FROM cards
WHERE city = 'perm' AND date IN ('2024-01-20', '2024-01-21') AND price_max >= 0 AND price_min <= 15
""")
def city_listing(spark, sf_dir):
    page = plan_city_listing(
        cards(spark, sf_dir), venues(spark, sf_dir), "perm", now(), day(), when="weekend", price_max=15
    )
    return page["events"].select("id", "seq", "date", "price_min")

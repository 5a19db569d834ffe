"""Feeds: pages are built out of the tables, then read back by the feed's reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import vocab
from eventloom.session import staged
from eventloom.sources import html_feeds, json_feeds, structured

from .base import SITE, query, scratch, spread, table
from .views import landed, pages_of

DAY = "strftime(ts, '%Y-%m-%d')"


def _json(*fields: str):
    """JSON text of a struct of SQL expressions `expr AS name`; null fields are left out."""
    parts = [f.rsplit(" AS ", 1) for f in fields]
    inner = ", ".join(f"'{name}', {expr}" for expr, name in parts)
    return F.expr(f"to_json(named_struct({inner}))")


@query(f"""
WITH games AS (
  SELECT event_id, ts, user_id, value,
    CASE WHEN event_id % 50 = 0 THEN '' ELSE 'g' || (event_id % 8000) END AS gid FROM events
), firsts AS (
  SELECT * FROM games QUALIFY gid = '' OR row_number() OVER (PARTITION BY gid ORDER BY event_id) = 1
)
SELECT CASE WHEN event_id % 17 = 0 THEN 'Name ' ELSE 'Game ' END || event_id AS title,
  {DAY} AS date, strftime(ts, '%H:%M') AS time_start,
  CASE WHEN event_id % 5 = 0 THEN 'QuizPlease' ELSE 'Bar ' || (user_id % 20) END AS venue_name,
  CASE WHEN event_id % 3 = 0 THEN 'Street ' || user_id ELSE 'Ulitsa ' || user_id END AS address,
  CASE event_id % 4 WHEN 0 THEN CAST(floor(value) AS INT) WHEN 1 THEN 500 ELSE 0 END AS price_min,
  CASE WHEN event_id % 4 = 1 THEN '500 ₽' WHEN event_id % 4 = 0 AND floor(value) <> 0
    THEN CAST(floor(value) AS INT) || ' ₽' ELSE 'Уточняйте у организатора' END AS price_text,
  CASE WHEN event_id % 9 = 0 THEN 'https://own.example/' || event_id
    WHEN gid = '' THEN '{SITE}/perm/schedule' ELSE '{SITE}/perm/game/' || gid END AS source_url
FROM firsts WHERE event_id % 13 <> 0 AND event_id % 34 <> 0
""")
def quiz_games(spark, sf_dir):
    games = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("no"),
        _json(
            "if(event_id % 50 = 0, '', concat('g', event_id % 8000)) AS id",
            "if(event_id % 17 = 0, null, concat('Game ', event_id)) AS title",
            "if(event_id % 34 = 0, null, concat('Name ', event_id)) AS name",
            "if(event_id % 13 = 0, 'soon', date_format(ts, 'dd.MM.yyyy HH:mm')) AS date",
            "named_struct('title', if(event_id % 5 = 0, null, concat('Bar ', user_id % 20)), "
            "'address_ru', if(event_id % 3 = 0, '', concat('Ulitsa ', user_id)), "
            "'address', concat('Street ', user_id)) AS place",
            "if(event_id % 4 = 0, value, null) AS price",
            "if(event_id % 4 = 1, '500', if(event_id % 4 = 2, 'ask', null)) AS current_price",
            "if(event_id % 9 = 0, concat('https://own.example/', event_id), null) AS url",
        ).alias("item"),
    )
    # A game without title and with a name of its own is kept; without both it is dropped.
    raw = pages_of(games, 30, '{"data":{"data":[', "]}}")
    read = json_feeds.quiz_games(raw, SITE + "/{city}")
    return read.select(
        "title", "date", "time_start", "venue_name", "address", "price_min", "price_text", "source_url"
    )


@query("""
SELECT 'Order ' || o_orderkey AS title,
  CASE o_orderkey % 5 WHEN 0 THEN 'concert' WHEN 1 THEN 'quiz' WHEN 2 THEN 'theater' ELSE 'other' END AS type,
  strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%H:%M') AS time_start,
  coalesce(min(CAST(trunc(l_extendedprice) AS INT)), 0) AS price_min,
  coalesce(max(CAST(trunc(l_extendedprice) AS INT)), 0) AS price_max,
  CASE WHEN min(l_extendedprice) IS NULL THEN 'уточняйте'
    WHEN min(CAST(trunc(l_extendedprice) AS INT)) = max(CAST(trunc(l_extendedprice) AS INT))
    THEN 'от ' || min(CAST(trunc(l_extendedprice) AS INT)) || ' ₽'
    ELSE 'от ' || min(CAST(trunc(l_extendedprice) AS INT)) || ' до ' || max(CAST(trunc(l_extendedprice) AS INT)) || ' ₽' END AS price_text,
  CASE o_orderkey % 3 WHEN 0 THEN 'Пермь' WHEN 1 THEN 'Пермь, Street ' || o_custkey ELSE 'Пермь Street ' || o_custkey END AS address,
  CASE o_orderkey % 3 WHEN 0 THEN 'Order ' || o_orderkey WHEN 1 THEN 'Street ' || o_custkey ELSE 'Пермь Street ' || o_custkey END AS venue_name,
  'https://tickets.example/' || o_orderkey AS source_url, o_orderpriority AS organizer
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderkey % 7 <> 0
GROUP BY o_orderkey, o_orderdate, o_custkey, o_orderpriority, l_linenumber // 8
""")
def ticket_events(spark, sf_dir):
    # At most eight tickets to an item, however many lines an order has.
    tickets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.expr("l_linenumber DIV 8")).agg(
        F.collect_list(F.struct(F.col("l_extendedprice").alias("price"))).alias("ticket_types")
    )
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(tickets, orders.o_orderkey == tickets.l_orderkey, "left")
    items = joined.select(
        F.col("o_orderkey").alias("no"),
        _json(
            "o_orderkey AS id", "if(o_orderkey % 14 = 0, 'x', concat(' Order ', o_orderkey)) AS name",
            "concat(date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\"), '+0500') AS starts_at",
            "if(o_orderkey % 14 = 7, null, concat('https://tickets.example/', o_orderkey)) AS url",
            "ticket_types AS ticket_types",
            "if(o_orderkey % 3 = 0, null, named_struct('city', 'Пермь', 'address', "
            "if(o_orderkey % 3 = 1, concat(' Street ', o_custkey), concat('Пермь Street ', o_custkey)))) AS location",
            "if(o_orderkey % 5 = 4, null, array(named_struct('id', 399), named_struct('id', "
            "array(460, 2335, 459, 462)[o_orderkey % 5]))) AS categories",
            "named_struct('name', o_orderpriority) AS organization",
        ).alias("item"),
    )
    raw = pages_of(items, 100, '{"values":[', "]}")
    return json_feeds.ticket_events(raw).select(
        "title", "type", "date", "time_start", "price_min", "price_max", "price_text", "address",
        "venue_name", "source_url", "organizer",
    )


@query(f"""
SELECT 'Show ' || event_id AS title,
  CASE event_id % 4 WHEN 0 THEN 'concert' WHEN 1 THEN 'theater' ELSE 'other' END AS type,
  CASE WHEN ts >= '2024-01-20' THEN {DAY} ELSE strftime(ts + INTERVAL 20 DAY, '%Y-%m-%d') END AS date,
  CASE WHEN ts >= '2024-01-20' THEN strftime(ts, '%H:%M') ELSE '10:00' END AS time_start,
  CASE event_id % 4 WHEN 0 THEN 1000 + user_id WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 0 END AS price_min,
  CASE event_id % 4 WHEN 0 THEN 2000 + user_id ELSE 0 END AS price_max,
  CASE event_id % 4 WHEN 0 THEN 'от ' || (1000 + user_id) || ' до ' || (2000 + user_id) || ' руб'
    WHEN 1 THEN 'бесплатно' WHEN 2 THEN 'уточняйте' ELSE 'по записи' END AS price_text,
  'Hall ' || (user_id % 9) AS venue_name, 'https://api.example/' || event_id AS source_url,
  CASE WHEN event_id % 3 = 0 THEN 'https://img.example/' || event_id END AS image_url
FROM events
WHERE event_id % 11 <> 0 AND ts + INTERVAL 20 DAY >= '2024-01-20'
""")
def listing_api_events(spark, sf_dir):
    items = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("no"),
        _json(
            "concat('Show ', event_id) AS title",
            "array(named_struct('start_date', date_format(ts + interval 20 days, 'yyyy-MM-dd'), 'start_time', '10:00:00'), "
            "named_struct('start_date', date_format(ts, 'yyyy-MM-dd'), 'start_time', date_format(ts, 'HH:mm:ss'))) AS dates",
            "if(event_id % 11 = 0, null, named_struct('title', concat('Hall ', user_id % 9), "
            "'address', concat('Street ', user_id))) AS place",
            "array(concat('от ', 1000 + user_id, ' до ', 2000 + user_id, ' руб'), 'Бесплатно', ' ', 'по записи')[event_id % 4] AS price",
            "array('unknown', array('concert', 'theater', 'tour', 'walk')[event_id % 4]) AS categories",
            "if(event_id % 3 = 0, array(named_struct('image', ''), named_struct('image', concat('https://img.example/', event_id))), null) AS images",
            "concat('https://api.example/', event_id) AS site_url",
        ).alias("item"),
    )
    raw = pages_of(items, 100, '{"results":[', "]}")
    return json_feeds.listing_api_events(raw, F.lit("2024-01-20").cast("date")).select(
        "title", "type", "date", "time_start", "price_min", "price_max", "price_text", "venue_name",
        "source_url", "image_url",
    )


@query("""
SELECT p_name AS title, 'bowling' AS type, 'always' AS date,
  CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE 'near ' || p_partkey END AS address,
  CASE WHEN p_partkey % 2 = 0 THEN 'District ' || p_size END AS district,
  CASE p_partkey % 4 WHEN 0 THEN 'https://img.example/main' || p_partkey
    WHEN 1 THEN 'https://img.example/any' || p_partkey END AS image_url,
  'по тарифам заведения' AS price_text
FROM part WHERE p_partkey % 13 <> 0
""")
def catalog_venues(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("no"),
        _json(
            "if(p_partkey % 26 = 0, null, if(p_partkey % 5 = 0, named_struct('primary', '', 'name', p_name), "
            "named_struct('primary', p_name, 'name', 'x'))) AS name_ex",
            "if(p_partkey % 3 = 0 and p_partkey % 13 <> 0, p_type, null) AS full_address_name",
            "if(p_partkey % 3 = 1 and p_partkey % 13 <> 0, p_brand, '') AS address_name",
            "if(p_partkey % 3 = 2 and p_partkey % 13 <> 0, concat('near ', p_partkey), null) AS address_comment",
            "array(named_struct('type', 'city', 'name', 'c'), named_struct('type', if(p_partkey % 2 = 0, 'district', 'area'), "
            "'name', concat('District ', p_size))) AS adm_div",
            "array(named_struct('subtype', 'logo', 'main_photo_url', 'l', 'url', 'l'), "
            "named_struct('subtype', if(p_partkey % 4 < 2, 'photo', 'video'), "
            "'main_photo_url', if(p_partkey % 4 = 0, concat('https://img.example/main', p_partkey), null), "
            "'url', concat('https://img.example/any', p_partkey))) AS external_content",
        ).alias("item"),
    )
    raw = pages_of(items, 10, '{"meta":{"code":200},"result":{"items":[', "]}}")
    return json_feeds.catalog_venues(raw, "bowling").select(
        "title", "type", "date", "address", "district", "image_url", "price_text"
    )


@query(f"""
WITH rows AS (
  SELECT o_orderkey, 'm' || (o_orderkey % 9000) AS id, o_orderdate, o_custkey, o_orderkey % 2 AS nested,
    row_number() OVER (PARTITION BY o_orderkey % 9000 ORDER BY o_orderkey % 2, o_orderkey) AS rn
  FROM orders
)
SELECT 'Item ' || o_orderkey AS title,
  strftime(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 10 DAY ELSE o_orderdate END, '%Y-%m-%d') AS date,
  CASE o_orderkey % 4 WHEN 0 THEN '{SITE}/storage/a.jpg' WHEN 1 THEN 'https://cdn.example/b.jpg'
    WHEN 2 THEN 'https://abs.example/c.jpg' END AS image_url,
  CASE WHEN o_orderkey % 5 = 0 THEN 'https://far.example/' || o_orderkey ELSE '{SITE}/e/' || o_orderkey END AS source_url,
  'Hall' AS venue_name
FROM rows WHERE rn = 1
""")
def museum_items(spark, sf_dir):
    item = _json(
        "concat('m', o_orderkey % 9000) AS id",
        "if(o_orderkey % 5 = 0, concat('https://far.example/', o_orderkey), concat('/e/', o_orderkey)) AS url",
        "array('/storage/a.jpg', '/storage/proxy/https://cdn.example/b.jpg', 'https://abs.example/c.jpg', null)[o_orderkey % 4] AS media_url_extended",
        "concat(' Item ', o_orderkey) AS title_extended",
        "date_format(o_orderdate, 'dd.MM.yyyy') AS starts_at",
        "if(o_orderkey % 3 = 0, date_format(o_orderdate + interval 10 days, 'dd.MM.yyyy'), "
        "if(o_orderkey % 3 = 1, date_format(o_orderdate, 'dd.MM.yyyy'), null)) AS ends_at",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", item.alias("item"))
    flat = pages_of(
        orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("no"), "item"),
        50, '{"data":[', "]}",
    )
    buckets = orders.filter("o_orderkey % 2 = 1").select(
        F.col("o_orderkey").alias("no"),
        F.concat(F.lit('{"id":1,"events":[['), "item", F.lit("]]}")).alias("item"),
    )
    last = 1_000_000_000  # exhibition pages come before event pages
    nested = pages_of(buckets, 50, '{"data":[', "]}").withColumn("page", F.col("page") + last)
    read = json_feeds.museum_items(flat.unionByName(nested), SITE, "exhibition", "Hall", "Street 1")
    return read.select("title", "date", "image_url", "source_url", "venue_name")


_CONTENT = "replace(replace(replace(text, chr(9), ' '), chr(10), ' '), chr(13), ' ')"


@query("""
SELECT conv_id AS owner_id, turn AS post_id, conv_id * 1000.0 + turn AS date_unix, text,
  'https://social.example/wall' || conv_id || '_' || turn AS url
FROM conversations
""")
def wall_posts(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("no"),
        _json("conv_id AS owner_id", "turn AS id", "conv_id * 1000 + turn AS date", "text AS text").alias("item"),
    )
    raw = pages_of(items, 1000, '{"response":{"count":1,"items":[', "]}}")
    return json_feeds.wall_posts(raw, "https://social.example").select(
        "owner_id", "post_id", "date_unix", "text", "url"
    )


@query("""
SELECT 'Концерт ' || event_id AS title,
  CASE event_id % 3 WHEN 0 THEN 'quiz' ELSE 'concert' END AS type,
  strftime(date_trunc('second', ts) + INTERVAL 3 HOUR, '%Y-%m-%d') AS date,
  strftime(date_trunc('second', ts) + INTERVAL 3 HOUR, '%H:%M') AS time_start,
  CASE WHEN event_id % 2 = 0 THEN strftime(date_trunc('second', ts) + INTERVAL 5 HOUR, '%H:%M') END AS time_end,
  CASE event_id % 5 WHEN 0 THEN 'Пермь' WHEN 1 THEN 'Hall' WHEN 2 THEN 'Street' ELSE 'Street' END AS address,
  CASE event_id % 5 WHEN 0 THEN 'Пермь' WHEN 1 THEN 'Hall' WHEN 2 THEN 'Street' ELSE 'Hall' END AS venue_name,
  'https://social.example/club' || event_id AS source_url
FROM events WHERE CAST(date_trunc('second', ts) + INTERVAL 3 HOUR AS DATE) >= '2024-01-20' AND event_id % 19 <> 0
""")
def event_groups(spark, sf_dir):
    items = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("no"),
        _json(
            "event_id AS id", "if(event_id % 19 = 0, ' a ', concat('Концерт ', event_id)) AS name",
            "if(event_id % 3 = 0, 'КВИЗ', 'зал') AS activity",
            "unix_timestamp(cast(ts AS timestamp)) AS start_date",
            "if(event_id % 2 = 0, unix_timestamp(cast(ts AS timestamp)) + 7200, 0) AS finish_date",
            "if(event_id % 5 = 0, null, named_struct('title', if(event_id % 5 = 2, ' ', 'Hall'), "
            "'address', if(event_id % 5 = 1, null, ' Street'))) AS place",
        ).alias("item"),
    )
    raw = pages_of(items, 500, '{"response":{"groups":[', "]}}")
    return json_feeds.event_groups(raw, "https://social.example", F.lit("2024-01-20").cast("date")).select(
        "title", "type", "date", "time_start", "time_end", "address", "venue_name", "source_url"
    )


@query("""
SELECT 'q' || (page_id // 30) AS query, page_id % 30 AS no,
  CASE WHEN page_id // 30 % 3 = 2 THEN url ELSE url END AS url,
  (['serper', 'brave', 'duckduckgo'])[page_id // 30 % 3 + 1] AS provider
FROM pages WHERE page_id % 30 <> 29
""")
def search_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "page_id DIV 30 AS q", "url")
    wrapped = (
        "concat('<a rel=\"nofollow\" class=\"result__a big\" href=\"//search.example/l/?uddg=', "
        "url_encode(url), '&amp;rut=1\">hit</a><a class=\"other\" href=\"x\">no</a>')"
    )
    item = F.expr(
        "CASE q % 3 WHEN 0 THEN to_json(named_struct('link', if(page_id % 30 = 29, '', url))) "
        "WHEN 1 THEN to_json(named_struct('url', if(page_id % 30 = 29, '', url))) "
        f"ELSE if(page_id % 30 = 29, '<a class=\"result__a\">none</a>', {wrapped}) END"
    )
    pages = rows.withColumn("item", item).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("page_id", "item"))).alias("r")
    ).withColumn("items", F.transform("r", lambda r: r["item"]))
    content = (
        F.when(F.col("q") % 3 == 0, F.concat(F.lit('{"organic":['), F.array_join("items", ","), F.lit("]}")))
        .when(F.col("q") % 3 == 1, F.concat(F.lit('{"web":{"results":['), F.array_join("items", ","), F.lit("]}}")))
        .otherwise(F.concat(F.lit("<html><body>"), F.array_join("items", ""), F.lit("</body></html>")))
    )
    raw = pages.select(
        F.concat(F.lit("q"), "q").alias("query"),
        F.expr("array('serper', 'brave', 'duckduckgo')[q % 3]").alias("provider"),
        content.alias("content"),
    )
    return json_feeds.search_hits(raw).select("query", F.col("rank").alias("no"), "url", "provider")


@query("""
SELECT 'Answer ' || event_id AS title, CAST(floor(value) AS INT) AS price_min,
  strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_id % 3 = 0 THEN 'вечером' ELSE '' END AS tags,
  'https://doc.example/' || (event_id // 20) AS source_url
FROM events WHERE event_id % 9 <> 0 AND event_id % 8 <> 0
""")
def model_responses(spark, sf_dir):
    from eventloom.operators.cards import validate_cards

    items = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("no"),
        _json(
            "if(event_id % 9 = 0, 'NOT_AN_EVENT', concat('Answer ', event_id)) AS title",
            "if(event_id % 8 = 0, 'unheard of', 'concert') AS type",
            "date_format(ts, 'yyyy-MM-dd') AS date", "cast(floor(value) AS int) AS price_min",
            "cast(cast(floor(value) AS int) AS string) AS price_max", "'x' AS price_text",
            "'Street' AS address", "'Hall' AS venue_name",
            "if(event_id % 3 = 0, array('вечером', 'made up'), null) AS tags",
        ).alias("item"),
    )
    even = pages_of(items.filter("no DIV 20 % 2 = 0"), 20, '{"events":[', "]}")
    odd = pages_of(items.filter("no DIV 20 % 2 = 1"), 20, " [", "]")
    raw = even.unionByName(odd).withColumn(
        "url", F.concat(F.lit("https://doc.example/"), F.col("page").cast("string"))
    )
    valid, _ = validate_cards(json_feeds.model_responses(raw))
    return valid.select("title", "price_min", "date", F.array_join("tags", ",").alias("tags"), "source_url")


@query("""
SELECT url, 'feed' AS source FROM pages WHERE page_id % 40 <> 0 AND url LIKE '%/en/%'
""")
def sitemap_urls(spark, sf_dir):
    entry = F.when(
        F.col("page_id") % 40 == 0, F.lit("<url><lastmod>2024-01-01</lastmod></url>")
    ).otherwise(
        F.concat(
            F.lit("<url><loc>\n "), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>")
        )
    )
    items = table(spark, sf_dir, "pages").select(F.col("page_id").alias("no"), entry.alias("item"))
    raw = pages_of(
        items, 100, '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>"
    ).withColumn("content", F.replace("content", F.lit(",<url>"), F.lit("<url>")))
    return structured.sitemap_urls(raw, "/en/").select("url", "source")


@query("""
WITH anchors AS (
  SELECT page_id, url AS listing_url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages
)
SELECT DISTINCT listing_url, regexp_extract(listing_url, '^[a-z]+://[^/?#]*', 0) || replace(href, '&amp;', '&') AS url
FROM anchors WHERE regexp_matches(href, '^/[a-zA-Z]')
""")
def listing_links(spark, sf_dir):
    raw = landed(table(spark, sf_dir, "pages").selectExpr("url", "html AS content", "page_id AS page"))
    return html_feeds.listing_links(raw, "^/[a-zA-Z]").select("listing_url", "url")


def _jsonld_pages(spark, sf_dir):
    """A page per part: an event as an object, in a list, in a graph, or nested deeper than usual."""
    event = _json(
        "if(p_partkey % 4 = 1, array('Thing', 'MusicEvent'), array(array('Event', 'TheaterEvent', 'Event', 'Place')[p_partkey % 4])) AS @type",
        "concat(' ', p_name, ' ', p_partkey) AS name",
        "concat('2024-02-', lpad(1 + p_partkey % 28, 2, '0'), if(p_partkey % 2 = 0, 'T19:30:00+03:00', '')) AS startDate",
        "named_struct('name', p_brand, 'address', named_struct('streetAddress', p_type, 'addressLocality', "
        "if(p_partkey % 3 = 0, null, 'Town'))) AS location",
        "array(named_struct('price', cast(p_retailprice AS string), 'lowPrice', null), "
        "named_struct('price', null, 'lowPrice', p_retailprice + p_partkey % 3)) AS offers",
        "array(named_struct('url', concat('https://img.example/', p_partkey))) AS image",
        "named_struct('name', p_brand) AS organizer", "concat('/e/', p_partkey) AS url",
    )
    other = '{"@type":"WebSite","name":"site"}'
    nested = (
        "CASE p_partkey % 5 WHEN 0 THEN ev "
        f"WHEN 1 THEN concat('[{other},', ev, ']') "
        f"WHEN 2 THEN concat('{{\"@context\":\"c\",\"@graph\":[{other},', ev, ']}}') "
        "WHEN 3 THEN concat('[[[[{\"@graph\":[[', ev, ']]}]]]]') "
        "ELSE concat('{bad json', ev) END"
    )
    page = (
        "concat('<html><head><script type=\"application/ld+json\">', ld, '</script>', "
        "'<script>var x=1;</script></head><body>x</body></html>')"
    )
    parts = spread(table(spark, sf_dir, "part")).withColumn("ev", event)
    return landed(
        parts.withColumn("ld", F.expr(nested)).select(
            F.expr(page).alias("content"), F.col("p_partkey").alias("page"),
            F.concat(F.lit("https://site.example/p"), F.col("p_partkey").cast("string")).alias("url"),
        )
    )


_JSONLD = """
jsonld AS (
  SELECT p_partkey, p_name || ' ' || p_partkey AS title,
    CASE p_partkey % 4 WHEN 1 THEN 'concert' WHEN 2 THEN 'other' ELSE 'other' END AS type,
    '2024-02-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') AS date,
    CASE WHEN p_partkey % 2 = 0 THEN '19:30' END AS time_start,
    p_brand AS venue_name,
    CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_type || ', Town' END AS address,
    CAST(trunc(p_retailprice) AS INT) AS price_min,
    CAST(trunc(p_retailprice + p_partkey % 3) AS INT) AS price_max,
    'https://img.example/' || p_partkey AS image_url, p_brand AS organizer,
    '/e/' || p_partkey AS event_url, 'https://site.example/p' || p_partkey AS source_url
  FROM part WHERE p_partkey % 5 <> 4 AND p_partkey % 4 <> 3
)"""


@query(f"""WITH {_JSONLD}
SELECT * EXCLUDE (p_partkey), CASE WHEN price_min = price_max THEN 'от ' || price_min || ' ₽'
  ELSE 'от ' || price_min || ' до ' || price_max || ' ₽' END AS price_text
FROM jsonld
""")
def jsonld_events(spark, sf_dir):
    return structured.jsonld_events(_jsonld_pages(spark, sf_dir), "other").select(
        "title", "type", "date", "time_start", "venue_name", "address", "price_min", "price_max",
        "image_url", "organizer", "event_url", "source_url", "price_text",
    )


@query(f"""WITH {_JSONLD}
SELECT source_url, title FROM jsonld
UNION ALL
SELECT 'https://site.example/p' || p_partkey, 'Model ' || p_partkey FROM part
WHERE p_partkey % 6 = 0 AND NOT (p_partkey % 5 <> 4 AND p_partkey % 4 <> 3)
""")
def structured_or_model(spark, sf_dir):
    read = staged(structured.jsonld_events(_jsonld_pages(spark, sf_dir), "other"), f"{scratch(spark)}/structured")
    answers = table(spark, sf_dir, "part").filter("p_partkey % 6 = 0").select(
        F.concat(F.lit('[{"title":"Model '), F.col("p_partkey").cast("string"), F.lit('"}]')).alias("content"),
        F.concat(F.lit("https://site.example/p"), F.col("p_partkey").cast("string")).alias("url"),
        F.col("p_partkey").alias("page"),
    )
    model = json_feeds.model_responses(landed(answers))
    return structured.structured_or_model(read, model).select("source_url", "title")


@query("""
WITH shows AS (
  SELECT event_id, ts, row_number() OVER (PARTITION BY event_id % 7000 ORDER BY event_id) AS rn,
    event_id % 7000 AS k
  FROM events
  WHERE event_id % 12 <> 0 AND ts >= '2024-01-20'
)
SELECT 'Show & <' || event_id || '>' AS title, strftime(ts, '%Y-%m-%d') AS date,
  CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%H:%M') END AS time_start,
  '/playbills/playbill/' || k AS source_url,
  CASE WHEN event_id % 3 = 0 THEN '/img/' || event_id || '.jpg' END AS image_url
FROM shows WHERE rn = 1
""")
def playbill_cards(spark, sf_dir):
    card = F.expr(
        "concat('<article class=\"c\" data-element=\"event-card\" data-calendar-date=\"', date_format(ts, 'yyyy-MM-dd'), '\">', "
        "if(event_id % 4 = 0, '', concat('<link data-element=\"event-date\" content=\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '\">')), "
        "if(event_id % 3 = 0, concat('<img src=\"/img/', event_id, '.jpg\">'), ''), "
        "'<div><a href=\"/other\">no</a>', if(event_id % 12 = 0, '', concat('<a href=\"/playbills/playbill/', event_id % 7000, '\">\n Show &amp; <b>&lt;', event_id, '&gt;</b> </a>')), '</div></article>')"
    )
    items = table(spark, sf_dir, "events").select(F.col("event_id").alias("no"), card.alias("item"))
    joined = pages_of(items, 60, "<div>", "</div>")
    raw = joined.withColumn("content", F.to_json(F.struct("content")))
    read = html_feeds.playbill_cards(raw, "concert", "Opera", "Street 1", F.lit("2024-01-20").cast("date"))
    return read.select("title", "date", "time_start", "source_url", "image_url")


@query("""
SELECT * FROM (
  SELECT conv_id, 'post ' || conv_id || chr(10) || turn AS text,
    'https://t.example/' || conv_id || '/' || turn AS url, 1704067200.0 + turn * 60 AS date_unix
  FROM conversations WHERE turn % 5 <> 4
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3
)
""")
def channel_posts(spark, sf_dir):
    message = F.expr(
        "concat('<div class=\"x tgme_widget_message\">', if(turn % 5 = 4, '', concat("
        "'<div class=\"tgme_widget_message_text\"> post ', conv_id, ' <br> <b>', turn, '</b></div>')), "
        "'<a class=\"tgme_widget_message_date\" href=\"https://t.example/', conv_id, '/', turn, '\"><time datetime=\"', "
        "date_format(timestamp_seconds(1704067200 + turn * 60), \"yyyy-MM-dd'T'HH:mm:ss\"), '+00:00\">t</time></a></div>')"
    )
    messages = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", message.alias("m"), F.expr("turn DIV 20").alias("page")
    )
    pages = messages.groupBy("conv_id", "page").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("r"))
    raw = landed(
        pages.select(
            F.array_join(F.transform("r", lambda r: r["m"]), "").alias("content"),
            F.concat(F.lit("https://t.example/s/"), F.col("conv_id").cast("string")).alias("url"), "page",
        )
    )
    return html_feeds.channel_posts(raw, 3).select(
        F.regexp_extract("group_url", r"(\d+)$", 1).cast("long").alias("conv_id"), "text", "url", "date_unix"
    )


@query("""
SELECT 'Place ' || p_brand AS title, 'Street ' || p_size AS address, 'karting' AS type, page AS no,
  arg_min(CASE WHEN p_partkey % 2 = 0 THEN 'https://img.example/' || p_partkey || '_2.jpg'
    ELSE 'https://img.example/' || p_partkey || '.png' END, p_partkey) AS image_url
FROM (SELECT *, p_partkey // 40 AS page FROM part WHERE p_partkey % 8 <> 0)
GROUP BY ALL
""")
def venue_cards_html(spark, sf_dir):
    card = F.expr(
        "concat('<div class=\"', if(p_partkey % 3 = 0, '_1kf6gff', '_5b28jpo'), '\">', "
        "'<a class=\"_1rehek\" href=\"#\"><span>Place&nbsp;', p_brand, '</span></a>', "
        "'<div class=\"_klarpw\">Закроется через 40 мин</div>', "
        "if(p_partkey % 8 = 0, '', concat('<div class=\"_klarpw\">Street ', p_size, if(p_partkey % 4 = 1, '  2 филиала', ''), '</div>')), "
        "'<div class=\"_1dk5lq4\" style=\"', if(p_partkey % 2 = 0, concat('background-image: image-set(url(&quot;https://img.example/', p_partkey, '_1.jpg&quot;) 1x, url(&quot;https://img.example/', p_partkey, '_2.jpg&quot;) 2x);'), "
        "concat('background-image: url(https://img.example/', p_partkey, '.png);')), '\"></div></div>')"
    )
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("no"), card.alias("item"))
    raw = pages_of(items, 40, "<html><body>", "</body></html>").withColumn(
        "url", F.concat(F.lit("https://map.example/"), F.col("page").cast("string"))
    )
    return html_feeds.venue_cards_html(raw, "karting").select(
        "title", "address", "type", F.col("seq.page").alias("no"), "image_url"
    )


@query("""
WITH bare AS (
  SELECT page_id, regexp_replace(regexp_replace(html,
    '(?is)<(script|style|noscript|svg|iframe|head)\\b[^>]*>.*?</(script|style|noscript|svg|iframe|head)\\s*>', '', 'g'),
    '(?is)^.*?(<body)', '\\1') AS body FROM pages
)
SELECT page_id, regexp_replace(body, '</html>$', '') AS html FROM bare
""")
def clean_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return html_feeds.clean_html(pages, "html")


@query(r"""
WITH parts AS (
  SELECT page_id, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
    regexp_extract(html, '(?s)</h1>(.*)</article>', 1) AS body FROM pages),
split AS (SELECT page_id, string_split(body, '<p>') AS p FROM parts),
lines AS (
  SELECT page_id, i, replace(p[i], '</p>', '') AS t FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM split)),
texts AS (SELECT page_id, 0 AS i, false AS bold, '# ' AS mark, h1 AS t FROM parts UNION ALL SELECT page_id, -1, false, '', ad FROM parts
  UNION ALL SELECT page_id, i, starts_with(t, '<b>'), '', replace(replace(t, '<b>', ''), '<br>', '') FROM lines),
plain AS (
  SELECT page_id, i, bold, mark, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '*', '\*'), '_', '\_'), '\s+', ' ', 'g')) AS t FROM texts)
SELECT page_id, string_agg(mark || CASE WHEN bold THEN '**' || t || '**' ELSE t END, chr(10) || chr(10) ORDER BY i) AS html
FROM plain WHERE t <> '' GROUP BY page_id
""")
def clean_html_markdown(spark, sf_dir):
    """The pages as Markdown: the advert, the title, paragraphs; unclosed bold text ends with its paragraph."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return html_feeds.clean_markdown(pages, "html")


@query(r"""
SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || 'Costs **' || p_size || '** at [' || p_brand || '](/b?x=1 "Brand").' || chr(10) || chr(10)
  || '* one' || chr(10) || '* two' || chr(10) || '  1. in' || chr(10) || '  2. side' || chr(10) || chr(10)
  || '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_type || ' | ' || p_size || ' |' || chr(10) || chr(10)
  || '> Said *so*.' || chr(10) || chr(10) || '## End' AS content FROM part
""")
def clean_markdown_structure(spark, sf_dir):
    """Headings, marks, links, nested lists, tables and quotes; navigation and images are gone."""
    page = F.expr(
        "concat('<html><head><title>x</title></head><body><nav><a href=\"/\">Home</a></nav><h1>', p_name, '</h1>\\n<p>Costs <b>', p_size, "
        "'</b> at <a href=\"/b?x=1\" title=\"Brand\" class=\"c\">', p_brand, '</a>.<img src=\"i.png\" alt=\"no\"></p><ul><li>one<li>two<ol><li>in</li>"
        "<li>side</ol></ul><table><tr><th>name</th><th>size</th></tr><tr><td>', p_type, '</td><td>', p_size, '</td></tr></table>"
        "<blockquote><p>Said <em>so</em>.</blockquote><script>x < 1</script><h2>End</h2><footer>f</footer></body></html>')"
    )
    parts = spread(table(spark, sf_dir, "part"))
    return html_feeds.clean_markdown(parts.select("p_partkey", page.alias("content")), "content")


@query("""
SELECT page_id, '<body><p>' || page_id || '</p>' || CASE WHEN page_id % 2 = 0 THEN '<p>left' ELSE '' END || '</body>' AS html FROM pages
""")
def clean_html_unclosed(spark, sf_dir):
    page = F.expr(
        "concat('<html><head><title>x</title>', if(page_id % 3 = 0, '</head>', ''), '<body><svg><p>', page_id, '</p>', "
        "if(page_id % 2 = 0, '<noscript><p>left', ''), '</body></html>')"
    )
    pages = table(spark, sf_dir, "pages").select("page_id", page.alias("html"))
    return html_feeds.clean_html(pages, "html")


@query("""
SELECT c AS city, name, feed_order, CASE WHEN feed_order % 2 = 0 THEN 'per_url' ELSE 'direct_api' END AS extraction_mode,
  CASE WHEN feed_order % 3 = 0 THEN 0 ELSE feed_order * 10 END AS priority,
  feed_order % 4 <> 3 AS enabled, feed_order % 5 = 4 AS full_snapshot
FROM (SELECT 'city ' || n_regionkey AS c, n_name AS name,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS feed_order FROM nation)
""")
def sources_dim(spark, sf_dir):
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    rows = table(spark, sf_dir, "nation").withColumn("o", order).select(
        F.concat(F.lit("city "), F.col("n_regionkey").cast("string")).alias("city"), "o",
        F.expr(
            "named_struct('name', n_name, 'extraction_mode', if(o % 2 = 0, null, 'direct_api'), "
            "'priority', if(o % 3 = 0, null, o * 10), 'enabled', if(o % 4 = 3, false, null), "
            "'full_snapshot', if(o % 5 = 4, true, null))"
        ).alias("s"),
    )
    path = scratch(spark)
    rows.groupBy("city").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda r: r["s"]).alias("sources")
    ).write.json(path)
    return structured.sources_dim(spark, path).select(
        "city", "name", "feed_order", "extraction_mode", "priority", "enabled", "full_snapshot"
    )


@query("""
SELECT n_name AS name, 'forced' AS extraction_mode FROM nation WHERE n_nationkey % 3 <> 0
""")
def enabled_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").selectExpr(
        "n_name AS name", "'per_url' AS extraction_mode", "n_nationkey % 3 <> 0 AS enabled"
    )
    return structured.enabled_sources(rows, mode_override="forced").drop("enabled")

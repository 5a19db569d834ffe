"""Column functions and row tests over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import vocab
from eventloom.functions import dates, predicates, prices, text, types, urls
from eventloom.operators import cards as card_ops
from eventloom.sources import html_feeds, json_feeds, structured

from .base import AS_OF, NOW, SITE, query, table
from .views import CARDS, HITS, SOCIAL, cards, hits, social

E, D, P = "events", "documents", "pages"
T = lambda s, d, n: table(s, d, n)
day = lambda: F.lit(AS_OF).cast("date")
now = lambda: F.lit(NOW).cast("timestamp")
c, lit, expr = F.col, F.lit, F.expr

_ASCII = "regexp_replace(strip_accents({0}), '[^\\x00-\\x7f]+', '', 'g')"
_SLUG = "substr(trim(regexp_replace({0}, '[^a-z0-9]+', '-', 'g'), '-'), 1, 80)"
_PLAIN = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


# --- text --------------------------------------------------------------------------------


@query(f"""
SELECT doc_id, {_SLUG.format(_ASCII.format("lower(text)"))} || '-2024-01-' || lpad(CAST(1 + doc_id % 30 AS VARCHAR), 2, '0') AS slug,
  {_SLUG.format(_ASCII.format("lower(text)"))} AS undated
FROM documents
""")
def slugify(spark, sf_dir):
    date = F.concat(lit("2024-01-"), F.lpad((1 + c("doc_id") % 30).cast("string"), 2, "0"))
    return T(spark, sf_dir, D).select(
        "doc_id", text.slugify(c("text"), date).alias("slug"),
        text.slugify(c("text"), lit("always")).alias("undated"),
    )


@query(f"""
SELECT event_id, 'shchuka-yozh-tsirk-o' || user_id || '-vecher-chay-yug-obyom-mysh-hleb-eho' AS slug
FROM events
""")
def transliterate(spark, sf_dir):
    title = F.concat(
        lit("Щука, ёж — «Цирк» №"), c("user_id").cast("string"),
        lit(": вечер; ЧАЙ & ЮГ, объём, мышь; Хлеб эхо"),
    )
    return T(spark, sf_dir, E).select("event_id", text.slugify(title).alias("slug"))


@query(f"WITH {CARDS} SELECT id, city || '-' || slug AS event_id FROM cards")
def event_id(spark, sf_dir):
    return cards(spark, sf_dir).select("id", text.event_id(c("city"), c("slug")).alias("event_id"))


@query(f"SELECT doc_id, {_PLAIN.format('text')} AS plain FROM documents")
def normalize_text(spark, sf_dir):
    return T(spark, sf_dir, D).select("doc_id", text.normalize_text(c("text")).alias("plain"))


@query(f"""
SELECT doc_id, substr(sha256({_PLAIN.format('text')} || '|2024-01-01|' || {_PLAIN.format('source')}), 1, 16) AS fingerprint
FROM documents
""")
def fingerprint(spark, sf_dir):
    return T(spark, sf_dir, D).select(
        "doc_id", text.fingerprint(c("text"), lit("2024-01-01"), c("source")).alias("fingerprint")
    )


@query("""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
    '(?is)<(script|style|template)\\b[^>]*>.*?</(script|style|template)\\s*>', '', 'g'), '(?is)^.*?<body\\b[^>]*>', '') AS b
  FROM pages
)
SELECT page_id, sha256(html) AS hash,
  sha256(trim(regexp_replace(regexp_replace(b, '(?s)\\s*<[^>]*>\\s*', '', 'g'), '\\s+', ' ', 'g'))) AS visible_hash
FROM bare
""")
def content_hash(spark, sf_dir):
    return T(spark, sf_dir, P).select(
        "page_id", text.content_hash(c("html")).alias("hash"),
        text.content_hash(c("html"), True).alias("visible_hash"),
    )


@query("""
SELECT doc_id, nullif(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '') AS cleaned,
  substr(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 1, 500) AS description FROM documents
""")
def clean_text(spark, sf_dir):
    return T(spark, sf_dir, D).select(
        "doc_id", text.clean(c("text")).alias("cleaned"),
        text.clean_description(c("text")).alias("description"),
    )


@query("""
SELECT event_id, CASE WHEN event_id % 100 BETWEEN 11 AND 14 THEN 'событий' WHEN event_id % 10 = 1 THEN 'событие'
  WHEN event_id % 10 BETWEEN 2 AND 4 THEN 'события' ELSE 'событий' END AS form FROM events
""")
def plural_ru(spark, sf_dir):
    return T(spark, sf_dir, E).select("event_id", text.plural_ru(c("event_id")).alias("form"))


# --- dates -------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN event_id % 5 <> 3 THEN strftime(ts, '%Y-%m-%d') END AS date,
  CASE WHEN event_id % 5 IN (0, 4) THEN strftime(ts, '%H:%M') END AS time FROM events
""")
def parse_iso(spark, sf_dir):
    shapes = expr(
        "CASE event_id % 5 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") "
        "WHEN 1 THEN date_format(ts, 'yyyy-MM-dd') WHEN 2 THEN date_format(ts, 'yyyy-MM-dd HH:mm') "
        "WHEN 3 THEN concat('on ', date_format(ts, 'yyyy-MM-dd')) "
        "ELSE concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm\"), '+03:00') END"
    )
    return T(spark, sf_dir, E).select(
        "event_id", dates.iso_date_part(shapes).alias("date"), dates.iso_time_part(shapes).alias("time")
    )


@query("""
SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN strftime(ts, '%Y-%m-%d') END AS date FROM events
""")
def parse_dmy(spark, sf_dir):
    shapes = expr(
        "CASE event_id % 4 WHEN 0 THEN date_format(ts, 'dd.MM.yyyy') WHEN 1 THEN date_format(ts, ' d.M.yyyy ') "
        "WHEN 2 THEN date_format(ts, 'd.MM.yyyy') ELSE date_format(ts, 'dd/MM/yyyy') END"
    )
    return T(spark, sf_dir, E).select("event_id", dates.parse_dmy(shapes).alias("date"))


@query("""
SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(date_trunc('second', ts) + INTERVAL 3 HOUR, '%Y-%m-%d') END AS date,
  CASE WHEN event_id % 9 <> 0 THEN strftime(date_trunc('second', ts) + INTERVAL 3 HOUR, '%H:%M') END AS time FROM events
""")
def unix_to_local(spark, sf_dir):
    seconds = expr("if(event_id % 9 = 0, 0, unix_timestamp(cast(ts AS timestamp)))")
    local = dates.unix_to_local(seconds)
    return T(spark, sf_dir, E).select(
        "event_id", F.date_format(local, "yyyy-MM-dd").alias("date"), F.date_format(local, "HH:mm").alias("time")
    )


@query("""
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN epoch(date_trunc('second', ts)) - 10800 END AS unix FROM events
""")
def iso_to_unix(spark, sf_dir):
    shapes = expr(
        "if(event_id % 7 = 0, 'no date', concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+03:00'))"
    )
    return T(spark, sf_dir, E).select("event_id", dates.iso_to_unix(shapes).alias("unix"))


@query("""
SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 4 DAY ELSE o_orderdate END, '%Y-%m-%d') AS date
FROM orders
""")
def range_end_date(spark, sf_dir):
    o = T(spark, sf_dir, "orders").withColumn("s", F.date_format("o_orderdate", "yyyy-MM-dd"))
    end = expr(
        "CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate + interval 4 days, 'yyyy-MM-dd') WHEN 1 THEN s END"
    )
    return o.select("o_orderkey", dates.range_end_date(c("s"), end).alias("date"))


_MONTHS = str(vocab.MONTHS)


@query(f"""
WITH {CARDS}, {SOCIAL},
shown AS (SELECT *, day(ts) || ' ' || ({_MONTHS})[month(ts)] AS d FROM social)
SELECT seq, CASE WHEN date = 'always' THEN 'ежедневно' WHEN time_start IS NULL THEN d ELSE d || ', ' || time_start END AS card,
  CASE WHEN date = 'always' THEN 'Доступно ежедневно' WHEN time_start IS NULL THEN d WHEN time_end IS NULL
    THEN d || ', ' || time_start ELSE d || ', ' || time_start || '–' || time_end END AS page
FROM shown
""")
def format_event_date(spark, sf_dir):
    return social(spark, sf_dir).select(
        "seq", dates.format_event_date(c("date"), c("time_start")).alias("card"),
        dates.format_event_date(c("date"), c("time_start"), c("time_end")).alias("page"),
    )


# --- urls --------------------------------------------------------------------------------


@query(f"WITH {HITS} SELECT seq, domain FROM hits")
def domain_of(spark, sf_dir):
    return hits(spark, sf_dir).select("seq", urls.domain_of(c("url")).alias("domain"))


@query("""
WITH linked AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages
)
SELECT page_id, href, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || replace(href, '&amp;', '&') AS joined,
  regexp_extract(url, '^[a-z]+://[^?#]*/', 0) || 'rel/x?y=1' AS relative,
  regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/top' AS climbed, 'https://other.example/a' AS absolute
FROM linked
""")
def url_join(spark, sf_dir):
    found = T(spark, sf_dir, P).select(
        "page_id", "url", F.explode(html_feeds.page_links(c("html"))).alias("href")
    )
    up = F.concat(F.repeat(lit("../"), lit(9)), lit("./top"))
    return found.select(
        "page_id", "href", urls.url_join(c("url"), c("href")).alias("joined"),
        urls.url_join(c("url"), lit("rel/x?y=1")).alias("relative"),
        urls.url_join(c("url"), up).alias("climbed"),
        urls.url_join(c("url"), lit("https://other.example/a")).alias("absolute"),
    )


@query("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://own.example/' || page_id WHEN 2 THEN url
  WHEN 3 THEN url WHEN 4 THEN regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/e/' || page_id ELSE url END AS resolved
FROM pages
""")
def resolve_url(spark, sf_dir):
    link = expr(
        "CASE page_id % 6 WHEN 0 THEN null WHEN 1 THEN concat(' https://own.example/', page_id) WHEN 2 THEN ' # ' "
        "WHEN 3 THEN concat('https://Go.Taplink.cc/', page_id) WHEN 4 THEN concat('/e/', page_id) "
        "ELSE 'javascript:void(0)' END"
    )
    return T(spark, sf_dir, P).select("page_id", urls.resolve_url(link, c("url")).alias("resolved"))


@query("SELECT page_id, url AS target, url AS direct FROM pages")
def unwrap_redirect(spark, sf_dir):
    wrapped = F.concat(lit("//search.example/l/?x=1&uddg="), F.url_encode("url"), lit("&rut=2"))
    return T(spark, sf_dir, P).select(
        "page_id", urls.unwrap_redirect(wrapped).alias("target"), urls.unwrap_redirect(c("url")).alias("direct")
    )


@query(f"""
WITH {HITS} SELECT seq, regexp_matches(domain, '(^|\\.)(example\\.net|example\\.org)$') AS listed FROM hits
""")
def domain_in_set(spark, sf_dir):
    return hits(spark, sf_dir).select(
        "seq", urls.domain_in_set(urls.domain_of(c("url")), ["example.net", "example.org"]).alias("listed")
    )


@query(f"""
WITH {HITS} SELECT seq, domain FROM hits WHERE NOT regexp_matches(domain, '(^|\\.)(example\\.net|example\\.org)$')
""")
def drop_listed_domains(spark, sf_dir):
    listed = T(spark, sf_dir, P).select(
        F.regexp_extract("url", r"(example\.(net|org))[/?#]", 1).alias("domain")
    ).filter("domain <> ''")
    found = hits(spark, sf_dir).withColumn("domain", urls.domain_of(c("url")))
    return urls.drop_listed_domains(found, "domain", listed).select("seq", "domain")


@query("""
SELECT s_suppkey, 'https://2gis.ru/search/' || url_encode(s_name || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' ул. ' || s_suppkey END) AS map
FROM supplier
""")
def map_url(spark, sf_dir):
    from eventloom.operators.listing import map_url as link

    address = expr("if(s_suppkey % 3 = 0, null, concat('ул. ', s_suppkey))")
    return T(spark, sf_dir, "supplier").select("s_suppkey", link(c("s_name"), address).alias("map"))


# --- prices ------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber // 8 AS part, min(CAST(trunc(l_quantity) AS INT)) AS price_min, max(CAST(trunc(l_quantity) AS INT)) AS price_max,
  CASE WHEN min(CAST(trunc(l_quantity) AS INT)) = max(CAST(trunc(l_quantity) AS INT)) THEN 'от ' || min(CAST(trunc(l_quantity) AS INT)) || ' ₽'
    ELSE 'от ' || min(CAST(trunc(l_quantity) AS INT)) || ' до ' || max(CAST(trunc(l_quantity) AS INT)) || ' ₽' END AS price_text
FROM lineitem GROUP BY l_orderkey, l_linenumber // 8
""")
def price_range(spark, sf_dir):
    grouped = T(spark, sf_dir, "lineitem").groupBy("l_orderkey", expr("l_linenumber DIV 8").alias("part")).agg(
        F.collect_list(c("l_quantity").cast("int")).alias("prices")
    )
    read = grouped.select("l_orderkey", "part", prices.price_range(c("prices")).alias("p"))
    return read.select("l_orderkey", "part", "p.*")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1000 + user_id % 1000 WHEN 3 THEN user_id ELSE 0 END AS price_min,
  CASE event_id % 4 WHEN 0 THEN 20000 + user_id % 1000 WHEN 3 THEN user_id ELSE 0 END AS price_max,
  CASE event_id % 4 WHEN 0 THEN 'от 1 ' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') || ' до 20 ' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0')
    WHEN 1 THEN 'бесплатно' WHEN 2 THEN 'уточняйте' ELSE user_id || ' руб' END AS price_text
FROM events
""")
def price_from_text(spark, sf_dir):
    shown = expr(
        "CASE event_id % 4 WHEN 0 THEN concat(' от 1 ', lpad(user_id % 1000, 3, '0'), ' до 20 ', lpad(user_id % 1000, 3, '0')) "
        "WHEN 1 THEN 'Вход БЕСПЛАТНЫЙ' WHEN 2 THEN ' ' ELSE concat(user_id, ' руб') END"
    )
    read = T(spark, sf_dir, E).select("event_id", prices.price_from_text(shown).alias("p"))
    return read.select("event_id", "p.*")


# --- types, tags, labels -----------------------------------------------------------------


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'concert' WHEN 1 THEN 'quiz' WHEN 2 THEN 'kids' ELSE 'other' END AS by_id,
  CASE event_id % 4 WHEN 0 THEN 'quest' WHEN 1 THEN 'party' ELSE 'other' END AS by_name FROM events
""")
def map_type_by_category(spark, sf_dir):
    ids = expr("array(399, array(460, 2335, 379, 462)[event_id % 4], 457)")
    ids = F.when(c("event_id") % 4 == 3, F.array(lit(399), lit(462))).otherwise(ids)
    names = expr("array('walk', array('quest', 'party', 'Concert', null)[event_id % 4])")
    return T(spark, sf_dir, E).select(
        "event_id", types.map_type_by_category(ids, vocab.TICKET_CATEGORIES).alias("by_id"),
        types.map_type_by_category(names, vocab.LISTING_CATEGORIES).alias("by_name"),
    )


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'concert' WHEN 1 THEN 'festival' ELSE 'quiz' END AS type FROM events
""")
def map_type_by_schema(spark, sf_dir):
    kinds = expr("array('Event', array('MusicEvent', 'Festival', 'SocialEvent')[event_id % 3])")
    return T(spark, sf_dir, E).select("event_id", types.map_type_by_schema(kinds, "quiz").alias("type"))


def _first_hit(column):
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains({column}, {w!r})' for w in words)} THEN '{name}'"
        for name, words in vocab.TYPE_KEYWORDS
    )
    return f"CASE {whens} ELSE 'other' END"


@query(f"""
WITH texts AS (SELECT doc_id, lower(text || (['', ' Большой КОНЦЕРТ', ' лекция про Кино', ' симпатия', ' Стенд-ап'])[doc_id % 5 + 1]) AS t FROM documents)
SELECT doc_id, {_first_hit('t')} AS type FROM texts
""")
def infer_type(spark, sf_dir):
    tail = expr("array('', ' Большой КОНЦЕРТ', ' лекция про Кино', ' симпатия', ' Стенд-ап')[doc_id % 5]")
    return T(spark, sf_dir, D).select("doc_id", types.infer_type(F.concat("text", tail)).alias("type"))


@query(f"WITH {CARDS} SELECT seq, array_to_string(tags, ',') AS tags FROM cards")
def filter_tags(spark, sf_dir):
    raw = expr("array(array('a','b','x')[event_id % 3], array('c','d','a','y')[event_id % 4])")
    return T(spark, sf_dir, E).select(
        c("event_id").alias("seq"), F.array_join(types.filter_tags(raw, ["a", "b", "c", "d"]), ",").alias("tags")
    )


_DEFAULTS = "CASE type " + " ".join(
    f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in vocab.DEFAULT_TAGS.items()
) + " ELSE '' END"


@query(f"""
WITH {CARDS} SELECT seq, CASE WHEN seq % 2 = 0 THEN 'вечером' ELSE {_DEFAULTS} END AS tags FROM cards
""")
def default_tags(spark, sf_dir):
    given = F.when(c("seq") % 2 == 0, F.array(lit("вечером")))
    return cards(spark, sf_dir).select("seq", F.array_join(types.fill_tags(given, c("type")), ",").alias("tags"))


_LABEL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.TYPE_LABELS.items()) + " END"


@query(f"""
WITH {CARDS} SELECT seq, {_LABEL} AS label, CASE type WHEN 'bowling' THEN 'Боулинг' WHEN 'quest' THEN 'Квест'
  ELSE 'Развлекательное место' END AS venue_label FROM cards
""")
def type_label(spark, sf_dir):
    return cards(spark, sf_dir).select(
        "seq", types.type_label(c("type")).alias("label"), types.venue_type_label(c("type")).alias("venue_label")
    )


# --- values out of union-typed JSON ------------------------------------------------------


def _locations(spark, sf_dir):
    shape = expr(
        "CASE p_partkey % 5 WHEN 0 THEN to_json(named_struct('address', concat(' ', p_type, ' '))) "
        "WHEN 1 THEN to_json(named_struct('address', named_struct('streetAddress', p_type, 'addressLocality', p_brand))) "
        "WHEN 2 THEN to_json(array(named_struct('address', named_struct('addressLocality', p_brand)))) "
        "WHEN 3 THEN to_json(named_struct('address', 5)) ELSE '\"somewhere\"' END"
    )
    return T(spark, sf_dir, "part").select("p_partkey", F.parse_json(shape).alias("v"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN p_type || ', ' || p_brand WHEN 2 THEN p_brand END AS address FROM part
""")
def join_address(spark, sf_dir):
    return _locations(spark, sf_dir).select("p_partkey", structured.join_address(c("v")).alias("address"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN 'https://img.example/' || p_partkey END AS image FROM part
""")
def pick_image(spark, sf_dir):
    url = "concat('https://img.example/', p_partkey)"
    shape = expr(
        f"CASE p_partkey % 5 WHEN 0 THEN to_json(array({url})) WHEN 1 THEN to_json(named_struct('url', {url})) "
        f"WHEN 2 THEN to_json(array(named_struct('url', ' '), named_struct('url', {url}))) "
        f"WHEN 3 THEN concat('\"', {url}, '\"') ELSE '7' END"
    )
    v = T(spark, sf_dir, "part").select("p_partkey", F.parse_json(shape).alias("v"))
    return v.select("p_partkey", structured.pick_image(c("v")).alias("image"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://cdn.example/b' WHEN 1 THEN 'https://site.example/m/' || p_partkey
  WHEN 2 THEN 'http://abs.example/c' END AS media,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://i.example/2' ELSE 'https://i.example/1' END AS background FROM part
""")
def unproxied_image(spark, sf_dir):
    media = expr("array('/p/https://cdn.example/b', concat('/m/', p_partkey), 'http://abs.example/c', null)[p_partkey % 4]")
    style = expr(
        "if(p_partkey % 2 = 0, 'background: image-set(url(\"https://i.example/1\") 1x, url(\"https://i.example/2\") 2x)', "
        "'background: url(https://i.example/1)')"
    )
    return T(spark, sf_dir, "part").select(
        "p_partkey", json_feeds.unproxied_image(media, SITE).alias("media"),
        html_feeds.background_image(style).alias("background"),
    )


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_name WHEN 2 THEN p_type END AS organizer FROM part
""")
def pick_organizer(spark, sf_dir):
    shape = expr(
        "CASE p_partkey % 4 WHEN 0 THEN to_json(named_struct('name', p_brand)) WHEN 1 THEN to_json(array(named_struct('name', p_name), "
        "named_struct('name', 'x'))) WHEN 2 THEN concat('\" ', p_type, '\"') ELSE '[]' END"
    )
    v = T(spark, sf_dir, "part").select("p_partkey", F.parse_json(shape).alias("v"))
    return v.select("p_partkey", structured.pick_organizer(c("v")).alias("organizer"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'D' || p_size END AS district FROM part
""")
def district_of(spark, sf_dir):
    divisions = expr(
        "array(named_struct('type', 'city', 'name', 'C'), named_struct('type', if(p_partkey % 2 = 0, 'district', 'x'), "
        "'name', concat('D', p_size)), named_struct('type', if(p_partkey % 2 = 0, 'district', 'y'), 'name', 'later'))"
    )
    return T(spark, sf_dir, "part").select("p_partkey", json_feeds.district_of(divisions).alias("district"))


# --- row tests ---------------------------------------------------------------------------


def _broken_cards(spark, sf_dir):
    rows = cards(spark, sf_dir).withColumns({
        "title": expr("if(seq % 10 = 0, 'no', title)"),
        "type": expr("if(seq % 10 = 1, 'ballet', type)"),
        "date": expr("CASE seq % 10 WHEN 2 THEN 'soon' WHEN 3 THEN date_format(ts, 'yyyy-M-d') WHEN 9 THEN 'always' ELSE date END"),
        "time_start": expr("CASE seq % 10 WHEN 4 THEN '25:00' WHEN 5 THEN '9:05' ELSE time_start END"),
        "price_max": expr("if(seq % 10 = 6, -1, price_max)"),
        "description": expr("if(seq % 10 = 7, repeat('x', 501), description)"),
        "address": expr("if(seq % 10 = 8, null, address)"),
        "event_url": lit(None).cast("string"),
        "tags": F.array(lit("вечером"), lit("made up")),
    })
    return rows


@query(f"""
WITH {CARDS}
SELECT seq, CASE seq % 10 WHEN 9 THEN 'always' ELSE date END AS date,
  CASE WHEN seq % 10 = 5 THEN '09:05' ELSE time_start END AS time_start, 'вечером' AS tags
FROM cards WHERE seq % 10 IN (3, 5, 9)
""")
def validate_cards(spark, sf_dir):
    valid, _ = card_ops.validate_cards(_broken_cards(spark, sf_dir))
    return valid.select("seq", "date", "time_start", F.array_join("tags", ",").alias("tags"))


@query(f"""
WITH {CARDS}
SELECT seq, CASE seq % 10 WHEN 0 THEN 'title_length' WHEN 1 THEN 'type_unknown' WHEN 2 THEN 'date_format'
  WHEN 4 THEN 'time_start_format' WHEN 6 THEN 'price_max_negative,price_order' WHEN 7 THEN 'description_length'
  ELSE 'address_missing' END AS failed
FROM cards WHERE seq % 10 NOT IN (3, 5, 9)
""")
def rejected_cards(spark, sf_dir):
    _, rejected = card_ops.validate_cards(_broken_cards(spark, sf_dir))
    return rejected.select("seq", F.array_join("failed", ",").alias("failed"))


@query(f"""
WITH t AS (SELECT doc_id, lower(text) AS t, doc_id % 3 = 0 AS strict FROM documents),
s AS (SELECT *, regexp_matches(t, '\\b\\d{{1,2}}[./]\\d{{1,2}}\\b|\\b\\d{{1,2}}:\\d{{2}}\\b') AS dated,
  contains(t, 'entlich') OR contains(t, 'tionth') OR contains(t, 'http') AS marked FROM t)
SELECT doc_id, CASE WHEN strict THEN dated AND marked ELSE dated OR marked END AS candidate FROM s
""")
def is_event_candidate(spark, sf_dir):
    kind = F.when(c("doc_id") % 3 == 0, predicates.AGGREGATOR).otherwise(predicates.SOCIAL)
    test = predicates.is_event_candidate(
        c("text"), kind, ["entlich", "tionth"], ["http"], r"\b\d{1,2}[./]\d{1,2}\b|\b\d{1,2}:\d{2}\b"
    )
    return T(spark, sf_dir, D).select("doc_id", test.alias("candidate"))


@query("""
SELECT event_id FROM events WHERE epoch(date_trunc('second', ts)) >= epoch(TIMESTAMP '2024-01-20 12:00:00') - 14 * 86400
""")
def within_days(spark, sf_dir):
    seconds = F.unix_timestamp(c("ts").cast("timestamp"))
    return T(spark, sf_dir, E).filter(predicates.within_days(seconds, 14, now())).select("event_id")


@query(f"WITH {CARDS}, {SOCIAL} SELECT seq, date <> 'always' AND date < '2024-01-20' AS past FROM social")
def is_past(spark, sf_dir):
    return social(spark, sf_dir).select("seq", predicates.is_past(c("date"), day()).alias("past"))


_SPURIOUS = (
    "date = 'always' AND (starts_with(source, 'vk-') OR starts_with(source, 'telegram-') OR starts_with(source, 'generic'))"
    " AND type NOT IN ('bowling', 'billiards', 'karting', 'quest')"
)


@query(f"WITH {CARDS}, {SOCIAL} SELECT seq, {_SPURIOUS} AS spurious FROM social")
def is_spurious_always(spark, sf_dir):
    test = predicates.is_spurious_always(c("date"), c("type"), c("source"))
    return social(spark, sf_dir).select("seq", test.alias("spurious"))


@query(f"WITH {CARDS}, {SOCIAL} SELECT seq, CASE WHEN date = 'always' THEN 'venue' ELSE 'event' END AS target FROM social")
def route_always(spark, sf_dir):
    events, places = card_ops.route_always(social(spark, sf_dir))
    return events.select("seq", lit("event").alias("target")).unionByName(
        places.select("seq", lit("venue").alias("target"))
    )


@query("SELECT p_partkey, p_partkey % 3 <> 2 AS event FROM part")
def is_jsonld_event(spark, sf_dir):
    kinds = expr("array(array('Thing', 'Festival'), array('MusicEvent'), array('Place', 'Movie'))[p_partkey % 3]")
    return T(spark, sf_dir, "part").select("p_partkey", predicates.is_jsonld_event(kinds).alias("event"))


@query("SELECT page_id, page_id % 2 = 0 AS found FROM pages")
def has_jsonld_event(spark, sf_dir):
    tail = expr("if(page_id % 2 = 0, '{\"@type\" : \"DanceEvent\"}', '{\"@type\":\"Place\"}')")
    return T(spark, sf_dir, P).select(
        "page_id", predicates.has_jsonld_event(F.concat("html", tail)).alias("found")
    )


@query("""
SELECT page_id, contains(url, '/en/') OR contains(url, '/de/') AS found FROM pages
""")
def has_event_path(spark, sf_dir):
    test = predicates.has_event_path(F.array(lit("https://x.example/"), F.upper("url")), ["/en/", "/de/"])
    return T(spark, sf_dir, P).select("page_id", test.alias("found"))


@query(f"""
WITH {HITS} SELECT seq, seq % 2 = 0 AND contains(url, '/en/') AND seq % 5 >= 3 AND NOT regexp_matches(domain, '(^|\\.)example\\.net$') AS approved FROM hits
""")
def auto_approve(spark, sf_dir):
    test = predicates.auto_approve(
        urls.domain_of(c("url")), c("seq") % 2 == 0, F.array("url"), c("seq") % 5, ["/en/"], ["example.net"]
    )
    return hits(spark, sf_dir).select("seq", test.alias("approved"))


@query("""
SELECT event_id, event_id % 7 <> 0 AND ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 10 DAY AS fresh FROM events
""")
def listing_fresh(spark, sf_dir):
    checked = expr("if(event_id % 7 = 0, 'never', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"))")
    return T(spark, sf_dir, E).select("event_id", predicates.listing_fresh(checked, now(), 10).alias("fresh"))


@query(f"WITH {CARDS} SELECT seq, image_url IS NOT NULL AND seq % 4 > 1 AS usable FROM cards")
def usable_image(spark, sf_dir):
    url = expr("CASE seq % 4 WHEN 0 THEN concat(image_url, '.SVG') WHEN 1 THEN '' ELSE image_url END")
    return cards(spark, sf_dir).select("seq", predicates.usable_image(url).alias("usable"))


@query("SELECT event_id, event_id % 4 < 3 AS status FROM events")
def is_status_line(spark, sf_dir):
    line = expr("array('Закроется через час', 'ДО ОТКРЫТИЯ 40 мин', 'Круглосуточно', 'ул. Ленина, 60')[event_id % 4]")
    return T(spark, sf_dir, E).select("event_id", predicates.is_status_line(line).alias("status"))


# --- rows --------------------------------------------------------------------------------


@query(f"""
WITH {CARDS}, {SOCIAL}
SELECT city || '-user-' || regexp_extract(title, '\\d+') || CASE WHEN date = 'always' THEN '' ELSE '-' || date END AS id,
  source, 1 AS tags_version,
  substr(sha256(lower(title) || '|' || date || '|' || CASE WHEN venue_name = ' - ' THEN '' ELSE lower(venue_name) END), 1, 16) AS fingerprint,
  {_DEFAULTS} AS tags, seq
FROM social WHERE NOT ({_SPURIOUS})
""")
def to_event_row(spark, sf_dir):
    given = social(spark, sf_dir).withColumn("tags", F.array().cast("array<string>"))
    rows = card_ops.to_event_rows(given, now())
    return rows.select(
        "id", "source", "tags_version", "fingerprint", F.array_join("tags", ",").alias("tags"), "seq"
    )


@query(f"""
WITH {CARDS}, {SOCIAL}
SELECT city || '-venue-' || regexp_extract(venue_name, '\\d+') AS id, venue_name AS name, type,
  CASE WHEN seq % 2 = 0 THEN address END AS address, 'twogis' AS source, seq
FROM social WHERE date = 'always' AND venue_name <> ' - '
""")
def to_venue(spark, sf_dir):
    rows = social(spark, sf_dir).filter("date = 'always' AND venue_name <> ' - '")
    rows = rows.withColumn("address", expr("if(seq % 2 = 0, address, '')"))
    return card_ops.to_venues(rows, lit("twogis"), now()).select("id", "name", "type", "address", "source", "seq")

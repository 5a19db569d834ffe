"""Jobs and streams end to end over the tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from eventloom import tables as tb
from eventloom.operators.ranking import drop_repeats
from eventloom.plans import city as city_plan, feeds
from eventloom.schemas import CANDIDATE, EVENT, HEALTH, RAW, arrival, ddl, shape
from eventloom.streaming import jobs as streams

from .base import AS_OF, NOW, query, scratch, spread, table
from .feeds import _JSONLD, _jsonld_pages, _json
from .views import CARDS, PRIORITIES, SOCIAL, cards, social

c, lit, expr = F.col, F.lit, F.expr
day = lambda: F.lit(AS_OF).cast("date")
now = lambda: F.lit(NOW).cast("timestamp")
AS_OF_DAY = datetime.date(2024, 1, 20)
MOMENT = datetime.datetime(2024, 1, 20, 12)
FEEDS = ["click", "error", "purchase", "signup", "view"]


def _cards_with_order(rows):
    rows = rows.withColumn("event_url", lit(None).cast("string"))
    return rows.withColumn("seq", arrival(lit(0), "seq"))


def _counts(run):
    totals = run.tally().groupBy("counter").agg(F.sum("n").alias("n"))
    return totals.filter("n > 0")


_OUTCOME = "CASE WHEN date = 'always' THEN 'venue' ELSE 'extracted' END"


@query(f"WITH {CARDS}, {SOCIAL} SELECT source, {_OUTCOME} AS outcome, count(*) AS n FROM social GROUP BY ALL")
def direct_feed(spark, sf_dir):
    run = feeds.direct_feed(_cards_with_order(social(spark, sf_dir)))
    return run.settled.groupBy("source", "outcome").agg(F.count(lit(1)).alias("n"))


@query(f"""
WITH {CARDS}, {SOCIAL}, o AS (SELECT *, date = 'always' AND (starts_with(source, 'vk-') OR starts_with(source, 'telegram-')
  OR starts_with(source, 'generic')) AND type NOT IN ('bowling', 'quest') AS dropped FROM social)
SELECT counter, n FROM (SELECT count(*) AS discovered, count(*) FILTER (WHERE NOT dropped) AS extracted,
  count(*) FILTER (WHERE NOT dropped) AS new, count(*) FILTER (WHERE dropped) AS skipped_always FROM o)
UNPIVOT (n FOR counter IN (discovered, extracted, new, skipped_always))
""")
def group_event_feed(spark, sf_dir):
    return _counts(feeds.group_event_feed(_cards_with_order(social(spark, sf_dir))))


def _post_inputs(spark, sf_dir, limit=3):
    wall = table(spark, sf_dir, "conversations").select(
        lit("vk-posts").alias("source"), lit("perm").alias("city"),
        F.concat(lit("https://wall.example/group"), c("conv_id").cast("string")).alias("group_url"),
        F.concat(lit("https://wall.example/"), c("conv_id").cast("string"), lit("_"), c("turn").cast("string")).alias("url"),
        F.concat("text", lit(" билет")).alias("text"),
        F.unix_timestamp(lit("2024-01-19 00:00:00")).cast("double").alias("date_unix"),
        arrival(lit(0), "turn"),
    )
    taken, documents = feeds.post_documents(wall, now(), size=2, limit=limit, staging=scratch(spark))
    links = F.regexp_extract_all("document", F.lit(r"=== POST (\S+) ==="), F.lit(1))
    answers = documents.filter("chunk = 0 OR posts = 2").select(
        "doc_hash",
        F.to_json(F.struct(F.transform(links, lambda u: F.struct(
            F.concat(lit("Event of "), u).alias("title"), lit("concert").alias("type"),
            F.when(u.endswith("_1"), "2024-01-01").otherwise("2024-02-01").alias("date"),
            lit(0).alias("price_min"), lit(0).alias("price_max"), lit("x").alias("price_text"),
            lit("Street").alias("address"), lit("Hall").alias("venue_name"), u.alias("event_url"),
        )).alias("events"))).alias("content"),
    )
    return taken, documents, answers


_POSTS = """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place,
  'https://wall.example/' || conv_id || '_' || turn AS url FROM conversations QUALIFY place <= 3),
d AS (SELECT *, (place - 1) // 2 AS chunk, count(*) OVER (PARTITION BY conv_id, (place - 1) // 2) AS size FROM p)
"""


@query(_POSTS + """
SELECT 'Event of ' || url AS title, url AS source_url, CASE WHEN turn = 1 THEN 'past' ELSE 'extracted' END AS outcome
FROM d WHERE chunk = 0 OR size = 2
""")
def post_feed(spark, sf_dir):
    taken, documents, answers = _post_inputs(spark, sf_dir)
    return feeds.post_feed(taken, documents, answers, day()).settled.select("title", "source_url", "outcome")


@query(_POSTS + """
SELECT url, sha256(text || ' билет') AS hash FROM d WHERE chunk = 0 OR size = 2
""")
def post_feed_archive(spark, sf_dir):
    taken, documents, answers = _post_inputs(spark, sf_dir)
    return feeds.post_feed(taken, documents, answers, day()).archive.select("url", "hash")


_POSTS_ALL = _POSTS.replace(" QUALIFY place <= 3", "")


@query(_POSTS_ALL + """
SELECT 'Event of ' || url AS title, url AS source_url, CASE WHEN turn = 1 THEN 'past' ELSE 'extracted' END AS outcome
FROM d WHERE chunk = 0 OR size = 2
""")
def post_feed_all(spark, sf_dir):
    taken, documents, answers = _post_inputs(spark, sf_dir, None)
    return feeds.post_feed(taken, documents, answers, day()).settled.select("title", "source_url", "outcome")


def _listing_run(spark, sf_dir, garbage=None):
    pages = _jsonld_pages(spark, sf_dir).withColumns({
        "event_type": expr("if(page % 2 = 0, 'quiz', null)"), "rendered": c("page") % 4 == 0,
    })
    answers = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(
        F.concat(lit("https://site.example/p"), c("p_partkey").cast("string")).alias("url"),
        _json(
            "array(named_struct('title', concat('Model ', p_partkey), 'type', 'concert', 'date', '2024-02-01', 'price_min', 0, "
            "'price_max', 0, 'price_text', 'x', 'address', 'Street', 'venue_name', 'Hall')) AS events"
        ).alias("content"),
    )
    if garbage:
        answers = answers.withColumn("content", F.when(F.expr(garbage), "sorry, no json").otherwise(c("content")))
    stored = pages.filter("page % 10 = 1").select("url", F.sha2("content", 256).alias("hash"))
    return feeds.listing_feed(pages, answers, day(), stored, scratch(spark))


_LISTED = f"""
WITH {_JSONLD},
pages_in AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 10 <> 1),
ld AS (SELECT * FROM jsonld WHERE p_partkey % 2 = 0 AND p_partkey % 10 <> 1),
model AS (SELECT k FROM pages_in WHERE k % 3 = 0 AND k NOT IN (SELECT p_partkey FROM ld))
"""


@query(_LISTED + """
SELECT title, CASE WHEN type = 'other' THEN 'quiz' ELSE type END AS type, 'https://site.example' || event_url AS source_url FROM ld
UNION ALL SELECT 'Model ' || k, 'concert', 'https://site.example/p' || k FROM model
""")
def listing_feed(spark, sf_dir):
    settled = _listing_run(spark, sf_dir).settled
    return settled.filter("outcome = 'extracted'").select("title", "type", "source_url")


@query(_LISTED + """
SELECT counter, n FROM (SELECT (SELECT count(*) FROM ld) + (SELECT count(*) FROM model) AS discovered,
  (SELECT count(*) FROM ld) + (SELECT count(*) FROM model) AS extracted, (SELECT count(*) FROM ld) + (SELECT count(*) FROM model) AS new,
  (SELECT count(*) FROM pages_in WHERE k % 3 <> 0 AND k NOT IN (SELECT p_partkey FROM ld)) AS failed)
UNPIVOT (n FOR counter IN (discovered, extracted, new, failed))
""")
def listing_feed_counters(spark, sf_dir):
    return _counts(_listing_run(spark, sf_dir))


_UNREADABLE = _LISTED.replace("SELECT k FROM pages_in WHERE k % 3 = 0", "SELECT k FROM pages_in WHERE k % 3 = 0 AND k % 9 <> 0")


@query(_UNREADABLE + """
SELECT counter, n FROM (SELECT (SELECT count(*) FROM ld) + (SELECT count(*) FROM model) AS discovered,
  (SELECT count(*) FROM ld) + (SELECT count(*) FROM model) AS extracted, (SELECT count(*) FROM ld) + (SELECT count(*) FROM model) AS new,
  (SELECT count(*) FROM pages_in WHERE (k % 3 <> 0 OR k % 9 = 0) AND k NOT IN (SELECT p_partkey FROM ld)) AS failed)
UNPIVOT (n FOR counter IN (discovered, extracted, new, failed))
""")
def unreadable_answers(spark, sf_dir):
    return _counts(_listing_run(spark, sf_dir, "cast(substring_index(url, '/p', -1) AS int) % 9 = 0"))


@query("""
SELECT 'failed' AS counter, count(*) AS n FROM pages WHERE page_id % 3 = 0
""")
def unreadable_pages(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").select(
        lit("quiz").alias("source"), lit("perm").alias("city"), "url", c("page_id").alias("page"),
        F.when(c("page_id") % 3 == 0, c("html")).otherwise(lit('{"data": {"data": []}}')).alias("content"),
    )
    from eventloom.sources import json_feeds

    return _counts(feeds.direct_feed(json_feeds.quiz_games(raw, "https://site.example"), raw))


@query("""
SELECT counter, n FROM (SELECT count(*) AS discovered, count(*) FILTER (WHERE page_id % 4 <> 0) AS new,
  count(*) FILTER (WHERE page_id % 4 <> 0 AND page_id % 3 = 0) AS extracted,
  count(*) FILTER (WHERE page_id % 4 <> 0 AND page_id % 3 <> 0) AS failed FROM (
    SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)) UNPIVOT (n FOR counter IN (discovered, new, extracted, failed))
""")
def per_url_feed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.max("html").alias("content"))
    pages = pages.withColumn("source", lit("afisha")).withColumn("city", lit("perm"))
    found = pages.select("url", "source", "city", arrival(lit(0), "page_id"))
    known = pages.filter("page_id % 4 = 0").select(c("url").alias("source_url"))
    answers = pages.filter("page_id % 3 < 2").select(
        "url",
        _json(
            "concat('Page ', page_id) AS title", "if(page_id % 3 = 0, 'concert', 'bad type') AS type", "'2024-02-01' AS date",
            "0 AS price_min", "0 AS price_max", "'x' AS price_text", "'Street' AS address", "'Hall' AS venue_name",
        ).alias("content"),
    )
    return _counts(feeds.per_url_feed(found, known, pages, answers))


@query("""
WITH best AS (SELECT c_custkey AS k, row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_custkey % 13 DESC, 'd' || c_custkey || '.example') AS place,
  c_custkey % 2 AS town FROM customer QUALIFY place <= 20),
t AS (SELECT *, sum(CASE WHEN k % 5 <> 0 AND k % 4 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY town ORDER BY place) AS turn FROM best)
SELECT 'generic:d' || k || '.example' AS source, CASE WHEN k % 4 = 0 THEN 'Data ' ELSE 'Model ' END || k AS title
FROM t WHERE k % 5 <> 0 AND (k % 4 = 0 OR turn <= 5)
""")
def generic_feed(spark, sf_dir):
    run, _ = _generic_run(spark, sf_dir, 20, 5)
    return run.settled.filter("outcome = 'extracted'").select("source", "title")


@query("""
SELECT 'generic:d' || c_custkey || '.example' AS source, CASE WHEN c_custkey % 4 = 0 THEN 'Data ' ELSE 'Model ' END || c_custkey AS title
FROM customer WHERE c_custkey % 5 <> 0
""")
def generic_feed_all(spark, sf_dir):
    run, _ = _generic_run(spark, sf_dir)
    return run.settled.filter("outcome = 'extracted'").select("source", "title")


def _generic_run(spark, sf_dir, domains=None, asked=None):
    rows = table(spark, sf_dir, "customer")
    domain = F.concat(lit("d"), c("c_custkey").cast("string"), lit(".example"))
    url = F.concat(lit("https://"), domain, lit("/afisha"))
    stored = shape(
        rows.select(
            domain.alias("domain"), expr("if(c_custkey % 2 = 0, 'perm', 'sochi')").alias("city"),
            F.array(url).alias("sample_urls"), (c("c_custkey") % 13).alias("score"), lit("approved").alias("status"),
        ), CANDIDATE,
    )
    card = (
        "named_struct('@type', 'Event', 'name', concat('Data ', c_custkey), 'startDate', '2024-02-01', 'location', "
        "named_struct('name', 'Hall', 'address', 'Street'))"
    )
    pages = rows.select(
        url.alias("url"), "c_custkey",
        F.when(
            c("c_custkey") % 4 == 0,
            F.concat(lit('<script type="application/ld+json">'), F.expr(f"to_json({card})"), lit("</script>")),
        ).otherwise(F.concat(lit("<p>plain "), c("c_custkey").cast("string"))).alias("content"),
    )
    answers = rows.select(
        url.alias("url"),
        _json(
            "array(named_struct('title', concat('Model ', c_custkey), 'type', 'concert', 'date', '2024-02-01', 'price_min', 0, "
            "'price_max', 0, 'price_text', 'x', 'address', 'Street', 'venue_name', 'Hall')) AS events"
        ).alias("content"),
    )
    hashes = pages.filter("c_custkey % 5 = 0").select("url", F.sha2("content", 256).alias("hash"))
    probes = pages.select(
        lit("none").alias("domain"), lit(0).alias("probe_order"), "url", lit(200).alias("status"), "content"
    )
    return feeds.generic_feed(stored, probes, pages, answers, hashes, now(), domains, asked, scratch(spark))


def _city_run(spark, sf_dir, times=1):
    """A run for one city: five feeds by event type, over a table that already holds rows."""
    rows = cards(spark, sf_dir)
    tables = city_plan.Tables(spark, scratch(spark))
    stored = drop_repeats(shape(rows.filter("stored"), EVENT, ["seq"]), ["id"], "seq")
    for city in ("perm", "sochi"):
        tables.events.of(city).replace(stored.filter(c("city") == city).withColumn("tags_version", lit(1)))
    incoming = _cards_with_order(rows.filter("NOT stored AND city = 'perm'"))
    configured = [
        city_plan.Feed(
            name, lambda name=name: feeds.direct_feed(incoming.filter(c("source") == name)), name == "signup"
        )
        for name in FEEDS
    ]

    def broken():
        raise ValueError("HTTP 403")

    configured.append(city_plan.Feed("broken", broken))
    for _ in range(times):
        run = city_plan.run_city(tables, "perm", configured, PRIORITIES, AS_OF_DAY, MOMENT, "run")
    return tables, run


_CITY = f"""
WITH {CARDS},
stored_rows AS (SELECT * FROM cards WHERE stored QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
incoming AS (SELECT *, list_position({FEEDS}, source) AS feed_order FROM cards WHERE NOT stored AND city = 'perm'),
kept AS (SELECT * FROM stored_rows s WHERE NOT (source = 'signup' AND city = 'perm' AND date >= '2024-01-20'
  AND NOT EXISTS (SELECT 1 FROM incoming i WHERE i.source = 'signup' AND i.id = s.id))),
reports AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY pri DESC, origin, feed_order, seq) AS place,
    row_number() OVER (PARTITION BY id ORDER BY origin, feed_order, seq) AS arrived
  FROM (SELECT *, 0 AS origin FROM incoming UNION ALL
        SELECT *, 0 AS feed_order, 1 AS origin FROM kept WHERE id IN (SELECT id FROM incoming))
),
filled AS (
  SELECT id, arg_min(time_start, arrived) FILTER (WHERE time_start IS NOT NULL) AS time_start,
    arg_min(description, arrived) FILTER (WHERE description IS NOT NULL) AS description,
    min(arrived) FILTER (WHERE price_min <> 0 OR price_max <> 0) AS priced_at
  FROM reports GROUP BY id
),
merged AS (
  SELECT w.id, w.source, w.city, w.date, coalesce(w.time_start, f.time_start) AS time_start,
    coalesce(w.description, f.description) AS description,
    CASE WHEN w.price_min = 0 AND w.price_max = 0 THEN coalesce(p.price_max, 0) ELSE w.price_max END AS price_max
  FROM reports w JOIN filled f USING (id) LEFT JOIN reports p ON p.id = w.id AND p.arrived = f.priced_at WHERE w.place = 1
)
"""


@query(_CITY + """
SELECT id, source, time_start, description, price_max FROM (
  SELECT * FROM merged UNION ALL
  SELECT id, source, city, date, time_start, description, price_max FROM kept WHERE id NOT IN (SELECT id FROM merged))
WHERE city <> 'perm' OR date >= '2024-01-19'
""")
def run_city(spark, sf_dir):
    tables, _ = _city_run(spark, sf_dir)
    return tables.events.read().select("id", "source", "time_start", "description", "price_max")


_AFTER = _CITY + """
SELECT id, source, time_start, description, price_max FROM (
  SELECT * FROM merged UNION ALL
  SELECT id, source, city, date, time_start, description, price_max FROM kept WHERE id NOT IN (SELECT id FROM merged))
WHERE city <> 'perm' OR date >= '2024-01-19'
"""


@query(f"SELECT *, 6 AS health_rows FROM ({_AFTER})")
def run_city_repeated(spark, sf_dir):
    """The same run twice: the same table, and health rows once."""
    tables, run = _city_run(spark, sf_dir, times=2)
    run.close()
    written = spark.read.schema(ddl(HEALTH)).parquet(tables.path("health")).count()
    return tables.events.read().select(
        "id", "source", "time_start", "description", "price_max", lit(written).alias("health_rows"))


@query(f"""
WITH {CARDS} SELECT source, count(*) AS extracted, 0 AS failed FROM cards WHERE NOT stored AND city = 'perm' AND source <> 'error' GROUP BY source
""")
def run_from_sources(spark, sf_dir):
    """A run from a source list: order, modes and priorities come from it; a disabled source is left out."""
    from eventloom.sources.structured import sources_dim

    tables = city_plan.Tables(spark, scratch(spark))
    entries = F.array(*[F.struct(
        lit(name).alias("name"), lit("direct_api").alias("extraction_mode"), lit(PRIORITIES.get(name, 0)).alias("priority"),
        lit(name != "error").alias("enabled")) for name in FEEDS])
    listed = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(lit("perm").alias("city"), entries.alias("sources"))
    listed.write.json(tables.path("sources"))
    incoming = _cards_with_order(cards(spark, sf_dir).filter("NOT stored AND city = 'perm'"))
    readers = {"direct_api": lambda name: feeds.direct_feed(incoming.filter(c("source") == name))}
    mine, priorities = city_plan.configured_feeds(sources_dim(spark, tables.path("sources")), "perm", readers)
    city_plan.run_city(tables, "perm", mine, priorities, AS_OF_DAY, MOMENT, "dry", dry_run=True).close()
    run = city_plan.run_city(tables, "perm", mine, priorities, AS_OF_DAY, MOMENT, "run", duration=1.5)
    return run.parts.select("source", "extracted", "failed")


@query(f"""
WITH {CARDS} SELECT city, count(DISTINCT id) AS n, count(DISTINCT city) AS cities FROM cards
WHERE NOT stored AND date >= '2024-01-19' GROUP BY city
""")
def run_two_cities(spark, sf_dir):
    """Two cities at once under one run id: each table holds its own city."""
    from concurrent.futures import ThreadPoolExecutor

    tables = city_plan.Tables(spark, scratch(spark))
    incoming = _cards_with_order(cards(spark, sf_dir).filter("NOT stored"))

    def run(city):
        mine = [city_plan.Feed("all", lambda: feeds.direct_feed(incoming.filter(c("city") == city)))]
        city_plan.run_city(tables, city, mine, PRIORITIES, AS_OF_DAY, MOMENT, "run").close()
        rows = tables.events.of(city).read()
        return rows.groupBy(lit(city).alias("city")).agg(
            F.count_distinct("id").alias("n"), F.count_distinct("city").alias("cities"))

    with ThreadPoolExecutor(2) as pool:
        perm, sochi = pool.map(run, ("perm", "sochi"))
    return perm.unionByName(sochi)


@query(_CITY + """
SELECT source, count(*) AS discovered, count(*) AS extracted, 0 AS failed, NULL AS last_error FROM incoming GROUP BY source
UNION ALL SELECT 'broken', 0, 0, 1, 'broken: HTTP 403'
""")
def run_city_health(spark, sf_dir):
    tables, run = _city_run(spark, sf_dir)
    health = spark.read.schema(ddl(HEALTH)).parquet(tables.path("health"))
    return run.parts.join(health.select("source", "last_error"), "source").select(
        "source", "discovered", "extracted", "failed", "last_error"
    )


@query(_CITY + """
SELECT source, found AS events_found, CAST(found - coalesce(lost, 0) AS BIGINT) AS unique_events,
  round((found - coalesce(lost, 0)) / found, 3) AS unique_events_ratio
FROM (SELECT source, count(*) AS found FROM incoming GROUP BY source)
LEFT JOIN (SELECT l.source, count(*) AS lost FROM reports l JOIN reports w ON w.id = l.id AND w.place = 1
  WHERE l.source <> w.source GROUP BY l.source) USING (source)
""")
def run_city_quality(spark, sf_dir):
    tables, _ = _city_run(spark, sf_dir)
    return spark.read.parquet(tables.path("quality")).select(
        "source", "events_found", "unique_events", "unique_events_ratio"
    )


@query(f"""
WITH {CARDS}, {SOCIAL}, places AS (
  SELECT city, city || '-venue-' || regexp_extract(venue_name, '\\d+') AS id, venue_name AS name,
    row_number() OVER (PARTITION BY city, venue_name ORDER BY seq) AS rn, address FROM social WHERE venue_name <> ' - ')
SELECT id, name, address, CASE city WHEN 'perm' THEN 'twogis' ELSE 'playwright' END AS source FROM places WHERE rn = 1
""")
def refresh_venues(spark, sf_dir):
    rows = social(spark, sf_dir).filter("venue_name <> ' - '").withColumn("date", lit("always"))
    tables = city_plan.Tables(spark, scratch(spark))
    city_plan.refresh_venues(tables, rows.filter("city = 'perm'"), rows, MOMENT, ["perm", "sochi"])
    return tables.venues.read().select("id", "name", "address", "source")


@query(f"""
WITH {CARDS}, {SOCIAL} SELECT id, venue_name AS name, 'twogis' AS source FROM social
WHERE date = 'always' AND starts_with(source, 'twogis-')
""")
def sync_venues(spark, sf_dir):
    tables = city_plan.Tables(spark, scratch(spark))
    for city in ("perm", "sochi"):
        tables.events.of(city).replace(social(spark, sf_dir).filter(c("city") == city))
    city_plan.sync_venues(tables, MOMENT, ["perm", "sochi"])
    city_plan.sync_venues(tables, MOMENT, ["perm", "sochi"], force=True)
    return tables.venues.read().select("id", "name", "source")


# --- streams -----------------------------------------------------------------------------


@query("SELECT DISTINCT 'u' || user_id AS url, sha256(event_type) AS hash FROM events")
def stream_posts(spark, sf_dir):
    landed_posts = streams.landed_stream(
        spark, sf_dir, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string", "events.parquet"
    )
    rows = landed_posts.select(
        F.concat(lit("u"), c("user_id").cast("string")).alias("url"), c("event_type").alias("text"),
        c("ts").cast("timestamp").alias("posted_at"),
    )
    folder = scratch(spark)
    streams.write_posts(streams.new_posts(rows), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("url", "hash")


@query("""
SELECT DISTINCT 'u' || user_id AS url, sha256(event_type) AS hash FROM events WHERE ts >= TIMESTAMP '2024-01-06 12:00:00'
""")
def stream_posts_fresh(spark, sf_dir):
    """Posts older than the window before a given time are cut."""
    landed_posts = streams.landed_stream(
        spark, sf_dir, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string", "events.parquet"
    )
    rows = landed_posts.select(
        F.concat(lit("u"), c("user_id").cast("string")).alias("url"), c("event_type").alias("text"),
        c("ts").cast("timestamp").alias("posted_at"),
    )
    folder = scratch(spark)
    streams.write_posts(streams.new_posts(rows, now()), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("url", "hash")


@query(f"""
WITH {CARDS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pri DESC, seq) AS place,
  row_number() OVER (PARTITION BY id ORDER BY seq) AS arrived FROM cards),
f AS (SELECT id, arg_min(description, arrived) FILTER (WHERE description IS NOT NULL) AS description FROM r GROUP BY id)
SELECT id, source, coalesce(r.description, f.description) AS description FROM r JOIN f USING (id) WHERE place = 1
""")
def stream_merge(spark, sf_dir):
    rows = shape(cards(spark, sf_dir), EVENT, ["seq"])
    folder = scratch(spark)
    spread(rows).write.parquet(f"{folder}/in")  # a task reads and sorts a share of what landed, however much that is
    store = tb.KeyedTable(spark, f"{folder}/events", EVENT)
    stream = streams.landed_stream(spark, f"{folder}/in", f"{ddl(EVENT)}, seq bigint")
    streams.stream_merge(stream, store, PRIORITIES, f"{folder}/state").awaitTermination()
    return store.read().select("id", "source", "description")


@query("""
SELECT event_type AS source, CASE WHEN user_id % 2 = 0 THEN 'perm' ELSE 'sochi' END AS city,
  round(avg(CAST(floor(value) AS BIGINT)), 2) AS avg_events,
  CAST(sum(CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 10 THEN 1 ELSE 0 END) AS BIGINT) AS total_errors
FROM events GROUP BY ALL
""")
def stream_health(spark, sf_dir):
    from .views import runs

    folder = scratch(spark)
    shape(runs(spark, sf_dir), HEALTH).write.parquet(f"{folder}/in")
    state = tb.KeyedTable(spark, f"{folder}/state", streams.HEALTH_SUMS, "key")
    stream = streams.landed_stream(spark, f"{folder}/in", ddl(HEALTH))
    streams.stream_health(stream, f"{folder}/log", state, f"{folder}/check").awaitTermination()
    return streams.health_state(state.read()).select("source", "city", "avg_events", "total_errors")


@query("SELECT CAST(doc_id AS VARCHAR) AS url, sha256(text) AS hash FROM documents WHERE doc_id % 4 <> 0")
def stream_changed_docs(spark, sf_dir):
    folder = scratch(spark)
    docs = table(spark, sf_dir, "documents").select(
        "source", c("doc_id").cast("string").alias("url"), c("text").alias("content"), lit("html").alias("content_type"),
        lit(None).cast("string").alias("hash"), now().alias("fetched_at"), "doc_id",
    )
    archive = tb.RawArchive(spark, f"{folder}/raw")
    archive.append(docs.filter("doc_id % 4 = 0"), F.lit("2024-01-10").cast("timestamp"))
    docs.drop("doc_id").write.parquet(f"{folder}/in")
    stream = streams.landed_stream(spark, f"{folder}/in", ddl(RAW))
    streams.stream_changed_docs(stream, archive, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(ddl(RAW)).parquet(f"{folder}/out").select("url", "hash")

"""Keyed writes, joins against what is stored, and upkeep of the tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from eventloom import tables as tb
from eventloom.operators import cards as card_ops, maintenance, posts as post_ops
from eventloom.schemas import EVENT, RAW, VENUE, ddl
from eventloom.sources import structured

from .base import AS_OF, NOW, query, scratch, table
from .views import CARDS, SOCIAL, VENUES, cards, posts, social, venues

c, lit, expr = F.col, F.lit, F.expr
day = lambda: F.lit(AS_OF).cast("date")
now = lambda: F.lit(NOW).cast("timestamp")
_PLACE = "date = 'always' AND starts_with(source, 'twogis-')"


def _event_rows(spark, sf_dir):
    """One event row per event, keyed by e{n}."""
    return social(spark, sf_dir)


@query(f"""
WITH {CARDS}, {SOCIAL}
SELECT id, CASE WHEN seq % 3 <> 0 THEN 'new ' || title ELSE title END AS title, city FROM social
""")
def upsert_events(spark, sf_dir):
    rows = _event_rows(spark, sf_dir)
    store = tb.KeyedTable(spark, scratch(spark), EVENT, "id", ("city",))
    tb.upsert_events(store, rows.filter("seq % 3 <> 2"))
    again = rows.filter("seq % 3 <> 0").withColumn("title", F.concat(lit("new "), "title"))
    tb.upsert_events(store, again)
    tb.upsert_events(store, again)  # the same rows once more change nothing
    return store.read().select("id", "title", "city")


@query("""
SELECT count(*) FILTER (WHERE event_id % 3 = 2) AS inserted, count(*) FILTER (WHERE event_id % 3 = 1) AS updated FROM events
""")
def upsert_counts(spark, sf_dir):
    rows = _event_rows(spark, sf_dir)
    store = tb.KeyedTable(spark, scratch(spark), EVENT)
    tb.upsert_events(store, rows.filter("seq % 3 <> 2"))
    counts = tb.upsert_events(store, rows.filter("seq % 3 <> 0"))
    return spark.createDataFrame([(counts.inserted, counts.updated)], "inserted long, updated long")


@query("SELECT event_id AS seq, 'b' AS title FROM events")
def upsert_duplicate_keys(spark, sf_dir):
    rows = _event_rows(spark, sf_dir)
    twice = rows.withColumn("title", lit("a")).unionByName(rows.withColumn("title", lit("b")))
    store = tb.KeyedTable(spark, scratch(spark), EVENT)
    tb.upsert_events(store, twice)
    tb.upsert_events(store, twice)
    return store.read().join(rows.select("id", "seq"), "id").select("seq", "title")


@query(f"""
WITH {VENUES}
SELECT id, CASE WHEN source = 'manual' THEN name ELSE 'renamed ' || name END AS name, source FROM venues
UNION ALL SELECT 'new-' || id, name, source FROM venues WHERE source <> 'manual'
""")
def upsert_venues(spark, sf_dir):
    stored = venues(spark, sf_dir)
    store = tb.KeyedTable(spark, scratch(spark), VENUE)
    store.replace(stored)
    renamed = stored.withColumn("name", F.concat(lit("renamed "), "name")).withColumn("source", lit("twogis"))
    fresh = stored.filter("source <> 'manual'").withColumn("id", F.concat(lit("new-"), "id"))
    tb.upsert_venues(store, renamed.unionByName(fresh))
    return store.read().select("id", "name", "source")


@query(f"""
WITH {VENUES} SELECT id, name FROM venues UNION ALL SELECT 'new-' || id, name FROM venues
""")
def insert_only_venues(spark, sf_dir):
    stored = venues(spark, sf_dir)
    store = tb.KeyedTable(spark, scratch(spark), VENUE)
    store.replace(stored)
    renamed = stored.withColumn("name", F.concat(lit("renamed "), "name"))
    fresh = stored.withColumn("id", F.concat(lit("new-"), "id"))
    tb.upsert_venues(store, renamed.unionByName(fresh), insert_only=True)
    return store.read().select("id", "name")


@query(f"WITH {VENUES} SELECT id FROM venues WHERE source <> 'manual'")
def manual_guard(spark, sf_dir):
    rows = venues(spark, sf_dir)
    return card_ops.manual_guard(rows, rows).select("id")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "source", F.concat(lit("https://doc.example/"), (c("doc_id") % 700).cast("string")).alias("url"),
        c("text").alias("content"), "doc_id",
    )


@query("""
WITH d AS (SELECT *, 'https://doc.example/' || (doc_id % 700) AS url,
  TIMESTAMP '2024-01-01' + INTERVAL (doc_id // 100) HOUR AS fetched FROM documents)
SELECT url, source, sha256(text) AS hash, length(text) AS n, 'html' AS content_type FROM d
QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched DESC, sha256(text) DESC) = 1
""")
def archive_raw(spark, sf_dir):
    archive = tb.RawArchive(spark, scratch(spark))
    at = expr("timestamp '2024-01-01' + make_dt_interval(0, cast(doc_id DIV 100 AS int))")
    docs = _docs(spark, sf_dir)
    archive.append(docs.filter("doc_id % 2 = 0"), at)
    archive.append(docs.filter("doc_id % 2 = 1"), at)
    return archive.latest().select("url", "source", "hash", F.length("content").alias("n"), "content_type")


@query("""
SELECT doc_id FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM documents s WHERE s.doc_id % 2 = 0 AND s.doc_id % 3 <> 0 AND s.doc_id = d.doc_id)
""")
def changed_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", c("doc_id").cast("string").alias("url"), F.sha2("text", 256).alias("hash")
    )
    stored = docs.filter("doc_id % 2 = 0").withColumn(
        "hash", F.when(c("doc_id") % 3 == 0, F.sha2("hash", 256)).otherwise(c("hash"))
    )
    return card_ops.changed_docs(docs, stored).select("doc_id")


@query(f"""
WITH {CARDS} SELECT DISTINCT source_url AS url FROM cards WHERE source_url NOT IN (SELECT source_url FROM cards WHERE seq % 4 = 0)
""")
def new_urls(spark, sf_dir):
    rows = cards(spark, sf_dir)
    return card_ops.new_urls(
        rows.select(c("source_url").alias("url")).distinct(), rows.filter("seq % 4 = 0")
    )


@query("""
WITH runs AS (SELECT event_type AS source, event_id AS run_id, round(value / 7, 3) AS duration_sec FROM events)
SELECT source, count(*) AS runs, round(sum(duration_sec), 3) AS seconds FROM runs GROUP BY source
""")
def append_health(spark, sf_dir):
    from .views import runs

    rows, path = runs(spark, sf_dir), scratch(spark)
    tb.append_health(path, rows.filter("run_id % 2 = 0"))
    tb.append_health(path, rows.filter("run_id % 2 = 1"))
    return spark.read.parquet(path).groupBy("source").agg(
        F.count(lit(1)).alias("runs"), F.round(F.sum("duration_sec").cast("double"), 3).alias("seconds")
    )


@query(f"""
WITH {CARDS}, stats AS (SELECT city, type AS category, date AS snapshot_date, count(*) AS n FROM cards GROUP BY ALL)
SELECT city, category, snapshot_date, CASE WHEN city = 'perm' AND snapshot_date >= '2024-01-15' THEN n * 2 ELSE n END AS n FROM stats
""")
def snapshot_upsert(spark, sf_dir):
    stats = cards(spark, sf_dir).groupBy(
        "city", c("type").alias("category"), c("date").alias("snapshot_date")
    ).agg(F.count(lit(1)).alias("n"))
    path = scratch(spark)
    keys = ["category"]
    tb.snapshot_upsert(spark, path, stats, keys)
    again = stats.filter("city = 'perm' AND snapshot_date >= '2024-01-15'").withColumn("n", c("n") * 2)
    tb.snapshot_upsert(spark, path, again, keys, scratch(spark))
    return spark.read.schema(stats.schema).parquet(path).select("city", "category", "snapshot_date", "n")


@query(f"""
WITH {VENUES}
SELECT id, 'INSERT INTO venues (id, city, name, type, address, district, image_url, source, updated_at) VALUES (''' || id || ''', ''' || city || ''', ''' || name || ''', ''' || type || ''', '
  || coalesce('''' || replace(address, '''', '''''') || '''', 'NULL') || ', ''' || district || ''', ' || coalesce('''' || image_url || '''', 'NULL') || ', ''' || source || ''', ''2024-01-01 00:00:00'')'
  || chr(10) || '  ON CONFLICT (id) DO UPDATE SET city = EXCLUDED.city, name = EXCLUDED.name, type = EXCLUDED.type, address = EXCLUDED.address, district = EXCLUDED.district, image_url = EXCLUDED.image_url, source = EXCLUDED.source, updated_at = EXCLUDED.updated_at;' AS statement
FROM venues
""")
def export_venues(spark, sf_dir):
    return tb.venue_statements(venues(spark, sf_dir))


@query("""
SELECT 'city ' || (event_id // 20) AS city, event_id AS seq, repeat('token ', 30 + event_id % 5) || event_id AS warning FROM events
""")
def write_warnings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "concat('city ', event_id DIV 20) AS city",
        "concat(repeat('token ', 30 + event_id % 5), event_id) AS warning",
    )
    path = scratch(spark)
    tb.write_warnings(rows, path)
    return spark.read.schema("city string, seq bigint, warning string").json(path).select("city", "seq", "warning")


@query(f"WITH {CARDS}, {SOCIAL} SELECT id, title FROM social WHERE seq % 5 = 0 AND seq % 10 <> 0")
def fetch_by_ids(spark, sf_dir):
    rows = _event_rows(spark, sf_dir).withColumn("title", expr("if(seq % 10 = 0, 'x', title)"))
    store = tb.KeyedTable(spark, scratch(spark), EVENT)
    store.replace(rows)
    wanted = rows.filter("seq % 5 = 0").select("id")
    return tb.fetch_by_ids(store, wanted.unionByName(wanted)).select("id", "title")


# --- upkeep ------------------------------------------------------------------------------


@query(f"WITH {CARDS}, {SOCIAL} SELECT seq FROM social WHERE city = 'sochi' OR date = 'always' OR date >= '2024-01-19'")
def purge_past(spark, sf_dir):
    return maintenance.purge_past(social(spark, sf_dir), day(), "perm")[0].select("seq")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 10 DAY")
def purge_raw(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("fetched_at", c("ts").cast("timestamp"))
    return maintenance.purge_raw(rows, now(), 10)[0].select("event_id")


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= '2024-01-10'")
def purge_raw_days(spark, sf_dir):
    archive = tb.RawArchive(spark, scratch(spark))
    docs = table(spark, sf_dir, "events").select(
        c("event_type").alias("source"), c("event_id").cast("string").alias("url"),
        c("props").alias("content"), "ts",
    )
    archive.append(docs, c("ts").cast("timestamp"))
    archive.purge(datetime.date(2024, 1, 20), 10)
    return archive.latest().select(F.date_format("fetched_at", "yyyy-MM-dd").alias("day")).distinct()


@query(f"""
WITH {CARDS}, {SOCIAL}
SELECT seq FROM social WHERE NOT (source IN ('vk-posts', 'tickets') AND date <> 'always' AND date >= '2024-01-20' AND seq % 4 <> 0)
""")
def sync_snapshot(spark, sf_dir):
    rows = social(spark, sf_dir)
    current = rows.filter("source IN ('vk-posts', 'tickets') AND seq % 4 = 0")
    return maintenance.sync_snapshot(rows, current, day())[0].select("seq")


@query(f"""
WITH {CARDS}, {SOCIAL}
SELECT seq, source, type FROM social WHERE date = 'always' AND (starts_with(source, 'vk-') OR starts_with(source, 'telegram-')
  OR starts_with(source, 'generic:') OR source = 'generic') AND type NOT IN ('bowling', 'billiards', 'karting', 'quest')
  AND parsed_at < TIMESTAMP '2024-01-19 12:00:00'
""")
def purge_always(spark, sf_dir):
    return maintenance.purge_always(social(spark, sf_dir), now())[1].select("seq", "source", "type")


@query(f"WITH {CARDS}, {SOCIAL} SELECT seq FROM social WHERE NOT ({_PLACE})")
def purge_always_places(spark, sf_dir):
    return maintenance.purge_always_places(social(spark, sf_dir))[0].select("seq")


_FROM_EVENTS = "SELECT id, city, venue_name AS name, type, address, district, image_url, 'twogis' AS source"


@query(f"WITH {CARDS}, {SOCIAL} {_FROM_EVENTS} FROM social WHERE {_PLACE} AND city = 'perm'")
def venues_from_events(spark, sf_dir):
    return maintenance.venues_from_events(social(spark, sf_dir), now(), "perm").drop("updated_at")


@query(f"WITH {CARDS}, {SOCIAL} {_FROM_EVENTS} FROM social WHERE {_PLACE} AND city = 'sochi'")
def bootstrap_venues(spark, sf_dir):
    stored = venues(spark, sf_dir).filter("city = 'perm'")
    return maintenance.bootstrap_venues(stored, social(spark, sf_dir), now()).drop("updated_at")


def _reused_ids(spark, sf_dir):
    rows = social(spark, sf_dir)
    place = F.concat("city", lit("-place-"), c("seq").cast("string"))
    return rows.withColumn("id", place)


@query(f"""
WITH {CARDS}, {SOCIAL}, {VENUES},
fresh AS (SELECT city || '-place-' || seq AS id, venue_name AS name, address FROM social WHERE {_PLACE})
SELECT coalesce(v.id, f.id) AS id,
  CASE WHEN f.id IS NOT NULL AND v.source IS DISTINCT FROM 'manual' THEN f.name ELSE v.name END AS name,
  CASE WHEN f.id IS NOT NULL AND v.source IS DISTINCT FROM 'manual' THEN f.address ELSE v.address END AS address,
  CASE WHEN f.id IS NOT NULL AND v.source IS DISTINCT FROM 'manual' THEN 'twogis' ELSE v.source END AS source
FROM venues v FULL JOIN fresh f ON f.id = v.id
""")
def backfill_venues(spark, sf_dir):
    filled = maintenance.backfill_venues(venues(spark, sf_dir), _reused_ids(spark, sf_dir), now())
    return filled.select("id", "name", "address", "source")


@query("""
SELECT event_id FROM events WHERE NOT (event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 9 DAY)
""")
def purge_stale_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "cast(ts AS timestamp) AS last_seen", "if(event_id % 3 = 0, 'new', 'approved') AS status"
    )
    return maintenance.purge_stale_candidates(rows, now(), 9)[0].select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 < 2")
def stale_tags(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", c("doc_id").cast("string").alias("url"), "text")
    events = raw.select(c("url").alias("source_url"), (c("doc_id") % 5).cast("int").alias("tags_version"))
    return maintenance.stale_tags(events, raw, 2).select("doc_id")


# --- posts -------------------------------------------------------------------------------

_LIVE = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"""
WITH p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS chunk,
  {_LIVE} AS body, 'https://wall.example/' || conv_id || '_' || turn AS url FROM conversations)
SELECT conv_id, chunk, count(*) AS posts,
  string_agg('=== POST ' || url || ' ===' || chr(10) || body, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE body <> '') AS document
FROM p GROUP BY conv_id, chunk HAVING count(*) FILTER (WHERE body <> '') > 0
""")
def assemble_posts(spark, sf_dir):
    return post_ops.assemble_posts(posts(spark, sf_dir), ["conv_id"], "turn", 5)


@query(f"""
SELECT conv_id, 'https://wall.example/' || conv_id || '_' || turn AS url, {_LIVE} AS text
FROM conversations WHERE {_LIVE} <> ''
""")
def split_posts(spark, sf_dir):
    documents = post_ops.assemble_posts(posts(spark, sf_dir), ["conv_id"], "turn", 5)
    return card_ops.split_posts(documents).select("conv_id", "url", "text")


@query("""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'https://wall.example/' || conv_id || '_' || turn
  ELSE 'https://wall.example/group' || conv_id END AS source_url FROM conversations
""")
def attach_post_url(spark, sf_dir):
    rows = posts(spark, sf_dir).withColumn(
        "event_url", F.when(c("turn") % 3 == 0, c("url")).when(c("turn") % 3 == 1, lit("https://bit.ly/x"))
    )
    return card_ops.attach_post_url(rows).select("conv_id", "turn", "source_url")


@query("""
WITH p AS (
  SELECT event_type, event_id, floor(epoch(date_trunc('second', ts))) AS at FROM events
  WHERE epoch(date_trunc('second', ts)) >= epoch(TIMESTAMP '2024-01-20 12:00:00') - 14 * 86400
    AND event_id % 3 <> 0 AND event_id % 4 <> 0
)
SELECT event_type, event_id FROM p QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 20
""")
def candidate_posts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_type", "event_id", c("event_id").alias("seq"), c("event_id").cast("string").alias("url"),
        F.unix_timestamp(c("ts").cast("timestamp")).cast("double").alias("date_unix"),
        F.concat(
            F.when(c("event_id") % 3 == 0, lit("Спасибо за вечер")).otherwise(lit("Ждём вас, начало ")),
            c("event_id").cast("string"),
        ).alias("text"),
    )
    stored = rows.filter("event_id % 4 = 0").select("url", F.sha2("text", 256).alias("hash"))
    picked = post_ops.candidate_posts(rows, now(), stored, group=["event_type"], limit=20)
    return picked.select("event_type", "event_id")


@query(f"""
SELECT id, city, slug, title, time_start AS "timeStart", price_min AS "priceMin", venue_name AS "venueName", image_url AS "imageUrl"
FROM (WITH {CARDS} SELECT * FROM cards) WHERE city = 'perm'
""")
def read_events(spark, sf_dir):
    return structured.read_events(cards(spark, sf_dir), "perm").select(
        "id", "city", "slug", "title", "timeStart", "priceMin", "venueName", "imageUrl"
    )


@query(f"""
WITH {VENUES} SELECT id, city, substr(id, 7) AS slug, name, type, address, district, image_url AS "imageUrl", updated_at AS "updatedAt"
FROM venues WHERE city = 'sochi'
""")
def read_venues(spark, sf_dir):
    return structured.read_venues(venues(spark, sf_dir), "sochi")

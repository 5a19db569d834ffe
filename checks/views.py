"""Views over the given tables that the queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import table

PRIORITIES = {"purchase": 100, "signup": 80, "view": 60, "click": 60}
TAGS = ["a", "b", "c", "d"]
KINDS = ["quiz", "standup", "concert", "bowling", "quest", "other"]


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows: one card per user and day, reported by several sources."""
    e = table(spark, sf_dir, "events")
    free = "event_id % 4 = 0"
    rows = e.selectExpr(
        "event_id AS seq", "ts", "event_type AS source",
        "if(user_id % 2 = 0, 'perm', 'sochi') AS city",
        "concat('User ', user_id) AS title",
        f"array({', '.join(map(repr, KINDS))})[event_id % 6] AS type",
        "cast(null AS string) AS category",
        "date_format(ts, 'yyyy-MM-dd') AS date",
        "if(event_id % 3 = 0, null, date_format(ts, 'HH:mm')) AS time_start",
        "if(event_id % 5 < 3, null, '23:00') AS time_end",
        f"if({free}, 0, cast(floor(value) AS int)) AS price_min",
        f"if({free}, 0, cast(floor(value) + 10 AS int)) AS price_max",
        f"if({free}, 'ask', concat('from ', cast(floor(value) AS int))) AS price_text",
        "array(null, '', 'at the door')[event_id % 3] AS price_note",
        "concat('Street ', user_id % 60) AS address",
        "if(user_id % 41 = 0, ' - ', concat('Venue ', user_id % 40)) AS venue_name",
        "if(event_id % 6 < 4, null, concat('District ', event_id % 4)) AS district",
        "if(event_id % 11 < 6, null, concat('https://img.example/', event_id, '.jpg')) AS image_url",
        "if(event_id % 7 < 3, null, concat('About ', event_id)) AS description",
        "if(event_id % 2 = 0, null, concat('Org ', event_id % 9)) AS organizer",
        f"array_intersect(concat(array(array('a','b','x')[event_id % 3]), "
        f"array(array('c','d','a','y')[event_id % 4])), array({', '.join(map(repr, TAGS))})) AS tags",
        "concat('https://h', user_id % 12, '.example/', event_id) AS source_url",
        "event_id % 5 = 0 AS stored",
    )
    slug = F.concat(F.lit("user-"), F.substring("title", 6, 20), F.lit("-"), F.col("date"))
    return rows.withColumn("slug", slug).withColumn("id", F.concat_ws("-", "city", "slug"))


CARDS = f"""
cards AS (
  SELECT event_id AS seq, ts, event_type AS source,
    CASE WHEN user_id % 2 = 0 THEN 'perm' ELSE 'sochi' END AS city,
    'User ' || user_id AS title,
    ({KINDS})[event_id % 6 + 1] AS type,
    strftime(ts, '%Y-%m-%d') AS date,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%H:%M') END AS time_start,
    CASE WHEN event_id % 5 < 3 THEN NULL ELSE '23:00' END AS time_end,
    CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(value) AS INT) END AS price_min,
    CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(value) + 10 AS INT) END AS price_max,
    CASE WHEN event_id % 4 = 0 THEN 'ask' ELSE 'from ' || CAST(floor(value) AS INT) END AS price_text,
    ([NULL, '', 'at the door'])[event_id % 3 + 1] AS price_note,
    'Street ' || (user_id % 60) AS address,
    CASE WHEN user_id % 41 = 0 THEN ' - ' ELSE 'Venue ' || (user_id % 40) END AS venue_name,
    CASE WHEN event_id % 6 < 4 THEN NULL ELSE 'District ' || (event_id % 4) END AS district,
    CASE WHEN event_id % 11 < 6 THEN NULL ELSE 'https://img.example/' || event_id || '.jpg' END AS image_url,
    CASE WHEN event_id % 7 < 3 THEN NULL ELSE 'About ' || event_id END AS description,
    CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'Org ' || (event_id % 9) END AS organizer,
    [x FOR x IN list_distinct_ordered IF list_contains({TAGS}, x)] AS tags,
    'https://h' || (user_id % 12) || '.example/' || event_id AS source_url,
    event_id % 5 = 0 AS stored,
    'user-' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS slug,
    CASE WHEN user_id % 2 = 0 THEN 'perm' ELSE 'sochi' END || '-user-' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS id,
    CASE event_type WHEN 'purchase' THEN 100 WHEN 'signup' THEN 80 WHEN 'view' THEN 60
      WHEN 'click' THEN 60 ELSE 0 END AS pri
  FROM (SELECT *, CASE WHEN t1 = t2 THEN [t1] ELSE [t1, t2] END AS list_distinct_ordered
        FROM (SELECT *, (['a','b','x'])[event_id % 3 + 1] AS t1,
                     (['c','d','a','y'])[event_id % 4 + 1] AS t2 FROM events))
)"""

# Reports in arrival order with the winner's rank first.
REPORTS = """
reports AS (
  SELECT *, stored::INT AS origin,
    row_number() OVER (PARTITION BY id ORDER BY pri DESC, stored::INT, seq) AS place,
    row_number() OVER (PARTITION BY id ORDER BY stored::INT, seq) AS arrived
  FROM cards
)"""


def incoming_and_stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = cards(spark, sf_dir)
    kept = [c for c in rows.columns if c not in ("stored", "ts")]
    return rows.filter(~F.col("stored")).select(kept), rows.filter("stored").select(kept)


SOURCES = ["vk-posts", "telegram-posts", "generic:site.example", "twogis-bowling", "tickets"]


def social(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows of social and other sources, every seventh undated."""
    rows = cards(spark, sf_dir)
    names = f"array({', '.join(map(repr, SOURCES))})"
    rows = rows.withColumn("source", F.expr(f"{names}[seq % 5]"))
    rows = rows.withColumn("date", F.when(F.col("seq") % 7 == 0, "always").otherwise(F.col("date")))
    rows = rows.withColumn("parsed_at", F.col("ts").cast("timestamp"))
    return rows.withColumn("id", F.concat(F.lit("e"), F.col("seq").cast("string")))


SOCIAL = f"""
social AS (
  SELECT * REPLACE (({SOURCES})[seq % 5 + 1] AS source,
    CASE WHEN seq % 7 = 0 THEN 'always' ELSE date END AS date, 'e' || seq AS id), ts AS parsed_at
  FROM cards
)"""


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue rows from the suppliers: city is the region, every tenth entered by hand."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.selectExpr(
        "concat(if(s_suppkey % 2 = 0, 'perm', 'sochi'), '-place-', s_suppkey) AS id",
        "if(s_suppkey % 2 = 0, 'perm', 'sochi') AS city",
        "s_name AS name",
        "array('bowling', 'karting', 'quest', 'museum')[s_suppkey % 4] AS type",
        "if(s_suppkey % 6 = 0, null, concat(n_name, '''s street ', s_suppkey)) AS address",
        "r_name AS district",
        "if(s_suppkey % 3 = 0, null, concat('https://img.example/', s_suppkey, "
        "if(s_suppkey % 2 = 0, '.SVG', '.jpg'))) AS image_url",
        "if(s_suppkey % 10 = 0, 'manual', 'twogis') AS source",
        "timestamp '2024-01-01 00:00:00' AS updated_at",
    )


VENUES = """
venues AS (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'perm' ELSE 'sochi' END || '-place-' || s_suppkey AS id,
    CASE WHEN s_suppkey % 2 = 0 THEN 'perm' ELSE 'sochi' END AS city, s_name AS name,
    (['bowling', 'karting', 'quest', 'museum'])[s_suppkey % 4 + 1] AS type,
    CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE n_name || '''s street ' || s_suppkey END AS address,
    r_name AS district,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'https://img.example/' || s_suppkey ||
      CASE WHEN s_suppkey % 2 = 0 THEN '.SVG' ELSE '.jpg' END END AS image_url,
    CASE WHEN s_suppkey % 10 = 0 THEN 'manual' ELSE 'twogis' END AS source,
    TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log rows from the events."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS source", "if(user_id % 2 = 0, 'perm', 'sochi') AS city",
        "cast(ts AS timestamp) AS run_at", "cast(floor(value) AS bigint) AS events_found",
        "if(cast(get_json_object(props, '$.k') AS int) < 10, 1L, 0L) AS errors",
        "value / 7 AS duration_sec", "event_id AS run_id",
        "if(event_id % 4 = 0, array(concat('token ', event_id % 50)), "
        "cast(array() AS array<string>)) AS warnings",
        "event_id % 3 AS skipped_always",
    )


RUNS = """
runs AS (
  SELECT event_type AS source, CASE WHEN user_id % 2 = 0 THEN 'perm' ELSE 'sochi' END AS city,
    ts AS run_at, CAST(floor(value) AS BIGINT) AS events_found,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 10 THEN 1 ELSE 0 END AS errors,
    value / 7 AS duration_sec, event_id AS run_id,
    CASE WHEN event_id % 4 = 0 THEN 'token ' || (event_id % 50) END AS warning,
    event_id % 3 AS skipped_always
  FROM events
)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits from the pages: the query is the page's language."""
    return table(spark, sf_dir, "pages").selectExpr(
        "array('perm', 'sochi')[page_id % 2] AS city",
        "concat('q-', regexp_extract(html, '<html lang=\"(\\\\w+)\"', 1), '-', page_id % 3) AS query",
        "array('serper', 'brave', 'duckduckgo')[page_id % 3] AS provider",
        "page_id AS seq", "url",
    )


HITS = """
hits AS (
  SELECT (['perm', 'sochi'])[page_id % 2 + 1] AS city,
    'q-' || regexp_extract(html, '<html lang="(\\w+)"', 1) || '-' || (page_id % 3) AS query,
    (['serper', 'brave', 'duckduckgo'])[page_id % 3 + 1] AS provider, page_id AS seq, url,
    regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain
  FROM pages
)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts from the conversations: a conversation is a group."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "role", "text",
        "concat('https://wall.example/', conv_id, '_', turn) AS url",
        "concat('https://wall.example/group', conv_id) AS group_url",
    )


def landed(df: DataFrame) -> DataFrame:
    """Fill the columns of landed input that a query does not set."""
    have = set(df.columns)
    defaults = {
        "source": F.lit("feed"), "city": F.lit("perm"), "url": F.lit("https://feed.example/"),
        "page": F.lit(0).cast("bigint"),
    }
    return df.withColumns({k: v for k, v in defaults.items() if k not in have})


def pages_of(items: DataFrame, size: int, *envelope: str) -> DataFrame:
    """Pages of JSON with `size` items each, from rows (no, item) numbered without gaps or with."""
    grouped = items.withColumn("page", F.floor(F.col("no") / size)).groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct("no", "item"))).alias("rows")
    )
    body = F.concat(
        F.lit(envelope[0]), F.array_join(F.transform("rows", lambda r: r["item"]), ","), F.lit(envelope[1])
    )
    return landed(grouped.select("page", body.alias("content")))

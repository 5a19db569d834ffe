"""Merge, its counters, and the unions it is built on."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.types import filter_tags
from eventloom.operators import merge, reports
from eventloom.operators.cards import stored_peers

from .base import query
from .views import CARDS, PRIORITIES, REPORTS, TAGS, cards, incoming_and_stored

_MERGE = f"""
WITH {CARDS}, {REPORTS},
tag_rows AS (
  SELECT id, tag, min((CASE WHEN place = 1 THEN 0 ELSE arrived END) * 100 + pos) AS k
  FROM (SELECT id, place, arrived, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM reports)
  GROUP BY id, tag
),
tag_lists AS (SELECT id, string_agg(tag, ',' ORDER BY k) AS tags FROM tag_rows GROUP BY id),
filled AS (
  SELECT id, count(*) AS reports,
    arg_min(time_start, arrived) FILTER (WHERE time_start IS NOT NULL) AS time_start,
    arg_min(time_end, arrived) FILTER (WHERE time_end IS NOT NULL) AS time_end,
    arg_min(image_url, arrived) FILTER (WHERE image_url IS NOT NULL) AS image_url,
    arg_min(description, arrived) FILTER (WHERE description IS NOT NULL) AS description,
    arg_min(organizer, arrived) FILTER (WHERE organizer IS NOT NULL) AS organizer,
    arg_min(district, arrived) FILTER (WHERE district IS NOT NULL) AS district,
    min(arrived) FILTER (WHERE price_min <> 0 OR price_max <> 0) AS priced_at
  FROM reports GROUP BY id
)
SELECT w.id, w.source, w.title, w.date, w.source_url, f.reports,
  coalesce(w.time_start, f.time_start) AS time_start, coalesce(w.time_end, f.time_end) AS time_end,
  coalesce(w.image_url, f.image_url) AS image_url,
  coalesce(w.description, f.description) AS description,
  coalesce(w.organizer, f.organizer) AS organizer, coalesce(w.district, f.district) AS district,
  CASE WHEN w.price_min = 0 AND w.price_max = 0 AND p.id IS NOT NULL THEN p.price_min ELSE w.price_min END AS price_min,
  CASE WHEN w.price_min = 0 AND w.price_max = 0 AND p.id IS NOT NULL THEN p.price_max ELSE w.price_max END AS price_max,
  CASE WHEN w.price_min = 0 AND w.price_max = 0 AND p.id IS NOT NULL THEN p.price_text ELSE w.price_text END AS price_text,
  CASE WHEN w.price_min = 0 AND w.price_max = 0 AND p.id IS NOT NULL AND nullif(p.price_note, '') IS NOT NULL
    THEN p.price_note ELSE w.price_note END AS price_note,
  coalesce(t.tags, '') AS tags
FROM reports w JOIN filled f USING (id)
LEFT JOIN reports p ON p.id = w.id AND p.arrived = f.priced_at
LEFT JOIN tag_lists t ON t.id = w.id
WHERE w.place = 1
"""


@query(_MERGE)
def merge_cards(spark, sf_dir):
    incoming, stored = incoming_and_stored(spark, sf_dir)
    merged = merge.merge_cards(incoming, stored, PRIORITIES, TAGS)
    return merged.select(
        "id", "source", "title", "date", "source_url", "reports", "time_start", "time_end",
        "image_url", "description", "organizer", "district", "price_min", "price_max",
        "price_text", "price_note", F.array_join("tags", ",").alias("tags"),
    )


_PAIRS = f"""
pairs AS (
  SELECT l.source AS loser, w.source AS winner, count(*) AS n
  FROM reports l JOIN reports w ON w.id = l.id AND w.place = 1
  WHERE l.source <> w.source GROUP BY 1, 2
)"""


@query(f"WITH {CARDS}, {REPORTS}, {_PAIRS} SELECT * FROM pairs")
def merge_pairs(spark, sf_dir):
    return merge.merge_pairs(*incoming_and_stored(spark, sf_dir), PRIORITIES)


@query(f"WITH {CARDS}, {REPORTS}, {_PAIRS} SELECT CAST(sum(n) AS BIGINT) AS merged FROM pairs")
def merged_count(spark, sf_dir):
    return merge_pairs(spark, sf_dir).agg(F.sum("n").alias("merged"))


@query(f"""
WITH {CARDS}, places AS (
  SELECT trim(regexp_replace(replace(lower(venue_name), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS v,
    date, count(DISTINCT id) AS ids
  FROM cards GROUP BY 1, 2 HAVING v <> ''
)
SELECT CAST(coalesce(sum(ids - 1), 0) AS BIGINT) AS near_misses FROM places
""")
def near_misses(spark, sf_dir):
    return merge.near_misses(*incoming_and_stored(spark, sf_dir))


@query(f"WITH {CARDS} SELECT source, count(*) AS found FROM cards WHERE NOT stored GROUP BY source")
def extracted_by_source(spark, sf_dir):
    return reports.extracted_by_source(incoming_and_stored(spark, sf_dir)[0])


@query(f"""
WITH {CARDS}, {REPORTS}, {_PAIRS},
lost AS (SELECT loser AS source, sum(n) AS lost FROM pairs GROUP BY 1),
found AS (SELECT source, count(*) AS found FROM cards WHERE NOT stored GROUP BY 1)
SELECT source, 'perm' AS city, '2024-01-20' AS snapshot_date, found AS events_found,
  CAST(found - coalesce(lost, 0) AS BIGINT) AS unique_events,
  round((found - coalesce(lost, 0)) / found, 3) AS unique_events_ratio
FROM found LEFT JOIN lost USING (source)
""")
def source_quality(spark, sf_dir):
    incoming, stored = incoming_and_stored(spark, sf_dir)
    return reports.source_quality(
        reports.extracted_by_source(incoming), merge.merge_pairs(incoming, stored, PRIORITIES),
        "perm", F.lit("2024-01-20"),
    )


@query(f"WITH {CARDS} SELECT id, source, CAST(pri AS INT) AS pri, seq FROM cards WHERE NOT stored")
def with_priority(spark, sf_dir):
    incoming, _ = incoming_and_stored(spark, sf_dir)
    listed = spark.createDataFrame(list(PRIORITIES.items()), "source string, priority int")
    return merge.with_priority(incoming, listed).select("id", "source", "pri", "seq")


@query(f"""
WITH {CARDS}
SELECT s.id, s.seq, s.source FROM cards s
WHERE s.stored AND EXISTS (SELECT 1 FROM cards i WHERE i.id = s.id AND NOT i.stored)
""", name="stored_peers")
def _stored_peers(spark, sf_dir):
    incoming, stored = incoming_and_stored(spark, sf_dir)
    return stored_peers(incoming, stored).select("id", "seq", "source")


@query(f"""
WITH {CARDS}, {REPORTS} SELECT id, seq, origin, arrived FROM reports
""")
def incoming_then_stored(spark, sf_dir):
    from pyspark.sql import Window

    rows = merge.incoming_then_stored(*incoming_and_stored(spark, sf_dir))
    arrived = F.row_number().over(Window.partitionBy("id").orderBy("arrival"))
    return rows.select(
        "id", "seq", F.col("arrival._origin").alias("origin"), arrived.alias("arrived")
    )


@query(f"""
WITH {CARDS}, {REPORTS},
tag_rows AS (
  SELECT id, tag, min(arrived * 100 + pos) AS k
  FROM (SELECT id, arrived, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM reports)
  GROUP BY id, tag
)
SELECT id, string_agg(tag, ',' ORDER BY k) AS tags FROM tag_rows GROUP BY id
""")
def ordered_tag_union(spark, sf_dir):
    rows = cards(spark, sf_dir).withColumn("pri", F.lit(0))
    same = merge.merge_cards(
        rows.filter(~F.col("stored")).drop("pri"), rows.filter("stored").drop("pri"), {}, TAGS
    )
    tags = filter_tags(F.col("tags"), TAGS)
    return same.filter(F.size("tags") > 0).select("id", F.array_join(tags, ",").alias("tags"))

"""First, last, next and numbered rows; statistics about sources, runs and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import ranking, reports

from .base import AS_OF, query, table
from .views import CARDS, RUNS, cards, posts, runs, social, SOCIAL

c, lit, expr = F.col, F.lit, F.expr


@query("""
SELECT event_id FROM events WHERE user_id % 10 = 0
UNION ALL SELECT min(event_id) FROM events WHERE user_id % 10 <> 0 GROUP BY user_id
""")
def drop_repeats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("key", expr("if(user_id % 10 = 0, null, user_id)"))
    return ranking.drop_repeats(rows.select("event_id", "key"), ["key"], "event_id", blank="key").select("event_id")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 20")
def first_n_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return ranking.first_n(rows, ["user_id"], [c("event_id")], 20)


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 7")
def last_n_posts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return ranking.last_n(rows, ["user_id"], ["event_id"], 7)


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS row_no FROM events")
def number_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ranking.number_rows(rows, ["event_type"], "event_id", block=1000)


@query("""
SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS BIGINT) AS chunk FROM conversations
""")
def chunk_id(spark, sf_dir):
    return ranking.chunk_id(posts(spark, sf_dir).select("conv_id", "turn"), ["conv_id"], "turn", 5, block=4)


@query("""
SELECT l_orderkey, l_linenumber // 8 AS part, strftime(min(l_shipdate), '%Y-%m-%d') AS date,
  arg_min(l_linenumber, strftime(l_shipdate, '%Y-%m-%d') || lpad(CAST(l_linenumber AS VARCHAR), 3, '0')) AS line
FROM lineitem WHERE l_shipdate >= '1996-01-01' GROUP BY l_orderkey, l_linenumber // 8
""")
def next_date(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", expr("l_linenumber DIV 8").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(
            "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("start_date"),
            c("l_linenumber").alias("start_time"),
        ))).alias("dates")
    )
    found = listed.withColumn("d", ranking.next_date(c("dates"), lit("1996-01-01").cast("date")))
    return found.filter(c("d").isNotNull()).select(
        "l_orderkey", "part", c("d.start_date").alias("date"), c("d.start_time").alias("line")
    )


@query(f"""
WITH {RUNS}
SELECT source, city, strftime(max(run_at), '%Y-%m-%d %H:%M:%S') AS last_run,
  strftime(max(run_at) FILTER (WHERE errors = 0), '%Y-%m-%d %H:%M:%S') AS last_success,
  round(avg(events_found), 2) AS avg_events, round(avg(CASE WHEN errors = 0 THEN 1 ELSE 0 END), 3) AS success_rate,
  CAST(sum(errors) AS BIGINT) AS total_errors
FROM runs GROUP BY source, city
""")
def health_agg(spark, sf_dir):
    state = reports.health_agg(runs(spark, sf_dir))
    shown = lambda name: F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
    return state.select(
        "source", "city", shown("last_run"), shown("last_success"), "avg_events", "success_rate", "total_errors"
    )


@query(f"WITH {CARDS} SELECT city, type AS category, count(*) AS count, '2024-01-20' AS snapshot_date FROM cards WHERE city = 'perm' GROUP BY ALL")
def coverage(spark, sf_dir):
    return reports.coverage(cards(spark, sf_dir), lit(AS_OF), "perm")


@query(f"""
WITH {CARDS}, snaps AS (SELECT city, type AS category, date AS snapshot_date, count(*) AS count FROM cards GROUP BY ALL)
SELECT *, count - lag(count) OVER w AS change, lag(count) OVER w AS previous FROM snaps
WINDOW w AS (PARTITION BY city, category ORDER BY snapshot_date)
""")
def coverage_trend(spark, sf_dir):
    snaps = cards(spark, sf_dir).groupBy("city", c("type").alias("category"), c("date").alias("snapshot_date")).agg(
        F.count(lit(1)).alias("count")
    )
    return reports.coverage_trend(snaps)


@query(f"WITH {CARDS}, {SOCIAL} SELECT source, count(*) AS n FROM social WHERE date = 'always' GROUP BY source")
def always_by_source(spark, sf_dir):
    return reports.always_by_source(social(spark, sf_dir))


def _parts(spark, sf_dir):
    return runs(spark, sf_dir).selectExpr(
        "run_id DIV 10 AS run", "run_id AS feed_order", "source", "city", "events_found + 3 AS discovered", "events_found AS new",
        "events_found AS extracted", "errors * 30 AS failed", "skipped_always", "warnings",
    )


@query(f"""
WITH {RUNS}
SELECT run_id // 10 AS run, CAST(sum(events_found + 3) AS BIGINT) AS discovered, CAST(sum(events_found) AS BIGINT) AS new,
  CAST(sum(events_found) AS BIGINT) AS extracted, CAST(sum(errors * 30) AS BIGINT) AS failed,
  CAST(sum(skipped_always) AS BIGINT) AS skipped_always, sum(errors * 30) < sum(events_found) AS success,
  coalesce(string_agg(warning, '|' ORDER BY run_id) FILTER (WHERE warning IS NOT NULL), '') AS warnings
FROM runs GROUP BY run_id // 10
""")
def run_summary(spark, sf_dir):
    total = reports.run_summary(_parts(spark, sf_dir), ["run"])
    return total.withColumn("warnings", F.array_join("warnings", "|"))


@query(f"""
WITH {RUNS} SELECT run_id, coalesce(warning, CASE WHEN skipped_always > 0 THEN 'Отброшено spurious ''always'': ' || skipped_always END) AS last_error FROM runs
""")
def health_error_text(spark, sf_dir):
    text = reports.health_error_text(c("warnings"), c("skipped_always"))
    return runs(spark, sf_dir).select("run_id", text.alias("last_error"))

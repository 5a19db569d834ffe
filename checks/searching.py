"""Search hits, candidates and their budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import urls
from eventloom.operators import discovery
from eventloom.plans import search as search_plan
from eventloom.schemas import CANDIDATE, shape

from .base import NOW, query, table
from .views import HITS, hits

c, lit, expr = F.col, F.lit, F.expr
now = lambda: F.lit(NOW).cast("timestamp")

_FOUND = """
found AS (
  SELECT city, domain, list(DISTINCT query) AS qs,
    arg_min(provider, seq) AS first_provider, arg_min(query, seq) AS first_query, min(seq) AS first_seq
  FROM hits WHERE NOT regexp_matches(domain, '(^|\\.)example\\.net$') GROUP BY city, domain
),
samples AS (
  SELECT city, domain, list(url ORDER BY seq) AS urls FROM (
    SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY city, domain ORDER BY seq) <= 5) GROUP BY city, domain
)"""


def _found(spark, sf_dir):
    return discovery.collect_candidates(hits(spark, sf_dir), ignored=["example.net"])


@query(f"""
WITH {HITS}, {_FOUND}
SELECT city, domain, array_to_string(list_sort(qs), '|') AS queries, array_to_string(urls, '|') AS sample_urls,
  first_provider, first_query, first_seq FROM found JOIN samples USING (city, domain)
""")
def collect_candidates(spark, sf_dir):
    return _found(spark, sf_dir).withColumns({
        "queries": F.array_join("queries", "|"), "sample_urls": F.array_join("sample_urls", "|"),
    })


@query(f"""
WITH {HITS} SELECT domain, arg_min(provider, seq) AS first_provider, arg_min(query, seq) AS first_query FROM hits GROUP BY domain
""")
def first_seen(spark, sf_dir):
    return discovery.first_seen(hits(spark, sf_dir))


def _pages(spark, sf_dir):
    """Landed first samples; every third page holds an event object, every tenth failed."""
    return table(spark, sf_dir, "pages").select(
        "url", expr("if(page_id % 10 = 0, 404, 200)").alias("status"),
        F.concat("html", expr("if(page_id % 3 = 0, '{\"@type\": \"MusicEvent\"}', '')")).alias("content"),
    )


_SCORED = f"""
{HITS}, {_FOUND},
flags AS (SELECT DISTINCT url FROM pages WHERE page_id % 10 <> 0 AND page_id % 3 = 0),
scored AS (
  SELECT f.*, s.urls, flags.url IS NOT NULL AS has_jsonld_event,
    len(list_filter_en) > 0 AS path,
    CAST(len(qs) - 1 + CASE WHEN len(list_filter_en) > 0 THEN 2 ELSE 0 END + CASE WHEN flags.url IS NOT NULL THEN 3 ELSE 0 END
      - CASE WHEN regexp_matches(f.domain, '(^|\\.)example\\.org$') THEN 5 ELSE 0 END AS BIGINT) AS score
  FROM found f JOIN (SELECT *, [u FOR u IN urls IF contains(lower(u), '/en/')] AS list_filter_en FROM samples) s USING (city, domain)
  LEFT JOIN flags ON flags.url = s.urls[1]
)"""


def _scored(spark, sf_dir):
    return discovery.score_candidates(_found(spark, sf_dir), _pages(spark, sf_dir), ["/en/"], ["example.org"])


@query(f"WITH {_SCORED} SELECT city, domain, has_jsonld_event, score FROM scored")
def score_candidates(spark, sf_dir):
    return _scored(spark, sf_dir).select("city", "domain", "has_jsonld_event", "score")


@query(f"WITH {_SCORED} SELECT domain, score, row_number() OVER (ORDER BY score DESC, first_seq, domain) AS place FROM scored")
def candidates_by_score(spark, sf_dir):
    from eventloom.operators.ranking import number_rows

    best = discovery.by_score(_scored(spark, sf_dir)).select(
        "domain", "score", lit(0).alias("all"), F.struct(-c("score"), "first_seq", "domain").alias("o"))
    return number_rows(best, ["all"], "o", "place", -c("score")).select("domain", "score", "place")


@query("""
SELECT url FROM pages ORDER BY url LIMIT 10
""")
def url_sample(spark, sf_dir):
    from eventloom.operators.listing import sample

    return sample(table(spark, sf_dir, "pages").select("url"), 10, "url")


@query(f"""
WITH {HITS}, ranked AS (SELECT *, list_position(['brave', 'duckduckgo', 'serper'], provider) AS r,
  regexp_replace(query, '-\\d$', '') AS q FROM hits)
SELECT q AS query, provider, seq, url FROM ranked QUALIFY r = min(r) OVER (PARTITION BY q)
""")
def first_answering(spark, sf_dir):
    rows = hits(spark, sf_dir).withColumn("query", F.regexp_replace("query", r"-\d$", ""))
    return discovery.first_answering(rows, ["brave", "duckduckgo", "serper"]).select("query", "provider", "seq", "url")


@query(f"""
WITH {HITS} SELECT seq FROM hits WHERE domain NOT IN (SELECT domain FROM hits WHERE seq % 7 = 0)
""")
def drop_known_domains(spark, sf_dir):
    from eventloom.operators.cards import drop_known_domains as drop

    found = hits(spark, sf_dir).withColumn("domain", urls.domain_of(c("url")))
    return drop(found, found.filter("seq % 7 = 0").select("domain")).select("seq")


@query(f"""
WITH {_SCORED}
SELECT coalesce(p.provider, f.first_provider) AS provider, coalesce(queries, 0) AS queries, coalesce(domains, 0) AS domains
FROM (SELECT provider, count(DISTINCT query) AS queries FROM (
  SELECT query, provider FROM hits UNION ALL SELECT 'silent ' || seq, 'none' FROM hits WHERE seq % 9 = 0) GROUP BY provider) p
FULL JOIN (SELECT first_provider, count(*) AS domains FROM scored GROUP BY 1) f ON f.first_provider = p.provider
""")
def provider_stats(spark, sf_dir):
    rows = hits(spark, sf_dir)
    silent = rows.filter("seq % 9 = 0").selectExpr("concat('silent ', seq) AS query", "'none' AS provider")
    return discovery.provider_stats(rows.select("query", "provider").unionByName(silent), _scored(spark, sf_dir))


@query(f"""
WITH {_SCORED} SELECT count(*) AS domains, round(avg(score), 1) AS avg_score, count(*) FILTER (WHERE score >= 7) AS score_ge_7 FROM scored
""")
def discovery_summary(spark, sf_dir):
    return discovery.discovery_summary(_scored(spark, sf_dir))


def _stored(spark, sf_dir):
    """A candidate table from the customers."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('d', c_custkey, '.example') AS domain", "if(c_custkey % 2 = 0, 'perm', 'sochi') AS city",
        "array(concat('q', c_custkey % 7)) AS queries", "array('https://x.example/') AS sample_urls",
        "c_custkey % 13 AS score", "c_custkey % 3 = 0 AS has_jsonld_event",
        "array('new', 'approved', 'rejected')[c_custkey % 3] AS status",
        "timestamp '2024-01-01' + make_dt_interval(cast(c_custkey % 20 AS int)) AS found_at",
        "timestamp '2024-01-02' AS last_seen",
        "array('serper', 'brave', null)[c_nationkey % 3] AS first_provider", "'q' AS first_query",
        "if(c_custkey % 4 = 0, concat('https://d', c_custkey, '.example/cached'), null) AS listing_url",
        "if(c_custkey % 8 = 0, timestamp '2024-01-19', timestamp '2023-01-01') AS last_verified", "c_custkey",
    )


_STORED = """
stored AS (
  SELECT 'd' || c_custkey || '.example' AS domain, CASE WHEN c_custkey % 2 = 0 THEN 'perm' ELSE 'sochi' END AS city,
    c_custkey % 13 AS score, (['new', 'approved', 'rejected'])[c_custkey % 3 + 1] AS status,
    TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 20) DAY AS found_at, c_custkey,
    (['serper', 'brave', NULL])[c_nationkey % 3 + 1] AS first_provider FROM customer
)"""


@query(f"""
WITH {_STORED}, r AS (SELECT coalesce(first_provider, '?') AS p, status AS s, score FROM stored WHERE city = 'perm' AND found_at >= '2024-01-13')
SELECT CASE WHEN grouping(p) = 1 AND grouping(s) = 1 THEN 'total' WHEN grouping(p) = 0 THEN 'provider' ELSE 'status' END AS kind,
  coalesce(p, s, 'all') AS value, count(*) AS n, round(avg(score), 1) AS avg_score, count(*) > 0 AS healthy
FROM r GROUP BY GROUPING SETS ((p), (s), ())
""")
def discovery_health(spark, sf_dir):
    return discovery.discovery_health(_stored(spark, sf_dir), "perm", lit("2024-01-13").cast("timestamp"))


@query("SELECT 'total' AS kind, 'all' AS value, 0 AS n, NULL::DOUBLE AS avg_score, false AS healthy")
def discovery_health_empty(spark, sf_dir):
    return discovery.discovery_health(_stored(spark, sf_dir), "perm", lit("2025-01-01").cast("timestamp"))


@query(f"WITH {_STORED} SELECT first_provider, count(*) AS n FROM stored GROUP BY 1")
def provider_contribution(spark, sf_dir):
    return discovery.provider_contribution(_stored(spark, sf_dir))


@query(f"""
WITH {_STORED} SELECT domain, city, score, row_number() OVER (PARTITION BY city ORDER BY score DESC, domain) AS place
FROM stored WHERE status = 'approved' QUALIFY place <= 20
""")
def approved_domains(spark, sf_dir):
    return discovery.approved_domains(_stored(spark, sf_dir), 20).select("domain", "city", "score", "place")


@query(f"""
WITH {_STORED}, best AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY score DESC, domain) AS place
  FROM stored WHERE status = 'approved' QUALIFY place <= 20),
t AS (SELECT *, c_custkey % 5 <> 0 AS changed, c_custkey % 4 = 0 AS structured,
  sum(CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY city ORDER BY place) AS turn FROM best)
SELECT domain, CASE WHEN NOT changed THEN 'unchanged' WHEN structured THEN 'structured' WHEN turn <= 7 THEN 'model' ELSE 'over_budget' END AS reading FROM t
""")
def budgeted_domains(spark, sf_dir):
    best = discovery.approved_domains(_stored(spark, sf_dir), 20).withColumns({
        "changed": c("c_custkey") % 5 != 0, "structured": c("c_custkey") % 4 == 0,
    })
    return discovery.budgeted_domains(best, "changed", "structured", 7).select("domain", "reading")


@query(f"""
WITH {_STORED}, t AS (SELECT *, c_custkey % 5 <> 0 AS changed, c_custkey % 4 = 0 AS structured,
  sum(CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY city ORDER BY score DESC, domain) AS turn
  FROM stored WHERE status = 'approved')
SELECT domain, CASE WHEN NOT changed THEN 'unchanged' WHEN structured THEN 'structured' WHEN turn <= 7 THEN 'model' ELSE 'over_budget' END AS reading FROM t
""")
def budgeted_domains_all(spark, sf_dir):
    """A model budget without a limit of domains: it goes to the best scores of a city."""
    approved = discovery.approved_domains(_stored(spark, sf_dir)).withColumns({
        "changed": c("c_custkey") % 5 != 0, "structured": c("c_custkey") % 4 == 0,
    })
    return discovery.budgeted_domains(approved, "changed", "structured", 7).select("domain", "reading")


@query(f"""
WITH probes AS (
  SELECT c_custkey, arg_min(p, p) AS p FROM (SELECT c_custkey, unnest(range(6)) AS p FROM customer)
  WHERE NOT (p <= c_custkey % 7) GROUP BY 1
)
SELECT 'd' || c_custkey || '.example' AS domain,
  CASE WHEN c_custkey % 8 = 0 THEN 'https://d' || c_custkey || '.example/cached'
    WHEN c_custkey % 3 = 0 THEN 'https://d' || c_custkey || '.example/Afisha'
    ELSE 'https://d' || c_custkey || '.example' || (['', '/afisha', '/events', '/poster', '/raspisanie', '/schedule'])[p + 1] END AS listing_url
FROM customer LEFT JOIN probes USING (c_custkey)
""")
def pick_listing_url(spark, sf_dir):
    from eventloom import vocab

    rows = _stored(spark, sf_dir).withColumn(
        "sample_urls",
        expr("array('https://x.example/', if(c_custkey % 3 = 0, concat('https://d', c_custkey, '.example/Afisha'), 'https://y.example/'))"),
    )
    paths = F.array(*[lit(p) for p in vocab.PROBE_PATHS])
    probes = rows.select("domain", "c_custkey", F.posexplode(paths).alias("probe_order", "path")).select(
        "domain", "probe_order", F.concat(lit("https://"), "domain", "path").alias("url"),
        expr("if(probe_order = c_custkey % 7, 500, 200)").alias("status"),
        expr("repeat('x', if(probe_order < c_custkey % 7, 500, 501))").alias("content"),
    )
    return discovery.pick_listing_url(rows, probes, now()).select("domain", "listing_url")


@query(f"""
SELECT 'd' || c_custkey || '.example' AS domain, CASE WHEN c_custkey % 5 = 0 THEN 'https://new.example/' || c_custkey
  WHEN c_custkey % 4 = 0 THEN 'https://d' || c_custkey || '.example/cached' END AS listing_url,
  CASE WHEN c_custkey % 5 = 0 THEN '2024-01-20 12:00:00' WHEN c_custkey % 8 = 0 THEN '2024-01-19 00:00:00' ELSE '2023-01-01 00:00:00' END AS last_verified
FROM customer
""")
def update_listing_cache(spark, sf_dir):
    rows = _stored(spark, sf_dir)
    found = rows.filter("c_custkey % 5 = 0").selectExpr("domain", "concat('https://new.example/', c_custkey) AS listing_url")
    return discovery.update_listing_cache(rows, found, now()).select(
        "domain", "listing_url", F.date_format("last_verified", "yyyy-MM-dd HH:mm:ss").alias("last_verified")
    )


_MERGED = """
WITH s AS (SELECT c_custkey AS k, (['new', 'approved', 'rejected'])[c_custkey % 3 + 1] AS status, c_custkey % 13 AS score,
    (['serper', 'brave', NULL])[c_nationkey % 3 + 1] AS first_provider, 'q' || (c_custkey % 7) AS q FROM customer WHERE c_custkey % 2 = 0),
f AS (SELECT c_custkey AS k, c_custkey % 4 AS strong FROM customer WHERE c_custkey % 5 < 2)
SELECT 'd' || coalesce(s.k, f.k) || '.example' AS domain,
  CASE WHEN s.k IS NULL THEN CASE WHEN strong = 0 THEN 'approved' ELSE 'new' END
    WHEN f.k IS NOT NULL AND s.status = 'new' AND strong = 0 THEN 'approved' ELSE s.status END AS status,
  CASE WHEN f.k IS NULL THEN q ELSE array_to_string(list_sort(list_distinct(['qa', 'qb', 'qc', coalesce(q, 'qa')])), '|') END AS queries,
  CASE WHEN f.k IS NULL THEN s.score ELSE 9 END AS score,
  CASE WHEN s.k IS NULL THEN 'duckduckgo' ELSE s.first_provider END AS first_provider,
  f.k IS NOT NULL AS seen_now, s.k IS NULL AS found_now
FROM s FULL JOIN f ON s.k = f.k
"""


@query(_MERGED)
def merge_candidates(spark, sf_dir):
    rows = _stored(spark, sf_dir)
    found = rows.filter("c_custkey % 5 < 2").select(
        "domain", "city", expr("array('qa', 'qb', 'qc')").alias("queries"),
        expr("array('https://x.example/afisha')").alias("sample_urls"), lit(9).cast("long").alias("score"),
        expr("c_custkey % 4 = 0").alias("has_jsonld_event"), lit("duckduckgo").alias("first_provider"),
        lit("qa").alias("first_query"),
    )
    merged = discovery.merge_candidates(found, rows.filter("c_custkey % 2 = 0"), now())
    return merged.select(
        "domain", "status", F.array_join("queries", "|").alias("queries"), "score", "first_provider",
        (c("last_seen") == now()).alias("seen_now"), (c("found_at") == now()).alias("found_now"),
    )


@query("""
WITH texts AS (SELECT c_custkey, 'Город ' || c_custkey AS city FROM customer)
SELECT c_custkey, 'квиз ' || city AS first, 'куда сходить ' || city AS last, 8 AS n FROM texts
""")
def search_queries(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(
        "c_custkey", discovery.search_queries(F.concat(lit("Город "), c("c_custkey").cast("string"))).alias("q")
    )
    return asked.select("c_custkey", c("q")[0].alias("first"), c("q")[7].alias("last"), F.size("q").alias("n"))


@query(f"""
WITH {HITS},
best AS (SELECT *, list_position(['serper', 'brave', 'duckduckgo'], provider) AS r FROM hits),
answered AS (SELECT * FROM best QUALIFY r = min(r) OVER (PARTITION BY query)),
kept AS (SELECT * FROM answered WHERE domain NOT IN (SELECT domain FROM hits WHERE seq % 7 = 0)),
f AS (SELECT city, domain, count(DISTINCT query) AS q FROM kept GROUP BY city, domain),
s AS (SELECT city, domain, list(url ORDER BY seq) AS urls FROM (SELECT * FROM kept
  QUALIFY row_number() OVER (PARTITION BY city, domain ORDER BY seq) <= 5) GROUP BY city, domain),
flags AS (SELECT DISTINCT url FROM pages WHERE page_id % 10 <> 0 AND page_id % 3 = 0)
SELECT city, domain, CAST(q - 1 + CASE WHEN flags.url IS NOT NULL THEN 3 ELSE 0 END AS BIGINT) AS score
FROM f JOIN s USING (city, domain) LEFT JOIN flags ON flags.url = s.urls[1]
""")
def discover_sources(spark, sf_dir):
    rows = hits(spark, sf_dir)
    known = rows.filter("seq % 7 = 0").select("url")
    none = shape(_stored(spark, sf_dir).filter("false"), CANDIDATE)
    scored, _ = search_plan.discover_sources(rows, known, none, _pages(spark, sf_dir), now())
    return scored.select("city", "domain", "score")


@query(f"""
WITH {HITS},
best AS (SELECT *, list_position(['serper', 'brave', 'duckduckgo'], provider) AS r FROM hits),
answered AS (SELECT * FROM best QUALIFY r = min(r) OVER (PARTITION BY query)),
kept AS (SELECT * FROM answered WHERE domain NOT IN (SELECT domain FROM hits WHERE seq % 7 = 0))
SELECT domain, min(city) AS city, array_to_string(list_sort(list(DISTINCT query)), '|') AS queries FROM kept GROUP BY domain
""")
def discover_sources_table(spark, sf_dir):
    rows = hits(spark, sf_dir)
    known = rows.filter("seq % 7 = 0").select("url")
    none = shape(_stored(spark, sf_dir).filter("false"), CANDIDATE)
    _, stored = search_plan.discover_sources(rows, known, none, _pages(spark, sf_dir), now())
    return stored.select("domain", "city", F.array_join("queries", "|").alias("queries"))


@query("""
SELECT 'd' || c_custkey // 2 || '.example' AS domain, min(CASE WHEN c_custkey % 2 = 0 THEN 'perm' ELSE 'sochi' END) AS city,
  array_to_string(list_sort(list(DISTINCT 'q' || c_custkey % 5)), '|') AS queries FROM customer GROUP BY c_custkey // 2
""")
def candidates_of_two_cities(spark, sf_dir):
    found = table(spark, sf_dir, "customer").select(
        expr("concat('d', c_custkey DIV 2, '.example')").alias("domain"),
        expr("if(c_custkey % 2 = 0, 'perm', 'sochi')").alias("city"),
        expr("array(concat('q', c_custkey % 5))").alias("queries"), expr("array('https://x.example/')").alias("sample_urls"),
        lit(1).cast("long").alias("score"), lit(False).alias("has_jsonld_event"), lit("brave").alias("first_provider"),
        lit("q").alias("first_query"),
    )
    merged = discovery.merge_candidates(found, shape(_stored(spark, sf_dir).filter("false"), CANDIDATE), now())
    return merged.select("domain", "city", F.array_join("queries", "|").alias("queries"))

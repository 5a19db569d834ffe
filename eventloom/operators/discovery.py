"""Search hits to scored candidate domains, and approved domains to pages worth reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions import predicates, urls
from ..schemas import CANDIDATE, shape
from .cards import drop_known_domains
from .ranking import first_n


def search_queries(city_name: Column) -> Column:
    """The queries run for a city, in order."""
    return F.array(*[F.replace(F.lit(t), F.lit("{city}"), city_name) for t in vocab.SEARCH_TEMPLATES])


def first_answering(hits: DataFrame, providers: list[str] = vocab.SEARCH_PROVIDERS) -> DataFrame:
    """Hits of the first provider that found anything, per query.

    The best provider per query is aggregated first, so no query's hits are gathered in one task.
    """
    order = F.array_position(F.array(*[F.lit(p) for p in providers]), F.col("provider"))
    ranked = hits.withColumn("_rank", order).filter(F.col("_rank") > 0)
    best = ranked.groupBy("query").agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, ["query", "_rank"], "left_semi").select(*hits.columns)


def collect_candidates(
    hits: DataFrame,
    known: DataFrame | None = None,
    ignored: list[str] = vocab.IGNORED_DOMAINS,
    samples: int = 5,
) -> DataFrame:
    """One row per domain: its distinct queries, first sample urls, first provider and query.

    `hits` has city, query, provider, url and the order column `seq`. Pairs of domain and
    query are made distinct before they are gathered, and sample urls are cut to the first
    few on both sides of the shuffle, so a domain with very many hits stays small.
    """
    found = hits.withColumn("domain", urls.domain_of(F.col("url"))).filter(
        F.col("domain").isNotNull() & ~urls.domain_in_set(F.col("domain"), ignored)
    )
    if known is not None:
        found = drop_known_domains(found, known)
    key = ["city", "domain"]
    per_query = found.groupBy(*key, "query").agg(
        F.min(F.struct("seq", "provider", "query")).alias("first")
    )
    queries = per_query.groupBy(*key).agg(
        F.array_sort(F.collect_set("query")).alias("queries"), F.min("first").alias("first")
    )
    sampled = first_n(found.select(*key, "seq", "url"), key, [F.col("seq")], samples)
    urls_of = sampled.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("_urls")
    )
    return queries.join(urls_of, key).select(
        *key, "queries", F.transform("_urls", lambda u: u["url"]).alias("sample_urls"),
        F.col("first.provider").alias("first_provider"), F.col("first.query").alias("first_query"),
        F.col("first.seq").alias("first_seq"),
    )


def first_seen(hits: DataFrame) -> DataFrame:
    """Provider and query that found each domain first."""
    found = hits.withColumn("domain", urls.domain_of(F.col("url"))).filter(F.col("domain").isNotNull())
    first = found.groupBy("domain").agg(F.min(F.struct("seq", "provider", "query")).alias("f"))
    return first.select(
        "domain", F.col("f.provider").alias("first_provider"), F.col("f.query").alias("first_query")
    )


def score_candidates(
    candidates: DataFrame, pages: DataFrame, hints: list[str] = vocab.EVENT_PATHS,
    aggregators: list[str] = vocab.AGGREGATOR_DOMAINS,
) -> DataFrame:
    """Candidates with `has_jsonld_event` and `score`.

    `pages` are the landed first samples (url, status, content). They are reduced to one
    flag per url before the join, so page contents never move.
    """
    flags = pages.filter((F.col("status") == 200) & predicates.has_jsonld_event(F.col("content")))
    flags = flags.select("url").distinct().withColumn("_jsonld", F.lit(True))
    first = candidates.withColumn("_first", F.get("sample_urls", 0))
    joined = first.join(flags, first["_first"] == flags["url"], "left").drop("url", "_first")
    jsonld = F.coalesce("_jsonld", F.lit(False))
    path = predicates.has_event_path(F.col("sample_urls"), hints)
    penalty = urls.domain_in_set(F.col("domain"), aggregators)
    score = (
        F.size("queries") - 1 + F.when(path, 2).otherwise(0) + F.when(jsonld, 3).otherwise(0)
        - F.when(penalty, vocab.AGGREGATOR_PENALTY).otherwise(0)
    )
    return joined.withColumn("has_jsonld_event", jsonld).withColumn(
        "score", score.cast("long")
    ).drop("_jsonld")


def by_score(candidates: DataFrame) -> DataFrame:
    """Best first, in the order found among equals."""
    return candidates.orderBy(F.desc("score"), "first_seq", "domain")


def merge_candidates(found: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """The candidate table after a run: one full outer join by domain.

    A moderator's decision, the finding time and the first provider and query of a known
    domain stay; its queries grow; a `new` one that now has every sign becomes `approved`.
    Domains not found this time stay as they are. A domain found in several cities is one row:
    the first city by name, with the queries of all.
    """
    rest = [c for c in found.columns if c not in ("domain", "queries")]
    found = found.groupBy("domain").agg(
        F.min_by(F.struct(*rest), F.struct("city", F.to_json(F.struct(*rest)))).alias("_row"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("queries")))).alias("queries"),
    ).select("domain", "queries", "_row.*")
    f = found.select(
        "domain",
        F.struct(*[c for c in found.columns if c != "domain"]).alias("f"),
        F.when(
            predicates.auto_approve(
                F.col("domain"), F.col("has_jsonld_event"), F.col("sample_urls"), F.size("queries")
            ),
            "approved",
        ).otherwise("new").alias("verdict"),
    )
    s = shape(stored, CANDIDATE)
    s = s.select("domain", F.struct(*[c for c in CANDIDATE if c != "domain"]).alias("s"))
    joined = f.join(s, "domain", "full_outer")
    seen, known = F.col("f").isNotNull(), F.col("s").isNotNull()
    none = F.array().cast("array<string>")
    newest = lambda name: F.when(seen, F.col(f"f.{name}")).otherwise(F.col(f"s.{name}"))
    oldest = lambda name, value: F.when(known, F.col(f"s.{name}")).otherwise(value)
    status = (
        F.when(~known, F.col("verdict"))
        .when(seen & (F.col("s.status") == "new") & (F.col("verdict") == "approved"), "approved")
        .otherwise(F.col("s.status"))
    )
    values = {
        "domain": F.col("domain"),
        "city": newest("city"),
        "queries": F.when(
            seen,
            F.array_sort(F.array_union(F.col("f.queries"), F.coalesce("s.queries", none))),
        ).otherwise(F.col("s.queries")),
        "sample_urls": newest("sample_urls"),
        "score": newest("score"),
        "has_jsonld_event": newest("has_jsonld_event"),
        "status": status,
        "found_at": oldest("found_at", now),
        "last_seen": F.when(seen, now).otherwise(F.col("s.last_seen")),
        "first_provider": oldest("first_provider", F.col("f.first_provider")),
        "first_query": oldest("first_query", F.col("f.first_query")),
        "listing_url": F.col("s.listing_url"),
        "last_verified": F.col("s.last_verified"),
    }
    return joined.select(*[values[n].cast(t).alias(n) for n, t in CANDIDATE.items()])


def update_listing_cache(candidates: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Candidates with the listing url found for their domain and the time of the check."""
    fresh = found.select("domain", F.col("listing_url").alias("_url"))
    joined = candidates.join(fresh, "domain", "left")
    return joined.withColumns({
        "listing_url": F.coalesce("_url", "listing_url"),
        "last_verified": F.when(F.col("_url").isNotNull(), now).otherwise(F.col("last_verified")),
    }).select(*candidates.columns)


def provider_stats(searches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per provider: queries it answered (`none` for unanswered ones) and domains it found first."""
    asked = searches.groupBy("provider").agg(F.count_distinct("query").alias("queries"))
    new = candidates.groupBy(F.col("first_provider").alias("provider")).agg(
        F.count(F.lit(1)).alias("domains")
    )
    return asked.join(new, "provider", "full_outer").select(
        "provider", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("queries", "domains")]
    )


def discovery_summary(candidates: DataFrame) -> DataFrame:
    return candidates.agg(
        F.count(F.lit(1)).alias("domains"),
        F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("avg_score"),
        F.count_if(F.col("score") >= 7).alias("score_ge_7"),
    )


def discovery_health(candidates: DataFrame, city: str, since: Column) -> DataFrame:
    """New candidates since a time: in all, by provider and by status.

    `kind` is total, provider or status; `healthy` is false when there are none at all.
    """
    rows = candidates.filter((F.col("city") == city) & (F.col("found_at") >= since)).select(
        F.coalesce(F.nullif("first_provider", F.lit("")), F.lit("?")).alias("provider"),
        F.coalesce(F.nullif("status", F.lit("")), F.lit("?")).alias("status"),
        F.coalesce("score", F.lit(0)).alias("score"),
    )
    p, s = F.col("provider"), F.col("status")
    sets = rows.groupingSets([[p], [s]], p, s).agg(
        F.grouping("provider").alias("_p"), F.grouping("status").alias("_s"),
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 1).alias("avg_score"),
    )
    # The total is an aggregate without groups, which has a row even where there is nothing.
    sets = sets.unionByName(rows.agg(
        F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("status"),
        F.lit(1).alias("_p"), F.lit(1).alias("_s"),
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 1).alias("avg_score"),
    ))
    total = (F.col("_p") == 1) & (F.col("_s") == 1)
    kind = F.when(total, "total").when(F.col("_p") == 0, "provider").otherwise("status")
    return sets.select(
        kind.alias("kind"), F.coalesce("provider", "status", F.lit("all")).alias("value"), "n",
        "avg_score", (F.col("n") > 0).alias("healthy"),
    )


def provider_contribution(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("first_provider").agg(F.count(F.lit(1)).alias("n"))


def approved_domains(candidates: DataFrame, limit: int | None = None, by: str = "city") -> DataFrame:
    """The approved domains of each city; with `limit` the best ones, with their rank `place`.

    Without a limit no rank is needed and `place` is 0, so that no city is sorted as a whole.
    """
    approved = candidates.filter(F.col("status") == "approved")
    if limit is None:
        return approved.withColumn("place", F.lit(0))
    order = Window.partitionBy(by).orderBy(F.desc("score"), "domain")
    return approved.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


#: Stands for a score that is missing, in the order of scores.
_NO_SCORE = -(1 << 62)


def budgeted_domains(
    domains: DataFrame, changed: str, structured: str, model_budget: int | None = None, by: str = "city"
) -> DataFrame:
    """Which domains are read, and which of them may use the model.

    Unchanged domains are skipped; those without structured data share the model budget by score and
    domain, the best first, if there is one. The last domain that the budget reaches is found by a ranked
    limit, which Spark also applies before the shuffle, and the others are compared with it: no city is
    sorted as a whole.
    """
    kind = F.when(~F.col(changed), "unchanged").when(F.col(structured), "structured")
    if model_budget is None:
        return domains.withColumn("reading", kind.otherwise("model"))
    needs = domains.filter(F.col(changed) & ~F.col(structured)).select(by, "score", "domain")
    served = first_n(needs, [by], [F.desc("score"), F.col("domain")], model_budget)
    # The score is turned round so that the last one served is the greatest pair.
    rank = F.struct((-F.coalesce("score", F.lit(_NO_SCORE))).alias("score"), F.col("domain"))
    last = served.groupBy(by).agg(F.max(rank).alias("_last"))
    domains = domains.withColumn("_city", F.col(by)).join(
        last.withColumnRenamed(by, "_by"), F.col("_city").eqNullSafe(F.col("_by")), "left")
    reading = kind.when(rank <= F.col("_last"), "model").otherwise("over_budget")
    return domains.withColumn("reading", reading).drop("_city", "_by", "_last")


def pick_listing_url(candidates: DataFrame, probes: DataFrame, now: Column) -> DataFrame:
    """The page to read per domain: the fresh cached one, a sample that looks like a listing,
    or the first probed page that answered with real content.

    `probes` are landed pages (domain, probe_order, url, status, content), reduced to one
    url per domain before the join.
    """
    good = probes.filter((F.col("status") == 200) & (F.length("content") > 500))
    probed = good.groupBy("domain").agg(F.min_by("url", "probe_order").alias("_probed"))
    cached = F.when(
        predicates.listing_fresh(F.col("last_verified"), now), F.nullif("listing_url", F.lit(""))
    )
    sample = urls.first_with_path(F.col("sample_urls"), vocab.LISTING_PATHS)
    return candidates.join(probed, "domain", "left").withColumn(
        "listing_url", F.coalesce(cached, sample, F.col("_probed"))
    ).drop("_probed")

"""From landed search results to the candidate table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..operators import discovery


def known_domains(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Domains not searched again: those of configured sources and the rejected ones."""
    configured = sources.select(urls.domain_of(F.col("url")).alias("domain"))
    rejected = candidates.filter(F.col("status") == "rejected").select("domain")
    return configured.unionByName(rejected).filter(F.col("domain").isNotNull()).distinct()


def discover_sources(
    hits: DataFrame, sources: DataFrame, stored: DataFrame, pages: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """(scored candidates, the candidate table after the run)."""
    answered = discovery.first_answering(hits)
    found = discovery.collect_candidates(answered, known_domains(sources, stored))
    scored = discovery.score_candidates(found, pages)
    return scored, discovery.merge_candidates(scored, stored, now)

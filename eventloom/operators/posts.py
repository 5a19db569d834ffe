"""Posts of social sources: selection, batches and the documents built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import predicates
from ..functions.text import strip
from .cards import changed_docs
from .ranking import chunk_id, first_n


def candidate_posts(
    posts: DataFrame,
    now: Column,
    archive: DataFrame | None = None,
    source_type: Column | str = predicates.SOCIAL,
    group: list[str] = ("source", "city", "group_url"),
    days: int = 14,
    limit: int | None = None,
) -> DataFrame:
    """Fresh announcements not processed before; with `limit` the first ones of each group in feed order.

    The cheap tests run in the scan; only what passes them is compared with the archive.
    """
    fresh = posts.filter(
        predicates.within_days(F.col("date_unix"), days, now)
        & predicates.is_event_candidate(F.col("text"), source_type)
        & F.col("url").isNotNull()
    ).withColumn("hash", F.sha2("text", 256))
    if archive is not None:
        fresh = changed_docs(fresh, archive)
    return first_n(fresh, list(group), [F.col("seq")], limit)


def assemble_posts(
    posts: DataFrame, group: list[str], order: str, size: int = 5, **kwargs
) -> DataFrame:
    """Documents of up to `size` consecutive posts of a group, each under its link.

    Blank posts keep their place in the batches but add no text; a batch of blank posts
    gives no document. A document is bounded by `size` posts.
    """
    chunks = chunk_id(posts, group, order, size, **kwargs)
    body = strip(F.coalesce("text", F.lit("")))
    piece = F.when(body != "", F.struct(order, F.format_string(vocab.POST_MARKER + "%s", "url", body).alias("piece")))
    documents = chunks.groupBy(*group, "chunk").agg(
        F.array_sort(F.collect_list(piece)).alias("_pieces"), F.count(F.lit(1)).alias("posts")
    )
    return documents.filter(F.size("_pieces") > 0).select(
        *group, "chunk", "posts",
        F.array_join(F.transform("_pieces", lambda p: p["piece"]), "\n\n").alias("document"),
    )

"""Statistics about sources, runs and coverage: one grouped pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions.dates import is_always


def extracted_by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("found"))


def source_quality(
    found: DataFrame, pairs: DataFrame, city: Column | str, day: Column, clamp: bool = False
) -> DataFrame:
    """Share of a source's events that no better source reported too.

    Losses include stored rows while `found` counts this run only, so the share can come
    out too low; `clamp` keeps it at zero or above.
    """
    losses = pairs.groupBy(F.col("loser").alias("source")).agg(F.sum("n").alias("lost"))
    unique = F.col("found") - F.coalesce("lost", F.lit(0))
    if clamp:
        unique = F.greatest(unique, F.lit(0))
    return (
        found.filter(F.col("found") > 0).join(losses, "source", "left")
        .select(
            "source", (F.lit(city) if isinstance(city, str) else city).alias("city"),
            day.alias("snapshot_date"), F.col("found").alias("events_found"),
            unique.alias("unique_events"),
        )
        .withColumn(
            "unique_events_ratio", F.round(F.col("unique_events") / F.col("events_found"), 3)
        )
    )


def health_agg(log: DataFrame) -> DataFrame:
    """State of each source from its whole run log."""
    clean = F.col("errors") == 0
    return log.groupBy("source", "city").agg(
        F.max("run_at").alias("last_run"),
        F.max(F.when(clean, F.col("run_at"))).alias("last_success"),
        F.round(F.avg("events_found"), 2).alias("avg_events"),
        F.round(F.avg(clean.cast("int")), 3).alias("success_rate"),
        F.sum("errors").alias("total_errors"),
    )


def coverage(events: DataFrame, day: Column, city: str | None = None) -> DataFrame:
    """Number of stored events per city and type."""
    rows = events.filter(F.col("city") == city) if city else events
    return rows.groupBy("city", F.col("type").alias("category")).agg(
        F.count(F.lit(1)).alias("count")
    ).withColumn("snapshot_date", day)


def coverage_trend(snapshots: DataFrame) -> DataFrame:
    """Each snapshot against the one before it."""
    before = F.lag("count").over(Window.partitionBy("city", "category").orderBy("snapshot_date"))
    return snapshots.withColumn("previous", before).withColumn(
        "change", F.col("count") - F.col("previous")
    )


def always_by_source(events: DataFrame) -> DataFrame:
    return events.filter(is_always(F.col("date"))).groupBy("source").agg(
        F.count(F.lit(1)).alias("n")
    )


COUNTERS = ["discovered", "new", "extracted", "failed", "skipped_always"]


def run_summary(parts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counters of a run added up over its sources, with the run's warnings in feed order.

    `parts` has one row per source: `feed_order`, the counters and `warnings`.
    """
    listed = F.array_sort(F.collect_list(F.struct("feed_order", "warnings")))
    total = parts.groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in COUNTERS], listed.alias("_listed")
    )
    warnings = F.flatten(F.transform("_listed", lambda w: w["warnings"]))
    return total.withColumn("warnings", warnings).drop("_listed").withColumn(
        "success", F.col("failed") < F.col("extracted")
    )


def health_error_text(warnings: Column, skipped: Column) -> Column:
    """Error text of a run: its first warning, else the number of undated cards dropped."""
    return F.coalesce(
        F.get(warnings, 0), F.when(skipped > 0, F.format_string(vocab.SKIPPED_ALWAYS_TEXT, skipped))
    )

"""One card per id out of all sources that report it.

Everything is one aggregation by id. Each of its parts combines before the shuffle, so a
card reported by a third of all rows reaches its reducer as one row per map task, and no
list grows with the number of reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions.text import normalize_text, present
from ..functions.types import filter_tags, literal_map
from ..schemas import FILLABLE

PRICE = ["price_min", "price_max", "price_text", "price_note"]


def with_priority(
    rows: DataFrame, priorities: dict[str, int] | DataFrame, by_prefix: bool = False
) -> DataFrame:
    """Rows with the priority `pri` of their source, 0 for a source that is not listed.

    A dictionary becomes a literal map. A frame (`source`, `priority`) is joined, broadcast
    only when counted small. `by_prefix` looks `a:b` up as `a`.
    """
    key = F.split_part("source", F.lit(":"), F.lit(1)) if by_prefix else F.col("source")
    if isinstance(priorities, dict):
        found = literal_map(priorities)[key] if priorities else F.lit(None)
        return rows.withColumn("pri", F.coalesce(found.cast("int"), F.lit(0)))
    listed = priorities.groupBy(F.col("source").alias("_source")).agg(F.max("priority").alias("pri"))
    joined = rows.join(listed, key == F.col("_source"), "left")
    return joined.drop("_source").withColumn("pri", F.coalesce("pri", F.lit(0)))


def incoming_then_stored(incoming: DataFrame, existing: DataFrame | None) -> DataFrame:
    """All reports with their `arrival`: this run's rows in feed order, then the stored ones."""
    rows = incoming.withColumn("_origin", F.lit(0))
    if existing is not None:
        stored = existing.withColumn("_origin", F.lit(1))
        rows = rows.unionByName(stored, allowMissingColumns=True)
    return rows.withColumn("arrival", F.struct("_origin", "seq")).drop("_origin")


def merge_cards(
    incoming: DataFrame,
    existing: DataFrame | None,
    priorities: dict[str, int] | DataFrame,
    allowed_tags: list[str] = vocab.ALLOWED_TAGS,
    by_prefix: bool = False,
) -> DataFrame:
    """The merged cards, with `reports`, the number of rows behind each.

    The source of highest priority wins, the earliest row on ties. Its empty fields are
    filled from the earliest row that has them, its price when it has none from the
    earliest priced row, and its tags are joined by those of the other rows.
    `incoming` has the order column `seq`, unique within a run.
    """
    reports = with_priority(incoming_then_stored(incoming, existing), priorities, by_prefix)
    columns = [c for c in incoming.columns if c != "seq"]
    arrival = F.col("arrival")
    winner_first = F.struct(-F.col("pri"), arrival)
    priced = (F.col("price_min") != 0) | (F.col("price_max") != 0)

    parts = [
        F.min_by(F.struct(*columns), winner_first).alias("win"),
        F.min_by(F.struct(*PRICE), F.when(priced, arrival)).alias("priced"),
        F.count(F.lit(1)).alias("reports"),
    ]
    for name in FILLABLE:
        given = F.when(F.col(name).isNotNull(), arrival)
        parts.append(F.min_by(F.col(name), given).alias(f"first_{name}"))
    for i, tag in enumerate(allowed_tags):
        at = F.array_position("tags", tag)
        parts.append(
            F.min(F.when(at > 0, F.struct(arrival, at.alias("at"), F.lit(tag).alias("tag")))).alias(f"tag_{i}")
        )
    grouped = reports.groupBy("id").agg(*parts)

    seen = F.array_sort(F.array_compact(F.array(*[F.col(f"tag_{i}") for i in range(len(allowed_tags))])))
    all_tags = F.concat(
        F.coalesce("win.tags", F.array().cast("array<string>")), F.transform(seen, lambda t: t["tag"])
    )
    unpriced = (F.col("win.price_min") == 0) & (F.col("win.price_max") == 0)
    take_price = unpriced & F.col("priced").isNotNull()

    merged = {name: F.col(f"win.{name}") for name in columns}
    merged |= {name: F.coalesce(f"win.{name}", f"first_{name}") for name in FILLABLE}
    for name in PRICE[:3]:
        merged[name] = F.when(take_price, F.col(f"priced.{name}")).otherwise(F.col(f"win.{name}"))
    merged["price_note"] = F.when(
        take_price, F.coalesce(present(F.col("priced.price_note")), F.col("win.price_note"))
    ).otherwise(F.col("win.price_note"))
    merged["tags"] = filter_tags(F.array_distinct(all_tags), allowed_tags)
    return grouped.select(*[merged[name].alias(name) for name in columns], "reports")


def merge_pairs(
    incoming: DataFrame, existing: DataFrame | None, priorities: dict[str, int] | DataFrame
) -> DataFrame:
    """How many rows of one source lost to another: (loser, winner, n).

    Rows are counted per (id, source) first, so the window over an id sees one row per source.
    """
    reports = with_priority(incoming_then_stored(incoming, existing), priorities)
    best = F.struct(-F.col("pri"), F.col("arrival"))
    per_source = reports.groupBy("id", "source").agg(
        F.count(F.lit(1)).alias("rows"), F.min(best).alias("best")
    )
    by_id = Window.partitionBy("id")
    winner = F.min(F.struct("best", "source")).over(by_id)["source"]
    return (
        per_source.select("source", "rows", winner.alias("winner"))
        .filter(F.col("source") != F.col("winner"))
        .groupBy(F.col("source").alias("loser"), "winner")
        .agg(F.sum("rows").alias("n"))
    )


def near_misses(incoming: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """How many further ids share a venue and date with another: one row, `near_misses`."""
    keys = ["venue_name", "date", "id"]
    rows = incoming.select(*keys)
    if existing is not None:
        rows = rows.unionByName(existing.select(*keys))
    named = rows.select(
        normalize_text(F.col("venue_name")).alias("venue"), "date", "id"
    ).filter(F.col("venue") != "")
    per_place = named.groupBy("venue", "date").agg(F.count_distinct("id").alias("ids"))
    return per_place.agg(F.coalesce(F.sum(F.col("ids") - 1), F.lit(0)).alias("near_misses"))

"""Mixing sources to target weights as a time-varying curriculum.

A source's target is its weighted share of the words the mix takes, at most `max_repeats` times its
own words; what a full source can't take is shared again by weight. Training time runs from 0 to 1 and
each source has a weight schedule over it, linear between equally spaced knots. The integral of the
schedule, scaled to the target, is the source's cumulative demand; a document that stands at a word
count in its source's seeded order is due at the time where the demand reaches that count. Documents
are range-sorted by that time.

Whole documents are taken: a reading of a document counts if its middle word lies within the target,
so a source misses its target by at most half a document.

Nulls and ties: a null text has no words and is never taken; a null source is a source of its own and
comes last. Rows that repeat each other in id and size are interchangeable. Equal times are ordered by
source and id. A table without words takes nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BLOCK_ROWS, WORD, cut, group_key, in_blocks, running, seeded_hash

WEIGHTS = (3, 1, 2)
#: Schedules at equally spaced knots, in the order of the weights: early, even and late sources.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE_PERCENT = 150
MAX_REPEATS = 2
SEED = 29


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets for rows (source_key, source_size), one row per source.

    In order of room per weight, full sources come first: the first that its share doesn't fill ends
    them. One window over as many rows as there are sources.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy("source_key")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    df = sizes.withColumn("_at", F.row_number().over(ordered) - 1).withColumn("weight", weight)
    df = df.withColumn("_cap", F.col("source_size") * max_repeats)
    by_room = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("weight"), "source_key")
    every = Window.partitionBy(F.lit(0))
    df = (
        df.withColumn("_caps", F.coalesce(F.sum("_cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(every) * share_percent)
        .withColumn("_room", F.row_number().over(by_room))
    )
    fills = (F.col("_all") - F.col("_caps") * 100) * F.col("weight") > F.col("_cap") * F.col("_rest") * 100
    open_at = F.min(F.when(~fills, F.struct("_room", "_caps", "_rest"))).over(every)
    df = df.withColumn("_open", open_at)
    shared = F.col("weight") * (F.col("_all") / 100.0 - F.col("_open._caps")) / F.col("_open._rest")
    full = F.col("_open").isNull() | (F.col("_room") < F.col("_open._room"))
    return df.select(
        "source_key", "source_size", "weight", F.col("_at").alias("source_at"),
        F.when(full, F.col("_cap").cast("double")).otherwise(shared).alias("target"),
    )


def due_time(share: Column, knots: tuple[float, ...]) -> Column:
    """The time at which the integral of a schedule, linear between knots, reaches a share of its whole."""
    if len(knots) < 2 or min(knots) < 0 or not any(knots):
        raise ValueError("a schedule needs two knots or more, none below zero and one above")
    step = 1.0 / (len(knots) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:])]
    reached = share * sum(areas)
    out, below = F.lit(1.0), sum(areas)
    for k in range(len(areas) - 1, -1, -1):
        below -= areas[k]
        start, slope = knots[k], (knots[k + 1] - knots[k]) / step
        rest = F.greatest(reached - below, F.lit(0.0))
        if areas[k] == 0:
            continue
        if slope == 0:
            within = rest / start
        else:
            within = (F.sqrt(F.greatest(F.lit(start * start) + rest * (2 * slope), F.lit(0.0))) - start) / slope
        time = F.least(F.lit(k * step) + within, F.lit(1.0))
        out = time if k == len(areas) - 1 else F.when(reached <= below + areas[k], time).otherwise(out)
    return out


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
             share_percent: int = SHARE_PERCENT, max_repeats: int = MAX_REPEATS, seed: int = SEED,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of `docs`: id, sizes, `target`, `taken` and `times`, one due time for each reading taken."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select(
        F.col(id_col).alias("_id"), size.alias("size"), group_key(source_col).alias("source_key"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        seeded_hash(seed, id_col).alias("_hash"), F.monotonically_increasing_id().alias("_row"),
    ))
    targets = source_targets(
        rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, share_percent, max_repeats)
    order = ["_hash", "_id", "size", "text_hash", "_row"]
    blocks = in_blocks(rows, ["source_key", *order], rows.count(), block_rows)
    df = running(blocks, ["source_key"], F.col("_block"), [F.col(c) for c in order], F.col("size"))
    df = df.join(targets, ["source_key"])
    reading = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(max_repeats - 1)),
            lambda k: k.cast("long") * F.col("source_size") + F.col("before") + F.col("size") / 2),
        lambda middle: (F.col("size") > 0) & (middle <= F.col("target")))
    kind = F.col("source_at") % len(schedules)

    def due(middle: Column) -> Column:
        share = middle / F.col("target")
        out = due_time(share, schedules[-1])
        for k in range(len(schedules) - 1):
            out = F.when(kind == k, due_time(share, schedules[k])).otherwise(out)
        return out

    df = df.withColumn("_middles", reading)
    return df.select(
        F.col("_id").alias(id_col), "text_hash", "source_key", "size", "source_size", "target",
        (F.col("size") * F.size("_middles")).alias("taken"), F.transform("_middles", due).alias("times"),
    )


def in_training_order(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The readings of a plan, one row each, range-sorted by due time."""
    readings = plan.select("*", F.explode("times").alias("time")).drop("times")
    return readings.orderBy("time", "source_key", id_col)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixed documents in training order, with their own columns; a document read twice stands twice."""
    plan = plan_mix(docs, id_col, text_col, **options)
    # Rows that repeat an id and its text are one document, which is read as often as they are.
    readings = plan.filter("taken > 0").groupBy(F.col(id_col).alias("_id"), "text_hash").agg(
        F.flatten(F.collect_list("times")).alias("_times"))
    marked = docs.select(
        F.struct("*").alias("_doc"), F.col(id_col).alias("_doc_id"), F.xxhash64(F.col(text_col)).alias("_hash"))
    same = F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("text_hash"))
    due = marked.join(readings, same).dropDuplicates(["_doc_id", "_hash"]).withColumn("_time", F.explode("_times"))
    return due.orderBy("_time", "_doc_id").select("_doc.*")


def training_places(mixed: DataFrame) -> DataFrame:
    """The rows of a written mix with their place in training order: `train_part`, `train_row` within it.

    Parquet promises no order between files, so the place is read from the files themselves: a range-sorted
    table is written one part for each range, in order. Equal places don't occur.
    """
    name = F.col("_metadata.file_name")
    # A task that writes several files numbers these after a `c`.
    part = F.regexp_extract(name, r"^part-([0-9]+)", 1).cast("long") * 1_000_000
    return mixed.select(
        "*", (part + F.coalesce(F.regexp_extract(name, r"-c([0-9]+)", 1).try_cast("long"), F.lit(0))).alias("train_part"),
        F.col("_metadata.row_index").alias("train_row"))

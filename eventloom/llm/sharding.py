"""Sharding by proportional stratified interleaving.

Within each source, rows stand in a seeded random order; row r of n gets the fraction (r - 1/2) / n.
All rows are then sorted by fraction and cut into equal pieces, so every shard holds each source in
the proportion of the whole, and row counts are at most one apart (law `rows`).

Ranks are running numbers over blocks of bounded size, cut by the whole order: neither a source with a
third of all rows, nor thousands of sources with one row (all at the fraction 1/2), nor rows with one id
or none pass through one task.

Nulls and ties: a null source is a source of its own; a null text has no bytes. Equal fractions
of several sources follow each other in source order; rows that repeat each other in id and text are
interchangeable. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import BLOCK_ROWS, cut, group_key, in_blocks, running, seeded_hash

SEED = 17


def interleave(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of `docs`: id, `size`, `text_crc32`, `source_key`, `fraction`, `position`, `shard`, `slot`."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), group_key(source_col).alias("source_key"),
        seeded_hash(seed, id_col).alias("_hash"), F.monotonically_increasing_id().alias("_row"),
    ))
    total = rows.count()
    order = ["_hash", "_id", "text_crc32", "size", "_row"]
    blocks = in_blocks(rows, ["source_key", *order], total, block_rows)
    ranked = running(blocks, ["source_key"], F.col("_block"), [F.col(c) for c in order], F.lit(1).cast("long"))
    ranked = ranked.select(
        "_id", "size", "text_crc32", "source_key",
        ((F.col("before") * 2 + 1) / (F.col("whole") * 2)).alias("fraction"),
    )
    blocks = in_blocks(ranked, ["fraction", "source_key"], total, block_rows)
    placed = running(
        blocks, [], F.col("_block"), [F.col("fraction"), F.col("source_key")],
        F.lit(1).cast("long")).withColumnRenamed("before", "position")
    shard = F.expr(f"cast(position * {shards} div {max(total, 1)} as int)")
    start = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        F.col("_id").alias(id_col), "size", "text_crc32", "source_key", "fraction", "position", "shard",
        (F.col("position") - start).alias("slot"),
    )

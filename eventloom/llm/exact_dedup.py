"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition is a run: one record for each digest it holds. In each round up to `fan_in`
neighbouring runs merge into one, digest by digest, and a record keeps the best identifier of the
rows below it, so a group of copies reaches the next round as at most one record for each run. When
one run is left it is the result, spread over all tasks by digest. The records that keep the winner
are rows of struct type, which Spark aggregates by sorting each run and merging neighbours.

A merge is verified at every level: records merge only if SHA-256, a second 64-bit hash and the
length in bytes all agree.

Nulls and ties: a null text counts as empty. Of equal texts the row with the largest (or smallest)
id stays; a null id stays only where the group has no other. Rows that repeat an id and its text
are one group, of which one row stays. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut

FAN_IN = 8
_KEY = ["text_sha256", "_bytes", "_proof"]


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                     fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of `docs`: id, `keep_id`, `group_size`, `kept`, `text_sha256`."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(
        F.col(id_col).alias("_id"), F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).alias("_bytes"),
        F.xxhash64(text).alias("_proof"), F.spark_partition_id().alias("_run"),
        F.monotonically_increasing_id().alias("_row"),
    ))
    if keep == "largest":
        rank, best = F.col("_id").isNotNull(), F.max
    else:
        rank, best = F.col("_id").isNull(), F.min
    runs = leaves = rows.groupBy("_run", *_KEY).agg(
        best(F.struct(rank.alias("rank"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_best"),
        F.count(F.lit(1)).alias("_n"),
    )
    left = (rows.agg(F.max("_run")).first()[0] or 0) + 1
    while True:
        runs = runs.groupBy(F.floor(F.col("_run") / fan_in).cast("int").alias("_run"), *_KEY).agg(
            best("_best").alias("_best"), F.sum("_n").alias("_n"))
        left = -(-left // fan_in)
        if left == 1:
            break
    # Down again: first to the leaves, where a digest has a record for each run at most, then to the rows.
    winners = leaves.select("_run", *_KEY).join(runs.drop("_run"), _KEY)
    return rows.join(winners, ["_run", *_KEY]).select(
        F.col("_id").alias(id_col), F.col("_best.id").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_best.row")).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    kept = duplicate_groups(docs, id_col, text_col, keep).filter("kept").select(
        F.col(id_col).alias("_keep_id"), F.col("text_sha256").alias("_keep_digest"))
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    marked = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), digest.alias("_digest"))
    same = F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_digest") == F.col("_keep_digest"))
    return marked.join(kept, same, "left_semi").dropDuplicates(["_id", "_digest"]).select("_doc.*")

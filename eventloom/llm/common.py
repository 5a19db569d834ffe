"""Reading, checkpoints and distributed running numbers shared by the operators."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: One word is a run of characters other than space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Rows that one window partition of a running number holds on average.
BLOCK_ROWS = 20_000
#: The most blocks that a range is cut into; beyond it blocks grow, and sort on disk.
MOST_BLOCKS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether Spark removes what a query shuffled as soon as the query ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames made and run inside leave no shuffle files behind, where they else stay until the driver collects garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """`df` checkpointed in the shared folder the session names, so that no later step recomputes it.

    What was shuffled for it is removed at once: only the checkpoint is read again, and the shuffles of a long
    job would add up. Where no folder is named (tests, one machine) a local master gets a temporary folder; a
    cluster without a shared folder is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="eventloom-checkpoints-")
        context.setCheckpointDir(folder)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()


def group_key(column: str) -> Column:
    """A key that is never null and sorts as the column does by code point, null last."""
    text = F.col(column).cast("string")
    return F.when(text.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), text))


def seeded_hash(seed: int, *columns: str) -> Column:
    """32 hex digits that put rows in a random but repeatable order."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def in_blocks(df: DataFrame, order: list[str], rows: int, block_rows: int) -> DataFrame:
    """`df`, of `rows` rows, checkpointed with `_block`: blocks of about `block_rows` that follow each other in an order.

    Where blocks end comes from a sample of the whole order, so no value of its first columns makes a large
    block, however many rows have it. Rows that are equal in the whole order share one.
    """
    blocks = min(max(1, -(-rows // block_rows)), MOST_BLOCKS)
    return cut(df.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()))


def running(df: DataFrame, groups: list[str], block: Column, order: list[Column], value: Column) -> DataFrame:
    """Adds `before`, the sum of `value` over earlier rows of the group, and `whole`, the group's sum.

    `block` must rise with `order` within a group. Each block is numbered by itself and a sum per
    block, over as many rows as there are blocks, gives its offset: no task sorts a whole group.
    """
    df = df.withColumn("_block", block).withColumn("_value", value)
    sums = df.groupBy(*groups, "_block").agg(F.sum("_value").alias("_sum"))
    of_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = of_group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *groups, "_block",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"), F.sum("_sum").over(of_group).alias("whole"),
    )
    inside = Window.partitionBy(*groups, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    out = numbered.join(sums, [*groups, "_block"])
    return out.withColumn("before", F.col("_offset") + F.col("_inside")).drop("_block", "_value", "_offset", "_inside")


def once_per_worker(key: str, make: Callable):
    """What `make` gives, made once in a Python worker and kept for its later tasks.

    Functions travel to workers by value, so their modules' variables don't outlive a task. A worker
    keeps one such value, the last, so that the stages of a long job don't add up.
    """
    state = sys.modules.setdefault("eventloom_worker_state", types.ModuleType("eventloom_worker_state"))
    if getattr(state, "key", None) != key:
        state.key = state.value = None
        state.value = make()
        state.key = key
    return state.value


def by_bytes(batch: pa.RecordBatch, *texts: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about `most` bytes in some text columns, so that memory doesn't grow with batches."""
    sizes = sum(pc.binary_length(batch.column(i)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in texts)
    ends = np.concatenate([[0], np.cumsum(sizes + 64)])
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last
    if not batch.num_rows:
        yield batch

"""Incremental jobs as Structured Streaming queries over landing folders.

Batches may be repeated after a failure, so every sink gives the same tables when a batch
comes twice: keyed upserts, or folders named by batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import predicates
from ..operators import cards as card_ops, merge
from ..schemas import HEALTH, RAW, ddl
from ..tables import KeyedTable, RawArchive, finished, latest_documents, upsert_events


def landed_stream(spark: SparkSession, path: str, layout: str, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(layout).format("parquet")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def new_posts(
    posts: DataFrame, now: Column | None = None, time: str = "posted_at", days: int = 14
) -> DataFrame:
    """Posts whose text was not seen under their url within the freshness window.

    Posts older than `days` before `now` are cut exactly; without `now` none is cut. State is
    bounded by the watermark: a post edited back to an earlier text within the window is not
    repeated.
    """
    if now is not None:
        posts = posts.filter(predicates.within_days(F.col(time).cast("double"), days, now))
    hashed = posts.withColumn("hash", F.sha2("text", 256))
    return hashed.withWatermark(time, f"{days} days").dropDuplicatesWithinWatermark(["url", "hash"])


def write_posts(posts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        posts.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_merge(
    rows: DataFrame, table: KeyedTable, priorities: dict[str, int] | DataFrame, checkpoint: str
) -> StreamingQuery:
    """Merge each batch of event rows (with `seq`) into the event table.

    Merging a batch twice gives the same cards: its rows meet their own result again. A batch opens the
    buckets its ids fall in and writes its own cards.
    """

    def merge_batch(batch: DataFrame, _: int) -> None:
        peers = table.lookup(batch)
        upsert_events(table, merge.merge_cards(batch, peers, priorities))
        table.expire(keep=2)

    return rows.writeStream.foreachBatch(merge_batch).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


#: What is kept of a source: sums that take further runs, and the last batch that they hold.
HEALTH_SUMS = {
    "key": "string", "source": "string", "city": "string", "last_run": "timestamp", "last_success": "timestamp",
    "counted": "bigint", "events": "bigint", "judged": "bigint", "clean": "bigint", "total_errors": "bigint",
    "batch": "bigint",
}


def health_sums(runs: DataFrame) -> DataFrame:
    """The sums of some runs by source and city."""
    clean = F.col("errors") == 0
    return runs.groupBy("source", "city").agg(
        F.max("run_at").alias("last_run"), F.max(F.when(clean, F.col("run_at"))).alias("last_success"),
        F.count("events_found").alias("counted"), F.sum("events_found").alias("events"),
        F.count("errors").alias("judged"), F.count_if(clean).alias("clean"), F.sum("errors").alias("total_errors"),
    ).withColumn("key", source_key())


def source_key() -> Column:
    """A key of source and city, which may hold any character and be null."""
    return F.to_json(F.array("source", "city"))


def health_state(sums: DataFrame) -> DataFrame:
    """State of each source from its sums, as `reports.health_agg` gives it from the whole log."""
    return sums.select(
        "source", "city", "last_run", "last_success",
        F.round(F.col("events") / F.nullif("counted", F.lit(0)), 2).alias("avg_events"),
        F.round(F.col("clean") / F.nullif("judged", F.lit(0)), 3).alias("success_rate"), "total_errors",
    )


def add_runs(state: KeyedTable, runs: DataFrame, batch_id: int) -> None:
    """Add a batch of runs to the sums of its sources.

    A source that holds the batch already stays as it is. All sources of a batch are written as one
    version, so a batch that comes again finds either none of them added or all.
    """
    given = health_sums(runs).withColumn("batch", F.lit(batch_id).cast("bigint"))
    stored = state.lookup(given).select("key", F.struct(*[c for c in HEALTH_SUMS if c != "key"]).alias("_old"))
    old = lambda name: F.col(f"_old.{name}")
    plus = lambda name: F.when(
        F.col(name).isNull() & old(name).isNull(), F.lit(None)).otherwise(F.coalesce(name, F.lit(0)) + F.coalesce(old(name), F.lit(0)))
    joined = given.join(stored, "key", "left").filter(old("batch").isNull() | (old("batch") < batch_id))
    added = joined.select(
        "key", "source", "city",
        *[F.greatest(name, old(name)).alias(name) for name in ("last_run", "last_success")],
        *[plus(name).alias(name) for name in ("counted", "events", "judged", "clean", "total_errors")], "batch",
    )
    state.upsert(added)


def stream_health(runs: DataFrame, log_path: str, state: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Append run rows to the log and add them to the sums of their sources.

    `state` has the layout HEALTH_SUMS, keyed by `key`; `health_state` reads it. A batch meets the sums of
    its own sources only, never the log.
    """

    def record(batch: DataFrame, batch_id: int) -> None:
        folder = f"{log_path}/batch={batch_id}"
        batch.select(*HEALTH).write.mode("overwrite").parquet(folder)
        add_runs(state, batch.sparkSession.read.schema(ddl(HEALTH)).parquet(folder), batch_id)
        state.expire(keep=2)

    return runs.writeStream.foreachBatch(record).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


def stream_changed_docs(
    docs: DataFrame, archive: RawArchive, out_path: str, checkpoint: str
) -> StreamingQuery:
    """Pass on documents whose content differs from the last stored one.

    A document that returns to an earlier content passes again: the comparison is with the
    last stored hash, not with all hashes seen. Nothing is archived here: a hash is stored by the
    job that extracts, once it has succeeded.
    """

    def compare(batch: DataFrame, batch_id: int) -> None:
        folder = f"{out_path}/batch={batch_id}"
        if finished(batch.sparkSession, folder):
            return  # a batch that comes again stays as it was passed on
        latest = latest_documents(batch.withColumn("hash", F.sha2("content", 256)))
        changed = card_ops.changed_docs(latest, archive.hashes(latest))
        changed.select(*RAW).write.mode("overwrite").parquet(folder)

    return docs.writeStream.foreachBatch(compare).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()

"""The daily run of a city, and the upkeep of its venues."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import cards as card_ops, maintenance, merge, reports
from ..schemas import CANDIDATE, EVENT, VENUE
from ..keyed import Conflict
from ..runs import APPLIED, REFUSED, RunLog
from ..session import staged
from ..sources.structured import enabled_sources
from ..tables import CityTables, KeyedTable, RawArchive, append_health, snapshot_upsert, upsert_venues
from .feeds import FeedRun


@dataclass
class Tables:
    """The tables of a deployment under one folder of a shared file system."""

    spark: SparkSession
    root: str
    events: CityTables = field(init=False)
    venues: CityTables = field(init=False)
    candidates: KeyedTable = field(init=False)
    raw: RawArchive = field(init=False)

    def __post_init__(self):
        self.events = CityTables(self.spark, self.path("events"), EVENT)
        self.venues = CityTables(self.spark, self.path("venues"), VENUE)
        self.candidates = KeyedTable(self.spark, self.path("candidates"), CANDIDATE, "domain")
        self.raw = RawArchive(self.spark, self.path("raw"))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def runs(self, city: str) -> RunLog:
        return RunLog(self.spark, self.path(f"runs/city={city}"))


@dataclass
class Feed:
    """A configured source: its name, and the function that reads what landed for it."""

    name: str
    read: Callable[[], FeedRun]
    full_snapshot: bool = False


def configured_feeds(
    sources: DataFrame, city: str, readers: dict[str, Callable[[str], FeedRun]], only: str | None = None,
    mode_override: str | None = None,
) -> tuple[list[Feed], dict[str, int]]:
    """The feeds of a city in the order of the source list, and the priorities of its sources.

    `readers` gives for each extraction mode the function from a source's name to its feed.
    """
    chosen = enabled_sources(sources.filter(F.col("city") == city), only, mode_override)
    rows = chosen.orderBy("feed_order").collect()  # a configuration, as long as the file it is read from
    unknown = sorted({r.extraction_mode for r in rows} - set(readers))
    if unknown:
        raise ValueError(f"no reader for extraction modes {unknown}")
    feeds = [Feed(r.name, partial(readers[r.extraction_mode], r.name), r.full_snapshot) for r in rows]
    return feeds, {r.name: r.priority for r in rows}


@dataclass
class CityRun:
    """What a run did: frames over what it staged, and the counts of its writes."""

    parts: DataFrame
    summary: DataFrame
    merged: DataFrame
    pairs: DataFrame
    near_misses: DataFrame
    inserted: int
    updated: int
    spark: SparkSession
    staging: str

    def close(self) -> None:
        """Remove what the run staged; its frames can't be read after."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.staging)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


FEEDS_AT_A_TIME = 8


def stage(feeds: list[Feed], city: str, path: str) -> list[tuple]:
    """Write every feed's settled cards, counters and documents to archive.

    A feed that fails leaves the others alone. Feeds are small next to a cluster, so several are
    written at a time, each to folders of its own. Returns (order, feed, city, error, whether
    there are documents) with the error text of a failed feed.
    """

    def attempt(feed: Feed, work) -> str | None:
        try:
            work()
        except Exception as problem:  # one source must not take the run down
            return f"{feed.name}: {problem}"

    archives = set()

    def write(order: int, feed: Feed) -> None:
        run = feed.read()
        numbered = run.settled.withColumn("feed_order", F.lit(order))
        settled = staged(numbered, f"{path}/settled/feed={order}")
        tally = run.tally(settled).withColumn("feed_order", F.lit(order))
        tally.write.mode("overwrite").parquet(f"{path}/tally/feed={order}")
        if run.archive is not None:
            run.archive.write.mode("overwrite").parquet(f"{path}/archive/feed={order}")
            archives.add(order)

    with ThreadPoolExecutor(FEEDS_AT_A_TIME) as pool:
        errors = list(
            pool.map(lambda item: attempt(item[1], lambda: write(*item)), enumerate(feeds))
        )
    return [
        (order, feed.name, city, errors[order], order in archives and errors[order] is None)
        for order, feed in enumerate(feeds)
    ]


def side_by_side(*steps: Callable) -> list:
    """What steps that don't need each other give: the last tasks of one leave no cores idle."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [done.result() for done in [pool.submit(step) for step in steps]]


_TALLY = "source string, city string, counter string, n bigint, feed_order int"
_OUTCOMES = "feed_order int, source string, city string, warning string"


def run_city(
    tables: Tables,
    city: str,
    feeds: list[Feed],
    priorities: dict[str, int] | DataFrame,
    as_of: datetime.date,
    now: datetime.datetime,
    run_id: str,
    duration: float | None = None,
    dry_run: bool = False,
) -> CityRun:
    """Read all feeds, merge with what is stored, write, purge and record.

    Each feed is staged once, in a folder of the city and run, so the later steps read files. Nothing
    is written to a table before all is staged and the run is committed as one record; a run that
    fails before meets the same pages again, and one that stops after is completed by the next run of the
    city, or by `settle`. If another run of the city was committed meanwhile, or the event table changed,
    it raises Conflict and leaves all tables alone. A repeated run replaces its health rows. `CityRun.close`
    removes the staging folder once the frames of the result are read. A dry run stages and merges only.
    """
    spark = tables.spark
    events = tables.events.of(city)
    if not dry_run:
        settle(tables, city)
    runs = tables.runs(city)
    last, base = runs.last(), events.version()
    day, moment = F.lit(as_of), F.lit(now).cast("timestamp")
    folder = tables.path(f"staging/city={city}/run={run_id}/try={uuid.uuid4().hex}")
    outcomes = stage(feeds, city, folder)
    good = [o[0] for o in outcomes if o[3] is None]
    if not good:
        raise RuntimeError("every feed failed: " + "; ".join(o[3] for o in outcomes))

    settled = spark.read.parquet(*[f"{folder}/settled/feed={i}" for i in good])
    tally = spark.read.schema(_TALLY).parquet(*[f"{folder}/tally/feed={i}" for i in good])

    # Of two feeds that report a venue the later one counts, and of one feed the first report.
    found = settled.filter(F.col("outcome") == "venue").withColumn("seq", F.struct(-F.col("feed_order"), "seq"))
    venues = card_ops.to_venues(found, F.lit("twogis"), moment)

    extracted = settled.filter(F.col("outcome") == "extracted").withColumn(
        "seq", F.struct("feed_order", "seq")
    )
    rows = staged(card_ops.to_event_rows(extracted, moment), f"{folder}/rows")
    stored = events.read(base)
    full = [f.name for f in feeds if f.full_snapshot]
    current = rows.filter(F.col("source").isin(full)).select("source", "city", "id")
    kept, dropped = maintenance.sync_snapshot(stored, current, day)

    peers = card_ops.stored_peers(rows, kept)
    peers = staged(peers.filter(F.size(card_ops.failed_rules(peers)) == 0), f"{folder}/peers")
    merged, pairs = side_by_side(
        lambda: staged(merge.merge_cards(rows, peers, priorities), f"{folder}/merged"),
        lambda: staged(merge.merge_pairs(rows, peers, priorities), f"{folder}/pairs"),
    )
    counts = [lambda: merged.count(), lambda: merged.join(stored.select("id"), "id", "left_semi").count()]
    parts = run_parts(spark, tally, [o[:4] for o in outcomes])

    def result(total: int, known: int) -> CityRun:
        return CityRun(
            parts, reports.run_summary(parts, ["city"]), merged, pairs,
            merge.near_misses(rows, peers), total - known, known, spark, folder,
        )

    if dry_run:
        return result(*side_by_side(*counts))
    # One new version of the table: the merged cards, without what the snapshot sync drops and what is past.
    current_cards, past_cards = maintenance.purge_past(merged, day, city)
    gone = dropped.select("id").unionAll(maintenance.purge_past(kept, day, city)[1].select("id"))
    gone = gone.join(merged.select("id"), "id", "left_anti").unionAll(past_cards.select("id"))
    quality = reports.source_quality(reports.extracted_by_source(rows), pairs, city, day)
    frames = {
        "current": current_cards, "gone": gone.select("id"), "venues": venues, "quality_rows": quality,
        "health": health_rows(parts, moment, duration),
    }
    writes = [partial(staged, frame, f"{folder}/{name}") for name, frame in frames.items()]
    total, known, *written = side_by_side(*counts, *writes)
    schemas = {name: frame.schema.json() for name, frame in zip(frames, written)}
    number = runs.commit(last, {
        "run_id": run_id, "folder": folder, "base": base, "as_of": as_of.isoformat(), "now": now.isoformat(),
        "archives": [o[0] for o in outcomes if o[4]], "schemas": schemas,
    })
    apply_run(tables, city, number, again=False)
    return result(total, known)


def settle(tables: Tables, city: str) -> int | None:
    """Carry out what a stopped run had committed; returns its number, None if nothing was open.

    Readers that need the tables of a city to be of one run call it first.
    """
    number = tables.runs(city).pending()
    if number is not None:
        try:
            apply_run(tables, city, number, again=True)
        except Conflict:
            pass  # the event table had changed: the run is closed as refused, with nothing written
    return number


def apply_run(tables: Tables, city: str, number: int, again: bool) -> None:
    """Write a committed run to the tables. Every step may be repeated.

    The event table goes first: only there can another writer have been in the way, and then nothing else
    is written.
    """
    spark, events, runs = tables.spark, tables.events.of(city), tables.runs(city)
    record = runs.record(number)
    folder, as_of = record["folder"], datetime.date.fromisoformat(record["as_of"])
    moment = F.lit(datetime.datetime.fromisoformat(record["now"])).cast("timestamp")
    note = f"run {number}"

    def kept(name: str) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(json.loads(record["schemas"][name]))).parquet(f"{folder}/{name}")

    if note not in events.notes():
        try:
            events.merge(kept("current"), kept("gone"), record["base"], note)
        except Conflict:
            if note not in events.notes():
                runs.close(number, REFUSED)
                raise
    upsert_venues(tables.venues.of(city), kept("venues"))
    for order in record["archives"]:
        tables.raw.append(spark.read.parquet(f"{folder}/archive/feed={order}"), moment, city, again)
    events.expire(keep=3)
    tables.raw.purge(as_of)
    covered = reports.coverage(events.read(), F.lit(as_of), city)
    snapshot_upsert(spark, tables.path("coverage"), covered, ["category"], kept_at=f"{folder}/coverage_days")
    snapshot_upsert(spark, tables.path("quality"), kept("quality_rows"), ["source"], kept_at=f"{folder}/quality_days")
    append_health(tables.path("health"), kept("health"), city, record["run_id"])
    runs.close(number, APPLIED)


def run_parts(spark: SparkSession, tally: DataFrame, outcomes: list[tuple]) -> DataFrame:
    """One row per source: its counters and warnings. A failed feed has one failure and its warning."""
    sums = [
        F.coalesce(F.sum(F.when(F.col("counter") == name, F.col("n"))), F.lit(0)).alias(name)
        for name in reports.COUNTERS
    ]
    counted = tally.groupBy("feed_order", "source", "city").agg(*sums)
    listed = spark.createDataFrame(outcomes, _OUTCOMES)
    failed = listed.filter(F.col("warning").isNotNull()).select(
        "feed_order", "source", "city",
        *[F.lit(1 if name == "failed" else 0).cast("bigint").alias(name) for name in reports.COUNTERS],
        F.array("warning").alias("warnings"),
    )
    silent = listed.filter(F.col("warning").isNull()).join(
        counted.select("feed_order").distinct(), "feed_order", "left_anti"
    ).select(
        "feed_order", "source", "city",
        *[F.lit(0).cast("bigint").alias(name) for name in reports.COUNTERS],
    )
    none = F.array().cast("array<string>")
    return counted.withColumn("warnings", none).unionByName(failed).unionByName(
        silent.withColumn("warnings", none)
    )


def health_rows(parts: DataFrame, run_at, duration: float | None = None) -> DataFrame:
    return parts.select(
        "source", "city", run_at.alias("run_at"), F.col("extracted").alias("events_found"),
        F.col("failed").alias("errors"), F.lit(duration).cast("decimal(12,3)").alias("duration_sec"),
        reports.health_error_text(F.col("warnings"), F.col("skipped_always")).alias("last_error"),
    )


def upsert_by_city(tables: Tables, venues: DataFrame, cities: list[str]) -> dict:
    """Venue rows into the tables of the configured cities."""
    done = {}
    for city in cities:
        counts = upsert_venues(tables.venues.of(city), venues.filter(F.col("city") == city))
        done[city] = {"inserted": counts.inserted, "updated": counts.updated}
    return done


def refresh_venues(
    tables: Tables, catalog: DataFrame, rendered: DataFrame, now, cities: list[str]
) -> dict:
    """Venues from the catalog, or from rendered pages for cities where the catalog gave none."""
    moment = F.lit(now).cast("timestamp")
    folder = tables.path(f"staging/venues/run={now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex}")
    catalog = staged(catalog, f"{folder}/catalog")
    filled = catalog.select("city").distinct()
    fallback = rendered.join(filled, "city", "left_anti")
    venues = card_ops.to_venues(catalog, F.lit("twogis"), moment).unionByName(
        card_ops.to_venues(fallback, F.lit("playwright"), moment)
    )
    return upsert_by_city(tables, staged(venues, f"{folder}/venues"), cities)


def sync_venues(tables: Tables, now, cities: list[str], force: bool = False) -> dict:
    """Venues out of undated events; without `force` they are only counted."""
    stored = tables.events.read().filter(F.col("city").isin(cities))
    venues = maintenance.venues_from_events(stored, F.lit(now).cast("timestamp"))
    if not force:
        return {"would_import": venues.count()}
    return upsert_by_city(tables, venues, cities)

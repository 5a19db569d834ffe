"""Tables on a shared file system.

Keyed tables are merged on read (`keyed.py`). The raw archive is larger than all else, so it is only
ever appended to, by fetch day, and old days are dropped whole; a keyed table beside it holds the last
hash of every url, so that a check opens the buckets of its urls and never the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .keyed import CityTables, KeyedTable, WriteCounts, children
from .operators.cards import failed_rules, manual_guard
from .operators.ranking import drop_repeats
from .schemas import EVENT, HEALTH, RAW, VENUE, ddl, shape
from .session import cut_lineage


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to a folder was completed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def upsert_events(table: KeyedTable, rows: DataFrame) -> WriteCounts:
    return table.upsert(shape(rows, EVENT))


def upsert_venues(table: KeyedTable, venues: DataFrame, insert_only: bool = False) -> WriteCounts:
    """Venue rows except those entered by hand, the first row of each id."""
    if "seq" in venues.columns:
        venues = drop_repeats(venues, ["id"], "seq")
    return table.upsert(shape(manual_guard(venues, table.lookup(venues)), VENUE), insert_only)


def fetch_by_ids(table: KeyedTable, ids: DataFrame) -> DataFrame:
    """Stored rows under the given ids that still pass as events."""
    rows = table.lookup(ids)
    return rows.filter(F.size(failed_rules(rows)) == 0)


#: What is known of a url without its documents: when it was last stored, and the hash of that.
LAST_HASH = {"url": "string", "fetched_at": "timestamp", "hash": "string"}


class RawArchive:
    """Raw documents, appended by fetch day; the newest row of a url is the stored one.

    Every writer (a city's run, a stream) has a folder of its own, since two file writes
    into one folder at the same time remove each other's temporary files, and an index of its own
    of last hashes. Readers see all. An index follows its log: a writer that stops between the two
    leaves urls that count as changed once more, and `rebuild_index` makes up for it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self, writer: str | None = None) -> DataFrame:
        if not self._days():
            return self.spark.createDataFrame([], ddl(RAW))
        layout = f"{ddl(RAW)}, writer string, fetch_day date"
        rows = self.spark.read.schema(layout).parquet(self.path)
        if writer is not None:
            rows = rows.filter(F.col("writer") == writer)
        return rows.drop("writer", "fetch_day")

    def _writers(self) -> list[str]:
        _, statuses = children(self.spark, self.path)
        names = [s.getPath().getName() for s in statuses]
        return sorted(name[7:] for name in names if name.startswith("writer="))

    def _days(self) -> list:
        """Folders of all days of all writers."""
        found = []
        for writer in self._writers():
            _, days = children(self.spark, f"{self.path}/writer={writer}")
            found += [d.getPath() for d in days if d.getPath().getName().startswith("fetch_day=")]
        return found

    def index(self, writer: str) -> KeyedTable:
        """The last hashes of what a writer stored. It lies beside the log, where readers of the log don't look."""
        return KeyedTable(self.spark, f"{self.path}/_index/{writer}", LAST_HASH, "url")

    def append(self, docs: DataFrame, fetched_at: Column, writer: str = "shared", again: bool = False) -> None:
        """Add documents to a writer's log. `again` leaves out rows that a stopped write of the same has left there."""
        rows = archive_rows(docs, fetched_at).withColumn("fetch_day", F.to_date("fetched_at"))
        if again:
            same = ["url", "fetched_at", "hash"]
            left = self._log(writer).select(*same)
            new = rows.join(left, [rows[c].eqNullSafe(left[c]) for c in same], "left_anti").select(*rows.columns)
            new.write.mode("append").partitionBy("fetch_day").parquet(f"{self.path}/writer={writer}")
            return self._note(rows, writer)
        rows.write.mode("append").partitionBy("fetch_day").parquet(f"{self.path}/writer={writer}")
        self._note(rows, writer)

    def _note(self, rows: DataFrame, writer: str) -> None:
        """Put the newest of some rows into a writer's index where nothing newer is known."""
        index = self.index(writer)
        given = rows.select(*LAST_HASH)
        known = index.lookup(given)
        newest = given.unionByName(known).groupBy("url").agg(F.max(F.struct("fetched_at", "hash")).alias("_n"))
        index.upsert(newest.select("url", "_n.fetched_at", "_n.hash"))
        index.expire(keep=3)

    def rebuild_index(self) -> None:
        """Make the indexes anew from the log."""
        for writer in self._writers():
            log = self._log(writer).groupBy("url").agg(F.max(F.struct("fetched_at", "hash")).alias("_n"))
            self.index(writer).replace(log.select("url", "_n.fetched_at", "_n.hash"))

    def hashes(self, urls: DataFrame | None = None) -> DataFrame:
        """(url, hash) as last stored, of all urls or of the given ones.

        Read from the indexes, of which only the buckets of the urls are opened.
        """
        rows = self.spark.createDataFrame([], ddl(LAST_HASH))
        for writer in self._writers():
            index = self.index(writer)
            if not index.version():
                self.rebuild_index()  # a log from before there were indexes
            rows = rows.unionAll(index.read() if urls is None else index.lookup(urls))
        return rows.groupBy("url").agg(F.max_by("hash", F.struct("fetched_at", "hash")).alias("hash"))

    def latest(self, urls: DataFrame | None = None) -> DataFrame:
        """Stored documents, of all urls or of the given ones (then other contents never move)."""
        log = self._log()
        if urls is not None:
            log = log.join(urls.select("url").distinct(), "url", "left_semi")
        return latest_documents(log)

    def purge(self, as_of, keep_days: int = 120) -> list[str]:
        """Drop whole days that ended `keep_days` before `as_of` (a date); returns their names.

        Urls that were last stored on such a day leave the indexes first.
        """
        due = [f for f in self._days() if (as_of - as_of.fromisoformat(f.getName().split("=", 1)[1])).days > keep_days]
        dropped = sorted({f.getName().split("=", 1)[1] for f in due})
        if not dropped:
            return []
        for writer in self._writers():
            index = self.index(writer)
            version = index.version()
            old = index.read(version).filter(F.to_date("fetched_at").cast("string").isin(dropped))
            if version:
                index.merge(index.read(version).limit(0), old, version)
        for folder in due:
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return dropped


def archive_rows(docs: DataFrame, fetched_at: Column, content_type: str = "html") -> DataFrame:
    """Documents as archive rows; the hash is the one given, else that of the content."""
    have = set(docs.columns)
    given = F.col("hash") if "hash" in have else F.lit(None).cast("string")
    kind = F.col("content_type") if "content_type" in have else F.lit(content_type)
    return shape(
        docs.withColumns({
            "hash": F.coalesce(given, F.sha2("content", 256)),
            "content_type": kind,
            "fetched_at": fetched_at,
        }),
        RAW,
    )


def latest_documents(log: DataFrame) -> DataFrame:
    """The newest row per url. Times and hashes are compared first; contents then move for these only."""
    newest = log.groupBy("url").agg(F.max(F.struct("fetched_at", "hash")).alias("_n")).select(
        "url", F.col("_n.fetched_at").alias("fetched_at"), F.col("_n.hash").alias("hash")
    )
    return log.join(newest, ["url", "fetched_at", "hash"], "left_semi").dropDuplicates(["url"])


def append_health(path: str, runs: DataFrame, writer: str = "shared", run_id: str | None = None) -> None:
    """Add run rows to the log, durations to the millisecond; writers have folders of their own.

    With `run_id` the rows have a folder of their own too, so that a repeated run replaces them.
    """
    rows = shape(runs.withColumn("duration_sec", F.round("duration_sec", 3)), HEALTH)
    if run_id is None:
        rows.write.mode("append").parquet(f"{path}/writer={writer}/run=shared")
    else:
        rows.write.mode("overwrite").parquet(f"{path}/writer={writer}/run={run_id}")


DAILY = ("city", "snapshot_date")


def snapshot_rows(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The days of cities touched by `rows`: new rows, and stored ones of other keys of those days."""
    touched = rows.select(*DAILY).distinct()
    same_days = stored.join(touched, list(DAILY), "left_semi")
    kept = same_days.join(rows.select(*keys, *DAILY), [*keys, *DAILY], "left_anti")
    return rows.unionByName(kept.select(*rows.columns))


def snapshot_upsert(
    spark: SparkSession, path: str, rows: DataFrame, keys: list[str], checkpoint_dir: str | None = None,
    kept_at: str | None = None,
) -> None:
    """Replace the rows of some keys of some days; only those days of those cities are written.

    With `kept_at`, a folder of the run, the days are written there first: a run that stops while it replaces
    them does so again from there.
    """
    _, statuses = children(spark, path)
    if kept_at is not None:
        if not finished(spark, kept_at):
            some = any(s.getPath().getName().startswith("city=") for s in statuses)
            whole = snapshot_rows(spark.read.schema(rows.schema).parquet(path), rows, keys) if some else rows
            whole.write.mode("overwrite").parquet(kept_at)
        rows = spark.read.schema(rows.schema).parquet(kept_at)
    elif any(s.getPath().getName().startswith("city=") for s in statuses):
        stored = spark.read.schema(rows.schema).parquet(path)
        # The result is cut from its lineage: it is read from the partitions it replaces.
        rows = cut_lineage(snapshot_rows(stored, rows, keys), checkpoint_dir)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *DAILY
    ).parquet(path)


def venue_statements(venues: DataFrame) -> DataFrame:
    """Venues as SQL upsert statements in id order, one per row."""
    columns = list(VENUE)

    def literal(name):
        quoted = F.concat(
            F.lit("'"), F.replace(F.col(name).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")
        )
        return F.coalesce(quoted, F.lit("NULL"))

    updates = ", ".join(f"{c} = EXCLUDED.{c}" for c in columns if c != "id")
    statement = F.concat(
        F.lit(f"INSERT INTO venues ({', '.join(columns)}) VALUES ("),
        F.concat_ws(", ", *[literal(c) for c in columns]),
        F.lit(f")\n  ON CONFLICT (id) DO UPDATE SET {updates};"),
    )
    return venues.orderBy("id").select("id", statement.alias("statement"))


def export_venues(venues: DataFrame, path: str, city: str | None = None) -> None:
    rows = venues.filter(F.col("city") == city) if city else venues
    venue_statements(rows).select("statement").write.mode("overwrite").text(path)


#: Folders that the warnings of all cities share.
WARNING_FOLDERS = 64


def _warning_folder(city: Column) -> Column:
    return F.pmod(F.xxhash64(city), F.lit(WARNING_FOLDERS)).cast("int")


def write_warnings(warnings: DataFrame, path: str) -> None:
    """Warnings (city, seq, warning) as JSON lines, one each, those of a city together in the folder its name hashes to.

    The folders are as many for any number of cities; one for each city would cost more than its lines.
    """
    rows = warnings.select("city", "seq", "warning", _warning_folder(F.col("city")).alias("folder"))
    placed = rows.hint("rebalance", "folder").sortWithinPartitions("folder", "city")
    placed.write.mode("overwrite").partitionBy("folder").json(path)


def read_warnings(spark: SparkSession, path: str, city: str | None = None) -> DataFrame:
    """Written warnings, of all cities or of one; then only its folder is opened."""
    rows = spark.read.schema("city string, seq bigint, warning string, folder int").json(path)
    if city is not None:
        rows = rows.filter((F.col("folder") == _warning_folder(F.lit(city))) & (F.col("city") == city))
    return rows.drop("folder")

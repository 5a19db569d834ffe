"""Keyed tables on a shared file system: one row per key, merged on read.

Rows lie in buckets by the hash of their key. A write adds a part that holds only the rows it was given;
of several rows of a key the one of the newest part counts, and a deleted key leaves a mark. Readers merge
only the buckets that several parts share; a bucket of one part is read as it is. Buckets whose newer
parts have grown beyond a share of the oldest are rewritten, those only, so that what a write costs
follows its own rows and not the table.

A version is a small file that lists the parts. It is published by creating the next number, which fails
if another writer was first: a reader sees a whole version or the one before, and of two writers that
started from one version one has to start again. Parts of writes that never got so far are not listed
and stay unread.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace as changed

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .schemas import ddl, shape

#: Buckets of a new table. A table of many rows takes more: compaction rewrites whole buckets.
BUCKETS = 8
#: A bucket is rewritten once its newer parts hold this share of the rows of its oldest, or are this many.
COMPACT_SHARE, COMPACT_PARTS = 0.5, 16
#: Times a write is prepared anew when another writer was first.
ATTEMPTS = 5
#: Notes of earlier writes that a version keeps.
NOTES = 16


class Conflict(RuntimeError):
    """Another writer has published a version since the one a write was made from."""


@dataclass
class WriteCounts:
    inserted: int = 0
    updated: int = 0


@dataclass(frozen=True)
class Part:
    """Files of one write: their folder, their place in time, and the rows of each bucket that still counts."""

    folder: str
    seq: int
    rows: dict[int, int] = field(hash=False)


def children(spark: SparkSession, path: str) -> list:
    """(file system, statuses) of a folder, through Hadoop so that any file system works."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, (list(fs.listStatus(folder)) if fs.exists(folder) else [])


def read_text(spark: SparkSession, path: str) -> str:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a file with its whole text, or raise Conflict if there is one of that name.

    The text is written under another name first and then gets its own. Hadoop's rename without overwriting
    is atomic where the file system's is; a local disk has an atomic link instead.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        (_link if fs.getUri().getScheme() == "file" else _rename)(spark, fs, draft, target)
    except Py4JJavaError as problem:
        if fs.exists(target):
            raise Conflict(f"{path} was written by another job") from problem
        raise
    finally:
        fs.delete(draft, False)


def _link(spark: SparkSession, fs, draft, target) -> None:
    local = lambda p: spark._jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
    spark._jvm.java.nio.file.Files.createLink(local(target), local(draft))


def _rename(spark: SparkSession, fs, draft, target) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, none)


class KeyedTable:
    """A table with one row per key."""

    def __init__(self, spark: SparkSession, path: str, layout: dict[str, str], key: str = "id",
                 partition_by: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.layout, self.key = spark, path, layout, key
        self.partition_by, self.buckets = partition_by, buckets

    # --- versions ----------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        _, statuses = children(self.spark, f"{self.path}/versions")
        names = [s.getPath().getName() for s in statuses]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and not name.startswith("."))

    def version(self) -> int:
        """The last version, 0 if there is none."""
        return max(self._versions(), default=0)

    def _parts(self, version: int) -> tuple[int, list[Part]]:
        """Number of buckets and parts of a version, oldest first."""
        if not version:
            return self.buckets, []
        listed = json.loads(read_text(self.spark, f"{self.path}/versions/{version:08d}.json"))
        parts = [Part(p["folder"], p["seq"], {int(b): n for b, n in p["rows"].items()}) for p in listed["parts"]]
        return listed["buckets"], sorted(parts, key=lambda p: p.seq)

    def notes(self, version: int | None = None) -> list[str]:
        """The notes that the last writes up to a version were given."""
        version = self.version() if version is None else version
        return json.loads(read_text(self.spark, f"{self.path}/versions/{version:08d}.json")).get("notes", []) if version else []

    def _publish(self, after: int, buckets: int, parts: list[Part], note: str | None = None) -> None:
        listed = [{"folder": p.folder, "seq": p.seq, "rows": p.rows} for p in parts if p.rows]
        notes = [*self.notes(after), *([note] if note else [])][-NOTES:]
        text = json.dumps({"buckets": buckets, "parts": listed, "notes": notes})
        create_text(self.spark, f"{self.path}/versions/{after + 1:08d}.json", text)

    # --- reading -----------------------------------------------------------------------------

    def _bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _scan(self, parts: list[Part], columns: list[str]) -> DataFrame:
        """Rows of some parts and their buckets, with `_seq`, `_gone` and `_bucket`; other files aren't opened."""
        data = f"{self.path}/data"
        inner = [f"{name} {kind}" for name, kind in self.layout.items()]
        schema = ", ".join([*inner, "_gone boolean", "_part string", "_bucket int"])
        rows = self.spark.read.schema(schema).option("basePath", data).parquet(*[f"{data}/_part={p.folder}" for p in parts])
        live = F.lit(False)
        seqs = F.lit(None).cast("bigint")
        for part in parts:
            mine = F.col("_part") == part.folder
            live = live | (mine & F.col("_bucket").isin(sorted(part.rows)))
            seqs = F.when(mine, F.lit(part.seq)).otherwise(seqs)
        return rows.filter(live).select(*columns, "_gone", "_bucket", seqs.alias("_seq"))

    def _merged(self, parts: list[Part], columns: list[str]) -> DataFrame:
        """The newest row of every key that isn't deleted: `columns`, the key among them."""
        owners: dict[int, int] = {}
        for part in parts:
            for bucket in part.rows:
                owners[bucket] = owners.get(bucket, 0) + 1
        split = lambda wanted: [
            changed(p, rows=kept) for p in parts if (kept := {b: n for b, n in p.rows.items() if (owners[b] == 1) == wanted})]
        out = None
        if alone := split(True):
            out = self._scan(alone, columns).filter("NOT _gone").select(*columns)
        if several := split(False):
            values = [c for c in columns if c != self.key]
            newest = F.max_by(F.struct("_gone", *values), "_seq").alias("_row")
            rows = self._scan(several, columns).groupBy(self.key).agg(newest).filter("NOT _row._gone")
            rows = rows.select(self.key, *[F.col(f"_row.{v}").alias(v) for v in values]).select(*columns)
            out = rows if out is None else out.unionAll(rows)
        if out is None:
            out = self.spark.createDataFrame([], ddl(self.layout)).select(*columns)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of an earlier one that is still kept."""
        _, parts = self._parts(self.version() if version is None else version)
        return shape(self._merged(parts, list(self.layout)), self.layout)

    def lookup(self, keys: DataFrame, version: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """The stored rows of some keys. Only the buckets that these fall in are opened.

        One small row for each bucket reaches the driver.
        """
        buckets, parts = self._parts(self.version() if version is None else version)
        keys = keys.select(self.key).distinct()
        wanted = {r[0] for r in keys.select(self._bucket(F.col(self.key), buckets)).distinct().collect()} if parts else set()
        pruned = [changed(p, rows=kept) for p in parts if (kept := {b: n for b, n in p.rows.items() if b in wanted})]
        rows = self._merged(pruned, columns or list(self.layout))
        return rows.join(keys, self.key, "left_semi").select(*(columns or self.layout))

    # --- writing -----------------------------------------------------------------------------

    def _write(self, rows: DataFrame, buckets: int) -> str:
        """Write rows with `_gone` as a new part; large buckets get several files, small ones share a task."""
        folder = uuid.uuid4().hex
        rows = rows.select(*self.layout, "_gone", self._bucket(F.col(self.key), buckets).alias("_bucket"))
        writer = rows.hint("rebalance", "_bucket").write.mode("errorifexists").partitionBy("_bucket", *self.partition_by)
        writer.parquet(f"{self.path}/data/_part={folder}")
        return folder

    def _counted(self, folder: str, buckets: int) -> Part:
        """A written part, with its rows by bucket (one small row for each)."""
        every = {bucket: 0 for bucket in range(buckets)}
        rows = self._scan([Part(folder, 0, every)], [self.key]).groupBy("_bucket").count().collect()
        return Part(folder, 0, {r["_bucket"]: r["count"] for r in rows})

    def replace(self, rows: DataFrame, after: int | None = None) -> None:
        """Write the next version anew. Rows may be read from the current one.

        With `after`, the version the rows were made from, it fails if another writer has been
        there since.
        """
        base = self.version()
        if after is not None and base != after:
            raise Conflict(f"{self.path} was written by another job since version {after}")
        part = self._counted(self._write(shape(rows, self.layout).withColumn("_gone", F.lit(False)), self.buckets), self.buckets)
        for _ in range(ATTEMPTS):
            try:
                return self._publish(base, self.buckets, [changed(part, seq=base + 1)])
            except Conflict:
                if after is not None:
                    raise
                base = self.version()
        raise Conflict(f"{self.path} is written by other jobs all the time")

    def upsert(self, rows: DataFrame, insert_only: bool = False) -> WriteCounts:
        """Insert rows, replacing those of the same key, or only those of new keys.

        Of several rows of one key the greatest by their values counts. What is written are the given rows; of
        what is stored, only the keys of their buckets are read.
        """
        values = [name for name in self.layout if name != self.key]
        given = shape(rows, self.layout).groupBy(self.key).agg(F.max(F.struct(*values)).alias("_row"))
        given = given.select(self.key, "_row.*").withColumn("_gone", F.lit(False))
        folder = None
        for _ in range(ATTEMPTS):
            base = self.version()
            buckets, parts = self._parts(base)
            if folder is None or insert_only:
                known = self.lookup(given, base, [self.key]) if insert_only else None
                folder = self._write(given.join(known, self.key, "left_anti") if insert_only else given, buckets)
            try:
                return self._add(folder, base, buckets, parts)
            except Conflict:
                continue
        raise Conflict(f"{self.path} is written by other jobs all the time")

    def merge(self, rows: DataFrame, gone: DataFrame | None, after: int, note: str | None = None) -> WriteCounts:
        """Put rows, unique by key, in place of those of their keys and delete the keys of `gone`, as one version.

        A key that is in both stays. It fails if another writer has been there since version `after`. A `note`
        stays with the next versions, so that a repeated job can tell whether it has written.
        """
        if self.version() != after:
            raise Conflict(f"{self.path} was written by another job since version {after}")
        buckets, parts = self._parts(after)
        given = shape(rows, self.layout).withColumn("_gone", F.lit(False))
        if gone is not None:
            left = gone.select(self.key).distinct().join(rows.select(self.key), self.key, "left_anti")
            given = given.unionByName(shape(left, self.layout).withColumn("_gone", F.lit(True)))
        return self._add(self._write(given, buckets), after, buckets, parts, note)

    def _add(self, folder: str, base: int, buckets: int, parts: list[Part], note: str | None = None) -> WriteCounts:
        """Publish a written part on top of a version, and rewrite the buckets that have grown."""
        every = {bucket: 0 for bucket in range(buckets)}
        written = self._scan([Part(folder, 0, every)], [self.key])
        by_bucket = written.groupBy("_bucket").count().collect()
        rows = {r["_bucket"]: r["count"] for r in by_bucket}
        stored = [changed(p, rows=kept) for p in parts if (kept := {b: n for b, n in p.rows.items() if b in rows})]
        known = self._merged(stored, [self.key]).withColumn("_known", F.lit(True))
        new = written.filter("NOT _gone").select(self.key).join(known, self.key, "left")
        counts = new.agg(F.count_if(F.col("_known").isNull()), F.count_if("_known")).first()
        parts = [*parts, Part(folder, base + 1, rows)]
        self._publish(base, buckets, parts, note)
        self._compact(base + 1, buckets, parts)
        return WriteCounts(counts[0], counts[1])

    def _compact(self, version: int, buckets: int, parts: list[Part]) -> None:
        """Rewrite the buckets whose newer parts weigh too much; another writer's version goes first."""
        due = set()
        for bucket in range(buckets):
            sizes = [p.rows[bucket] for p in parts if bucket in p.rows]
            if len(sizes) > 1 and (sum(sizes[1:]) >= COMPACT_SHARE * sizes[0] or len(sizes) > COMPACT_PARTS):
                due.add(bucket)
        if not due:
            return
        old = [changed(p, rows={b: n for b, n in p.rows.items() if b in due}) for p in parts]
        merged = self._merged([p for p in old if p.rows], list(self.layout)).withColumn("_gone", F.lit(False))
        part = self._counted(self._write(merged, buckets), buckets)
        rest = [changed(p, rows={b: n for b, n in p.rows.items() if b not in due}) for p in parts]
        try:
            # The new part stands for the oldest ones, so it comes before any write still to come.
            self._publish(version, buckets, [*rest, changed(part, seq=version + 1)])
        except Conflict:
            return

    def expire(self, keep: int = 2) -> None:
        """Delete all but the last versions, and the parts that only deleted ones list."""
        versions = self._versions()
        old, kept = versions[:-keep], versions[-keep:]
        folders = lambda numbers: {p.folder for n in numbers for p in self._parts(n)[1]}
        unused = folders(old) - folders(kept) if old else set()
        for name in [*(f"versions/{n:08d}.json" for n in old), *(f"data/_part={f}" for f in sorted(unused))]:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


class CityTables:
    """A keyed table of its own for every city.

    A run writes to the table of its city only, and the runs of several cities can go on at
    the same time, each with its own versions.
    """

    def __init__(self, spark: SparkSession, path: str, layout: dict[str, str], key: str = "id"):
        self.spark, self.path, self.layout, self.key = spark, path, layout, key

    def of(self, city: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/city={city}", self.layout, self.key)

    def read(self) -> DataFrame:
        """The rows of all cities."""
        _, statuses = children(self.spark, self.path)
        names = sorted(s.getPath().getName() for s in statuses)
        out = None
        for name in names:
            if name.startswith("city="):
                rows = self.of(name[5:]).read()
                out = rows if out is None else out.unionAll(rows)
        return self.spark.createDataFrame([], ddl(self.layout)) if out is None else out

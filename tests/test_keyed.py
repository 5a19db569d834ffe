import datetime
import pathlib
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from eventloom import keyed, tables as tb
from eventloom.operators import reports
from eventloom.operators.cards import changed_docs
from eventloom.schemas import HEALTH, RAW, ddl, shape
from eventloom.streaming import jobs as streams

LAYOUT = {"id": "string", "n": "bigint", "text": "string"}
NOW = datetime.datetime(2026, 6, 1, 9)


def rows(spark, data):
    return spark.createDataFrame([(k, n, f"text {n}") for k, n in data], ddl(LAYOUT))


def content(table):
    found = [(r.id, r.n) for r in table.read().collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def size(folder):
    return sum(f.stat().st_size for f in pathlib.Path(folder).rglob("*.parquet"))


def test_a_small_batch_writes_little(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), LAYOUT, buckets=8)
    whole = spark.range(100_000).select(
        F.concat(F.lit("k"), "id").alias("id"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    table.replace(whole)
    before = size(tmp_path / "t")
    counts = table.upsert(whole.filter("n % 100 = 7").withColumn("n", -F.col("n")))
    assert (counts.inserted, counts.updated) == (0, 1000)
    assert size(tmp_path / "t") - before < 0.05 * before
    assert table.read().agg(F.sum("n"), F.count("n")).first() == (sum(range(100_000)) - 2 * sum(range(7, 100_000, 100)), 100_000)


def test_random_writes_against_a_dict(spark, tmp_path):
    rnd, want = random.Random(1), {}
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), LAYOUT, buckets=4)
    most = 0
    for step in range(14):
        batch = {f"k{rnd.randrange(40)}": rnd.randrange(1000) for _ in range(rnd.randrange(0, 9))}
        kind = rnd.choice(["upsert", "insert", "merge"])
        if kind == "merge":
            gone = [k for k in rnd.sample(sorted(want), min(len(want), 3)) if k not in batch] + ["never"]
            table.merge(rows(spark, batch.items()), spark.createDataFrame([(k,) for k in gone], "id string"), table.version())
            want = {k: v for k, v in want.items() if k not in gone} | batch
        else:
            counts = table.upsert(rows(spark, batch.items()), insert_only=kind == "insert")
            assert counts.inserted == len(set(batch) - set(want))
            assert counts.updated == (0 if kind == "insert" else len(set(batch) & set(want)))
            want = batch | want if kind == "insert" else want | batch
        if step % 4 == 3:
            assert content(table) == want
            some = [*rnd.sample(sorted(want), min(3, len(want))), "none"]
            found = table.lookup(spark.createDataFrame([(k,) for k in some], "id string"))
            assert {r.id: r.n for r in found.collect()} == {k: want[k] for k in some if k in want}
            table.expire(keep=1)
        most = max(most, len(table._parts(table.version())[1]))
    assert content(table) == want and most <= 4 * keyed.COMPACT_PARTS
    listed = {p.folder for p in table._parts(table.version())[1]}
    table.expire(keep=1)
    assert {p.name[6:] for p in (tmp_path / "t" / "data").iterdir() if p.name.startswith("_part=")} == listed


def test_compaction_rewrites_the_buckets_that_grew(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), LAYOUT, buckets=8)
    table.replace(rows(spark, [(f"k{i}", i) for i in range(400)]))
    bucket = table._bucket(F.col("id"), 8)
    one = table.read().filter(bucket == 3).cache()
    table.upsert(one.withColumn("n", -F.col("n")))
    _, parts = table._parts(table.version())
    assert [sorted(p.rows) for p in parts] == [[0, 1, 2, 4, 5, 6, 7], [3]]
    assert sorted(content(table).values())[0] == -max(r.n for r in one.collect())


def test_lookup_opens_only_the_buckets_of_its_keys(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), LAYOUT, buckets=16)
    table.replace(rows(spark, [(f"k{i}", i) for i in range(200)]))
    table.upsert(rows(spark, [(f"k{i}", -i) for i in range(10)]))
    plan = table.lookup(spark.createDataFrame([("k5",)], "id string"))
    assert plan.collect()[0].n == -5
    scans = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scans
    opened = {f.split("_bucket=")[1].split("/")[0] for f in plan.select(F.input_file_name().alias("f")).distinct().toPandas().f if "_bucket" in f}
    assert len(opened) <= 1


def test_of_two_writers_one_is_first(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), LAYOUT, buckets=2)
    table.replace(rows(spark, [("a", 1)]))
    base = table.version()

    def write(n):
        try:
            table.replace(rows(spark, [("a", n)]), after=base)
            return n
        except keyed.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [n for n in pool.map(write, range(10, 14)) if n]
    assert len(won) == 1 and content(table) == {"a": won[0]} and table.version() == base + 1
    # Upserts that meet start again, and none is lost.
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda n: table.upsert(rows(spark, [(f"b{n}", n)])), range(3)))
    assert content(table) == {"a": won[0], "b0": 0, "b1": 1, "b2": 2}
    with pytest.raises(keyed.Conflict):
        table.merge(rows(spark, [("c", 1)]), None, after=base)


def test_a_write_that_stops_is_not_seen(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), LAYOUT)
    table.upsert(rows(spark, [("a", 1)]))
    with monkeypatch.context() as m:
        m.setattr(keyed, "create_text", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            table.upsert(rows(spark, [("a", 2), ("b", 2)]))
    assert content(table) == {"a": 1}
    table.upsert(rows(spark, [("b", 3)]))
    assert content(table) == {"a": 1, "b": 3}


def test_files_are_created_once(spark, tmp_path, monkeypatch):
    keyed.create_text(spark, str(tmp_path / "a.json"), "äöü")
    with pytest.raises(keyed.Conflict):
        keyed.create_text(spark, str(tmp_path / "a.json"), "other")
    monkeypatch.setattr(keyed, "_link", keyed._rename)  # as on a file system without links
    keyed.create_text(spark, str(tmp_path / "b.json"), "x")
    with pytest.raises(keyed.Conflict):
        keyed.create_text(spark, str(tmp_path / "b.json"), "other")
    assert keyed.read_text(spark, str(tmp_path / "a.json")) == "äöü" and keyed.read_text(spark, str(tmp_path / "b.json")) == "x"


# --- sums of run health ------------------------------------------------------------------


def runs(spark, data):
    given = spark.createDataFrame(
        [(s, c, NOW + datetime.timedelta(hours=h), n, e) for s, c, h, n, e in data],
        "source string, city string, run_at timestamp, events_found bigint, errors bigint")
    return shape(given, HEALTH)


def test_sums_equal_the_whole_log(spark, tmp_path):
    state = tb.KeyedTable(spark, str(tmp_path / "s"), streams.HEALTH_SUMS, "key")
    batches = [
        [("a", "perm", 0, 3, 0), ("a", "perm", 1, 4, 2), ("b", None, 0, None, None), ("a|b", "c", 0, 1, 1)],
        [("a", "perm", 3, 9, 0), ("a", "b|c", 0, 2, 0)], [("b", None, 5, 7, 0), ("a", "perm", 2, 1, 1)],
    ]
    for n, batch in enumerate(batches):
        streams.add_runs(state, runs(spark, batch), n)
        streams.add_runs(state, runs(spark, batch), n)  # a batch that comes again
    want = reports.health_agg(runs(spark, [r for b in batches for r in b]))
    key = lambda r: (str(r["source"]), str(r["city"]))
    got = streams.health_state(state.read())
    assert got.columns == want.columns
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_health_stream_goes_on_without_the_log(spark, tmp_path):
    state = tb.KeyedTable(spark, str(tmp_path / "s"), streams.HEALTH_SUMS, "key")
    for n in range(3):
        runs(spark, [("a", "perm", n, n, 0)]).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.landed_stream(spark, str(tmp_path / "in"), ddl(HEALTH))
        streams.stream_health(stream, str(tmp_path / "log"), state, str(tmp_path / "check")).awaitTermination()
        for old in (tmp_path / "log").glob(f"batch={n}/*.parquet"):
            old.write_bytes(b"unreadable")  # later batches must not read it
    assert [(r.avg_events, r.success_rate) for r in streams.health_state(state.read()).collect()] == [(1.0, 1.0)]


# --- last hashes of the archive ----------------------------------------------------------


def docs(spark, **texts):
    return spark.createDataFrame([("s", u, t) for u, t in texts.items()], "source string, url string, content string")


def hour(n):
    return F.lit(NOW + datetime.timedelta(hours=n)).cast("timestamp")


def test_last_hashes_by_writer(spark, tmp_path):
    archive = tb.RawArchive(spark, str(tmp_path / "raw"))
    changed = lambda **t: sorted(
        r.url for r in changed_docs(docs(spark, **t).withColumn("hash", F.sha2("content", 256)), archive.hashes(docs(spark, **t))).collect())
    assert changed(a="1") == ["a"]
    archive.append(docs(spark, a="1", b="1"), hour(0), "perm")
    archive.append(docs(spark, a="2"), hour(2), "sochi")
    archive.append(docs(spark, a="0", c="1"), hour(1), "perm")  # older than what the other writer has
    assert changed(a="2", b="1", c="1") == [] and changed(a="1", b="2", d="1") == ["a", "b", "d"]
    want = {(r.url, r.hash) for r in archive.latest().select("url", "hash").collect()}
    assert {(r.url, r.hash) for r in archive.hashes().collect()} == want
    archive.append(docs(spark, a="1"), hour(3), "sochi")  # back to an earlier text
    assert changed(a="1") == [] and changed(a="2") == ["a"]


def test_hashes_are_read_from_the_index_alone(spark, tmp_path):
    archive = tb.RawArchive(spark, str(tmp_path / "raw"))
    archive.append(docs(spark, **{f"u{i}": "1" for i in range(50)}), hour(0))
    for file in (tmp_path / "raw").glob("writer=*/*/*.parquet"):
        file.write_bytes(b"unreadable")
    assert archive.hashes(docs(spark, u7="")).count() == 1 and archive.hashes().count() == 50


def test_logs_without_an_index_and_purged_days(spark, tmp_path):
    archive = tb.RawArchive(spark, str(tmp_path / "raw"))
    log = tb.archive_rows(docs(spark, a="1", b="1"), hour(0)).withColumn("fetch_day", F.to_date("fetched_at"))
    log.write.partitionBy("fetch_day").parquet(str(tmp_path / "raw" / "writer=old"))
    archive.append(docs(spark, b="2"), hour(24 * 40))
    assert archive.hashes().count() == 2 and shape(archive._log("old"), RAW).count() == 2
    assert archive.purge(datetime.date(2026, 10, 10)) == ["2026-06-01"]
    assert [r.url for r in archive.hashes().collect()] == ["b"]

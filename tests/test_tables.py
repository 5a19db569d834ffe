import datetime

from pyspark.sql import functions as F

from eventloom import tables as tb
from eventloom.operators import discovery, maintenance
from eventloom.plans import city as city_plan, feeds
from eventloom.schemas import CANDIDATE, VENUE, arrival, ddl, shape

from test_merge import card, rows

NOW = datetime.datetime(2026, 6, 1, 9)


def venue(spark, *data):
    given = spark.createDataFrame(list(data), "id string, name string, source string")
    return shape(given.withColumn("city", F.lit("perm")), VENUE)


def read(table):
    return {r.id: (r.name, r.source) for r in table.read().collect()}


def test_hand_entered_venues_stay(spark, tmp_path):
    table = tb.KeyedTable(spark, str(tmp_path / "v"), VENUE)
    assert read(table) == {}
    counts = tb.upsert_venues(table, venue(spark, ("a", "A", "manual"), ("b", "B", "twogis")))
    assert (counts.inserted, counts.updated) == (2, 0)
    again = venue(spark, ("a", "X", "twogis"), ("b", "Y", "twogis"), ("c", "Z", "twogis"))
    counts = tb.upsert_venues(table, again)
    assert (counts.inserted, counts.updated) == (1, 1)
    assert read(table) == {"a": ("A", "manual"), "b": ("Y", "twogis"), "c": ("Z", "twogis")}
    tb.upsert_venues(table, venue(spark, ("b", "no", "twogis"), ("d", "D", "twogis")), insert_only=True)
    assert read(table)["b"] == ("Y", "twogis") and read(table)["d"] == ("D", "twogis")


def test_readers_skip_unfinished_versions(spark, tmp_path):
    table = tb.KeyedTable(spark, str(tmp_path / "v"), VENUE)
    table.replace(venue(spark, ("a", "A", "twogis")))
    broken = tmp_path / "v" / "v=00000002"
    broken.mkdir()
    assert read(table) == {"a": ("A", "twogis")}
    table.replace(venue(spark, ("b", "B", "twogis")))
    table.replace(venue(spark, ("c", "C", "twogis")))
    assert read(table) == {"c": ("C", "twogis")}
    table.expire(keep=1)
    assert read(table) == {"c": ("C", "twogis")}


def test_a_document_that_returns_to_an_old_text_is_changed(spark, tmp_path):
    archive = tb.RawArchive(spark, str(tmp_path / "raw"))
    doc = lambda text: spark.createDataFrame([("s", "u", text)], "source string, url string, content string")
    for hour, text in enumerate(["A", "B"]):
        archive.append(doc(text), F.lit(NOW + datetime.timedelta(hours=hour)).cast("timestamp"))
    from eventloom.operators.cards import changed_docs

    hashed = lambda text: doc(text).withColumn("hash", F.sha2("content", 256))
    assert changed_docs(hashed("B"), archive.hashes()).count() == 0
    assert changed_docs(hashed("A"), archive.hashes()).count() == 1
    assert archive.purge(datetime.date(2026, 6, 30)) == []
    assert archive.purge(datetime.date(2026, 12, 30)) == ["2026-06-01"]


def test_daily_snapshots_keep_other_days_and_keys(spark, tmp_path):
    make = lambda *data: spark.createDataFrame(list(data), "city string, kind string, n int, snapshot_date string")
    path = str(tmp_path / "snap")
    tb.snapshot_upsert(spark, path, make(("perm", "a", 1, "2026-06-01"), ("sochi", "a", 2, "2026-06-01"), ("perm", "b", 4, "2026-06-01"), ("perm", "a", 3, "2026-06-02")), ["kind"])
    tb.snapshot_upsert(spark, path, make(("perm", "a", 9, "2026-06-01")), ["kind"])
    got = {(r.city, r.kind, r.snapshot_date.isoformat()): r.n for r in spark.read.parquet(path).collect()}
    assert got == {
        ("perm", "a", "2026-06-01"): 9, ("sochi", "a", "2026-06-01"): 2, ("perm", "b", "2026-06-01"): 4,
        ("perm", "a", "2026-06-02"): 3,
    }


def test_empty_answer_of_a_snapshot_source_drops_nothing(spark):
    stored = rows(spark, card("Один", "2026-07-01", "Зал", "tickets"), card("Два", "2026-07-02", "Зал", "vk-posts"))
    day = F.lit("2026-06-01").cast("date")
    kept, deleted = maintenance.sync_snapshot(stored, stored.filter("false"), day)
    assert (kept.count(), deleted.count()) == (2, 0)
    one = rows(spark, card("Иное", "2026-07-01", "Зал", "tickets"))
    kept, deleted = maintenance.sync_snapshot(stored, one, day)
    assert [r.title for r in deleted.collect()] == ["Один"]


def test_moderated_candidates_keep_their_status(spark):
    found = spark.createDataFrame(
        [(d, "perm", ["q1", "q2", "q3"], [f"https://{d}/afisha"], 7, True, "serper", "q1")
         for d in ("new.ru", "known.ru", "no.ru", "site.tilda.ws", "m.timepad.ru")],
        "domain string, city string, queries array<string>, sample_urls array<string>, score bigint, "
        "has_jsonld_event boolean, first_provider string, first_query string",
    )
    stored = shape(spark.createDataFrame(
        [("known.ru", ["q0"], "new", "brave"), ("no.ru", ["q0"], "rejected", "brave"), ("old.ru", ["q0"], "new", None)],
        "domain string, queries array<string>, status string, first_provider string",
    ), CANDIDATE)
    merged = {r.domain: r for r in discovery.merge_candidates(found, stored, F.lit(NOW).cast("timestamp")).collect()}
    assert {d: r.status for d, r in merged.items()} == {
        "new.ru": "approved", "known.ru": "approved", "no.ru": "rejected", "old.ru": "new",
        "site.tilda.ws": "new", "m.timepad.ru": "new",
    }
    assert merged["known.ru"].queries == ["q0", "q1", "q2", "q3"] and merged["known.ru"].first_provider == "brave"
    assert merged["old.ru"].last_seen is None and merged["old.ru"].queries == ["q0"]


def feed_cards(spark, *cards):
    given = rows(spark, *cards).withColumn("event_url", F.lit(None).cast("string"))
    return given.withColumn("seq", arrival(F.lit(0), "seq"))


def test_one_failing_feed_leaves_the_others_alone(spark, tmp_path):
    tables = city_plan.Tables(spark, str(tmp_path))

    def broken():
        raise ValueError("HTTP 403")

    def run(day, *more):
        configured = [
            city_plan.Feed("broken", broken),
            city_plan.Feed("tickets", lambda: feeds.direct_feed(feed_cards(spark, *more)), True),
        ]
        return city_plan.run_city(tables, "perm", configured, {"tickets": 100}, day.date(), day, day.strftime("%d"))

    first = run(NOW, card("Старое", "2026-06-01", "Зал", "tickets"), card("Отменённое", "2026-06-20", "Зал", "tickets"),
                card("Место", "always", "Боулинг", "tickets", type="bowling"))
    assert (first.inserted, first.updated) == (2, 0)
    summary = first.summary.collect()[0]
    assert (summary.extracted, summary.failed, summary.warnings, summary.success) == (2, 1, ["broken: HTTP 403"], True)
    assert [r.id for r in tables.venues.read().collect()] == ["perm-bouling"]

    later = run(NOW + datetime.timedelta(days=3), card("Новое", "2026-06-21", "Зал", "tickets"))
    assert (later.inserted, later.updated) == (1, 0)
    assert [r.title for r in tables.events.read().collect()] == ["Новое"]
    health = spark.read.parquet(tables.path("health"))
    assert health.count() == 4 and health.filter("last_error = 'broken: HTTP 403'").count() == 2
    assert spark.read.parquet(tables.path("coverage")).count() == 2


def test_warnings_of_many_cities_share_folders(spark, tmp_path):
    made = [(None if i == 7 else f"city {i // 2}", i, None if i == 9 else f"token {i}") for i in range(600)]
    tb.write_warnings(spark.createDataFrame(made, "city string, seq long, warning string"), str(tmp_path / "w"))
    folders = [p for p in (tmp_path / "w").iterdir() if p.is_dir()]
    assert len(folders) <= tb.WARNING_FOLDERS
    whole = spark.read.schema("city string, seq bigint, warning string").json(str(tmp_path / "w"))
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in whole.select("city", "seq", "warning").collect()), key=key) == made
    assert sorted(map(tuple, tb.read_warnings(spark, str(tmp_path / "w")).collect()), key=key) == made
    of_one = tb.read_warnings(spark, str(tmp_path / "w"), "city 5")
    assert sorted(map(tuple, of_one.collect())) == [("city 5", 10, "token 10"), ("city 5", 11, "token 11")]

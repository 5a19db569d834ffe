import datetime
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from eventloom import keyed, runs as run_log, tables as tb
from eventloom.plans import city as city_plan, feeds
from eventloom.schemas import arrival

from test_merge import card, rows

NOW = datetime.datetime(2026, 6, 1, 9)
LATER = NOW + datetime.timedelta(days=1)


def configured(spark, *cards, hook=lambda: None):
    def read():
        hook()
        given = rows(spark, *cards).withColumn("event_url", F.lit(None).cast("string"))
        run = feeds.direct_feed(given.withColumn("seq", arrival(F.lit(0), "seq")))
        run.archive = spark.createDataFrame([("s", "u", cards[0]["title"])], "source string, url string, content string")
        return run

    return [city_plan.Feed("tickets", read, True)]


FIRST = [card("Старое", "2026-06-20", "Зал", "tickets"), card("Место", "always", "Боулинг", "tickets", type="bowling")]
SECOND = [card("Новое", "2026-06-21", "Зал", "tickets"), card("Каток", "always", "Лёд", "tickets", type="bowling")]
OTHER = [card("Третье", "2026-06-22", "Зал", "tickets")]


def run(spark, tables, cards, moment=NOW, run_id="1", hook=lambda: None):
    return city_plan.run_city(
        tables, "perm", configured(spark, *cards, hook=hook), {"tickets": 100}, moment.date(), moment, run_id)


def state(spark, tables):
    """All that a city's run writes, as sorted rows."""
    def log(name):
        _, found = keyed.children(spark, tables.path(name))
        return sorted(map(str, spark.read.parquet(tables.path(name)).collect())) if found else []

    return (
        sorted(r.title for r in tables.events.read().collect()), sorted(r.name for r in tables.venues.read().collect()),
        sorted((r.url, r.content) for r in tables.raw._log("perm").collect()), sorted(map(tuple, tables.raw.hashes().collect())),
        log("coverage"), log("quality"), log("health"))


class Stopped(Exception):
    pass


@pytest.fixture(scope="module")
def wanted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("wanted"))
    tables = city_plan.Tables(spark, folder)
    run(spark, tables, FIRST)
    old = state(spark, tables)
    begun = shutil.copytree(folder, f"{folder}-begun")
    run(spark, tables, SECOND, LATER, "2")
    return old, state(spark, tables), begun


def after_first(spark, wanted, tmp_path):
    """Tables as the first run left them."""
    return city_plan.Tables(spark, shutil.copytree(wanted[2], str(tmp_path / "tables")))


#: The writes of a run in their order, the runs stop before these; of those made twice before the given one.
WRITES = [
    (run_log.RunLog, "commit", 1), (keyed.KeyedTable, "merge", 1), (city_plan, "upsert_venues", 1), (tb.RawArchive, "append", 1),
    (tb.RawArchive, "_note", 1), (city_plan, "snapshot_upsert", 1), (city_plan, "snapshot_upsert", 2),
    (city_plan, "append_health", 1), (run_log.RunLog, "close", 1)]


@pytest.mark.parametrize("owner, name, call", WRITES)
def test_a_run_that_stops_leaves_the_old_or_the_new_state(spark, tmp_path, monkeypatch, wanted, owner, name, call):
    old, new, _ = wanted
    tables = after_first(spark, wanted, tmp_path)
    real, calls = getattr(owner, name), []

    def stopping(*arguments, **options):
        calls.append(name)
        if len(calls) == call:
            raise Stopped
        return real(*arguments, **options)

    with monkeypatch.context() as patch:
        patch.setattr(owner, name, stopping)
        with pytest.raises(Stopped):
            run(spark, tables, SECOND, LATER, "2")
    committed = name != "commit"
    assert (tables.runs("perm").pending() is not None) == committed
    if not committed:
        assert state(spark, tables) == old
    city_plan.settle(tables, "perm")
    assert state(spark, tables) == (new if committed else old)
    assert city_plan.settle(tables, "perm") is None


def test_of_two_runs_one_wins(spark, tmp_path, wanted):
    _, new, _ = wanted
    tables = after_first(spark, wanted, tmp_path)
    with pytest.raises(keyed.Conflict):
        run(spark, tables, OTHER, LATER, "3", hook=lambda: run(spark, tables, SECOND, LATER, "2"))
    assert state(spark, tables) == new and tables.runs("perm").outcome(2) == "applied"


def test_a_changed_table_refuses_the_run(spark, tmp_path, wanted):
    tables = after_first(spark, wanted, tmp_path)
    table = tables.events.of("perm")
    with pytest.raises(keyed.Conflict):
        run(spark, tables, SECOND, LATER, "2", hook=lambda: table.merge(table.read().limit(0), table.read(), table.version()))
    titles, *others = state(spark, tables)
    assert titles == [] and others == list(wanted[0][1:]) and tables.runs("perm").outcome(2) == "refused"
    run(spark, tables, SECOND, LATER, "2")
    assert state(spark, tables)[0] == wanted[1][0]


def test_notes_stay_with_later_versions(spark, tmp_path):
    table = tb.KeyedTable(spark, str(tmp_path / "t"), {"id": "string", "n": "int"})
    given = spark.createDataFrame([("a", 1)], "id string, n int")
    table.merge(given, None, 0, "run 1")
    for n in range(3):
        table.upsert(given)
    table.expire(keep=1)
    assert table.notes() == ["run 1"]
    with pytest.raises(keyed.Conflict):
        table.merge(given, None, 1, "run 2")


def test_steps_that_need_only_the_staged_rows_run_side_by_side(spark, tmp_path, monkeypatch):
    both = threading.Barrier(2, timeout=60)

    def meeting(step):
        def met(*args):
            both.wait()  # broken if the other step isn't begun until this one has ended
            return step(*args)
        return met

    for name in ("merge_cards", "merge_pairs"):
        monkeypatch.setattr(city_plan.merge, name, meeting(getattr(city_plan.merge, name)))
    tables = city_plan.Tables(spark, str(tmp_path))
    done = run(spark, tables, FIRST)
    assert (done.inserted, done.updated) == (1, 0)
    again = run(spark, tables, FIRST + SECOND, LATER, "2")
    assert (again.inserted, again.updated) == (1, 1)

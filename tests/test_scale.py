"""Costly work on each row follows the rows, not the few files they lie in."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import feeds as feed_checks, jobs
from eventloom.sources import html_feeds, structured

from test_sources import EVENT, landed, page


@pytest.fixture
def parts(spark, tmp_path):
    """A part table in one file."""
    rows = spark.range(40).selectExpr(
        "id AS p_partkey", "concat('part ', id) AS p_name", "'Brand' AS p_brand", "'TYPE' AS p_type", "cast(id AS int) AS p_size",
        "10.0D + id AS p_retailprice",
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_pages_of_one_file_are_read_by_several_tasks(spark, parts):
    assert tasks_with_rows(feed_checks._jsonld_pages(spark, parts)) > 1
    assert tasks_with_rows(feed_checks.structured.jsonld_events(feed_checks._jsonld_pages(spark, parts))) > 1


def test_markdown_of_one_file_is_made_by_several_tasks(spark, parts):
    assert tasks_with_rows(feed_checks.clean_markdown_structure(spark, parts)) > 1


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_structured_data_is_parsed_once(spark, parts):
    read = structured.jsonld_events(landed(spark, page(EVENT)))
    assert plan(read).count("regexp_extract_all") == 1
    both = feed_checks.structured_or_model(spark, parts)
    assert "regexp_extract_all" not in plan(both)  # read from what was staged


def test_objects_keep_their_places(spark):
    deep = [[[[[{"@graph": [[{**EVENT, "name": "Third"}, {**EVENT, "name": "Fourth"}]]}]]]]]
    pages = landed(spark, page({**EVENT, "name": "First"}, [EVENT, {**EVENT, "name": "Second"}]) + page(deep, []))
    read = structured.jsonld_events(pages).orderBy("seq").select("title", "seq.pos").collect()
    assert [r.title for r in read] == ["First", "Концерт", "Second", "Third", "Fourth"]
    assert [r.pos for r in read] == [[0, 0, 0, 0, 0], [1, 0, 0, 0, 0], [1, 1, 0, 0, 0], [2, 0, 0, 0, 0], [2, 0, 0, 0, 1]]


def test_rows_of_pages_are_passed_on_run_by_run(spark, monkeypatch):
    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(html_feeds, "BATCH_CHARS", 10)
    run = html_feeds.map_pages(Pages(), lambda html: ((w, [w, None]) for w in html.split()), "word string, words array<string>")
    texts = ["a b", "", "c" * 30, "d", "e f g h i"]
    kept = [pa.array(["s"] * 5), pa.array(["c", None, "c", "c", "c"]), pa.array(["u"] * 5), pa.array([1, 2, None, 4, 5], pa.int64())]
    given = pa.RecordBatch.from_arrays([*kept, pa.array(texts)], names=["source", "city", "url", "page", "content"])
    made = list(run([given]))
    assert len(made) == 3  # two short pages, a long one, two short ones
    rows = [tuple(r.values()) for batch in made for r in batch.to_pylist()]
    assert [r[3:6] for r in rows] == [
        (1, 0, "a"), (1, 1, "b"), (None, 0, "c" * 30), (4, 0, "d"), *[(5, i, w) for i, w in enumerate("efghi")]]


def test_what_lands_for_the_stream_lies_in_several_files(spark, tmp_path, monkeypatch):
    rows = spark.range(60).selectExpr(
        "id AS event_id", "cast('2024-01-05 10:00:00' AS timestamp_ntz) AS ts", "id % 7 AS user_id", "'view' AS event_type",
        "cast(id AS double) AS value", "'{}' AS props",
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(jobs, "scratch", lambda _: str(tmp_path / "work"))
    assert jobs.stream_merge(spark, str(tmp_path)).count() == 7
    assert len(list((tmp_path / "work" / "in").glob("part-*"))) > 1

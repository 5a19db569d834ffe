import hashlib
import random
from collections import defaultdict

import pytest

from eventloom.llm.exact_dedup import drop_duplicates, duplicate_groups

SCHEMA = "doc_id long, text string, kept string, _run int, _id string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(parts)


def groups(rows):
    of = defaultdict(list)
    for i, t in rows:
        of[t or ""].append(i)
    return of


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
def test_against_plain_grouping(spark, keep, best):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot"] * 30 + [f"t{k}" for k in range(40)] + ["", None])) for i in range(300)]
    got = duplicate_groups(frame(spark, rows, 11), keep=keep, fan_in=2).collect()
    of = groups(rows)
    assert len(got) == 300
    for row, text in ((r, dict(rows)[r.doc_id] or "") for r in got):
        assert row.keep_id == best(of[text]) and row.group_size == len(of[text])
        assert row.kept == (row.doc_id == row.keep_id)
        assert row.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, None), (3, "")]
    docs = frame(spark, rows)
    got = duplicate_groups(docs).collect()
    assert sum(r.kept for r in got) == 3  # one of a, of b and of the empty texts
    assert {(r.keep_id, r.group_size) for r in got} == {(1, 3), (None, 2), (3, 2)}
    left = drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "b"), (1, "a"), (3, "")]


def test_empty_table(spark):
    docs = frame(spark, [])
    assert duplicate_groups(docs).count() == 0 and drop_duplicates(docs).count() == 0


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        duplicate_groups(frame(spark, []), keep="first")

import random
import zlib
from collections import Counter

import pytest

from eventloom.llm import sharding
from eventloom.llm.common import in_blocks
from eventloom.llm.sharding import interleave

SCHEMA = "doc_id long, text string, source string, shard string, before int, _block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "y") for i, t, s in rows], SCHEMA).repartition(3)


def test_shards_match_the_mixture(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["", None, "é", "some text"]), rnd.choice(["hot"] * 4 + ["b", "c", None])) for i in range(1003)]
    rows[7] = rows[8] = (None, "x", "b")
    got = interleave(frame(spark, rows), shards=16, block_rows=50).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 1003 and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(16):
        assert sorted(r.slot for r in got if r["shard"] == shard) == list(range(counts[shard]))
    of = Counter(s for _, _, s in rows)
    for source, n in of.items():
        key = "t" if source is None else f"s{source}"
        for shard in range(16):
            assert abs(sum(r["shard"] == shard and r.source_key == key for r in got) - n / 16) < 2
    texts = {i: t for i, t, _ in rows if i is not None}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
               for r in got if r.doc_id is not None)
    again = interleave(frame(spark, rows).repartition(2), shards=16, block_rows=300).collect()
    place = lambda out: {r.doc_id: (r["shard"], r.slot) for r in out if r.doc_id is not None}
    assert place(got) == place(again)


def test_few_rows_and_none(spark):
    got = interleave(frame(spark, [(1, "a", "s"), (1, "a", "s"), (2, "b", "s")])).collect()
    assert len({(r["shard"], r.slot) for r in got}) == 3 and all(r.slot == 0 for r in got)
    assert interleave(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [
    [(i, "x", f"source {i}") for i in range(20_000)], [(None, "x", "s")] * 20_000, [(None, f"x{i}", "s") for i in range(20_000)],
    [(i % 3, "x", "st"[i % 2]) for i in range(20_000)]])
def test_blocks_stay_even(spark, rows, monkeypatch):
    sizes = []

    def watched(df, *arguments):
        out = in_blocks(df, *arguments)
        sizes.append(sorted(r["count"] for r in out.groupBy("_block").count().collect()))
        return out

    monkeypatch.setattr(sharding, "in_blocks", watched)
    got = interleave(frame(spark, rows), block_rows=500).collect()
    assert len({(r["shard"], r.slot) for r in got}) == 20_000 and {r["shard"] for r in got} == set(range(16))
    assert len(sizes) == 2 and all(len(s) >= 39 and s[-1] < 2 * s[len(s) // 2] for s in sizes), sizes

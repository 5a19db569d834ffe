import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.llm import mixing
from eventloom.llm.common import in_blocks
from eventloom.llm.mixing import SCHEDULES, due_time, in_training_order, mix, plan_mix, source_targets, training_places

SCHEMA = "doc_id long, text string, source string, times string, _time int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], SCHEMA).repartition(3)


def poured(sizes, weights, total, most=2):
    """Targets by pouring again until nothing overflows."""
    full, target = set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(w for s, w in weights.items() if s not in full)
        over = {s for s in sizes if s not in full and weights[s] * left > most * sizes[s] * rest}
        if not over:
            return {s: most * sizes[s] if s in full else weights[s] * left / rest for s in sizes}
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_repeated_pouring(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{chr(97 + k)}": rnd.choice([0, 5, 50, 700, 10_000]) + rnd.randrange(9) for k in range(rnd.randint(1, 12))}
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source_key string, source_size long")).collect()
    want = poured(sizes, weights, 1.5 * sum(sizes.values()))
    assert {r.source_key: r.target for r in got} == pytest.approx(want)


@pytest.mark.parametrize("knots", [*SCHEDULES, (0.0, 1.0, 0.0), (1.0, 0.0, 0.0, 2.0)])
def test_due_time_inverts_the_integral(spark, knots):
    def integral(t):
        n, step = 20_000, 1 / (len(knots) - 1)
        out = 0.0
        for i in range(n):
            x = (i + 0.5) / n * t
            k = min(int(x / step), len(knots) - 2)
            out += (knots[k] + (knots[k + 1] - knots[k]) * (x - k * step) / step) * t / n
        return out

    shares = spark.createDataFrame([(i / 20,) for i in range(1, 20)], "u double")
    for r in shares.select("u", due_time(F.col("u"), knots).alias("t")).collect():
        assert integral(r.t) / integral(1.0) == pytest.approx(r.u, abs=2e-3)


def test_plan_and_mix(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["a"] * 5 + ["b", "c", None])) for i in range(600)]
    rows += [(601, None, "a"), (602, " \t ", None)]
    docs = frame(spark, rows)
    plan = plan_mix(docs, block_rows=70).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    assert all(r.size == size[r.doc_id] and r.taken <= 2 * r.size and r.taken == r.size * len(r.times) for r in plan)
    taken, target = defaultdict(int), {}
    for r in plan:
        taken[r.source_key] += r.taken
        target[r.source_key] = r.target
        assert all(0 <= t <= 1 for t in r.times) and list(r.times) == sorted(r.times)
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)
    assert sorted(plan_mix(docs.repartition(1), block_rows=1000).select("doc_id", "taken", "times").collect()) == sorted(
        (r.doc_id, r.taken, r.times) for r in plan)
    order = [r.time for r in in_training_order(plan_mix(docs)).collect()]
    assert order == sorted(order) and len(order) == sum(len(r.times) for r in plan)
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    want = {r.doc_id: len(r.times) for r in plan if r.taken}
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert got == want


def test_repeats_nulls_and_no_words(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c d", "s"), (None, "e f", None)]
    plan = plan_mix(frame(spark, rows)).collect()
    mixed = mix(frame(spark, rows))
    assert mixed.count() == sum(len(r.times) for r in plan)
    assert all(r.taken == 0 for r in plan_mix(frame(spark, [(1, None, None), (2, "", "a")])).collect())
    assert plan_mix(frame(spark, [])).count() == 0 and mix(frame(spark, [])).count() == 0


def test_null_ids_and_repeats_fill_even_blocks(spark, monkeypatch):
    sizes = []

    def watched(df, *arguments):
        out = in_blocks(df, *arguments)
        sizes.append(sorted(r["count"] for r in out.groupBy("_block").count().collect()))
        return out

    monkeypatch.setattr(mixing, "in_blocks", watched)
    plan = plan_mix(frame(spark, [(None, "a b", "s")] * 12_000 + [(None, f"a w{i}", "t") for i in range(8_000)]), block_rows=500)
    assert plan.count() == 20_000 and abs(plan.agg(F.sum("taken")).first()[0] - 60_000) <= 4
    assert len(sizes[0]) >= 39 and sizes[0][-1] < 2 * sizes[0][len(sizes[0]) // 2]


def test_places_of_a_written_mix(spark, tmp_path):
    rnd = random.Random(6)
    docs = frame(spark, [(i, " ".join(["w"] * rnd.randint(1, 40)), rnd.choice("aab")) for i in range(900)])
    due = in_training_order(plan_mix(docs)).select("doc_id").collect()
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 70)
    try:
        mix(docs).write.parquet(f"{tmp_path}/mixed")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    placed = training_places(spark.read.parquet(f"{tmp_path}/mixed")).collect()
    assert [r.doc_id for r in sorted(placed, key=lambda r: (r.train_part, r.train_row))] == [r.doc_id for r in due]

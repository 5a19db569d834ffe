import random

from pyspark.sql import functions as F

from eventloom.operators import posts as post_ops, ranking


def skewed(spark, n=3000, seed=1):
    """Rows (g, seq) of which group 0 holds a third; seq is unique and has gaps."""
    rng = random.Random(seed)
    numbers = rng.sample(range(n * 5), n)
    data = [(0 if rng.random() < 1 / 3 else rng.randint(1, 50), s) for s in numbers]
    return data, spark.createDataFrame(data, "g int, seq bigint").repartition(6)


def test_numbering_equals_sorting(spark):
    data, df = skewed(spark)
    want = {}
    for g in {g for g, _ in data}:
        for i, s in enumerate(sorted(s for h, s in data if h == g), 1):
            want[(g, s)] = i
    got = {(r.g, r.seq): r.row_no for r in ranking.number_rows(df, ["g"], "seq", block=100).collect()}
    assert got == want
    chunks = {(r.g, r.seq): r.chunk for r in ranking.chunk_id(df, ["g"], "seq", 5, block=100).collect()}
    assert chunks == {k: (i - 1) // 5 for k, i in want.items()}


def test_first_per_key_keeps_blank_keys(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("", 2), (None, 4), ("", 5), ("b", 6)], "k string, seq int")
    kept = {(r.k, r.seq) for r in ranking.drop_repeats(rows, ["k"], "seq", blank="k").collect()}
    assert kept == {("a", 1), ("", 2), (None, 4), ("", 5), ("b", 6)}


def test_first_n_limits_groups_before_the_shuffle(spark):
    data, df = skewed(spark)
    first = ranking.first_n(df, ["g"], [F.col("seq")], 20)
    want = set()
    for g in {g for g, _ in data}:
        want |= {(g, s) for s in sorted(s for h, s in data if h == g)[:20]}
    assert {(r.g, r.seq) for r in first.collect()} == want
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_next_date_takes_the_first_listed_of_equal_days(spark):
    rows = spark.createDataFrame(
        [([("2026-05-01", "10:00"), ("2026-06-20", "12:00"), ("2026-06-15", "19:30"), ("2026-06-15", "11:00")],)],
        "d array<struct<start_date:string,start_time:string>>",
    )
    found = rows.select(ranking.next_date(F.col("d"), F.lit("2026-06-01").cast("date")).alias("n")).collect()[0].n
    assert (found.start_date, found.start_time) == ("2026-06-15", "19:30")


def test_documents_skip_blank_posts(spark):
    rows = spark.createDataFrame(
        [(1, 1, "u1", " a "), (1, 2, "u2", "  "), (1, 3, "u3", "c"), (2, 1, "u4", " ")],
        "g int, n int, url string, text string",
    )
    docs = post_ops.assemble_posts(rows, ["g"], "n", 2).orderBy("chunk").collect()
    assert [d.document for d in docs] == ["=== POST u1 ===\na", "=== POST u3 ===\nc"]

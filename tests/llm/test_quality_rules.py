import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.llm.quality_rules import CUTOFFS, LEVEL, RISK, binomial_tail, cutoffs, judge_quality, measures

SCHEMA = "doc_id long, text string, lang string, kept string, n_words int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, t, lang in rows], SCHEMA).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures_against_plain_counts(spark):
    rnd = random.Random(6)
    texts = ["", None, " ", "\n\n", "a", "é🙂 ß", "a b c d e f g h " * 2, "a " * 30, "x\ny\nx\n \n \nx", "#*$%&|<> a|b", "\x0b\x0c\x1c a\x85b\xa0c"]
    for _ in range(120):
        unit = [rnd.choice("abcdefg") for _ in range(rnd.randint(1, 14))]
        texts.append("".join(rnd.choice([" ", "\n", "\t", " | "]) + w for _ in range(rnd.randint(1, 5)) for w in unit + [rnd.choice("xyz")]))
    texts.append("one two three " * 40_000)
    got = measures(frame(spark, [(i, t, "en") for i, t in enumerate(texts)]), "text", F.col("doc_id").alias("_id")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r._id]), texts[r._id]


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.1), (50, 3, 0.05), (2000, 8, 0.005), (5, 5, 0.3)])
def test_binomial_tail(spark, n, k, p):
    got = spark.createDataFrame([(n, k)], "n long, rejected long").select(binomial_tail("rejected", "n", p)).first()[0]
    assert got == pytest.approx(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)


def test_cutoffs_against_plain_selection(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(4000):
        share = rnd.random() ** 6 * 0.6
        words = ["word" if rnd.random() > share else "##" for _ in range(40)]
        rows.append((i, " ".join(f"{w}{k}" if w == "word" else w for k, w in enumerate(words)), "en" if i % 5 else None))
    docs = frame(spark, rows)
    stratum = F.coalesce(F.concat(F.lit("s"), "lang"), F.lit("t"))
    measured = measures(docs, "text", F.col("doc_id").alias("_id"), stratum.alias("_stratum"))
    good = spark.createDataFrame([(i,) for i in range(0, 4000) if i % 3], "_id long")
    got = {r._stratum: r for r in cutoffs(measured, good, risk=0.2).collect()}
    of = {"sen": [], "t": []}
    for i, text, lang in rows:
        if i % 3:
            m = plain(text)
            of["sen" if lang else "t"].append(m[2] / m[1])
    for stratum, shares in of.items():
        want = None
        for c in CUTOFFS["symbol_share"]:
            n, k, p = len(shares), sum(s > c for s in shares), 0.2 / len(CUTOFFS)
            if sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) * 2 * len(CUTOFFS) > LEVEL:
                break
            want = c
        assert got[stratum].max_symbol_share == want is not None
        assert sum(s > want for s in shares) <= 0.2 / len(CUTOFFS) * len(shares)


def test_good_documents_are_kept(spark):
    docs, held = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = judge_quality(docs, held).join(held.filter("quality = 1"), "doc_id").filter("not base_failed")
    kept, rows = got.agg(F.count_if("kept"), F.count(F.lit(1))).first()
    assert kept >= (1 - RISK) * rows - 3


def test_rows_without_labels_repeats_and_nulls(spark):
    long = " ".join(f"w{k}" for k in range(30))
    docs = frame(spark, [(1, long, "en"), (1, long, "en"), (None, long, None), (2, None, "de"), (3, "", "de"), (4, "#" * 50 + long, "fr")])
    got = judge_quality(docs, labels(spark, [(1, None, 0), (None, 1, 0), (77, 1, 1)])).collect()
    assert sorted((r.doc_id or 0, r.base_failed, r.kept) for r in got) == [
        (0, False, True), (1, False, True), (1, False, True), (2, True, False), (3, True, False), (4, False, True)]
    assert judge_quality(docs.limit(0), labels(spark, [(1, 1, 0)])).count() == 0


def test_sql_splits_at_every_ascii_space(spark, tmp_path):
    from checks.run import compare

    unit = "one\rtwo\x0bthree\x0cfour\tfive six\nseven eight "
    rows = [(1, unit * 4, "en"), (2, "a\rb\x0cc " * 10, "en"), (3, "\r\n\x0b\n x", None), (4, None, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").toPandas().to_parquet(tmp_path / "documents.parquet")
    labels(spark, [(1, 1, 0), (2, 1, 0)]).toPandas().to_parquet(tmp_path / "labels.parquet")
    result = compare(spark, str(tmp_path), ["op8_quality_rules"])["op8_quality_rules"]
    assert result.startswith("ok 4 rows"), result

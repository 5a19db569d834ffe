import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm.language_id import ORDER, held_out, identify, keep_identified, train

SCHEMA = "doc_id long, text string, lang string, kept string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, t, lang in rows], SCHEMA)


def plain_bits(training, text):
    """Code length by context dictionaries, byte by byte."""
    follow = defaultdict(Counter)
    for t in training:
        data = b"\n" * ORDER + t.encode()
        for i in range(ORDER, len(data)):
            for k in range(ORDER + 1):
                follow[data[i - k:i]][data[i]] += 1
    bits, data = 0.0, b"\n" * ORDER + text.encode()
    for i in range(ORDER, len(data)):
        for k in range(ORDER, -1, -1):
            seen = follow.get(data[i - k:i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / whole)
                break
            bits -= math.log2(len(seen) / whole)
        else:
            bits += 8
    return bits


def test_code_lengths_against_plain_trees(spark):
    training = {"aa": ["the cat sat on the mat", "a theory"], "bb": ["der hund saß auf der matte", "x"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in training.items() for t in ts)]
    model = train(frame(spark, rows))
    assert model.languages == ["aa", "bb"]
    texts = ["the hat", "der", "ß", "zzz\n\n\n\nthe", "x" * 50]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = model.code_lengths(data, offsets)
    want = [[plain_bits(training[lang], t) for lang in model.languages] for t in texts]
    assert np.allclose(got, want, atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs.filter(~held_out()))
    found = identify(docs, model, F.struct("doc_id", "lang")).filter(held_out("kept.doc_id")).collect()
    right = sum(r.lang_pred == r.kept.lang for r in found)
    assert len(found) > 300 and right >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_texts_without_letters_and_repeats(spark):
    rows = [(1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"),
            (3, None, "en"), (4, "", "de"), (5, "12 34 !", "en"), (None, "die katze", None), (6, "a", None)]
    docs = frame(spark, rows)
    model = train(docs)
    got = [(r.kept, r.lang_pred) for r in identify(docs, model, F.col("doc_id")).collect()]
    assert got == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "de"), (6, got[-1][1])]
    left = keep_identified(docs, model)
    assert left.columns == docs.columns and left.count() == 5


def test_long_text_in_pieces(spark):
    rows = [(1, "the cat and the dog ran to the sea ", "en"), (2, "der hund und die katze am see ", "de")]
    model = train(frame(spark, rows))
    long = frame(spark, [(9, rows[1][1] * 70_000, None), (10, rows[1][1], None)])
    got = {r.kept: r for r in identify(long, model, F.col("doc_id")).collect()}
    assert got[9].lang_pred == "de"
    whole = model.code_lengths(np.frombuffer((rows[1][1] * 70_000).encode(), np.uint8), np.array([0, len(rows[1][1]) * 70_000]))
    assert got[9].bits_per_byte == pytest.approx(whole.min() / (len(rows[1][1]) * 70_000), rel=1e-3)


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "words", None)])
    assert train(docs) is None
    assert identify(docs, None, F.col("doc_id")).first().lang_pred == "und"
    empty = frame(spark, [])
    assert train(empty) is None and keep_identified(empty, None).count() == 0


def test_languages_of_long_rows_only_are_learned(spark):
    long = "der hund und die katze am see " * 3_000
    rows = [(1, "the cat and the dog ran to the sea ", "en"), (2, long, "de"), (3, long * 20, "de"), (4, "x" * 70_000, "xx")]
    model = train(frame(spark, rows))
    assert model.languages == ["de", "en", "xx"]
    text = "die katze am see"
    got = model.code_lengths(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert got[0, 0] == pytest.approx(plain_bits([long], text), rel=1e-3)
    assert train(frame(spark, [(2, long * 20, "de")])).languages == ["de"]


def test_ids_that_repeat_lose_no_language(spark):
    rows = [(i, f"die katze {k}", f"de{k}") for k, i in enumerate([None, *range(12)]) for _ in range(40)]
    rows += [(i, "the same text", f"en{i}") for i in range(12) for _ in range(40)]
    assert len(train(frame(spark, rows), sample_rows=1).languages) == 25


def test_without_a_model_texts_with_a_letter_stay(spark):
    docs = frame(spark, [(1, "words", None), (2, "12 34", None), (3, None, None), (4, "é1", None)])
    assert [r.doc_id for r in keep_identified(docs, train(docs)).collect()] == [1, 4]

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from eventloom.llm import importance
from eventloom.llm.importance import cutoff, resample, word_buckets

SCHEMA = "doc_id long, text string, score string, n_features string, _row int, before int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA).repartition(3)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, target, percent=10, least=20):
    def bucket(w):
        return zlib.crc32(w.encode()) % 10000

    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for w in words(text):
                counts[bucket(w)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        found = [gain[bucket(w)] for w in words(text)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(eligible[:percent * len(eligible) // 100], 1):
        row.append(rank)
    return sorted(((*r, None)[:5] for r in out), key=repr)


def found(spark, rows, target, **options):
    benchmark = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    return sorted((tuple(r) for r in resample(frame(spark, rows), benchmark, **options).collect()), key=repr)


def made(n, seed):
    rnd = random.Random(seed)
    stock = [f"w{i}" for i in range(60)] + ["É", "ß9", "MiXed", "naïve"]
    return [" ".join(rnd.choice(stock) for _ in range(rnd.randrange(0, 60))) for _ in range(n)]


def test_against_plain_python(spark):
    rows = list(enumerate(made(300, 1)))
    rows += [(7, rows[7][1]), (None, rows[9][1]), (900, None), (901, ""), (902, "-- .."), (903, "A" * 200_000 + " b" * 200_000)]
    target = [*made(20, 2), None, ""]
    want = brute(rows, target)
    assert found(spark, rows, target) == want
    # Rounds of medians instead of one sort.
    assert found(spark, rows, target, finish_rows=5) == want


def test_every_cutoff(spark):
    rnd = random.Random(5)
    rows = [(-rnd.randrange(6), False, rnd.randrange(40), rnd.randrange(3), n) for n in range(150)] + [(-2, True, None, 1, 999)]
    keys = spark.createDataFrame(rows, "_neg long, _no_id boolean, _id long, n_features long, _row long").repartition(7)
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0, r[3], r[4]))
    for wanted in (1, 2, 40, 75, 76, 150, 151):
        assert tuple(cutoff(keys, wanted, finish_rows=3))[:5] == order[wanted - 1]
    assert cutoff(keys, 0) is None and cutoff(keys, 152) is None


def test_empty_tables(spark):
    assert found(spark, [], ["a b"]) == []
    assert found(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(importance, "PIECE_BYTES", 7)
    texts = ["ab cd ef", None, "x" * 50 + " yy zz", "", "É é 1", "tail"]
    found = {}
    for rows, data, offsets in importance._pieces(pa.array(texts)):
        got, bounds = word_buckets(data, offsets, 1 << 30)
        for k, row in enumerate(rows.tolist()):
            found.setdefault(row, []).extend(got[bounds[k]:bounds[k + 1]].tolist())
    for i, text in enumerate(texts):
        assert found.get(i, []) == [zlib.crc32(w.encode()) % (1 << 30) for w in words(text)]
    assert not len(word_buckets(np.zeros(0, np.uint8), np.array([0, 0]), 10)[0])

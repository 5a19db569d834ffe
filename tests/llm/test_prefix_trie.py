import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from eventloom.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, conv string, sha string, before int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(3)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in sorted(members, key=len, reverse=True):
        saves = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += saves
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items())


def found(spark, rows):
    out = trie.prefix_trie(frame(spark, rows))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in out.collect())


def test_against_plain_trie(spark):
    rnd, rows = random.Random(3), []
    stock = [("user", "hi"), ("assistant", "héllo"), ("user", ""), ("user", "x" * 30), ("tool", "a")]
    for c in rnd.sample(range(120), 70):
        shared = [stock[(c // 40 + i) % 5] for i in range(rnd.randrange(0, 11))]
        turns = shared + [rnd.choice(stock) for _ in range(rnd.randrange(0, 4))]
        rows += [(c, i, *turn) for i, turn in enumerate(turns or [stock[0]])]
    rows += [(500, i, "user", "same") for i in range(40)] + [(501, i, "user", "same") for i in range(45)]
    rnd.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, None, "a"), (1, 0, "user", None), (1, 0, "user", None), (2, 5, "user", "b"), (2, 5, "user", "c"), (None, 0, "user", "z"),
            (7, 0, "a", "bc"), (8, 0, "ab", "c")]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_blocks_of_ids_and_turns(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_BLOCK", 3)
    monkeypatch.setattr(trie, "TURN_BLOCK", 2)
    rows = [(c, t, "user", f"t{t}") for c in (0, 4, 5, 9, 10, 11, 12, 103, 1000) for t in range(5)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("texts", [["a" * 300_000, "b"]])
def test_long_texts(spark, texts):
    rows = [(c, t, "user", text) for c in (0, 5) for t, text in enumerate(texts)]
    assert found(spark, rows) == brute(rows)

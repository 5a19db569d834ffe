import random
import re

import pyarrow as pa
import pytest

from eventloom.llm import near_dedup
from eventloom.llm.components import components
from eventloom.llm.near_dedup import SMALL, drop_near_duplicates, near_duplicates
from eventloom.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, hash string, component int, _doc string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(4)


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    label[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def variants(rnd, base, n, changes):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, changes)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, width, percent):
    rnd = random.Random(width)
    texts = []
    for size, n, changes in ((120, 60, 8), (40, 12, 3), (400, 10, 20), (6, 5, 1)):
        base = [f"b{rnd.randrange(10**6)}" for _ in range(size)]
        texts += variants(rnd, base, n, changes)
    texts += [" ".join(f"u{rnd.randrange(10**6)}" for _ in range(50)) for _ in range(40)]
    texts += ["one", "ONE", "two words", "", None, " \t\n", "a b c", "A  b\nc", "é É x y z", texts[0], texts[0].upper()]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    assert len(texts) > 8 * SMALL
    got = near_duplicates(frame(spark, rows), width=width, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chain_and_kept_rows(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[s:s + 200]) for s in range(0, 200, 8)]  # each links with its neighbours only
    docs = frame(spark, [*enumerate(texts, 10), (10, texts[0]), (500, None), (501, ""), (None, "alone here")])
    found = {r.doc_id: r.component_id for r in near_duplicates(docs, width=3, percent=85).collect()}
    assert {found[i] for i in range(10, 35)} == {10} and found[500] == 500
    left = drop_near_duplicates(docs, width=3, percent=85)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 10, 500, 501]


def test_empty_table(spark):
    docs = frame(spark, [])
    assert near_duplicates(docs).count() == 0 and drop_near_duplicates(docs).count() == 0


def test_shingles_of_long_and_foreign_texts():
    texts = ["a b c " * 100_000 + "d", "ß ü ß ü", "x" * 300_000 + " y z", "A b C", "a B c", ""]
    sets = [s for _, sets in shingle_sets(pa.array(texts), 3) for s in sets]
    assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]
    assert sets[3].tolist() == sets[4].tolist() and sets[2].tolist() != sets[3].tolist()


def test_components_of_random_links(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 450)]
    label = {x: x for pair in links for x in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == {k: v for k, v in label.items() if k not in loops}
    assert len(got) == len({r.node for r in got})


def edited(rnd, base, n, least, most):
    """Copies with words replaced, dropped and put in at random places."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(least, most)):
            at = rnd.randrange(len(words))
            words[at:at + rnd.randrange(2)] = [f"w{rnd.randrange(10**6)}"] * rnd.randrange(2)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 85), (2, 5, 80), (3, 1, 50), (4, 3, 70)])
def test_groups_around_the_threshold(spark, seed, width, percent, monkeypatch):
    """Large buckets in which some members link with the hub, some with each other only and most with none."""
    monkeypatch.setattr(near_dedup, "SAMPLE", 20)
    rnd = random.Random(seed)
    base = [f"b{rnd.randrange(10**6)}" for _ in range(80)]
    texts = edited(rnd, base, 90, 0, 14)
    for _ in range(6):  # families that share an edit and come near each other
        texts += edited(rnd, rnd.choice(texts[:90]).split(), 14, 0, 7)
    texts += edited(rnd, base[:60], 30, 0, 6) + edited(rnd, base + base[:20], 30, 0, 6)
    rows = list(enumerate(texts))
    got = near_duplicates(frame(spark, rows), width=width, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width, percent)


def test_many_near_copies_under_the_threshold(spark):
    """2,000 texts that come near a common one and link with none, and a chain through them."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(2000):
        words = list(base)
        for at in rnd.sample(range(10, 150), 9):
            words[at] = f"w{i}x{at}"
        texts.append(" ".join(words))
    chain = texts[17].split()
    for k in range(12):  # each step moves one word on: neighbours link, the ends don't
        chain[k * 12 + 3] = f"c{k}"
        texts.append(" ".join(chain))
    got = near_duplicates(frame(spark, list(enumerate(texts))), width=3, percent=85)
    sizes = {}
    for r in got.collect():
        sizes.setdefault(r.component_id, set()).add(r.doc_id)
    large = [ids for ids in sizes.values() if len(ids) > 1]
    assert {17, *range(2000, 2012)} in large
    for i in {x for ids in large for x in ids} - {17, *range(2000, 2012)}:
        raise AssertionError(f"{i} is linked with {sizes}")


def test_rows_pass_with_and_without_a_table_of_bits(spark, monkeypatch):
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = list(enumerate(edited(rnd, base, 30, 0, 3) + [f"own text number {i}" for i in range(40)]))
    rows += [rows[3], rows[50], (None, "x y z"), (None, "x y z"), (900, None), (900, None)]
    one = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in drop_near_duplicates(frame(spark, rows)).collect())
    monkeypatch.setattr(near_dedup, "BIT_TABLE_KEYS", 0)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in drop_near_duplicates(frame(spark, rows)).collect()) == one
    least = {c for _, _, c in brute([r for r in rows if r[0] is not None], 5, 80)}
    assert {i for i, _ in one if i >= 0} == least and len(one) == len(least) + 1

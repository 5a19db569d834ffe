import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from checks.run import compare
from eventloom.llm.bpe import read_ranks
from eventloom.llm.mixing import mix
from eventloom.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_its_sql(spark, name):
    result = compare(spark, SF_DIR, [name])[name]
    assert result.startswith("ok" if name in SQL else "rows only"), result


def test_every_stage_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        outs.append((docs.collect(), spark.read.parquet(f"{tmp_path}/{name}")))
        docs = outs[-1][1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for before, after in outs[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = outs[0]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    before, after = outs[1]
    largest = {}
    for r in before:
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    assert sorted(r.doc_id for r in after.collect()) == sorted(largest.values())
    before, after = outs[2]
    sets = {}
    for r in before:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower() if r.text.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b]) if a < b else 0
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(label.values()))
    before, after = outs[3]
    size, source = {r.doc_id: len(r.text.split()) for r in before}, {r.doc_id: r.source for r in before}
    whole, weights = defaultdict(int), {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(set(source.values())))}
    for i, n in size.items():
        whole[source[i]] += n
    read = Counter(r.doc_id for r in after.collect())
    assert set(read.values()) <= {1, 2} and set(read) <= set(size)
    taken = defaultdict(int)
    for i, n in read.items():
        taken[source[i]] += n * size[i]
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < sum(max(size[i] for i in size if source[i] == s) for s in weights) / 2
    before, after = outs[4]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    texts = {r.doc_id: r.text for r in before}
    rows = after.collect()
    assert len(rows) == sum(read.values())
    order = sorted(rows, key=lambda r: (r.train_part, r.train_row))
    assert len({(r.train_part, r.train_row) for r in rows}) == len(rows)
    assert [r.doc_id for r in order] == [r.doc_id for r in mix(outs[3][1].sparkSession.read.parquet(f"{tmp_path}/near_dedup")).collect()]
    for r in rows:
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "train_part", "train_row"] and out.count() > 100

import base64
import hashlib
import json
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from eventloom.llm import token_counts
from eventloom.llm.bpe import Encoder, decode_ids, encode_documents, read_ranks
from eventloom.llm.token_counts import Counter, check_settings, count_tokens

RANK_FILE, TOKENIZER = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"))
RANKS = read_ranks(RANK_FILE)
ENCODER, COUNTER = Encoder(RANKS, public_tokenizers.PATTERN), Counter(TOKENIZER)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
LIBRARY = Tokenizer.from_file(TOKENIZER)

PARTS = st.sampled_from([*"abcdeghilmnorstuv", "the", " The", "'s", "'re", "'ve", "'ll", "'d", "'", " '", " ", "  ", "\t", "\n", "\r\n", "\x1c", "\x85",
                         "\xa0", "0", "12", "²", "١", ".", "!?", "--", "é", "ß", "中", "🙂", "ſ", "<|endoftext|>", "\u0301", "\u200b", "\x00"])
TEXTS = st.one_of(st.lists(PARTS, max_size=30).map("".join), st.text(max_size=30))


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_ids_and_decoding_as_the_library(text):
    ids = ENCODER.encode(text)
    assert ids == ",".join(map(str, TIKTOKEN.encode_ordinary(text)))
    assert ENCODER.decode(ids) == text.encode()


@settings(max_examples=600, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_counts_as_the_library(texts):
    want = [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert COUNTER.count(texts) == want


def test_long_pre_tokens():
    rnd = random.Random(1)
    for text in ("a" * 30_000, " " * 10_000, "-" * 9_000, "ab" * 9_000, "".join(rnd.choices("abcdefgh", k=60_000)), "ß" * 5_000):
        assert ENCODER.encode(text) == ",".join(map(str, TIKTOKEN.encode_ordinary(text)))
        assert COUNTER.count([text]) == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]


def test_small_caches_change_nothing(monkeypatch):
    texts = [" ".join(f"word{i}x{j}" for j in range(50)) for i in range(40)]
    want = COUNTER.count(texts)
    for name, size in (("KEPT_TRANSITIONS", 50), ("KEPT_PAIRS", 10), ("KEPT_COUNTS", 5), ("BATCH_CHARS", 300), ("CHUNK", 7)):
        monkeypatch.setattr(token_counts, name, size)
    assert Counter(TOKENIZER).count(texts) == want


def test_merges_of_equal_rank_go_from_the_left():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aab": 257, b"ab": 258}
    own = Encoder(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for n in range(1, 9):
        for k in range(2**n):
            text = "".join("ab"[k >> i & 1] for i in range(n))
            assert own.encode(text) == ",".join(map(str, library.encode_ordinary(text)))


@pytest.fixture
def docs(spark):
    rows = [(1, "a text", "x"), (1, "a text", "x"), (2, None, "x"), (3, "", None), (None, "ü" * 2000, None), (4, "<|endoftext|>", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_encoded_rows(docs):
    got = encode_documents(docs, RANK_FILE, public_tokenizers.PATTERN)
    for row, (text,) in zip(got.collect(), docs.select("text").collect()):
        ids = TIKTOKEN.encode_ordinary(text or "")
        assert (row.n_tokens, row.ids) == (len(ids), ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert [bytes(r.data).decode() for r in decode_ids(got, RANK_FILE).collect()] == [r.text or "" for r in docs.collect()]
    assert encode_documents(docs.limit(0), RANK_FILE, public_tokenizers.PATTERN).count() == 0


def test_counted_rows(docs):
    got = count_tokens(docs, TOKENIZER).collect()
    want = [len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    assert [r.n_tokens for r in got] == want and got[5].n_tokens == 1
    assert [r.n_bytes for r in got] == [6, 6, 0, 0, 4000, 13] and [r.over_limit for r in got] == [n > 1024 for n in want]
    assert count_tokens(docs.limit(0), TOKENIZER).count() == 0


def test_rank_file(tmp_path):
    file = tmp_path / "ranks"
    file.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)))
    assert read_ranks(str(file)) == {bytes([b]): b for b in range(256)}


@pytest.mark.parametrize("change", [
    lambda s: s.update(normalizer={"type": "Lowercase"}), lambda s: s.update(pre_tokenizer={"type": "Whitespace"}),
    lambda s: s["pre_tokenizer"].update(add_prefix_space=True), lambda s: s.update(pre_tokenizer=None),
    lambda s: s["pre_tokenizer"].update(use_regex=False), lambda s: s["model"].update(ignore_merges=True),
    lambda s: s["model"].update(dropout=0.1), lambda s: s["added_tokens"][0].update(lstrip=True), lambda s: s["model"].update(type="Unigram")])
def test_other_settings_are_refused(change):
    with open(TOKENIZER, encoding="utf-8") as file:
        spec = json.load(file)
    check_settings(spec)
    change(spec)
    with pytest.raises(ValueError, match="can't be followed"):
        check_settings(spec)

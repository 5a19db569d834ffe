"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The tokens of a pre-token form a linked list. For every merge rank there is a bucket of list positions
where that merge could be made, and a bitmap with one bit per bucket that isn't empty; above it stands a
bitmap of its words, so the least rank is found by one find-first-set on each of the two. Entries are never
removed: one whose pair has changed meanwhile is skipped when its turn comes. A pre-token of n bytes
takes n merges at most, with logarithmic work for each, however long it is.

Pre-tokens seen before are kept in a bounded table, since most text repeats them.

Nulls and ties: a null text counts as empty and has no tokens. Of merges of equal rank the leftmost
goes first. Rows that repeat each other get equal results. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import by_bytes, once_per_worker

#: Pre-tokens in each of a worker's two generations of known ones, and the length up to which they are kept.
KEPT, KEPT_CHARS = 250_000, 64


def _for_ascii(pattern: str) -> re.Pattern | None:
    """The pattern for texts of ASCII alone, by the standard library; None if it can't be put so."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in plain else re.compile(plain, re.ASCII)


class Encoder:
    """Encodes and decodes by the ranks of a vocabulary: bytes of a token -> its id, which is its merge rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.ascii = ranks, regex.compile(pattern), _for_ascii(pattern)
        self.words = [0] * ((max(ranks.values(), default=0) >> 8) + 1)  # the lower bitmap; zero between calls
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.tokens = {str(rank): token for token, rank in ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n == 1:
            raise KeyError(f"the vocabulary lacks byte {piece!r}")
        # Position i starts a token that ends where its successor starts. `pending` is the rank of its merge
        # with the successor, `buckets` the one position or the heap of positions of a rank. `words` has a
        # bit for each rank that has a bucket, `top` one for each word that isn't zero.
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pending = [-1] * (n + 1)
        get, words, buckets, top = ranks.get, self.words, {}, 0
        fresh = [(i, i + 2) for i in range(n - 1)]
        while True:
            for start, stop in fresh:
                pending[start] = rank = get(piece[start:stop], -1)
                if rank < 0:
                    continue
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = start
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
                elif bucket.__class__ is int:
                    buckets[rank] = [bucket, start] if bucket < start else [start, bucket]
                else:
                    heapq.heappush(bucket, start)
            i = -1
            while top:
                at = (top & -top).bit_length() - 1
                bits = words[at]
                low = bits & -bits
                rank = at << 8 | low.bit_length() - 1
                bucket = buckets[rank]
                if bucket.__class__ is int:
                    i = bucket
                    del buckets[rank]
                    words[at] = bits ^ low
                    if bits == low:
                        top ^= 1 << at
                else:
                    i = heapq.heappop(bucket)
                    if len(bucket) == 1:
                        buckets[rank] = bucket[0]
                if pending[i] == rank:
                    break
                i = -1  # stale
            if i < 0:
                break
            gone = after[i]
            end = after[i] = after[gone]
            pending[gone] = pending[i] = -1
            fresh = []
            if end < n:
                before[end] = i
                fresh.append((i, after[end]))
            if i:
                fresh.append((before[i], end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def _ids(self, piece: str) -> str:
        ids = self.older.get(piece)
        if ids is None:
            ids = ",".join(map(str, self.merge(piece.encode())))
            if len(piece) > KEPT_CHARS:
                return ids
        if len(self.known) >= KEPT:
            self.older, self.known = self.known, {}
        self.known[piece] = ids
        return ids

    def encode(self, text: str) -> str:
        """The ids of a text as decimal numbers joined by commas."""
        split = self.ascii if self.ascii is not None and text.isascii() else self.pattern
        ids = self._ids
        return ",".join([self.known.get(p) or ids(p) for p in split.findall(text)])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.split(","))) if ids else b""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def _encoder(path: str, pattern: str) -> Encoder:
    return once_per_worker(f"bpe:{path}:{pattern}", lambda: Encoder(read_ranks(path), pattern))


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _coder(path: str, pattern: str, with_ids: bool):
    def code(batches):
        encoder = _encoder(path, pattern)
        for batch in (part for whole in batches for part in by_bytes(whole, 1)):
            counts, hashes, decoded, lists = [], [], [], [np.zeros(0, np.int32)]
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text or "")
                counts.append(ids.count(",") + 1 if ids else 0)
                hashes.append(_sha256(ids.encode()))
                decoded.append(_sha256(encoder.decode(ids)))
                if with_ids and ids:
                    lists.append(np.fromstring(ids, np.int32, sep=","))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                ends = pa.array(np.cumsum([0, *counts]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists))))
            columns += batch.columns[2:]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return code


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: id, `n_tokens`, `ids_sha256`, `decoded_sha256`, if asked for the `ids`, and `carried` columns.

    `rank_file` must be readable at the same path on every executor.
    """
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *carried)
    fields = [T.StructField(id_col, df.schema["_id"].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    fields += df.schema.fields[2:]
    return df.mapInArrow(_coder(rank_file, pattern, with_ids), T.StructType(fields))


def decode_ids(encoded: DataFrame, rank_file: str, id_col: str = "doc_id") -> DataFrame:
    """Id and `data`, the bytes that a list of `ids` stands for."""
    def decode(batches):
        encoder = _encoder(rank_file, "")
        for batch in batches:
            data = [encoder.decode(",".join(map(str, ids or ()))) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["_id", "data"])

    df = encoded.select(F.col(id_col).alias("_id"), "ids")
    schema = T.StructType([df.schema["_id"], T.StructField("data", T.BinaryType())])
    return df.mapInArrow(decode, schema).withColumnRenamed("_id", id_col)

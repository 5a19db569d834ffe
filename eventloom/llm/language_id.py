"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree: counts of the bytes that followed every context of up to
`ORDER` bytes in its training texts. A byte seen in its longest context costs its share there; else an
escape (method C: as many escapes as the context has followers) is paid and the next shorter context
is asked, down to eight bits for a byte never seen. The sum over all bytes of a text is its exact code
length under the frozen counts, and the language with the shortest code is the prediction.

Trees are fitted on a bounded sample: of each language, the rows first in a seeded order, at most
`SAMPLE_ROWS` of them and `SAMPLE_BYTES` bytes together, from rows of at most `SAMPLE_ROW_BYTES`
bytes. A language whose rows are all longer is learned from its shortest, at least one, so that none is
left out. Counting runs in Spark; the sample's bound, or one row a language where that is longer, is the
bound of what is broadcast. Texts are scored whole.

Nulls and ties: a text that is null or has no letter is `und` with score 0, as is every text if there
is nothing to learn from; `keep_identified` then keeps all that have a letter. Equal code lengths go to the first language in code point order. Rows that
repeat each other get equal results. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import once_per_worker, seeded_hash

ORDER = 4
SAMPLE_ROWS = 400
SAMPLE_BYTES = 1_000_000
SAMPLE_ROW_BYTES = 65_536
SEED = 7
#: What stands before a text, so that its first bytes have contexts too.
_BEFORE = np.full(ORDER, 0x0A, np.uint8)
CHUNK_BYTES = 400_000


class _Rows:
    """Finds the rows of 64-bit keys: a hash table whose few colliding keys go to a further table."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray | None = None, level: int = 0):
        rows = np.arange(len(keys), dtype=np.int32) if rows is None else rows
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.times = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1) + 2 * level * 0x632BE5AB) % 2**64 | 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        at = (keys * self.times) >> self.shift
        self.slots[at] = np.arange(len(keys), dtype=np.int32)
        self.keys, self.rows = keys, rows
        lost = self.slots[at] != np.arange(len(keys))
        self.more = _Rows(keys[lost], rows[lost], level + 1) if lost.any() else None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for keys that are not there."""
        slot = self.slots[(keys * self.times) >> self.shift]
        taken = slot >= 0
        right = taken & (self.keys[slot] == keys) if len(self.keys) else taken
        out = np.where(right, self.rows[slot], -1) if len(self.keys) else slot
        if self.more is not None:
            other = np.flatnonzero(taken & ~right)
            out[other] = self.more.find(keys[other])
        return out


@dataclass
class Model:
    """`cost[m]`: bits of the last byte of each known string of m bytes; `leave[m]`: bits to leave each context of m bytes."""

    languages: list[str]
    strings: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    leave: list[np.ndarray]

    def __post_init__(self):
        self.find_string = [_Rows(k) for k in self.strings]
        self.find_context = [_Rows(k) for k in self.contexts]

    def plain(self) -> tuple:
        return self.languages, self.strings, self.cost, self.contexts, self.leave

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        lengths = np.diff(offsets)
        out = np.zeros((len(lengths), len(self.languages)))
        full = np.flatnonzero(lengths)
        if not len(full):
            return out
        shift = np.repeat(np.arange(1, len(lengths) + 1) * ORDER, lengths)
        where = np.arange(len(data)) + shift
        padded = np.full(len(data) + ORDER * (len(lengths) + 1), _BEFORE[0], np.uint64)
        padded[where] = data
        key = padded[where]
        for back in range(1, ORDER + 1):
            key |= padded[where - back] << np.uint64(8 * back)
        bits = np.zeros((len(data), len(self.languages)), np.float32)
        left = np.arange(len(data))
        for m in range(ORDER + 1, 0, -1):
            row = self.find_string[m].find(key)
            hit = row >= 0
            bits[left[hit]] += self.cost[m][row[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                break
            row = self.find_context[m - 1].find(key >> np.uint64(8))
            bits[left] += np.where((row >= 0)[:, None], self.leave[m - 1][row], np.float32(0))
            key &= np.uint64((1 << 8 * (m - 1)) - 1)
        bits[left] += np.float32(8)
        out[full] = np.add.reduceat(bits, offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def _counter(batches):
    """Counts of the byte strings of each length that end at each byte of a text."""
    found: dict[tuple[str, int], list[np.ndarray]] = {}
    held = 0

    def counted():
        for (lang, m), keys in found.items():
            strings, counts = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(strings)), pa.array(np.full(len(strings), m, np.int32)),
                 pa.array(strings.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "m", "string", "n"])
        found.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            whole = np.concatenate([_BEFORE, np.frombuffer(text.encode(), np.uint8)])
            # A long text by pieces, each with the bytes before it as context.
            for begin in range(0, len(whole) - ORDER, CHUNK_BYTES):
                data = whole[begin:begin + CHUNK_BYTES + ORDER].astype(np.uint64)
                key = np.zeros(len(data) - ORDER, np.uint64)
                for m in range(1, ORDER + 2):
                    key = key | data[ORDER + 1 - m:len(data) + 1 - m] << np.uint64(8 * (m - 1))
                    found.setdefault((lang, m), []).append(key)
                held += len(key)
                if held >= 4 * CHUNK_BYTES:
                    yield from counted()
                    held = 0
    yield from counted()


def _compile(languages: list[str], counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]) -> Model:
    k = len(languages)
    lengths = [np.zeros(0, np.uint64)], [np.zeros((0, k), np.float32)], [], []
    shorter = None
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for m in range(1, ORDER + 2):
        of = [counts.get((lang, m), none) for lang in languages]
        strings = np.unique(np.concatenate([s for s, _ in of]))
        n = np.zeros((len(strings), k))
        for i, (s, c) in enumerate(of):
            n[np.searchsorted(strings, s), i] = c
        contexts, within = np.unique(strings >> np.uint64(8), return_inverse=True)
        whole, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
        np.add.at(whole, within, n)
        np.add.at(kinds, within, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(whole > 0, -np.log2(kinds / (whole + kinds)), 0.0)
            own = -np.log2(n / (whole + kinds)[within])
        if m == 1:
            rest = np.full((len(strings), k), 8.0)
        else:
            rest = shorter[np.searchsorted(lengths[0][m - 1], strings & np.uint64((1 << 8 * (m - 1)) - 1))]
        shorter = np.where(n > 0, own, leave[within] + rest)
        for of_all, of_this in zip(lengths, (strings, shorter.astype(np.float32), contexts, leave.astype(np.float32))):
            of_all.append(of_this)
    return Model(languages, *lengths)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, seed: int = SEED) -> Model | None:
    """Context trees of the languages in `lang_col`; None if no row has a text and a language."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("_id"))
    rows = rows.filter("lang is not null and text is not null").withColumn("_bytes", F.octet_length("text")).filter("_bytes > 0")
    rows = rows.withColumn("_text_hash", F.xxhash64("text")).withColumn("_hash", seeded_hash(seed, "_id", "_text_hash"))
    # Rows late in the order are left out before anything moves: of each language a share of hashes
    # that holds three samples on average. The counts are one row for each language.
    # The row with the least hash always stays, should few hashes stand for many rows.
    short = F.col("_bytes") <= SAMPLE_ROW_BYTES
    counts = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(
        F.count(F.when(short, 1)).alias("n"), F.min(F.when(short, F.col("_hash"))).alias("least")).collect()}
    if not counts:
        return None
    shares = F.create_map(*[F.lit(x) for lang, (n, _) in counts.items() for x in (lang, min(1.0, 3 * sample_rows / max(1, n)))])
    least = F.create_map(*[F.lit(x) for lang, (_, first) in counts.items() for x in (lang, first or "")])
    early = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / 2**32
    order = Window.partitionBy("lang").orderBy("_hash", "_bytes", "_text_hash")
    chosen = rows.filter(short).filter((early <= shares[F.col("lang")]) | (F.col("_hash") == least[F.col("lang")]))
    chosen = chosen.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= sample_rows)
    if long := [lang for lang, (n, _) in counts.items() if not n]:
        # So many long rows fill the sample's bytes.
        most = min(sample_rows, sample_bytes // SAMPLE_ROW_BYTES + 1)
        shortest = Window.partitionBy("lang").orderBy("_bytes", "_hash", "_text_hash")
        chosen = chosen.union(rows.filter(F.col("lang").isin(long)).withColumn(
            "_rank", F.row_number().over(shortest)).filter(F.col("_rank") <= most))
    rows = chosen
    upto = Window.partitionBy("lang").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_bytes").over(upto)).filter((F.col("_sum") <= sample_bytes) | (F.col("_rank") == 1))
    counted = rows.select("lang", "text").mapInArrow(_counter, "lang string, m int, string long, n long")
    found = counted.groupBy("lang", "m", "string").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by([("lang", "ascending"), ("m", "ascending"), ("string", "ascending")])
    lang, m = found["lang"].to_numpy(zero_copy_only=False), found["m"].to_numpy()
    string, n = found["string"].to_numpy().astype(np.uint64), found["n"].to_numpy()
    languages = sorted(set(lang.tolist()), key=lambda x: x.encode())
    counts = {}
    for language in languages:
        for length in range(1, ORDER + 2):
            own = (lang == language) & (m == length)
            order_of = np.argsort(string[own])
            counts[language, length] = string[own][order_of], n[own][order_of]
    return _compile(languages, counts)


def _scorer(shared, name: str):
    def score(batches):
        parts = shared.value
        model = once_per_worker(f"language_id:{name}", lambda: Model(*parts)) if parts else None
        for batch in batches:
            letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            n = batch.num_rows
            best, sure = np.full(n, "und", object), np.zeros(n)
            per_byte = np.zeros(n)
            if model is not None and n:
                texts = batch.column(2).fill_null("").cast(pa.large_string())
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
                first = 0
                while first < n:
                    last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
                    bits = np.zeros((last - first, len(model.languages)))
                    for begin in range(int(offsets[first]), int(offsets[last]), 4 * CHUNK_BYTES) if last == first + 1 else ():
                        # A long text by pieces, each with the bytes before it as context.
                        end = min(begin + 4 * CHUNK_BYTES, int(offsets[last]))
                        lead = min(ORDER, begin - int(offsets[first]))
                        piece = data[begin - lead:end]
                        bits += model.code_lengths(piece, np.array([0, len(piece)])) - (
                            model.code_lengths(piece[:lead], np.array([0, lead])) if lead else 0)
                    if last > first + 1:
                        bits = model.code_lengths(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                    at = bits.argmin(1)
                    least = bits.min(1)
                    best[first:last] = np.array(model.languages, object)[at]
                    sure[first:last] = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1)
                    per_byte[first:last] = least / np.maximum(1, np.diff(offsets[first:last + 1]))
                    first = last
                best[~letters], sure[~letters], per_byte[~letters] = "und", 0, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(sure), pa.array(per_byte)],
                names=["kept", "lang_pred", "score", "bits_per_byte"])

    return score


def _has_letter(text_col: str) -> F.Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, keep, text_col: str = "text") -> DataFrame:
    """`kept` (the column `keep` of each row), `lang_pred`, `score` (its share among all languages) and `bits_per_byte`."""
    shared = docs.sparkSession.sparkContext.broadcast(model.plain() if model else None)
    df = docs.select(keep.alias("kept"), _has_letter(text_col).alias("_letter"), F.col(text_col).alias("_text"))
    schema = T.StructType([
        df.schema["kept"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("bits_per_byte", T.DoubleType())])
    return df.mapInArrow(_scorer(shared, uuid.uuid4().hex), schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the third of documents that is never learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that have a language, with all their columns; those with a letter if there is no model."""
    if model is None:
        return docs.filter(_has_letter(text_col))
    return identify(docs, model, F.struct("*"), text_col).filter("lang_pred <> 'und'").select("kept.*")

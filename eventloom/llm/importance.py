"""Importance resampling towards a target distribution of hashed words.

1. Words of all documents and of all target texts are counted in a fixed number of hash buckets. A
   bucket's gain is the floored logarithm of its smoothed share in the target over that in the documents.
2. The gains, one array of as many numbers as there are buckets, score every document: its weight is the
   floored mean gain of its words, and a Gumbel number drawn from its id makes the highest scores a sample.
3. The cutoff is found by weighted median of medians: every partition gives the median key of its
   remaining rows and their number, and the weighted median of these splits the remaining rows so that a
   quarter of them at least leaves. What is left in the end, `finish_rows` at most, is sorted.
4. Winners are range-sorted and numbered in blocks. No task holds all keys, and the driver sees one pivot
   a round.

Words are counted on the bytes of the texts, in pieces of bounded size: a text of any length needs the
memory of one piece, or of its longest word.

Nulls and ties: a null text has no words and weight 0; a null id is drawn like the text `null` and comes
after all others of its score. Equal scores go by smaller id, then by fewer words; rows that still tie repeat each
other and are interchangeable. Without eligible documents nothing is drawn. An empty table gives an empty
table; an empty target leaves the gains to the documents' own shares.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import cut, running

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
#: Remaining rows that are sorted instead of split once more.
FINISH_ROWS = 20_000
#: Bytes of text that are taken apart at once.
PIECE_BYTES = 2_000_000
#: Bytes of a word whose checksums are computed side by side; the rest of a longer word follows by itself.
SIDE_BY_SIDE = 32

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


_CRC = _crc_table()


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): whole texts together, or one piece of a long text, cut between words."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
        if last > first:
            yield np.arange(first, last), data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            first = last
            continue
        begin, end = int(offsets[first]), int(offsets[first + 1])
        while begin < end:
            stop = min(begin + PIECE_BYTES, end)
            while stop < end and _IN_WORD[data[stop]]:
                stop += 1
            yield np.array([first]), data[begin:stop], np.array([0, stop - begin])
            begin = stop
        first += 1


def word_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word in order, and where each text's words begin (one entry more than texts)."""
    solid = np.concatenate([[False], _IN_WORD[data], [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), bounds
    low, lengths = _LOWER[data], ends - starts
    order = np.argsort(-lengths, kind="stable")
    begins, sizes = starts[order], lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(sizes[0]), SIDE_BY_SIDE)):
        n = int(np.searchsorted(-sizes, -k, "left"))
        part = crc[:n]
        crc[:n] = _CRC[(part ^ low[begins[:n] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-sizes, -SIDE_BY_SIDE, "left"))):
        crc[i] = zlib.crc32(low[begins[i] + SIDE_BY_SIDE:begins[i] + sizes[i]], int(crc[i]))
    out = np.empty(len(order), np.int64)
    out[order] = crc % np.uint32(buckets)
    return out, bounds


def _counter(buckets: int):
    def count(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in _pieces(batch.column(0)):
                counts += np.bincount(word_buckets(data, offsets, buckets)[0], minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) for the buckets that any word of the texts falls in; partitions count before the shuffle."""
    counted = texts.select(F.col(text_col).alias("_text")).mapInArrow(_counter(buckets), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str, target_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; one small row for each bucket reaches the driver."""
    mine, theirs = bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets)
    rows = mine.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(
        theirs.select("bucket", F.lit(0).cast("long"), "n"))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in rows.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[row.bucket], t[row.bucket] = row.s, row.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _scorer(gains: np.ndarray):
    def score(batches):
        for batch in batches:
            sums, counts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for rows, data, offsets in _pieces(batch.column(1)):
                found, bounds = word_buckets(data, offsets, len(gains))
                upto = np.concatenate([[0], np.cumsum(gains[found])])
                sums[rows] += upto[bounds[1:]] - upto[bounds[:-1]]
                counts[rows] += np.diff(bounds)
            weights = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(weights)], names=["_id", "n_features", "weight"])

    return score


def gumbel(seed: int, key: Column) -> Column:
    """A floored Gumbel number, in thousandths, drawn from a key."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    high = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((high + 0.5) / F.lit(4294967296.0)))).cast("long")


#: The order of winners: descending score, ascending id with null last, fewer words, the row.
KEY = ["_neg", "_no_id", "_id", "n_features", "_row"]


def _medians(names: list[str]):
    def median(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).select(names)
        order = pc.sort_indices(rows, sort_keys=[(n, "ascending") for n in names])
        middle = rows.take(order.slice((rows.num_rows - 1) // 2, 1))
        yield middle.append_column("size", pa.array([rows.num_rows], pa.int64())).combine_chunks().to_batches()[0]

    return median


def _upto(row) -> Column:
    """Whether a key comes no later than that of a collected row."""
    out = F.lit(True)
    for name in reversed(KEY):
        value = F.lit(row[name])
        if row[name] is None:  # null ids are all alike
            continue
        out = (F.col(name) < value) | (F.col(name).eqNullSafe(value) & out)
    return out


def cutoff(keys: DataFrame, wanted: int, finish_rows: int = FINISH_ROWS):
    """The row that is the `wanted`-th in key order, or None if there are fewer or none is wanted."""
    keys = keys.select(*KEY)
    remaining = written = keys.count()
    if wanted < 1 or wanted > remaining:
        return None
    medians = T.StructType([*keys.schema.fields, T.StructField("size", T.LongType())])
    while remaining > finish_rows:
        # One row for each partition; the pivot is the first median with half of all rows up to it.
        order = [F.col(name) for name in KEY]
        upto = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        weighed = keys.mapInArrow(_medians(KEY), medians).withColumn("_upto", F.sum("size").over(upto))
        pivot = weighed.filter(F.col("_upto") * 2 >= remaining).orderBy(*order).first()
        below = keys.filter(_upto(pivot)).count()
        if below == wanted:
            return pivot
        if below > wanted:
            if below == remaining:
                break  # the pivot is the last key of a few: they are sorted
            keys, remaining = keys.filter(_upto(pivot)), below
        else:
            keys, remaining, wanted = keys.filter(~_upto(pivot)), remaining - below, wanted - below
        if remaining * 2 <= written:
            keys, written = cut(keys), remaining
    return keys.orderBy(*KEY).limit(wanted).orderBy(*[F.col(n).desc() for n in KEY]).first()


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS,
             finish_rows: int = FINISH_ROWS) -> DataFrame:
    """One row per row of `docs`: id, `n_features`, `weight`, `score`, `rank` (null if not drawn).

    Of the documents with `min_words` words or more, `percent` in a hundred are drawn.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    gains = bucket_gains(texts, target, "_text", target_col, buckets)
    schema = T.StructType([texts.schema["_id"], T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    scored = texts.mapInArrow(_scorer(gains), schema)
    scored = scored.withColumn("score", F.col("weight") + gumbel(seed, F.col("_id"))).withColumns({
        "_neg": -F.col("score"), "_no_id": F.col("_id").isNull(), "_row": F.monotonically_increasing_id()})
    scored = cut(scored)
    eligible = scored.filter(F.col("n_features") >= min_words)
    wanted = eligible.count() * percent // 100
    last = cutoff(eligible, wanted, finish_rows)
    out = [F.col("_id").alias(id_col), "n_features", "weight", "score"]
    nothing = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select(*out, nothing)
    won = (F.col("n_features") >= min_words) & _upto(last)
    winners = scored.filter(won).repartitionByRange(*KEY).withColumn("_part", F.spark_partition_id())
    ranked = running(cut(winners), [], F.col("_part"), [F.col(n) for n in KEY], F.lit(1).cast("long"))
    return ranked.select(*out, (F.col("before") + 1).alias("rank")).unionAll(scored.filter(~won).select(*out, nothing))

"""Word shingles of whole texts as 64-bit hashes, computed on Arrow buffers without a Python string per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK_BYTES = 2_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random64(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 40)) * np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = random64(256, 1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z
_BYTE[_SPACE] = 0
_PLACE = {"weights": random64(1 << 12, 2) | np.uint64(1)}
_IN_SHINGLE = random64(64, 3) | np.uint64(1)


def _weights(n: int) -> np.ndarray:
    if len(_PLACE["weights"]) < n:
        _PLACE["weights"] = random64(2 * n, 2) | np.uint64(1)
    return _PLACE["weights"]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one entry more than texts)."""
    solid = ~_SPACE[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:len(data)] = ~solid[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(solid & fresh[:-1])
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    lengths = np.diff(np.append(starts, len(data)))
    begin = int(starts[0])
    place = np.arange(begin, len(data)) - np.repeat(starts, lengths)
    hashes = np.add.reduceat(_BYTE[data[begin:]] * _weights(int(lengths.max()))[place], starts - begin)
    return mix64(hashes), bounds


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) for runs of rows.

    A text with fewer words than `width` has its whole sequence as its one shingle; one without words has none.
    """
    for first, data, offsets in _chunks(texts):
        words, bounds = _word_hashes(data, offsets)
        counts = np.diff(bounds)
        full = np.zeros(0, np.uint64)
        if len(words) >= width:
            n = len(words) - width + 1
            full = words[:n] * _IN_SHINGLE[0]
            for j in range(1, width):
                full = full + words[j:j + n] * _IN_SHINGLE[j]
            full = mix64(full)
        sets = []
        for at, n in zip(bounds.tolist(), counts.tolist()):
            if n >= width:
                own = np.sort(full[at:at + n - width + 1])
                fresh = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                sets.append(own[fresh])
            elif n:
                whole = (words[at:at + n] * _IN_SHINGLE[:n]).sum(dtype=np.uint64) + np.uint64(n)
                sets.append(mix64(np.array([whole])))
            else:
                sets.append(full[:0])
        yield first, sets

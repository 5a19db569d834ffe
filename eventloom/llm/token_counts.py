"""Token counts by finite-state transducers.

Two machines count the tokens of byte-level BPE without making them.

* The pre-tokenizer is a deterministic transducer over twelve classes of characters; its output marks
  where pre-tokens begin. A batch is cut into chunks, the state map of every chunk (from each state it
  may begin in to the state it ends in) is found for all chunks at once, the maps are composed by a
  parallel prefix scan, and then all chunks run from the states they really begin in.
* The merges are compiled into a transducer over bytes, built as far as texts need it. A state holds
  what a later token may still reach back to: for each suffix that begins some token, the last token
  of the encoding before it and how many tokens that takes. A transition carries the number of tokens
  it adds, which may be negative when pieces merge; their sum over a pre-token is its token count.

The second machine rests on a property of BPE: a sequence of tokens is the encoding of its bytes if every
two neighbours are. So the last token of a prefix is the one token that ends it and
goes with the last token before.

Strings of special tokens in a text count as one token each, as the library does by default. A file with
settings that the machines don't follow (a normalizer, another pre-tokenizer, dropout, merges ignored for whole
words, special tokens that strip) is refused with a ValueError, not counted wrongly.

Nulls and ties: a null text counts as empty and has no tokens. Rows that repeat each other get equal
results. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import by_bytes, once_per_worker

#: Characters that are scanned at once, and characters in a chunk of the scan.
BATCH_CHARS, CHUNK = 1_000_000, 256
#: What a worker keeps of transitions, neighbours and, in each of two generations, counts of pre-tokens.
KEPT_TRANSITIONS, KEPT_PAIRS, KEPT_COUNTS = 700_000, 300_000, 300_000

# Classes of characters.
OTHER, LETTER, NUMBER, BLANK, WHITE, QUOTE, ONE, R, E, V, L, END = range(12)
# States: at a boundary, in a run of letters, numbers or others, after one or several white characters
# that end in a blank or not, after a quote that may begin a contraction, and within one of three.
_START, _IN_L, _IN_N, _IN_O, _BLANK1, _WHITE1, _BLANKS, _WHITES, _QUOTED, _QR, _QV, _QL = range(12)
_HERE, _BACK = 1, 2  # a pre-token begins at this character, at the one before

_LETTERS = {LETTER, ONE, R, E, V, L}


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for (state, class)."""
    states, out = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)

    def fresh(c: int) -> int:
        """The state after a pre-token's first character."""
        if c in _LETTERS:
            return _IN_L
        return {NUMBER: _IN_N, OTHER: _IN_O, QUOTE: _QUOTED, BLANK: _BLANK1, WHITE: _WHITE1, END: _START}[c]

    for s in range(12):
        for c in range(12):
            go, say = fresh(c), _HERE
            run = _IN_L if c in _LETTERS else {NUMBER: _IN_N, OTHER: _IN_O, QUOTE: _IN_O}.get(c)
            white = c in (BLANK, WHITE)
            if s in (_IN_L, _IN_N, _IN_O) and run == s:
                go, say = s, 0
            elif s in (_BLANK1, _WHITE1) and white or s in (_BLANKS, _WHITES) and white:
                go, say = (_BLANKS if c == BLANK else _WHITES), 0
            elif s == _BLANK1 and run is not None:
                go, say = run, 0
            elif s == _BLANKS and run is not None:
                go, say = run, _BACK
            elif s == _WHITES and run is not None:
                go, say = fresh(c), _BACK | _HERE
            elif s == _QUOTED and c in (ONE, R, V, L):
                go, say = {ONE: _START, R: _QR, V: _QV, L: _QL}[c], 0
            elif s == _QUOTED and c in (OTHER, QUOTE):
                go, say = _IN_O, 0
            elif s in (_QR, _QV, _QL):
                if c == (L if s == _QL else E):
                    go, say = _START, 0
                elif c in _LETTERS:
                    go, say = _IN_L, _BACK
                else:
                    go, say = fresh(c), _BACK | _HERE
            if c == END:
                # Nothing begins here, but a quote and a lone letter part at the end too.
                go, say = _START, (_BACK if s in (_QR, _QV, _QL) else 0) | _HERE
            states[s, c], out[s, c] = go, say
    return states, out


_NEXT, _SAYS = _machine()
_STATES = np.arange(12, dtype=np.uint8)
_WHITESPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    of = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        of[point] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    of[_WHITESPACE] = WHITE
    of[0x20], of[0x27] = BLANK, QUOTE
    of[[ord(c) for c in "stmd"]] = ONE
    of[ord("r")], of[ord("e")], of[ord("v")], of[ord("l")] = R, E, V, L
    return of


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in characters of these classes; texts are ended by END."""
    n = len(classes)
    width = min(CHUNK, max(1, n))
    chunks = -(-n // width)
    padded = np.full(chunks * width, END, np.uint8)
    padded[:n] = classes
    table = padded.reshape(chunks, width).T.copy()
    maps = np.broadcast_to(_STATES, (chunks, 12)).copy()
    flat = _NEXT.ravel()
    for column in table:
        maps = flat[maps * np.uint8(12) + column[:, None]]
    # Inclusive prefix scan: after it, row i maps a state before the first chunk to that after chunk i.
    step = 1
    while step < chunks:
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps[step:] = later
        step *= 2
    state = np.empty(chunks, np.uint8)
    state[0] = _START
    state[1:] = maps[:-1, _START]
    said, says = np.empty((width, chunks), np.uint8), _SAYS.ravel()
    for j, column in enumerate(table):
        at = state * np.uint8(12) + column
        said[j] = says[at]
        state = flat[at]
    said = said.T.ravel()[:n]
    begins = (said & _HERE).astype(bool)
    begins[:-1] |= (said[1:] & _BACK).astype(bool)
    return begins


#: Added to the tokens a transition adds, which may be below zero, to store them beside the next state.
_ZERO = 1 << 19


class Transducer:
    """Counts the tokens of pre-tokens; states and transitions are made when first needed."""

    def __init__(self, vocabulary: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]):
        self.tokens, self.merges = {token: token for token in vocabulary}, merges
        self.prefixes = {token[:i] for token in vocabulary for i in range(len(token) + 1)}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        # A state is the longest suffix that begins a token, and for it and each shorter such suffix: its
        # length, the last token before it (None at the beginning), and the tokens up to it less all so far.
        start = (b"", 0, None, 0)
        self.states, self.numbers = [start], {start: 0}
        self.go: dict[int, int] = {}

    def encode(self, data: bytes) -> list[bytes]:
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            least, at = min((self.merges.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if least == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _neighbours(self, left: bytes | None, right: bytes) -> bool:
        """Whether both tokens stand side by side in the encoding of their bytes."""
        if left is None:
            left = b""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.encode(left + right) == [t for t in (left, right) if t]
        return known

    def _transition(self, state: int, byte: int) -> int:
        marks = self.states[state]
        longer = marks[0] + bytes([byte])
        size = len(longer)
        for i in range(1, len(marks), 3):  # longest suffix first
            token = self.tokens.get(longer[size - 1 - marks[i]:])
            if token is not None and self._neighbours(marks[i + 1], token):
                break
        else:
            raise ValueError(f"no token ends in byte {byte}")
        added = marks[i + 2] + 1
        new, longest = [], 0
        for i in range(1, len(marks), 3):
            length = marks[i] + 1
            if longer[size - length:] in self.prefixes:
                longest = max(longest, length)
                new += (length, marks[i + 1], marks[i + 2] - added)
        new = (longer[size - longest:], *new, 0, token, 0)
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        self.go[state << 8 | byte] = step = number << 20 | added + _ZERO
        return step

    def count(self, pre_token: bytes) -> int:
        if len(self.go) >= KEPT_TRANSITIONS:
            self.reset()
        state = total = 0
        go = self.go
        for byte in pre_token:
            step = go.get(state << 8 | byte) or self._transition(state, byte)
            state = step >> 20
            total += (step & 0xFFFFF) - _ZERO
        return total


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def check_settings(spec: dict) -> None:
    """Raise ValueError if a tokenizer file asks for anything but plain byte-level BPE."""
    model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    off = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    unread = [f"model.{name}" for name in off if model.get(name)]
    if model.get("type", "BPE") != "BPE":
        unread.append("model.type")
    if spec.get("normalizer"):
        unread.append("normalizer")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True):
        unread.append("pre_tokenizer")
    unread += sorted({
        f"added_tokens.{name}" for token in spec.get("added_tokens") or () for name in ("single_word", "lstrip", "rstrip") if token.get(name)})
    if unread:
        raise ValueError(f"tokenizer settings that can't be followed: {', '.join(unread)}")


class Counter:
    """Counts tokens as the library that reads `path` does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        check_settings(spec)
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        special = [t["content"] for t in spec.get("added_tokens", ())]
        vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.machine = Transducer(vocabulary, {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)})
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.classes = _classes()
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def _count(self, pre_token: bytes) -> int:
        n = self.older.get(pre_token)
        if n is None:
            n = self.machine.count(pre_token)
            if len(pre_token) > 64:
                return n
        if len(self.known) >= KEPT_COUNTS:
            self.older, self.known = self.known, {}
        self.known[pre_token] = n
        return n

    def _counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece of plain text, which together are one batch."""
        text = "\n".join(pieces)  # the line feed is made an END below
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        classes = np.append(self.classes[points], np.uint8(END))
        classes[ends] = END
        begins = boundaries(classes)
        begins[ends] = True
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(size)])
        where = np.flatnonzero(begins)
        starts = at[where]
        raw, count = data.tobytes(), self._count
        counts = np.zeros(len(where), np.int64)
        is_end = np.zeros(len(begins), bool)
        is_end[ends] = True
        solid = np.flatnonzero(~is_end[where])
        words = [raw[s:e] for s, e in zip(starts[solid].tolist(), starts[solid + 1].tolist())]
        counts[solid] = [self.known.get(w) or count(w) for w in words]
        sums = np.concatenate([[0], np.cumsum(counts)])
        upto = sums[np.searchsorted(where, ends)]
        return np.diff(upto, prepend=0)

    def count(self, texts: list[str]) -> list[int]:
        pieces, owner, out = [], [], [0] * len(texts)
        pending = 0

        def flush() -> None:
            nonlocal pending
            if pieces:
                for i, n in zip(owner, self._counts(pieces).tolist()):
                    out[i] += n
            pieces.clear()
            owner.clear()
            pending = 0

        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            out[i] += len(parts) - 1
            for part in parts:
                if part:
                    pieces.append(part)
                    owner.append(i)
                    pending += len(part)
            if pending >= BATCH_CHARS:
                flush()
        flush()
        return out


def _counting(path: str, limit: int):
    def count(batches):
        counter = once_per_worker(f"token_counts:{path}", lambda: Counter(path))
        for batch in (part for whole in batches for part in by_bytes(whole, 2)):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            tokens = np.array(counter.count(texts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens), pa.array(tokens > limit)],
                names=["_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """One row per row of `docs`: id, `n_bytes`, `n_tokens`, `over_limit`.

    `tokenizer_file` must be readable at the same path on every executor.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    schema = T.StructType([
        df.schema["_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType())])
    return df.mapInArrow(_counting(tokenizer_file, limit), schema).withColumnRenamed("_id", id_col)

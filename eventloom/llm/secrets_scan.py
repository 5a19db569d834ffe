"""Secret scans through nested encodings.

A worklist holds layers of a text, the text itself first. Each layer is scanned for secrets, and what
it hides is unwrapped into further layers: percent escapes, Unicode and character-reference escapes,
base64 runs, also wrapped over lines, and compressed bytes (gzip, zlib, bzip2, xz, zstd) inside these. What
stands before a run may be glued to it (a path, a name and a dash), so a run is decoded from each of its first
four characters, and packed streams are opened wherever they begin in decoded or unpacked bytes. A layer of which the same
place has already given the same content is not taken again, so that the work ends at a fixpoint.
Spans found in a layer are mapped back to the original text: exactly through escapes and base64 of
ASCII, else to the whole run they came from. Bytes that are no text are scanned as Latin-1 and as
UTF-16; such a layer counts in `n_layers` if it holds a secret.

Every layer is opened. The layers are walked depth first, and each is cut at characters that no secret
and no run, in this layer or one decoded from it, can cross: an escape's layer is the part between two
such places, and an unpacked stream is read in windows of about `WINDOW` bytes that end there. Memory
thus follows the depth and the longest stretch without such a place, not the size of what is unpacked; a
packed stream inside another waits in a temporary file once it is larger than a window. Only a caller
sets a limit on unpacked bytes; streams it stops, and those that break off, count in `n_unopened`.

Nulls and ties: a null text counts as empty and has no spans. The same span found twice counts once.
Rows that repeat each other get equal results. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import io
import itertools
import lzma
import re
import tempfile
import zlib
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .common import by_bytes

KINDS = ("assign", "access", "hex")
WINDOW = 1 << 22
_READ = 1 << 16

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of hex digits is as long as it can be, so only runs of enough digits need be looked for.
_HEX = re.compile(r"[0-9a-f]{32,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPES = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+"
    r"|\\[\"'/]|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|apos|amp|equals|colon|lowbar|period|sol|plus);")
_NO_UTF8 = re.compile("[\udc80-\udcff]")
# ASCII in UTF-16 of either order.
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){8,}[\t\n\r\x20-\x7e]?|(?:\x00[\t\n\r\x20-\x7e]){8,}")
# The shortest secret, or what hides one, in bytes that are no text.
_SHORTEST = 14
_LEGIBLE = re.compile(rb"[\t\n\r\x20-\x7e]{%d}" % _SHORTEST)
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# A line of base64 after another; only the last of a run can be short.
_NEXT_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
# What no secret and no run crosses, however it is decoded: characters that stand in none of the patterns, and
# the space between a word without escapes and a letter or digit.
_BREAK = re.compile(r"""[^A-Za-z0-9+/_.=\-"':%\\&#;{}\t\n\r\x20]|(?<=[\t\n\r\x20])[A-Za-z0-9.]+\x20(?=[A-Za-z0-9])""")
# The same in bytes: outside of ASCII only before a byte that can begin a character, and zeros, which stand
# between the letters of UTF-16, only in pairs.
_BYTE_BREAK = re.compile(
    rb"""[\x01-\x08\x0b\x0c\x0e-\x1f!$()*,<>?@\[\]^`|~\x7f]|\x00\x00|(?=[\xc0-\xff])|(?<=[\t\n\r\x20])[A-Za-z0-9.]+\x20(?=[A-Za-z0-9])""")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of secrets that stand in a text as it is."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


class _Layer:
    """A decoded text and where its parts come from in its parent."""

    def __init__(self, content: str, parent: _Layer | None = None, pieces=(), run=None, exact=False, raw=False):
        self.content, self.parent, self.run, self.exact, self.raw = content, parent, run, exact, raw
        # (start here, start in parent, end in parent, whether offsets inside move alike)
        self.pieces = pieces
        self.starts = [p[0] for p in pieces]

    def above(self, index: int) -> int:
        """Where a character of joined pieces stands in the parent."""
        piece = self.pieces[bisect_right(self.starts, index) - 1]
        return piece[1] + index - piece[0]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            if layer.run is not None:
                first, last = layer.run
                if layer.exact:
                    start, end = first + start * 4 // 3, min(last, first + -(-end * 4 // 3))
                else:
                    start, end = first, last
            elif layer.pieces:
                a = layer.pieces[bisect_right(layer.starts, start) - 1]
                b = layer.pieces[bisect_right(layer.starts, end - 1) - 1]
                start = a[1] + start - a[0] if a[3] else a[1]
                end = b[1] + end - b[0] if b[3] else b[2]
            layer = layer.parent
        return start, end


def _decoded(data: bytes) -> str:
    """Bytes as UTF-8, and as Latin-1 where they are none."""
    return _NO_UTF8.sub(lambda m: chr(ord(m[0]) - 0xDC00), data.decode("utf-8", "surrogateescape"))


def _percent(run: str) -> str:
    return _decoded(binascii.unhexlify(run.replace("%", "")))


def _escape(run: str) -> str | None:
    try:
        if run.startswith("\\u{"):
            return chr(int(run[3:-1], 16))
        if run.startswith("\\u"):
            return b"".join(bytes.fromhex(h) for h in run.split("\\u")[1:]).decode("utf-16-be", "surrogatepass")
        if run.startswith("\\U"):
            return chr(int(run[2:], 16))
        if run.startswith("\\x"):
            return _decoded(bytes.fromhex(run.replace("\\x", "")))
        if run[0] == "\\":
            return run[1]
        if run[1] != "#":
            return html.unescape(run)
        return chr(int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1]))
    except (ValueError, OverflowError):
        return None


def _replaced(layer: _Layer, pattern: re.Pattern, decode):
    """Layers with every run of a pattern decoded, each the part of the text around runs that no break parts."""
    text = layer.content
    parts, pieces, at, here = [], [], 0, 0

    def add(part: str, end: int, alike: bool) -> None:
        nonlocal at, here
        if part:
            parts.append(part)
            pieces.append((here, at, end, alike))
            here += len(part)
        at = end

    for m in pattern.finditer(text):
        plain = decode(m[0])
        if not plain or plain == m[0]:
            continue
        breaks = _BREAK.finditer(text, at, m.start())
        if first := next(breaks, None):
            if pieces:
                add(text[at:first.end()], first.end(), True)
                yield _Layer("".join(parts), layer, pieces)
            parts, pieces, at, here = [], [], first.end(), 0
            for last in breaks:
                at = last.end()
        add(text[at:m.start()], m.start(), True)
        add(plain, m.end(), False)
    if pieces:
        last = _BREAK.search(text, at)
        end = last.end() if last else len(text)
        add(text[at:end], end, True)
        yield _Layer("".join(parts), layer, pieces)


def _wrapped(text: str, runs: list[tuple[int, int]]):
    """Lists of consecutive lines of base64 that may be one run.

    Lines of one width and a shorter one after them are taken together, also with the line before them,
    which may begin within a line; and all lines that follow each other, with and without the first,
    which may be a heading.
    """
    i = 0
    while i < len(runs):
        block = [runs[i]]
        i += 1
        while text[block[-1][1] - 1] != "=" and (m := _NEXT_LINE.match(text, block[-1][1])):
            if i < len(runs) and runs[i][0] == m.start(1):
                block.append(runs[i])
                i += 1
            else:
                block.append(m.span(1))
                break
        if len(block) == 1:
            continue
        found = {(0, len(block)), (1, len(block))}
        width = [e - s for s, e in block]
        first = 0
        while first < len(block):
            last = first + 1
            while last < len(block) and width[last] == width[first]:
                last += 1
            end = last + 1 if last < len(block) and width[last] < width[first] else last
            found |= {(first, end), (max(0, first - 1), end)}
            first = last
        yield from (block[a:b] for a, b in sorted(found) if b - a > 1)


def _joined_lines(layer: _Layer, lines: list[tuple[int, int]]) -> _Layer:
    """Lines of a layer as one run."""
    parts, pieces, here = [], [], 0
    for start, end in lines:
        parts.append(layer.content[start:end])
        pieces.append((here, start, end, True))
        here += end - start
    return _Layer("".join(parts), layer, pieces)


def _opener(head: bytes):
    """Makes a decompressor for a stream with these first bytes; None if they begin none."""
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if len(head) > 2 and head[0] & 0x8F == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return lambda: zstandard.ZstdDecompressor().decompressobj()
    return None


_MARKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
# The same, and two bytes that may begin a zlib stream.
_STREAM = re.compile(_MARKED.pattern + rb"|[\x08\x18\x28\x38\x48\x58\x68\x78][\x00-\xff]", re.DOTALL)
_LONGEST_MARK = 10
_SKIPPED = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18.{4}", re.DOTALL)
_BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError)


def _zlib_begins(data: bytes, at: int) -> bool:
    """Whether two bytes that look like a zlib header are followed by what can be its stream."""
    if len(data) - at < 8 or (data[at] << 8 | data[at + 1]) % 31:
        return False
    try:
        zlib.decompressobj().decompress(data[at:at + 128], 64)
    except zlib.error:
        return False
    return True


class _Unpacked:
    """The bytes that a file unpacks to from some place on, in chunks; `broken` if it can't be read to its end."""

    def __init__(self, packed, start: int = 0):
        self.packed, self.start, self.broken, self.size, self.rest = packed, start, False, 0, b""
        #: Where what follows the last stream begins; None at the end of the file.
        self.end = None

    def _through(self, opener, data: bytes):
        """Chunks of what some bytes of the file unpack to."""
        if hasattr(opener, "needs_input"):
            yield opener.decompress(data, _READ)
            while not opener.eof and not opener.needs_input:
                yield opener.decompress(b"", _READ)
        elif type(opener).__module__ != "zlib":
            # No bound can be given here; few bytes at a time keep what they unpack to small.
            for first in range(0, len(data), 256):
                if not opener.eof:
                    yield opener.decompress(data[first:first + 256])
        else:
            while data and not opener.eof:
                yield opener.decompress(data, _READ)
                data = opener.unconsumed_tail
            while not opener.eof and (more := opener.decompress(b"", _READ)):
                yield more

    def __iter__(self):
        self.packed.seek(self.start)
        data = self.packed.read(_READ)
        opener = _opener(data)()
        try:
            while data:
                for chunk in self._through(opener, data):
                    self.size += len(chunk)
                    if chunk:
                        yield chunk
                if opener.eof:
                    # Further members follow at once or after zeros; zstd also has frames to skip.
                    data = opener.unused_data.lstrip(b"\0")
                    while len(data) < 8 and (more := self.packed.read(_READ)):
                        data = (data + more).lstrip(b"\0")
                    if _SKIPPED.match(data):
                        self.packed.seek(int.from_bytes(data[4:8], "little") + 8 - len(data), 1)
                        data = self.packed.read(_READ)
                    if not data:
                        return
                    following = _opener(data)
                    if following is None:
                        self.rest, self.end = data, self.packed.tell() - len(data)
                        return
                    opener = following()
                else:
                    data = self.packed.read(_READ)
            self.broken = not opener.eof
        except _BROKEN:
            self.broken = True

    def trailing(self):
        """What follows the last stream in the file, in chunks."""
        while self.rest:
            yield self.rest
            self.rest = self.packed.read(_READ)


def _windows(chunks):
    """Bytes in windows of about `WINDOW` bytes that end at breaks; a stretch without one stays whole."""
    held, looked = bytearray(), 0
    for chunk in chunks:
        held += chunk
        if len(held) < WINDOW or len(held) - looked < WINDOW // 4:
            continue
        # The last of all breaks; only what came since the last look, and a word before it, is read.
        end = 0
        for m in _BYTE_BREAK.finditer(held, max(0, looked - 4096)):
            end = m.end()
        looked = len(held)
        if end:
            yield bytes(held[:end])
            del held[:end]
            looked = len(held)
    if held:
        yield bytes(held)


def _as_text(data: bytes) -> str | None:
    """Bytes as text if they are UTF-8 without control characters other than white space."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return None if _CONTROL.search(text) else text


def _starts_text(data: bytes) -> bool:
    """Whether bytes are the beginning of such a text; a zlib header can be letters."""
    try:
        return not _CONTROL.search(codecs.getincrementaldecoder("utf-8")().decode(data))
    except UnicodeDecodeError:
        return False


class _Scan:
    """The layers of one text, the secrets in them, and what could not be opened."""

    def __init__(self, text: str, max_expanded: int | None):
        self.root, self.left = _Layer(text), max_expanded
        self.base = base_spans(text)
        self.every, self.seen, self.layers, self.closed = set(self.base), set(), 0, 0

    def run(self) -> None:
        todo = [self.below(self.root)]
        while todo:
            layer = next(todo[-1], None)
            if layer is None:
                todo.pop()
            elif self.fresh(layer.content.encode("utf-8", "surrogatepass"), layer.origin(0, len(layer.content))):
                found = base_spans(layer.content)
                self.layers += not layer.raw or bool(found)
                self.every.update((s, kind, e) for a, kind, b in found for s, e in [layer.origin(a, b)])
                todo.append(self.below(layer))

    def fresh(self, content: bytes | str, where: tuple[int, int]) -> bool:
        """Whether a place gives a content for the first time."""
        place = content if isinstance(content, str) else hashlib.sha256(content).hexdigest(), where
        if place in self.seen:
            return False
        self.seen.add(place)
        return True

    def below(self, layer: _Layer):
        """The layers that a layer hides."""
        content = layer.content
        if "%" in content:
            yield from _replaced(layer, _PERCENT, _percent)
        if "\\" in content or "&" in content:
            yield from _replaced(layer, _ESCAPES, _escape)
        runs = [m.span() for m in _BASE64.finditer(content)]
        # Where streams begin, the fewest that broke off: one that its first line cuts off may be whole with the next ones.
        broken: dict = {}
        for span in runs:
            yield from self.decoded(layer, span, lambda index: index, broken)
        for lines in _wrapped(content, runs):
            joined = _joined_lines(layer, lines)
            yield from self.decoded(joined, (0, len(joined.content)), joined.above, broken)
        self.closed += sum(broken.values())
        layer.content = None

    def decoded(self, layer: _Layer, span: tuple[int, int], above, broken: dict):
        """The layers in a base64 run, which may begin with any of its first four characters."""
        whole = layer.content[slice(*span)].rstrip("=").translate(_STANDARD)
        for phase in range(4):
            run = whole[phase:len(whole) - ((len(whole) - phase) % 4 == 1)]
            data = base64.b64decode(run + "=" * (-len(run) % 4))
            if phase and len(data) < _SHORTEST:
                return
            part = (span[0] + phase, span[1])
            text = None if phase else _as_text(data)
            if text is None:
                yield from self.streams(layer, part, data, above, broken)
                yield from self.raw(layer, part, data, True)
            elif text:
                yield _Layer(text, layer, run=part, exact=text.isascii())

    def streams(self, layer: _Layer, span: tuple[int, int], data: bytes, above, broken: dict):
        """The layers in packed streams that begin somewhere in the bytes of a run."""
        packed, at = None, 0
        while m := _STREAM.search(data, at):
            at = m.start() + 1
            marked = m.end() - m.start() > 2
            if not marked and not _zlib_begins(data, m.start()):
                continue
            packed = packed or io.BytesIO(data)
            # A zlib header is also found by chance: within bytes such a stream doesn't count as one that broke off.
            place = above(span[0] + m.start() * 4 // 3) if marked or not m.start() else None
            end = yield from self.unpacked(layer, span, packed, m.start(), place, broken)
            if end is not None:
                at = max(at, end)

    def raw(self, layer: _Layer, span: tuple[int, int], data: bytes, exact: bool):
        """Bytes that are no text as Latin-1, which shows all ASCII in them, and what may be UTF-16 among them."""
        whole = _Layer(data.decode("latin-1"), layer, run=span, exact=exact, raw=True)
        for m in _WIDE.finditer(data):
            plain = m[0].replace(b"\0", b"").decode()
            if exact:
                pieces = [(i, m.start() + 2 * i, m.start() + 2 * i + 2, False) for i in range(len(plain))]
                yield _Layer(plain, whole, pieces)
            else:
                yield _Layer(plain, layer, run=span)
        if _LEGIBLE.search(data):
            yield whole

    def unpacked(self, layer: _Layer, span: tuple[int, int], packed, start: int, place, broken: dict):
        """The layers in a packed stream, and in streams it packs; enters the streams that broke off at their place.

        Returns where what follows the stream begins in the file, None if it broke off.
        """
        n, nested, after = 0, False, None
        while packed is not None:
            stream = _Unpacked(packed, start)
            chunks = self.limited(stream)
            first = b""
            while len(first) < 64 and (more := next(chunks, None)):
                first += more
            chunks, inner = itertools.chain([first] if first else [], chunks), None
            if _opener(first) and not _starts_text(first):
                digest = hashlib.sha256()
                inner = tempfile.SpooledTemporaryFile(WINDOW)
                for chunk in chunks:
                    digest.update(chunk)
                    inner.write(chunk)
                if not self.fresh(f"packed {digest.hexdigest()}", layer.origin(*span)):
                    inner.close()
                    inner = None
            else:
                yield from self.read(layer, span, chunks, place, broken)
            if nested and stream.broken:
                # Whatever it is, its bytes can be looked at.
                packed.seek(0)
                yield from self.read(layer, span, iter(lambda: packed.read(_READ), b""), place, broken, first=1)
            elif nested:
                yield from self.read(layer, span, stream.trailing(), place, broken)
            elif not stream.broken:
                packed.seek(0, io.SEEK_END)
                after = packed.tell() if stream.end is None else stream.end
            # A zlib header is also found by chance; such bytes give nothing and are no stream.
            packed.seek(start)
            n += stream.broken and (stream.size > 0 or _MARKED.match(packed.read(_LONGEST_MARK)) is not None)
            if nested:
                packed.close()
            packed, start, nested = inner, 0, True
        if place is not None:
            broken[place] = min(n, broken.get(place, n))
        return after

    def read(self, layer: _Layer, span: tuple[int, int], chunks, place, broken: dict, first: int = 0):
        """The layers in unpacked bytes, and in packed streams that begin among them at `first` or later."""
        rest, base, marks, at, tail = None, 0, [], 0, b""
        for window in _windows(chunks):
            # A mark may stand across two windows.
            seam, before = tail + window, at - len(tail)
            found = [before + m.start() for m in _MARKED.finditer(seam)]
            found = [mark for mark in found if mark >= first and (not marks or mark > marks[-1])]
            if rest is not None:
                rest.write(window)
            elif found:
                rest, base = tempfile.SpooledTemporaryFile(WINDOW), found[0]
                rest.write(seam[base - before:])
            marks += found
            at += len(window)
            tail = seam[1 - _LONGEST_MARK:]
            text = _as_text(window)
            if text is None:
                yield from self.raw(layer, span, window, False)
            else:
                yield _Layer(text, layer, run=span)
        end = 0
        for mark in marks:
            if mark < end:
                continue
            rest.seek(mark - base)
            beginning = hashlib.sha256(rest.read(_READ)).hexdigest()
            if self.fresh(f"packed {beginning} {at - mark}", layer.origin(*span)):
                after = yield from self.unpacked(
                    layer, span, rest, mark - base, None if place is None else (place, mark), broken)
                end = mark + 1 if after is None else base + after
        if rest is not None:
            rest.close()

    def limited(self, stream: _Unpacked):
        for chunk in stream:
            if self.left is not None:
                self.left -= len(chunk)
                if self.left < 0:
                    stream.broken = True
                    return
            yield chunk


def scan(text: str, max_expanded: int | None = None) -> tuple[list, list, int, int]:
    """Base spans and all spans as sorted (start, kind number, end), the number of layers below the text, and of streams not read to their end.

    `max_expanded` is the most bytes to unpack from compressed streams; without it all are read.
    """
    found = _Scan(text, max_expanded)
    found.run()
    return sorted(found.base), sorted(found.every), found.layers, found.closed


_STANDARD = str.maketrans("-_", "+/")


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scanner(batches):
    for batch in (part for whole in batches for part in by_bytes(whole, 1)):
        rows = []
        for text in batch.column(1).to_pylist():
            base, every, layers, closed = scan(text or "")
            kinds = [kind for _, kind, _ in base]
            rows.append((*(kinds.count(k) for k in range(3)), _joined(base), _joined(every), layers, closed))
        columns = list(zip(*rows)) or [[]] * 7
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=["_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers", "n_unopened"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, counts of base spans by kind, `base_spans`, `spans`, `n_layers`, `n_unopened`.

    Spans are kind:start:end in code points of the text, end exclusive, by start and kind, joined by commas.
    """
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    longs = ("n_assign", "n_access", "n_hex")
    schema = T.StructType([
        df.schema["_id"], *(T.StructField(c, T.LongType()) for c in longs), T.StructField("base_spans", T.StringType()),
        T.StructField("spans", T.StringType()), T.StructField("n_layers", T.LongType()), T.StructField("n_unopened", T.LongType())])
    return df.mapInArrow(_scanner, schema).withColumnRenamed("_id", id_col)

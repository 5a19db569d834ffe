import base64
import bz2
import gzip
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard
from hypothesis import given, settings, strategies as st

from eventloom.llm.secrets_scan import KINDS, _windows, base_spans, find_secrets, scan

KEY = "AKIA" + "Z" * 16
SECRET = f"password={'s3cr3t' * 3}"


def plain_base(text):
    found = []
    words = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    for kind, pattern, least, group in (
            (0, words + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2), (1, "AKIA[A-Z0-9]+", 16, 0), (2, "[0-9a-f]+", 32, 0)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["password", "PassWD", "toKen", "toKen", "ſecret", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abcdefgh", "short", "AKIA", "A1B2C3D4E5F6",
     "0123456789abcdef", "é", "\n", "🙂"]), max_size=14).map("".join))
def test_base_spans_against_plain_patterns(text):
    assert sorted(base_spans(text)) == plain_base(text)


def spans(text):
    return [(KINDS[k], text[s:e]) for s, k, e in scan(text)[1]]


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def test_percent_escapes_map_to_their_places():
    text = "é see password%3Dabcdefgh%31 and more"
    assert spans(text) == [("assign", "password%3Dabcdefgh%31")]
    twice = text.replace("%", "%25")
    assert spans(twice) == [("assign", "password%253Dabcdefgh%2531")]


@pytest.mark.parametrize("hidden", [
    "".join(f"\\u{ord(c):04x}" for c in SECRET), "".join(f"&#{ord(c)};" for c in SECRET), "".join(f"&#x{ord(c):x};" for c in SECRET),
    "".join(f"\\x{ord(c):02x}" for c in SECRET), "".join(f"\\u{{{ord(c):x}}}" for c in SECRET)])
def test_unicode_escapes(hidden):
    assert spans(f"🙂 {hidden} end") == [("assign", hidden)]


def test_base64_maps_to_its_part():
    run = b64(f"some words first, {KEY}, and some after")
    (kind, where), = spans(f"data: {run}.")
    assert kind == "access" and where in run and KEY.encode() in base64.b64decode(run)
    start = run.index(where)
    assert KEY.encode() in base64.b64decode(run[start // 4 * 4:(start + len(where) + 3) // 4 * 4])


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress])
def test_compressed_layers(pack):
    run = b64(pack(pack(f"x {SECRET} y".encode())))
    assert spans(f"<{run}>") == [("assign", run)]


def test_nested_layers():
    inner = b64(gzip.compress(f"token: {b64('api_key = abcdefghij0')} ".encode()))
    text = f"see {urllib.parse.quote(urllib.parse.quote(inner + ' ' + chr(233)))}"
    base, every, layers, closed = scan(text)
    assert ("assign", text[every[0][0]:every[0][2]])[0] == "assign" and layers >= 4 and closed == 0
    assert all(0 <= s < e <= len(text) for s, _, e in every)


def test_cycles_end():
    assert scan("%25" * 200)[2] <= 200
    self_like = b64("QUJD" * 6)
    assert scan(self_like * 3)[3] == 0


def test_expansion_is_bounded_and_counted():
    text = b64(gzip.compress(b"a" * 1_000_000))
    assert scan(text, max_expanded=10_000)[3] == 1
    assert scan(text)[3] == 0


def test_rows(spark):
    rows = [(1, SECRET, "x"), (1, SECRET, "x"), (2, None, "x"), (3, "", None), (None, f"{KEY} {'0f' * 16}", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = find_secrets(docs).collect()
    assert [(r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in got] == [(1, 1, 0, 0), (1, 1, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (None, 0, 1, 1)]
    assert got[0].spans == got[0].base_spans == "assign:0:27" and got[4].spans == "access:0:20,hex:21:53"
    assert find_secrets(docs.limit(0)).count() == 0


def test_long_text():
    text = "word " * 400_000 + SECRET
    assert scan(text)[0] == [(2_000_000, 0, 2_000_000 + len(SECRET))]


def test_layers_of_long_texts_stay_open(monkeypatch):
    hidden = SECRET
    for _ in range(4):
        hidden = urllib.parse.quote("".join(f"\\u{ord(c):04x}" for c in hidden))
    text = "plain words, " * 800_000 + hidden + " and more"
    base, every, layers, closed = scan(text)
    assert not base and closed == 0 and ("assign", hidden) in {(KINDS[k], text[s:e]) for s, k, e in every}
    monkeypatch.setattr("eventloom.llm.secrets_scan.WINDOW", 10_000)
    for words in ("word ", "words, ", "\0", "é", "a"):
        run = b64(gzip.compress(gzip.compress((words * 100_000 + f" {SECRET} " + words * 20_000).encode())))
        if words != "\0":
            assert ("assign", run) in spans(f"<{run}>")
        assert scan(run)[3] == 0


def test_windows_end_at_breaks(monkeypatch):
    monkeypatch.setattr("eventloom.llm.secrets_scan.WINDOW", 500)
    plain = " ".join(f"w{i} password%3D%20abcdefgh{i:03}" for i in range(300))
    run = b64(zlib.compress(plain.encode()))
    windows = list(_windows([plain[i:i + 70].encode() for i in range(0, len(plain), 70)]))
    assert b"".join(windows).decode() == plain and len(windows) > 10
    assert sum(len(re.findall(r"password%3D%20abcdefgh\d{3}", w.decode())) for w in windows) == 300
    assert scan(run)[3] == 0 and ("assign", run) in spans(run)


@pytest.mark.parametrize("width", [16, 64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  ", "\r\n\t"])
def test_wrapped_base64(width, end):
    def wrapped(data):
        run = b64(data)
        return end.join(run[i:i + width] for i in range(0, len(run), width))

    rnd = random.Random(width)
    junk = "".join(rnd.choice("bcdfg ") for _ in range(200))
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        run = wrapped(pack(f"{junk} {SECRET} {junk}".encode()))
        for text in (f"see:\n{run}\n\nend", f"data: {run}", f"BEGINCERTIFICATEHEADING{end}{run}"):
            assert ("assign", run) in spans(text) and scan(text)[3] == 0, text
    for lead in range(60):
        text = f"<{wrapped('x' * lead + f' {KEY}; é{lead * chr(233)} and more words here')}>"
        assert any(k == "access" and len(w.replace(end, "")) >= 27 for k, w in spans(text)), lead
        text = f"<{wrapped('x' * lead + f' {KEY}; and more words here')}>"
        (start, stop), = [(s, e) for s, k, e in scan(text)[1] if len(text[s:e].replace(end, "")) >= 27]
        assert len(text[start:stop].replace(end, "")) <= 28
    lines = "\n".join(b64(f"{i:03} password=abcdefgh{i:03} of line") for i in range(5))
    assert len({w for k, w in spans(lines)}) >= 5


@pytest.mark.parametrize("data", [
    f"see {SECRET} now".encode("utf-16-le"), f"see {SECRET} now".encode("utf-16"), f"see {SECRET} now".encode("utf-16-be"),
    f"ո{SECRET}".encode("utf-16-be"), f"é {SECRET} ü".encode("latin-1"), b"\0\1\2\xff" + f" {SECRET} ".encode() + b"\xfe\0" * 9])
def test_bytes_that_are_no_text(data):
    for text in (f"<{b64(data)}>", f"<{b64(gzip.compress(data))}>", f"<{b64(lzma.compress(bz2.compress(data)))}>"):
        found = scan(text)
        assert any(kind == 0 for _, kind, _ in found[1]) and found[3] == 0
    (start, kind, end), = scan(f"<{b64(data)}>")[1]
    wide = 2 if b"\0d" in data or b"d\0" in data else 1
    assert end - start <= -(-len(SECRET) * wide * 4 // 3) + 4


def test_runs_that_are_valid_in_part():
    latin = "".join(f"%{b:02X}" for b in f"clé {SECRET}".encode("latin-1"))
    assert ("assign", latin) in spans(f"<{latin}>")
    hexes = latin.replace("%", "\\x")
    assert ("assign", hexes) in spans(f"<{hexes}>")
    units = "\\ud800" + "".join(f"\\u{ord(c):04x}" for c in f" {SECRET}")
    assert ("assign", units) in spans(f"<{units}>")


@pytest.mark.parametrize("pack", [
    gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress,
    lambda data: (c := zlib.compressobj(9, zlib.DEFLATED, 9)).compress(data) + c.flush()])
def test_later_members(pack):
    skipped = b"\x52\x2a\x4d\x18\x05\0\0\0hello" if pack(b"x").startswith(b"\x28\xb5") else b"\0" * 8
    for data in (pack(b"first") + pack(SECRET.encode()), pack(b"first") + skipped + pack(b"") + pack(SECRET.encode()),
                 pack(b"first") + f"rest {SECRET}".encode(), pack(SECRET.encode())):
        run = b64(data)
        assert any(k == "assign" for k, w in spans(f"<{run}>")) and scan(run)[3] == 0
    noise = random.Random(1).randbytes(5000)
    assert scan(b64(pack(noise)[:3000]))[3] == 1


PACKS = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress]


@pytest.mark.parametrize("lead", ["https://h.example/cb/", "id-", "x_", "/a", "/v1/data/", "abcdefghijklmnopqrstu/"])
@pytest.mark.parametrize("trail", ["", "/a", "-x_1", "/abcdefgh"])
def test_runs_glued_to_paths(lead, trail):
    for plain in (f"some {KEY} key", f"{SECRET} é and more", f"say {SECRET}"):
        for data in (b64(plain).rstrip("="), base64.urlsafe_b64encode(plain.encode()).decode().rstrip("=")):
            text = f"see {lead}{data}{trail} there"
            want = 1 if KEY in plain else 0
            secret = KEY if want else SECRET
            (where,) = {(s, e) for s, k, e in scan(text)[1] if k == want and e - s >= len(secret) * 4 // 3}
            first = len(f"see {lead}") + plain.encode().index(secret.encode()) * 4 // 3
            assert where[0] == first, (text, where)
    for pack in PACKS:
        data = b64(pack(f"see {SECRET} there".encode())).rstrip("=")
        found = scan(f"see {lead}{data}{trail} there")
        assert any(k == 0 for _, k, _ in found[1]) and found[3] == 0, (lead, pack)


@pytest.mark.parametrize("pack", PACKS)
def test_streams_within_bytes(pack, monkeypatch):
    packed = pack(f"see {SECRET} there".encode())
    for head in (b"\1\2\3\4\5\6", b"six by", b"\xff" * 7):
        for data in (head + packed, head + packed + b"\0tail", head + pack(head + gzip.compress(f" {SECRET} ".encode())),
                     head + packed + packed, gzip.compress(head * 30 + gzip.compress(b"\0" + packed + b"x")) if pack is not zlib.compress else head + packed):
            found = scan(f"<{b64(data)}>")
            assert any(k == 0 for _, k, _ in found[1]) and found[3] == 0, (head, data)
    monkeypatch.setattr("eventloom.llm.secrets_scan.WINDOW", 300)
    if pack is not zlib.compress:
        noise = random.Random(4).randbytes(3000).replace(b"BZh", b"")
        for n in range(0, 60, 7):
            found = scan(b64(gzip.compress(noise[n:] + packed + noise)))
            assert any(k == 0 for _, k, _ in found[1]), n


def test_many_members_are_read_once():
    text = b64(b"\0" + b"".join(gzip.compress(f"line {i}".encode()) for i in range(3000)) + gzip.compress(SECRET.encode()))
    assert any(k == 0 for _, k, _ in scan(text)[1])
    assert scan(b64(b"\0" + b"BZh91AY&SY" * 3000))[3] > 0


def test_named_references_and_escaped_quotes():
    for hidden in ("password&quot;: &quot;abcdefgh1234&quot;", 'password\\": \\"abcdefgh1234\\"', "password&amp;#58; abcdefgh1234"):
        assert any(k == 0 and "abcdefgh1234" in hidden[s:e] for s, k, e in scan(hidden)[1]), hidden


def decoded_by_force(content, depth):
    """All texts that a few rules make of a text, whatever the order: no worklist, no windows, no spans."""
    out = {content}
    if not depth:
        return out
    following = [urllib.parse.unquote(content), re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), content)]
    for m in re.finditer(r"[A-Za-z0-9+/]{16,}", content):
        for phase in range(4):
            run = m[0][phase:]
            data = base64.b64decode(run[:len(run) - (len(run) % 4 == 1)] + "=" * (-(len(run) - (len(run) % 4 == 1)) % 4))
            following.append(data.decode("latin-1"))
            for at in range(len(data) - 8):
                for opened in (lambda d: zlib.decompressobj(31).decompress(d), lambda d: zlib.decompressobj().decompress(d),
                               lambda d: bz2.BZ2Decompressor().decompress(d)):
                    try:
                        following.append(opened(data[at:]).decode("latin-1"))
                    except (OSError, zlib.error):
                        pass
    for text in following:
        if text != content:
            out |= decoded_by_force(text, depth - 1)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_against_decoding_by_force(seed):
    rnd = random.Random(seed)
    content = f"{rnd.choice(['', 'a ', 'x1, '])}{rnd.choice([KEY, SECRET])}{rnd.choice([' end', '; more'])}"
    for _ in range(rnd.randint(1, 3)):
        content = rnd.choice([
            lambda t: urllib.parse.quote(t, safe=""), lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
            lambda t: rnd.choice(["", "p/", "ab/c"]) + b64(t), lambda t: "/" + b64(gzip.compress(t.encode())),
            lambda t: "id/" + b64(rnd.randbytes(rnd.randrange(5)) + bz2.compress(t.encode()))])(content)
    secrets = {(kind, layer[start:end]) for layer in decoded_by_force(content, 3) for start, kind, end in plain_base(layer)}
    kinds = {kind for _, kind, _ in scan(content)[1]}
    assert secrets and {kind for kind, _ in secrets} <= kinds, content

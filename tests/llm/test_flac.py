import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import flac, flac_plain
from tests.llm.fixtures import documents, ordered, rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=3000), st.text("aaab\n", max_size=3000).map(str.encode), st.integers(0, 255).map(lambda x: bytes([x]) * 2500)), min_size=1, max_size=4))
def test_round_trip(payloads):
    payloads = [p + bytes(max(64, -(-len(p) // 64) * 64) - len(p)) for p in payloads]
    back = flac.read_streams(flac.write_streams(payloads))
    assert [p for p, _ in back] == payloads
    assert all(points.tolist() == list(range(0, len(p), flac.BLOCK)) for p, points in back)


def test_extremes_and_runs(monkeypatch):
    monkeypatch.setattr(flac, "RUN", 3)
    r = random.Random(1)
    payloads = [bytes(r.choice((0, 255)) for _ in range(6400)), bytes(r.randrange(256) for _ in range(64)), b"\x80" * 64 * 200, (b"\x00" * 700 + b"\xff" * 4) * 10 + bytes(0)]
    payloads = [p[: len(p) // 64 * 64] for p in payloads]
    assert [p for p, _ in flac.read_streams(flac.write_streams(payloads))] == payloads


def test_a_plain_reader_reads_what_is_written():
    """Bit by bit, without the tables and the lockstep of the reader beside the writer."""
    r = random.Random(3)
    noise = bytes(r.randrange(256) for _ in range(64 * 70))
    payloads = [b"some text, stored and read. " * 160, bytes(64), b"\x80" * 6400, noise, noise[:1024] + bytes(2048) + b"abc " * 400, "é漢😀 ".encode() * 200]
    payloads = [p + bytes(-len(p) % 64) for p in payloads]
    streams = flac.write_streams(payloads)
    for stream, payload in zip(streams, payloads):
        got, points = flac_plain.read_stream(stream)
        assert got == payload and points.tolist() == list(range(0, len(payload), flac.BLOCK))
    assert len(streams[3]) < len(noise) + 200 + 20 * 5 and len(streams[2]) < 400


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, width):
        self.text += format(value & ((1 << width) - 1), f"0{width}b") if width else ""

    def rice(self, value, k):
        u = 2 * value if value >= 0 else -2 * value - 1
        self.text += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        self.text += "0" * (-len(self.text) % 8)
        return int(self.text, 2).to_bytes(len(self.text) // 8)


def frame(number, samples, subframe):
    head = Bits()
    for value, width in ((0x7FFC, 15), (0, 1), (7, 4), (0, 4), (0, 4), (1, 3), (0, 1), (number, 8), (len(samples) - 1, 16)):
        head.put(value, width)
    body = Bits()
    body.text = "".join(format(x, "08b") for x in head.bytes())
    body.put(flac_plain._crc(head.bytes(), 0x07, 8), 8)
    subframe(body, samples)
    whole = body.bytes()
    return whole + flac_plain._crc(whole, 0x8005, 16).to_bytes(2)


def constant(b, x):
    b.put(0, 8)
    b.put(x[0], 8)


def verbatim(b, x):
    b.put(1 << 1, 8)
    for v in x:
        b.put(v, 8)


def wasted(b, x):
    b.put(1 << 1 | 1, 8)
    b.text += "01"  # two bits
    for v in x:
        b.put(v >> 2, 6)


def escaped(b, x):
    """Fixed order 0, five-bit Rice parameters: one partition coded, one as it is."""
    b.put(8 << 1, 8)
    b.put(1, 2)
    b.put(1, 4)
    b.put(3, 5)
    half = len(x) // 2
    for v in x[:half]:
        b.rice(v, 3)
    b.put(31, 5)
    b.put(8, 5)
    for v in x[half:]:
        b.put(v, 8)


def fixed4(b, x):
    b.put(12 << 1, 8)
    for v in x[:4]:
        b.put(v, 8)
    b.put(0, 6)
    b.put(2, 4)
    for t in range(4, len(x)):
        b.rice(x[t] - (4 * x[t - 1] - 6 * x[t - 2] + 4 * x[t - 3] - x[t - 4]), 2)


def linear8(b, x):
    """Order 8, coefficients of five bits, shift 3."""
    by = [7, -3, 2, 1, -1, 3, -2, 1]
    b.put((31 + 8) << 1, 8)
    for v in x[:8]:
        b.put(v, 8)
    b.put(4, 4)
    b.put(3, 5)
    for c in by:
        b.put(c, 5)
    b.put(0, 6)
    b.put(4, 4)
    for t in range(8, len(x)):
        b.rice(x[t] - (sum(c * x[t - 1 - j] for j, c in enumerate(by)) >> 3), 4)


@pytest.mark.parametrize("kinds", [[constant], [verbatim], [wasted], [escaped], [fixed4], [linear8], [constant, linear8, verbatim, escaped, fixed4, wasted]])
@pytest.mark.parametrize("seekable", [False, True])
def test_streams_of_other_encoders(kinds, seekable):
    r = random.Random(7)
    frames, samples, points = [], [], []
    for i, kind in enumerate(kinds):
        n = 160 + 16 * i
        x = [r.randrange(-128, 128) for _ in range(n)]
        x = [x[0]] * n if kind is constant else [4 * (v >> 2) for v in x] if kind is wasted else x
        points.append((len(samples), sum(map(len, frames)), n))
        frames.append(frame(i, x, kind))
        samples += x
    pcm = bytes(v & 0xFF for v in samples)
    shape = (44100 << 44 | 0 << 41 | 7 << 36 | len(samples)).to_bytes(8)
    info = (160).to_bytes(2) + (400).to_bytes(2) + bytes(6) + shape + hashlib.md5(pcm).digest()
    seek = b"".join(s.to_bytes(8) + o.to_bytes(8) + n.to_bytes(2) for s, o, n in points)
    note = b"\x04" + (5).to_bytes(3) + b"hello"
    stream = b"fLaC\x00" + len(info).to_bytes(3) + info + note + (b"\x03" + len(seek).to_bytes(3) + seek if seekable else b"") + b"\x81" + (3).to_bytes(3) + bytes(3) + b"".join(frames)
    own = flac.write_streams([b"our own " * 200])[0]
    (_, _), (got, at) = flac.read_streams([own, stream])
    assert got == bytes(v + 128 for v in samples) and at.tolist() == [s for s, _, _ in points]
    broken = bytearray(stream)
    broken[-10] ^= 4
    with pytest.raises(ValueError):
        flac.read_streams([bytes(broken)])


def test_long_streams_have_fewer_seek_points(monkeypatch):
    monkeypatch.setattr(flac, "MOST_POINTS", 3)
    payload = b"text that is stored " * 320
    (stream,) = flac.write_streams([payload])
    assert int.from_bytes(stream[43:46]) <= 18 * 3 < 18 * (len(payload) // 1024)
    assert flac.read_streams([stream])[0][0] == payload


def test_frame_numbers_have_up_to_four_bytes():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 1 << 20):
        assert flac._header_bytes(memoryview(flac.frame_header(n, 1024) + b"\0" * 9), 0) == flac.frame_header(n, 1024)


@pytest.mark.parametrize("at", [0, 30, 60, 70, 100, -1, -40])
def test_damage_is_noticed(at):
    (stream,) = flac.write_streams([b"some text that is stored " * 64])
    broken = bytearray(stream)
    broken[at] ^= 0x10
    with pytest.raises((ValueError, IndexError)):
        flac.read_streams([bytes(broken)])


def test_compresses_smooth_signals():
    payload = bytes(128 + int(60 * ((i % 128) / 64 - 1)) for i in range(64 * 400))
    assert len(flac.write_streams([payload])[0]) < len(payload) / 2


def test_query(spark):
    got = flac.media_digests(flac.store(documents(spark), batch_bytes=5000), batch_bytes=5000).collect()
    brute = []
    for r in rows():
        p, n = flac.padded(r[1])
        brute.append((r[0], n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert ordered(tuple(r)[:5] for r in got) == ordered(brute)
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert flac.store(documents(spark).where("false")).count() == 0


def test_blocks_can_be_sought(spark):
    blocks = flac.pcm_blocks(flac.store(documents(spark, [(1, "word " * 900, "en", "s", 4500)]))).orderBy("block").collect()
    assert [b.sample_offset for b in blocks] == [i * flac.BLOCK for i in range(len(blocks))]
    assert b"".join(bytes(b.pcm) for b in blocks) == flac.padded("word " * 900)[0]

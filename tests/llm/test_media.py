"""AVI motion-JPEG: exact payloads, a decoder held against a plain one, shots and clips."""

import hashlib
import os
import re
import struct
import zlib

import numpy as np
import pytest

from slotloom.llm import jpeg, media

TEXTS = [b"", b"a", b"a" * 64, b"x" * 4096, b"y" * 4097, bytes([255]) * 300, b"\xff\x00\xff\xd0" * 900, os.urandom(9000), "é日本🙂".encode() * 500]


@pytest.mark.parametrize("text", TEXTS)
def test_payload_is_exact(text):
    payload = text + b"\0" * (-len(text) % 64 or (0 if text else 64))
    found = media.describe(text)
    assert found[:4] == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    stored = media.store_payload(payload)
    assert found[4:6] == (len(stored), hashlib.sha256(stored).hexdigest())
    assert found == media.describe(text)


def test_fast_path_equals_the_general_decoder():
    frame = next(media.read_avi(media.store_payload(os.urandom(4096))).frames())
    fast = frame.coefficients()
    frame.fixed_width = lambda: False
    assert (fast[0] == frame.coefficients()[0]).all()


def codes(counts, symbols):
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[symbols[k]] = format(code, f"0{length}b")
            code, k = code + 1, k + 1
        code <<= 1
    return out


def write_frame(planes, factors, width, height, interval=0, tables=True):
    """A plain encoder with the standard's tables: blocks (rows x columns x 64, zigzag) of each component."""
    dc, ac = (codes(*jpeg._DEFAULTS[k]) for k in (0x00, 0x10))
    dht = b"".join(jpeg._segment(0xC4, bytes([k]) + b"".join(jpeg._DEFAULTS[k])) for k in (0x00, 0x10)) if tables else b""
    n = len(planes)
    sof = struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(factors))
    sos = bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0"
    out = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + bytes([3] * 64)) + jpeg._segment(0xC0, sof) + dht
    out += jpeg._segment(0xDD, struct.pack(">H", interval)) if interval else b""
    out += jpeg._segment(0xDA, sos)
    bits, last, units = "", [0] * n, 0
    across, down = planes[0].shape[1] // factors[0][0], planes[0].shape[0] // factors[0][1]

    def magnitude(v):
        size = abs(int(v)).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for y in range(down):
        for x in range(across):
            if interval and units and units % interval == 0:
                out += flush(bits) + bytes([0xFF, 0xD0 + (units // interval - 1) % 8])
                bits, last = "", [0] * n
            units += 1
            for c, (h, v) in enumerate(factors):
                for dy in range(v):
                    for dx in range(h):
                        block = planes[c][y * v + dy, x * h + dx].tolist()
                        size, more = magnitude(block[0] - last[c])
                        bits += dc[size] + more
                        last[c], run = block[0], 0
                        for value in block[1:]:
                            if not value:
                                run += 1
                                continue
                            while run > 15:
                                bits, run = bits + ac[0xF0], run - 16
                            size, more = magnitude(value)
                            bits += ac[run << 4 | size] + more
                            run = 0
                        bits += ac[0] if run else ""
    return out + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize(("factors", "interval", "tables"), [([(1, 1)], 0, True), ([(1, 1)], 3, False), ([(2, 2), (1, 1), (1, 1)], 0, False), ([(2, 1), (1, 1), (1, 1)], 2, True)])
def test_standard_frames(factors, interval, tables):
    rng = np.random.default_rng(4)
    planes = [(rng.integers(-60, 60, (2 * v, 3 * h, 64)) * (rng.random((2 * v, 3 * h, 64)) < 0.15)).astype(int) for h, v in factors]
    wide, tall = max(f[0] for f in factors), max(f[1] for f in factors)
    width, height = 24 * wide - 3, 16 * tall - 5
    frame = jpeg.Frame(write_frame(planes, factors, width, height, interval, tables))
    for found, want in zip(frame.coefficients(), planes, strict=True):
        assert (found == want.reshape(-1, 64)).all()
    assert all(p.shape == (height, width) for p in frame.planes())
    # the first sample of the first block by the definition of the transform
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = planes[0][0, 0] * 3
    total = sum(block[u * 8 + v] * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * np.cos(u * np.pi / 16) * np.cos(v * np.pi / 16) for u in range(8) for v in range(8)) / 4
    assert abs(int(frame.planes()[0][0, 0]) - np.clip(total + 128, 0, 255)) <= 1


def flat(level):
    plane = np.zeros((2, 2, 64), int)
    plane[..., 0] = (level - 128) * 8 // 3
    return write_frame([plane], [(1, 1)], 16, 16)


def test_clips_with_and_without_index(spark):
    frames = [flat(40)] * 6 + [flat(200)] * 5 + [flat(90)] * 4
    data = media.write_avi(frames, 16, 16, 100_000)
    want = [(0, 0, 5, 0, 600), (1, 6, 10, 600, 1100), (2, 11, 14, 1100, 1500)]
    assert media.clips(media.read_avi(data)) == want
    assert media.clips(media.read_avi(data.replace(b"idx1", b"JUNK"))) == want
    rows = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"junk")), (4, bytearray(b"")), (5, bytearray(data[:900]))], "k long, m binary")
    got = media.clip_rows(rows, "k", "m").collect()
    assert [tuple(r[1:6]) for r in got if r.k == 1] == want
    assert {r.k for r in got if r.error} >= {3, 4} and not [r for r in got if r.k == 2]


def test_further_riff_parts():
    frames = [flat(40)] * 6 + [flat(200)] * 5 + [flat(90)] * 4
    chunks = [media._chunk(b"00dc", f) for f in frames]
    part = lambda *lists: media._chunk(b"RIFF", b"AVIX" + b"".join(lists))
    first = media.write_avi(frames[:4], 16, 16, 100_000)
    data = first + part(media._list(b"movi", media._chunk(b"ix00", b"\0" * 24), *chunks[4:9])) + part(media._list(b"movi", media._list(b"rec ", *chunks[9:12]), *chunks[12:]))
    whole = media.read_avi(media.write_avi(frames, 16, 16, 100_000))
    for found in (media.read_avi(data), media.read_avi(data.replace(b"idx1", b"JUNK"))):
        assert [found.data[a : a + n] for a, n in found.spans] == frames
        assert media.clips(found) == media.clips(whole) == [(0, 0, 5, 0, 600), (1, 6, 10, 600, 1100), (2, 11, 14, 1100, 1500)]
    assert media.read_avi(first).spans == found.spans[:4]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (None, "abc")], "doc_id long, text string")
    got = {r.doc_id: r for r in media.text_media_digests(docs).collect()}
    assert got[1][1:] == got[None][1:] == media.describe(b"abc") and got[2][1:] == media.describe(b"")
    assert media.text_media_digests(docs.limit(0)).count() == 0


def plain_reader(data):
    """Payload, shots' histograms and clip times of a stored file, by bits and the standard's definitions only."""
    at, frames, seconds, length = 12, [], None, None
    stack = [(12, len(data))]
    while stack:
        at, end = stack.pop(0)
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"LIST":
                stack.append((at + 12, at + 8 + size))
            elif name == b"00dc":
                frames.append(data[at + 8 : at + 8 + size])
            elif name == b"strh":
                seconds = int.from_bytes(data[at + 28 : at + 32], "little") / int.from_bytes(data[at + 32 : at + 36], "little")
            elif name == b"ICMT":
                length = int(data[at + 8 : at + 8 + size].rstrip(b"\0").split(b"=")[1])
            at += 8 + size + size % 2
    payload, shares = b"", []
    cosine = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.125**0.5 if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    for frame in frames:
        at, tables = 2, {}
        while frame[at + 1] != 0xDA:
            marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
            body = frame[at + 4 : at + 2 + size]
            if marker == 0xC4:
                tables[body[0]] = {v: k for k, v in codes(list(body[1:17]), list(body[17:])).items()}
            elif marker == 0xC0:
                height, width = struct.unpack(">HH", body[1:5])
            elif marker == 0xDB:
                quant = list(body[1:65])
            at += 2 + size
        coded = frame[at + 2 + int.from_bytes(frame[at + 2 : at + 4], "big") : -2]
        plane = np.zeros((height, width))
        for k, part in enumerate(re.split(rb"\xff[\xd0-\xd7]", coded)):
            bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff"))
            values, place = [], 0
            while len(values) < 64:
                n = next(n for n in range(1, 17) if bits[place : place + n] in tables[0x10 if values else 0])
                symbol = tables[0x10 if values else 0][bits[place : place + n]]
                assert symbol >> 4 == 0
                size = symbol & 15
                own = int(bits[place + n : place + n + size], 2)
                payload += bytes([own])
                values.append(own if own >> (size - 1) else own - (1 << size) + 1)
                place += n + size
            block = np.zeros(64)
            block[jpeg.ZIGZAG] = np.array(values) * quant
            y, x = divmod(k, width // 8)
            plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = cosine.T @ block.reshape(8, 8) @ cosine
        level = np.clip(np.rint(plane + 128), 0, 255).astype(int)
        shares.append(np.bincount((level // 8).reshape(-1), minlength=32) / level.size)
    return payload[:length], np.array(shares), 1000 * seconds


@pytest.mark.parametrize("text", [b"", b"plain text", os.urandom(5_000), b"ab" * 3_000 + b"\xff" * 4_096])
def test_stored_files_against_a_plain_reader(text):
    payload = text + b"\0" * (-len(text) % 64 or (0 if text else 64))
    stored = media.store_payload(payload)
    found, shares, ms = plain_reader(stored)
    assert found == payload
    frames = list(media.read_avi(stored).frames())
    assert np.abs(media.histograms(frames) - shares).max() < 2e-3  # samples at the edge between two levels may round apart
    clips = media.clips(media.read_avi(stored))
    assert clips == [(k, a, b, round(a * ms), round((b + 1) * ms)) for k, (a, b) in enumerate(media.shots(media.histograms(frames)))]
    assert clips[0][1] == 0 and clips[-1][2] == len(frames) - 1 and all(x[2] + 1 == y[1] for x, y in zip(clips, clips[1:]))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 4_096, 4_097, 50_001])
def test_long_texts_by_way_of_a_file(tmp_path, n):
    text = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    path = str(tmp_path / "one.avi")
    assert media.describe_long(text, path, group=3) == media.describe(text) and not list(tmp_path.iterdir())


def test_a_long_text_takes_memory_for_little_more_than_itself(spark, tmp_path):
    import tracemalloc

    text = b"some words of a long text, " * 1_500_000  # 40 MB
    tracemalloc.start()
    found = media.describe_long(text, str(tmp_path / "one.avi"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] == len(text) and found[2] == hashlib.sha256(text + b"\0" * (-len(text) % 64)).hexdigest()
    assert peak < 2 * len(text)
    rows = media.text_media_digests(spark.createDataFrame([(1, text.decode())], "doc_id long, text string")).collect()
    assert tuple(rows[0])[1:8] == found[:7]

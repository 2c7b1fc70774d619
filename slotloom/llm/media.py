"""Media columns: AVI files of motion-JPEG frames, their indexes, intra frames, shots and timed clips."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slotloom.llm.jpeg import Frame, encode_payload
from slotloom.llm.shared import arrow_map, drop_file, mapped, put_file, slices, texts, work_dir

SIDE = 64
FRAME_MICROSECONDS = 40_000
HISTOGRAM = 32
#: Bytes from which a text goes through a file, and frames of it that are in memory at once.
LONG_TEXT, GROUP = 16 << 20, 256
#: Shots: a cut is a difference above mean + SPREAD deviations of the WINDOW differences before it, and above LEAST.
WINDOW, SPREAD, LEAST = 12, 3.0, 0.1


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, *parts: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(parts))


def _around(sizes: list[int], width: int, height: int, frame_us: int, comment: bytes) -> tuple[bytes, bytes]:
    """What comes before and after the frames' chunks in a file with frames of these sizes."""
    longest = max(sizes, default=0)
    main = struct.pack("<14I", frame_us, 0, 0, 0x10, len(sizes), 0, 1, longest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, frame_us, 1_000_000, 0, len(sizes), longest, 0xFFFFFFFF, 0, 0, 0, width, height)
    shape = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    places = np.cumsum([4, *(8 + n + n % 2 for n in sizes)]).tolist()
    index = _chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 0x10, p, n) for p, n in zip(places, sizes, strict=False)))
    head = _list(b"hdrl", _chunk(b"avih", main), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", shape)))
    head += _list(b"INFO", _chunk(b"ICMT", comment + b"\0")) if comment else b""
    head += b"LIST" + struct.pack("<I", places[-1]) + b"movi"
    return b"RIFF" + struct.pack("<I", len(head) + places[-1] - 4 + len(index) + 4) + b"AVI " + head, index


def write_avi(frames: list[bytes], width: int, height: int, frame_us: int = FRAME_MICROSECONDS, comment: bytes = b"") -> bytes:
    """An AVI file with one motion-JPEG stream, every frame a key frame, and an index."""
    before, after = _around([len(f) for f in frames], width, height, frame_us, comment)
    return b"".join([before, *(_chunk(b"00dc", f) for f in frames), after])


@dataclass
class Avi:
    """What a file says of its first video stream: timing, comment, and where each frame's bytes are."""

    data: bytes | memoryview
    width: int
    height: int
    frame_us: float
    comment: bytes
    spans: list[tuple[int, int]]

    def frames(self) -> Iterator[Frame]:
        for begin, size in self.spans:
            yield Frame(bytes(self.data[begin : begin + size]))


def _walk(data: bytes, begin: int, end: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Chunks from begin to end: name, kind of list, begin and size of the body."""
    while begin + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, begin)
        size = min(size, end - begin - 8)
        if name in (b"LIST", b"RIFF"):
            yield name, bytes(data[begin + 8 : begin + 12]), begin + 12, size - 4
        else:
            yield name, b"", begin + 8, size
        begin += 8 + size + size % 2


def read_avi(data: bytes) -> Avi:
    """Parse a RIFF AVI file; frames come from its index, or from the stream where that has none.

    An OpenDML file goes on in further RIFF parts, of which idx1 says nothing: their lists are walked.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    width = height = 0
    frame_us, comment, stream, video = float(FRAME_MICROSECONDS), b"", -1, None
    index: list[tuple[bytes, int, int]] = []
    movies: list[tuple[int, int]] = []
    todo = [x for x in _walk(data, 0, len(data))]
    while todo:
        name, kind, at, size = todo.pop(0)
        if name == b"RIFF" or kind in (b"hdrl", b"strl", b"INFO"):
            todo = [*_walk(data, at, at + size), *todo]
        elif kind == b"movi":
            movies.append((at, size))
        elif name == b"avih":
            frame_us, width, height = float(struct.unpack_from("<I", data, at)[0]), *struct.unpack_from("<II", data, at + 32)
        elif name == b"strh":
            stream += 1
            if data[at : at + 4] == b"vids" and video is None:
                video = stream
                scale, rate = struct.unpack_from("<II", data, at + 20)
                frame_us = scale * 1e6 / rate if scale and rate else frame_us
        elif name == b"ICMT":
            comment = bytes(data[at : at + size]).rstrip(b"\0")
        elif name == b"idx1":
            index += [struct.unpack_from("<4s4xII", data, at + 16 * k) for k in range(size // 16)]
    own = {b"%02ddc" % (video or 0), b"%02ddb" % (video or 0)}
    spans: list[tuple[int, int]] = []
    listed: list[list[tuple[bytes, tuple[int, int]]]] = [[] for _ in movies]
    if index and movies:
        first = index[0][1]
        base = movies[0][0] - 4 if data[movies[0][0] - 4 + first : movies[0][0] + first] == index[0][0] else 0
        begins = [at for at, _ in movies]
        for name, place, size in index:
            listed[max(bisect_right(begins, base + place) - 1, 0)].append((name, (base + place + 8, size)))
    for (at, size), entries in zip(movies, listed, strict=True):
        spans += [span for name, span in entries if name in own]
        todo = [] if entries else [*_walk(data, at, at + size)]
        while todo:
            name, kind, begin, n = todo.pop(0)
            if kind == b"rec ":
                todo = [*_walk(data, begin, begin + n), *todo]
            elif name in own:
                spans.append((begin, n))
    return Avi(data, width, height, frame_us, comment, spans)


def store_payload(payload: bytes, side: int = SIDE) -> bytes:
    """An AVI file that holds the bytes of ``payload`` (a multiple of 64) as JPEG coefficients, exactly."""
    frames = encode_payload(np.frombuffer(payload, np.uint8), side, side)
    return write_avi(frames, side, side, comment=b"bytes=%d" % len(payload))


def histograms(frames: list[Frame]) -> np.ndarray:
    """Shares of luma levels per frame, after full decoding."""
    counts = [np.bincount(f.planes()[0].reshape(-1) // (256 // HISTOGRAM), minlength=HISTOGRAM) for f in frames]
    return np.array(counts, float).reshape(-1, HISTOGRAM) / np.array([[f.width * f.height] for f in frames], float).reshape(-1, 1)


def shots(shares: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each shot, by adaptive differences of histograms."""
    apart = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    starts = [0] if len(shares) else []
    for k, value in enumerate(apart):
        before = apart[max(starts[-1], k - WINDOW) : k]
        limit = before.mean() + SPREAD * before.std() if len(before) else LEAST * 2
        if value > max(limit, LEAST):
            starts.append(k + 1)
    return [(a, b - 1) for a, b in zip(starts, [*starts[1:], len(shares)], strict=True)]


def clips(avi: Avi, frames: list[Frame] | None = None) -> list[tuple[int, int, int, int, int]]:
    """Timed clips of a file: number, first and last frame, begin and end in milliseconds."""
    return _timed(avi, shots(histograms(frames if frames is not None else list(avi.frames()))))


def _timed(avi: Avi, found: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    return [(k, a, b, round(a * avi.frame_us / 1000), round((b + 1) * avi.frame_us / 1000)) for k, (a, b) in enumerate(found)]


_CLIP = ("clip", "first_frame", "last_frame", "start_ms", "end_ms")


def clip_rows(media: DataFrame, key: str, column: str) -> DataFrame:
    """Clips of each row's AVI file: key, clip, first_frame, last_frame, start_ms, end_ms, error.

    Null media have no rows; media that cannot be read have one with the reason as ``error``.  Repeated rows
    have their clips as often as they come; an empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _CLIP
        for batch in batches:
            for piece in slices(batch, column, 4 << 20):
                rows = []
                for k, data in zip(piece.column(key).to_pylist(), piece.column(column).to_pylist(), strict=True):
                    if data is None:
                        continue
                    try:
                        rows += [{key: k, "error": None} | dict(zip(names, c, strict=True)) for c in clips(read_avi(data))]
                    except (ValueError, struct.error, IndexError, KeyError) as problem:
                        rows.append({key: k, "error": str(problem) or type(problem).__name__} | dict.fromkeys(names))
                yield pa.RecordBatch.from_pylist(rows, pa.schema([piece.schema.field(key), *((n, pa.int64()) for n in names), ("error", pa.string())]))

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).transform(arrow_map, cut, f"`{key}` {kind}, clip long, first_frame long, last_frame long, start_ms long, end_ms long, error string")


def describe(text: bytes, side: int = SIDE) -> tuple:
    """Store one text, read it back, and describe what is read."""
    media = store_payload(text + b"\0" * (-len(text) % 64 or 64 * (not text)), side)
    avi = read_avi(media)
    frames = list(avi.frames())
    payload = b"".join(f.payload().tobytes() for f in frames)[: int(avi.comment.split(b"=")[1])]
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), *_seen(avi, histograms(frames))


def _seen(avi: Avi, shares: np.ndarray) -> tuple[str, list[tuple[int, int, int, int, int]]]:
    """The feature and the timed clips of a file by its frames' histograms."""
    cuts = shots(shares)
    levels = shares.mean(axis=0) * 1e6
    feature = f"frames={len(shares)};shots={len(cuts)};cuts={zlib.crc32(repr(cuts).encode()):08x};levels={','.join(f'{x:.0f}' for x in levels)}"
    return feature, _timed(avi, cuts)


def describe_long(text: bytes, path: str, side: int = SIDE, group: int = GROUP) -> tuple:
    """As ``describe``, by way of a file at ``path`` in the shared folder, with ``group`` frames in memory at once."""
    size = len(text) + (-len(text) % 64 or 64 * (not text))
    step = side * side * group

    def frames() -> Iterator[bytes]:
        for at in range(0, size, step):
            part = text[at : at + step]
            yield from encode_payload(np.frombuffer(part + b"\0" * (min(step, size - at) - len(part)), np.uint8), side, side)

    before, after = _around([len(f) for f in frames()], side, side, FRAME_MICROSECONDS, b"bytes=%d" % size)
    put_file(path, chain([before], (_chunk(b"00dc", f) for f in frames()), [after]))
    try:
        media = memoryview(mapped(path))
        avi = read_avi(media)
        left, shares, tail, read = int(avi.comment.split(b"=")[1]), [], b"", hashlib.sha256()
        n = left
        todo = avi.frames()
        while some := list(islice(todo, group)):
            shares.append(histograms(some))
            payload = b"".join(f.payload().tobytes() for f in some)[:left]
            left -= len(payload)
            read.update(payload)
            tail = (tail + payload[-64:])[-64:]
        found = _seen(avi, np.concatenate(shares))
        return len(text), n - left, read.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), *found
    finally:
        drop_file(path)


def text_media_digests(docs: DataFrame, side: int = SIDE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): what ``describe`` says of the text, with its timed clips.

    Null texts are empty and have one padded frame, as empty ones do.  Repeated rows and equal texts give equal
    values; an empty table gives no rows.  Texts of ``LONG_TEXT`` bytes and more go through a file in the shared folder,
    frame by frame, and take memory for little more than themselves.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    clip = pa.list_(pa.struct([(n, pa.int64()) for n in _CLIP]))
    folder = work_dir(docs.sparkSession, "media")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                own = (describe(t, side) if len(t) < LONG_TEXT else describe_long(t, f"{folder}/{uuid.uuid4().hex}.avi", side) for t in texts(piece.column("text")))
                *columns, found = zip(*own, strict=True)
                cut = pa.array([[dict(zip(_CLIP, c, strict=True)) for c in own] for own in found], clip)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), cut], ["doc_id", *names, "clips"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(
        arrow_map, described, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        f"clips array<struct<{', '.join(f'{n}: bigint' for n in _CLIP)}>>"
    )

"""Baseline JPEG: a decoder for intra frames of motion-JPEG, and a writer that keeps coefficients exactly.

The writer codes every coefficient with one Huffman symbol, "no zero run, eight bits", whose code is a
single 0 bit.  A payload byte is then the eight magnitude bits of one coefficient, and a block of 64 bytes
fills exactly 72 bytes; a restart marker after every block keeps DC values free of prediction.  Reading
back is exact because entropy coding is: no sample is ever rounded.  Frames stay valid baseline JPEG.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Fixed values of the JPEG standard: zigzag order as row * 8 + column.
ZIGZAG = np.array([r * 8 + c for s in range(15) for r, c in sorted(((r, s - r) for r in range(8) if 0 <= s - r < 8), key=lambda x: x[0] if s % 2 else x[1])])

_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_BLOCK = 72


def _cosines() -> np.ndarray:
    """64 x 64: coefficients in zigzag order to samples by rows."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG]


_COSINES = _cosines()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_header(width: int, height: int) -> bytes:
    """All that stands before the coded data of a grey frame."""
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, b"\0" + b"\x01" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + b"\x01" + b"\0" * 15 + b"\x08"),
        _segment(0xC4, b"\x10" + b"\x01" + b"\0" * 15 + b"\x08"),
        _segment(0xDD, b"\0\x01"),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def encode_payload(payload: np.ndarray, width: int, height: int) -> list[bytes]:
    """Frames of width x height samples that hold the bytes of ``payload``, one per coefficient; the last is filled up with zeros."""
    per_frame = width * height // 64
    blocks = payload.reshape(-1, 64)
    spare = -len(blocks) % per_frame
    if spare:
        blocks = np.concatenate([blocks, np.zeros((spare, 64), np.uint8)])
    eights = blocks.reshape(-1, 8)
    coded = np.empty((len(eights), 9), np.uint8)
    for j in range(9):  # eight times: a 0 bit, then eight bits
        left = eights[:, j - 1] << np.uint8(8 - j) if j else 0
        coded[:, j] = left | (eights[:, j] >> np.uint8(j + 1) if j < 8 else 0)
    out = np.empty((len(blocks), _BLOCK + 2), np.uint8)
    out[:, :_BLOCK] = coded.reshape(-1, _BLOCK)
    out[:, _BLOCK] = 0xFF
    out[:, _BLOCK + 1] = 0xD0 + np.arange(len(blocks)) % per_frame % 8
    stuffed = (out[:, :_BLOCK] == 0xFF).reshape(-1, per_frame * _BLOCK).any(axis=1)
    head, frames = frame_header(width, height), []
    for k, full in enumerate(stuffed):
        own = out[k * per_frame : (k + 1) * per_frame]
        if full:
            mark = np.zeros(own.shape, bool)
            mark[:, :_BLOCK] = own[:, :_BLOCK] == 0xFF
            mark = mark.reshape(-1)
            repeated = np.repeat(own.reshape(-1), 1 + mark)
            repeated[np.flatnonzero(mark) + np.arange(1, mark.sum() + 1)] = 0
            scan = repeated.tobytes()
        else:
            scan = own.tobytes()
        frames.append(head + scan[:-2] + b"\xff\xd9")
    return frames


def _huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit prefix: length of the code (0: none) and its symbol."""
    lengths, found = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            low = code << (16 - length)
            lengths[low : low + (1 << (16 - length))] = length
            found[low : low + (1 << (16 - length))] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return lengths, found


def _ac_symbols(first: str) -> bytes:
    """All symbols of run and size: the given ones, then the others in ascending order."""
    known = bytes.fromhex(first)
    others = [run << 4 | size for run in range(16) for size in range(1, 11)]
    return known + bytes(s for s in others if s not in known)


# Fixed values of the JPEG standard's typical tables, which motion-JPEG frames may leave out:
# code counts per length, then symbols.
_DEFAULTS = {
    0x00: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x10: (
        bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
        _ac_symbols("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a"),
    ),
    0x11: (
        bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
        _ac_symbols("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
    ),
}


class Frame:
    """A parsed frame: geometry, tables and entropy-coded data of one sequential scan."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        self.tables: dict[int, tuple[bytes, bytes]] = dict(_DEFAULTS)
        self.quantisers: dict[int, np.ndarray] = {}
        self.interval, at = 0, 2
        self.components: list[tuple[int, int, int, int]] = []
        self.scan: list[tuple[int, int, int]] = []
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._tables(body)
            elif marker in (0xC0, 0xC1):
                precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if precision != 8:
                    raise ValueError("only samples of 8 bits are read")
                self.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                end = data.rfind(b"\xff\xd9")
                self.coded = data[at : end if end >= at else len(data)]
                return
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("only sequential Huffman frames are read")

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, name = body[at] >> 4, body[at] & 15
            kind = ">u2" if wide else "u1"
            self.quantisers[name] = np.frombuffer(body, kind, 64, at + 1).astype(np.int64)
            at += 1 + 64 * (1 + wide)

    def _tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.tables[body[at]] = (counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def fixed_width(self) -> bool:
        """Whether every coefficient is one 0 bit and eight magnitude bits, as the writer above has it."""
        plain = (b"\x01" + b"\0" * 15, b"\x08")
        return self.interval == 1 and len(self.components) == 1 and len(self.scan) == 1 and self.tables.get(self.scan[0][1]) == plain and self.tables.get(0x10 | self.scan[0][2]) == plain

    def payload(self) -> np.ndarray:
        """The magnitude bytes of a frame of fixed width, all blocks in order."""
        blocks = -(-self.width // 8) * -(-self.height // 8)
        if len(self.coded) == blocks * (_BLOCK + 2) - 2:
            rows = np.frombuffer(self.coded + b"\xff\xd0", np.uint8).reshape(blocks, _BLOCK + 2)[:, :_BLOCK]
        else:
            rows = np.frombuffer(_RESTART.sub(b"", self.coded).replace(b"\xff\x00", b"\xff"), np.uint8).reshape(blocks, _BLOCK)
        nines = np.ascontiguousarray(rows).reshape(-1, 9)
        out = np.empty((len(nines), 8), np.uint8)
        for j in range(8):
            out[:, j] = (nines[:, j] << np.uint8(j + 1)) | (nines[:, j + 1] >> np.uint8(7 - j))
        return out.reshape(-1)

    def coefficients(self) -> list[np.ndarray]:
        """Per component: blocks by rows of the padded plane, 64 quantised coefficients in zigzag order each."""
        if self.fixed_width():
            value = self.payload().astype(np.int64).reshape(-1, 64)
            return [np.where(value >= 128, value, value - 255)]
        order = {c[0]: k for k, c in enumerate(self.components)}
        wide, tall = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.components) == 1:
            across, down, plan = -(-self.width // 8), -(-self.height // 8), [(0, 1, 1)]
            wide = tall = 1
        else:
            across, down = -(-self.width // (8 * wide)), -(-self.height // (8 * tall))
            plan = [(order[s[0]], self.components[order[s[0]]][1], self.components[order[s[0]]][2]) for s in self.scan]
        out = [np.zeros((down * v, across * h, 64), np.int64) for _, h, v in plan]
        tables = [(_huffman(*self.tables[s[1]]), _huffman(*self.tables[0x10 | s[2]])) for s in self.scan]
        parts = [p.replace(b"\xff\x00", b"\xff") for p in _RESTART.split(self.coded)] if self.interval else [self.coded.replace(b"\xff\x00", b"\xff")]
        for k, part in enumerate(parts):
            first = k * self.interval
            last = min(first + self.interval, across * down) if self.interval else across * down
            bits = int.from_bytes(part + b"\xff" * 8, "big")
            left = len(part) * 8 + 64
            previous = [0] * len(plan)
            for unit in range(first, last):
                y, x = divmod(unit, across)
                for c, (_, h, v) in enumerate(plan):
                    for dy in range(v):
                        for dx in range(h):
                            left = self._block(bits, left, tables[c], previous, c, out[c][y * v + dy, x * h + dx])
        return [o.reshape(-1, 64) for o in out]

    @staticmethod
    def _block(bits: int, left: int, tables: tuple, previous: list[int], c: int, out: np.ndarray) -> int:
        k = 0
        while k < 64:
            lengths, symbols = tables[0 if k == 0 else 1]
            window = bits >> (left - 16) & 0xFFFF
            if not lengths[window]:
                raise ValueError("a code that no table has")
            left -= int(lengths[window])
            symbol = int(symbols[window])
            run, size = (0, symbol) if k == 0 else (symbol >> 4, symbol & 15)
            if k and not size and run < 15:
                break
            k += run
            value = 0
            if size:
                left -= size
                value = bits >> left & ((1 << size) - 1)
                if value < 1 << (size - 1):
                    value -= (1 << size) - 1
            if k == 0:
                previous[c] = value = previous[c] + value
            if k < 64:
                out[k] = value
            k += 1
        return left

    def planes(self) -> list[np.ndarray]:
        """Decoded samples of each component at full size; the first is luma."""
        found = []
        wide, tall = max(c[1] for c in self.components), max(c[2] for c in self.components)
        alone = len(self.components) == 1
        for coefficients, (_, h, v, q) in zip(self.coefficients(), self.components, strict=True):
            h, v, wide, tall = (1, 1, 1, 1) if alone else (h, v, wide, tall)
            across = -(-self.width // (8 * wide)) * h
            samples = (coefficients * self.quantisers[q]).astype(np.float64) @ _COSINES
            # the small shift keeps sums that end in .5 from depending on the order of additions
            samples = np.clip(np.floor(samples + 128.5 + 1e-6), 0, 255).astype(np.uint8)
            plane = samples.reshape(-1, across, 8, 8).transpose(0, 2, 1, 3).reshape(-1, across * 8)
            found.append(plane.repeat(tall // v, 0).repeat(wide // h, 1)[: self.height, : self.width])
        return found

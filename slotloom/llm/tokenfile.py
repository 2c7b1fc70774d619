"""Token-ID output in patched frame-of-reference blocks, and its reader.

A file holds documents in order.  Ids form blocks of 256: a block subtracts its minimum and packs the
differences at the width that holds a given percentile of them; differences that need more bits stand
whole in an exception list.  Block and exception starts are indexed, so any range of ids can be read alone.

File layout, little-endian: 48-byte header (magic, block size, documents, ids, blocks, exceptions, bytes of
packed data); packed data; exception positions (u2) and values (u4); per block the data start (i8),
exception start (i8), minimum (u4) and width (u1); per document the key (i8), whether it is set (u1) and
the end of its ids in the file (i8).  Sections are written last to first known, data as it comes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import arrow_map, get_file, put_file, slices, texts, work_dir
from slotloom.llm.words import Slots, Words, distinct, first_places, spread

BLOCK = 256
PERCENTILE = 0.9
MAGIC = b"SLPFOR1\0"
_HEADER = struct.Struct("<8sIIQQQQ")
#: Distinct words whose ids one worker keeps, and as many of the round before.
_CACHE_WORDS = 500_000
_CACHE_PARTS = 200_000
#: Ids from which a file is closed and the next one begun; only a longer document makes a longer file.
FILE_IDS = 16 << 20
_END = 1  # no word's hash


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class IdLists:
    """Lists of ids by the hash of a word, in flat arrays."""

    def __init__(self) -> None:
        self.slots = Slots()
        self.begins, self.lengths, self.flat = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32), np.empty(1 << 18, "<u4")
        self.used = 0

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        n = self.slots.count
        self.slots.add(keys)
        self.begins, self.lengths = (_room(x, n + len(keys)) for x in (self.begins, self.lengths))
        self.flat = _room(self.flat, self.used + len(ids))
        self.begins[n : n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(keys)] = lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the lists, and their ids one after another."""
        lengths = self.lengths[slots].astype(np.int64)
        return lengths, self.flat[spread(self.begins[slots], lengths)]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.empty(max(n - len(x), len(x)), x.dtype)])


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space, so that words between blanks are independent.

    Words are told apart by 64-bit hashes of their bytes as they came, and each new one is tokenized once.  A
    new word of Latin letters, with stops at its end or not, is two parts at most, and the library's model is
    asked once for each part.  The library encodes all other new words as texts, and as they came: it looks
    for its added tokens and composes marks before it turns to lower case.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4")
        self.parts: dict[str, bytes] = {}
        # how the library spells letters below U+0180 for its model
        letters = [c for c in map(chr, range(0x180)) if c.isalpha()]
        self.spelling = str.maketrans({c: self.library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})
        self.before = self._fresh()
        self.known = self._fresh()

    def _fresh(self) -> IdLists:
        lists = IdLists()
        lists.add(np.array([_END], np.uint64), np.array([1]), self.end)
        return lists

    def encode(self, all_texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has with the end id, and the ids of all texts in order."""
        if self.known.slots.count > _CACHE_WORDS:  # the words of the last round stay at hand once more
            self.before, self.known = self.known, self._fresh()
        if len(self.parts) > _CACHE_PARTS:
            self.parts.clear()
        words = Words(all_texts, fold=False)
        keys, of = distinct(words.hashes)
        slots = self.known.slots.find(keys)
        if (slots < 0).any():
            self._learn(words, keys, slots < 0, of)
            slots = self.known.slots.find(keys)
        ends = np.cumsum(words.counts + 1) - 1
        inner = np.ones(len(of) + len(ends), bool)
        inner[ends] = False
        chain = np.zeros(len(inner), np.int64)  # the list at 0 is the end
        chain[inner] = slots[of]
        lengths, ids = self.known.take(chain)
        return np.add.reduceat(lengths, np.concatenate([[0], ends[:-1] + 1])) if len(ends) else np.zeros(0, np.int64), ids

    def _learn(self, words: Words, keys: np.ndarray, new: np.ndarray, of: np.ndarray) -> None:
        earlier = self.before.slots.find(keys)
        again = np.flatnonzero(new & (earlier >= 0))
        self.known.add(keys[again], *self.before.take(earlier[again]))
        fresh = np.flatnonzero(new & (earlier < 0))
        at = first_places(of, len(keys))[fresh]
        blob = words.data.tobytes()
        lists = self._tokenized([blob[a:b] for a, b in zip(words.begins[at].tolist(), words.ends[at].tolist(), strict=True)])
        self.known.add(keys[fresh], np.fromiter(map(len, lists), np.int64, len(lists)) // 4, np.frombuffer(b"".join(lists), "<u4"))

    def _tokenized(self, new: list[bytes]) -> list[bytes]:
        found: list[bytes] = []
        others: dict[int, str] = {}
        for word in new:
            bare = word.rstrip(b".,;:!?%&*#$")
            letters = bare.decode("utf-8", "replace")
            # letters below U+0180 only change to lower case in the normaliser, and are one part; U+0130 becomes two characters
            if bare.isalpha() or letters.isalpha() and max(letters) < "\u0180" and (letters := letters.lower()).isalpha() and letters.islower():
                ids = self._part(letters.lower())
                found.append(ids if len(bare) == len(word) else ids + self._part(word[len(bare) :].decode()))
            else:
                others[len(found)] = word.decode("utf-8", "replace")
                found.append(b"")
        for k, e in zip(others, self.library.encode_batch_fast(list(others.values()), add_special_tokens=False), strict=True):
            found[k] = np.array(e.ids, "<u4").tobytes()
        return found

    def _part(self, part: str) -> bytes:
        """Ids of letters in lower case, or of stops."""
        ids = self.parts.get(part)
        if ids is None:
            ids = [t.id for t in self.library.model.tokenize(part if part.isascii() else part.translate(self.spelling))]
            ids = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return ids


_tokenizers: dict[tuple[str, int], WordTokenizer] = {}


def _tokenizer(path: str, end_id: int) -> WordTokenizer:
    if (path, end_id) not in _tokenizers:
        _tokenizers[path, end_id] = WordTokenizer(path, end_id)
    return _tokenizers[path, end_id]


def _packed(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers below 2 ** width as rows of bytes, lowest bits first."""
    if width > 16:
        bits = (rows[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        return np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
    eights = rows.reshape(len(rows), -1, 8)  # eight numbers are as many bytes as one has bits
    fours = np.zeros((*eights.shape[:2], 2), "<u8")
    for k in range(8):
        fours[:, :, k // 4] |= eights[:, :, k].astype(np.uint64) << np.uint64(k % 4 * width)
    if width < 16:
        low, high = fours[:, :, 0], fours[:, :, 1]
        low |= high << np.uint64(4 * width)
        high >>= np.uint64(64 - 4 * width)
    return fours.view(np.uint8)[:, :, :width].reshape(len(rows), -1)


def _unpacked(data: np.ndarray, width: int, block: int) -> np.ndarray:
    """The numbers of rows of bytes that ``_packed`` made."""
    if width > 16:
        bits = np.unpackbits(data, axis=1, bitorder="little").reshape(len(data), block, width)
        return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    whole = np.zeros((len(data), block // 8, 16), np.uint8)
    whole[:, :, :width] = data.reshape(len(data), -1, width)
    fours = whole.view("<u8")
    if width < 16:
        fours[:, :, 1] <<= np.uint64(64 - 4 * width)
        fours[:, :, 1] |= fours[:, :, 0] >> np.uint64(4 * width)
    out = np.empty((len(data), block // 8, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(8):
        out[:, :, k] = (fours[:, :, k // 4] >> np.uint64(k % 4 * width)) & mask
    return out.reshape(len(data), block)


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pack whole blocks: data, bytes and exceptions per block, minima, widths, and the exceptions as (position, value)."""
    rows = ids.astype(np.uint32).reshape(-1, block)
    least = rows.min(axis=1) if len(rows) else np.empty(0, np.uint32)
    apart = rows - least[:, None]
    rank = min(block - 1, int(np.ceil(percentile * block)) - 1)
    widths = np.ceil(np.log2(np.partition(apart, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(np.uint8)
    limit = (np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)
    patched = apart > limit[:, None]
    of, position = np.nonzero(patched)
    values = apart[of, position]
    low = np.where(patched, 0, apart).astype(np.uint32)
    sizes = widths.astype(np.int64) * (block // 8)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for width in np.unique(widths[widths > 0]):
        own = np.flatnonzero(widths == width)
        for begin in range(0, len(own), 2048):
            at = own[begin : begin + 2048]
            packed = _packed(low[at], int(width))
            out[starts[at][:, None] + np.arange(packed.shape[1])] = packed
    exceptions = np.stack([position.astype(np.uint32), values.astype(np.uint32)]) if len(of) else np.zeros((2, 0), np.uint32)
    return out.tobytes(), sizes, np.bincount(of, minlength=len(rows)), least, widths, exceptions


def unpack_blocks(data: np.ndarray, starts: np.ndarray, least: np.ndarray, widths: np.ndarray, exception_starts: np.ndarray, positions: np.ndarray, values: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Ids of the blocks whose data and exception starts are given; both start lists have one item more."""
    out = np.zeros((len(widths), block), np.uint32)
    for width in np.unique(widths[widths > 0]):
        own = np.flatnonzero(widths == width)
        size = int(width) * block // 8
        for begin in range(0, len(own), 2048):
            at = own[begin : begin + 2048]
            out[at] = _unpacked(data[starts[at][:, None] + np.arange(size)], int(width), block)
    of = np.repeat(np.arange(len(widths)), np.diff(exception_starts))
    out[of, positions] = values
    return (out + least[:, None]).reshape(-1)


class TokenFileWriter:
    """Collects the documents of one file in order; full blocks are packed at once."""

    def __init__(self) -> None:
        self.rest = np.empty(0, np.uint32)
        self.data: list[bytes] = []
        self.sizes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.least: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.exceptions: list[np.ndarray] = []
        self.keys: list[int | None] = []
        self.ends: list[int] = []
        self.total = 0

    def add(self, keys: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents by key and number of ids, and the ids of all of them."""
        self.keys += keys
        self.ends += (self.total + np.cumsum(lengths)).tolist()
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._pack(ids[:whole])
        self.rest = ids[whole:]

    def _pack(self, ids: np.ndarray) -> None:
        for begin in range(0, len(ids), BLOCK * 8192):
            data, *parts = pack_blocks(ids[begin : begin + BLOCK * 8192])
            self.data.append(data)
            for held, part in zip((self.sizes, self.counts, self.least, self.widths, self.exceptions), parts, strict=True):
                held.append(part)

    def pieces(self) -> Iterator[bytes]:
        """The file's bytes; the last block is filled up with its last id."""
        if len(self.rest):
            self._pack(np.concatenate([self.rest, np.repeat(self.rest[-1:], BLOCK - len(self.rest))]))
        join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        starts = np.concatenate([[0], np.cumsum(join(self.sizes, np.int64))]).astype("<i8")
        exception_starts = np.concatenate([[0], np.cumsum(join(self.counts, np.int64))]).astype("<i8")
        exceptions = np.concatenate([np.zeros((2, 0), np.uint32), *self.exceptions], axis=1)
        yield _HEADER.pack(MAGIC, BLOCK, len(self.keys), self.total, len(starts) - 1, exceptions.shape[1], int(starts[-1]))
        yield from self.data
        yield exceptions[0].astype("<u2").tobytes()
        yield exceptions[1].astype("<u4").tobytes()
        yield starts.tobytes()
        yield exception_starts.tobytes()
        yield join(self.least, np.uint32).astype("<u4").tobytes()
        yield join(self.widths, np.uint8).tobytes()
        yield np.array([k or 0 for k in self.keys], "<i8").tobytes()
        yield np.array([k is not None for k in self.keys], np.uint8).tobytes()
        yield np.array(self.ends, "<i8").tobytes()


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, blob: bytes):
        magic, self.block, documents, self.total, blocks, exceptions, size = _HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(blob, kind, count, at)
            at += found.nbytes
            return found

        self.data = take("u1", size)
        self.positions, self.values = take("<u2", exceptions), take("<u4", exceptions)
        self.starts, self.exception_starts = take("<i8", blocks + 1), take("<i8", blocks + 1)
        self.least, self.widths = take("<u4", blocks), take("u1", blocks)
        self.keys, self.valid, self.ends = take("<i8", documents), take("u1", documents), take("<i8", documents)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end (excluded), unpacking only their blocks."""
        first, last = begin // self.block, -(-end // self.block)
        if last <= first:
            return np.empty(0, np.uint32)
        low, high = self.exception_starts[first], self.exception_starts[last]
        found = unpack_blocks(
            self.data, self.starts[first:last], self.least[first:last], self.widths[first:last],
            self.exception_starts[first : last + 1] - low, self.positions[low:high], self.values[low:high], self.block,
        )
        return found[begin - first * self.block : end - first * self.block]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2) -> list[tuple[str, int]]:
    """Write all documents' ids to files in ascending order of doc_id; (path, ids) of each, in that order.

    Null texts are empty; every document ends with ``end_id``.  Null ids come first; rows of one id stand
    together, by a hash of the text and the text, repeated rows as often as they come.  An empty table has no files.  Texts are dealt to
    as many ranges of ids and hashes as there are shuffle partitions and pass through a sort that can spill; a range
    rolls to a new file every ``FILE_IDS`` ids, so a writer's memory does not depend on the range's size.
    """
    tokenizer = tokenizer or public_tokenizer()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # rows of one id, or of none, may fill several ranges
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, writer = _tokenizer(tokenizer, end_id), TokenFileWriter()
        part, number = TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            path = f"{folder}/ids-{part:06d}-{number:06d}.pfor"
            put_file(path, writer.pieces())
            row = {"part": part, "number": number, "path": path, "n_ids": writer.total}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64())]))

        for batch in batches:
            for piece in slices(batch, "text"):
                writer.add(piece.column("doc_id").to_pylist(), *words.encode(texts(piece.column("text"))))
                if writer.total >= FILE_IDS:
                    yield out()
                    writer, number = TokenFileWriter(), number + 1
        if writer.keys:
            yield out()

    rows = ordered.transform(arrow_map, write, "part int, number int, path string, n_ids long").collect()
    return [(r.path, r.n_ids) for r in sorted(rows)]


def read_token_files(docs_kind: str, files: list[tuple[str, int]], spark) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and ids_crc32, a task for each file."""
    starts = np.cumsum([0, *(n for _, n in files)]).tolist()
    listed = spark.createDataFrame([(k, path, start) for k, ((path, _), start) in enumerate(zip(files, starts, strict=False))], "id int, path string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                found = TokenFile(get_file(path))
                ends = found.ends
                begins = np.concatenate([[0], ends[:-1]])
                low = 0
                while low < len(ends):  # some four million ids at a time
                    high = max(low + 1, int(np.searchsorted(ends, begins[low] + (4 << 20), side="right")))
                    ids = found.ids(int(begins[low]), int(ends[high - 1])).astype("<u4")
                    base = int(begins[low])
                    sums = [zlib.crc32(ids[a - base : b - base]) for a, b in zip(begins[low:high].tolist(), ends[low:high].tolist(), strict=True)]
                    keys = pa.array(found.keys[low:high], mask=found.valid[low:high] == 0)
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array(begins[low:high] + start), pa.array(ends[low:high] - begins[low:high]), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    low = high

    return listed.repartitionById(max(1, len(files)), F.col("id")).transform(arrow_map, read, f"doc_id {docs_kind}, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and describe every document from what is read back."""
    files = write_token_files(docs, work_dir(docs.sparkSession, "tokens"), tokenizer, end_id)
    return read_token_files(docs.schema["doc_id"].dataType.simpleString(), files, docs.sparkSession)

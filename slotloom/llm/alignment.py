"""Alignment of two tokenizers' tokens over whole texts, by segments that are tokenised once each.

A text is cut before runs of white space where neither vocabulary can merge across: the byte-level tokenizer's
words never go on into white space, and no piece of the other has such white space after anything else (both are
checked when the files are read).  A token ends at every cut, so what holds for the segments holds for the text.

Documents come in blocks.  A block keeps its distinct segments as rows and its texts as numbers of them, in a file
of the shared folder.  Rows of equal segments meet, are tokenised and aligned once, links are counted over the
corpus, and a second join takes the alignments back to the blocks, which compose their documents.  What is
shuffled are distinct segments of blocks, never words of texts.  Counted pairs of ids, of which there are no more than
the vocabularies have, are sorted arrays in the shared folder, which workers map into memory.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotloom.llm.shared import arrow_map, open_arrays, put_arrays, read_arrays, release, slices, stored, texts, work_dir

#: Bytes of text of a block (one document at least), rows of a result batch, and segments that are composed at once.
BLOCK_BYTES = 32 << 20
_ROWS = 50_000
_STRETCH = 1 << 20
#: White space at which texts may be cut, where the vocabularies allow it.
_STOPS = " \t\n\x0b\x0c\r"
_BLANK = "▁"
_SPACES = [chr(c) for c in range(0x80, 0x10000) if chr(c).isspace()] + ["\u180e", "\u200b", "\ufeff"]
_PAIRS, _TRIPLES = (np.array([int.from_bytes(c.encode()) for c in _SPACES if len(c.encode()) == n]) for n in (2, 3))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_PAIR_SHIFT = 32
#: Files of counted pairs.
_SHARDS = 32
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def public_files() -> tuple[str, str]:
    """Files of the byte-level tokenizer (A) and of the piece model (B)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers, their tokens' bytes, and the white space at which texts may be cut."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_raw: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            self.a_raw[i] = bytes(letters[c] for c in name) if set(name) <= letters.keys() else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_raw = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.lone = self.b.piece_to_id(_BLANK)
        self.stops = self._checked(json.loads(self.a.to_str()), pieces)
        self.a_names, self.b_names = ([str(i) for i in range(len(raw))] for raw in (self.a_raw, self.b_raw))
        self.a_arrow, self.b_arrow = (pa.array(raw, pa.large_binary()) for raw in (self.a_raw, self.b_raw))
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in raw], np.int64) for raw in (self.a_raw, self.b_raw))

    def _checked(self, a: dict, pieces: list[str]) -> np.ndarray:
        """By byte, whether texts may be cut before it where something else than white space comes first."""
        words = a["pre_tokenizer"] or {}
        if a["normalizer"] or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex"):
            raise ValueError("the byte-level tokenizer may change texts or take words beyond white space")
        probe = "  a  ﬁé "
        if self.b.normalize(probe) != (_BLANK + probe).replace(" ", _BLANK) or pieces[self.lone] != _BLANK:
            raise ValueError("the piece model changes texts, or adds no blank before them")
        plain = [p.replace(_BLANK, " ") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        found = np.zeros(256, bool)
        for stop in _STOPS:
            inside = any(p[k] == stop and not p[k - 1].isspace() for p in plain for k in range(1, len(p)))
            # a segment that begins with a stop other than a blank has B's own blank before it, as a token of its own
            found[ord(stop)] = not inside and (stop == " " or not any(p.startswith(" " + stop) for p in plain))
        return found

    def cuts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where segments begin in texts that follow one another, each from a blank at ``begins``."""
        found = self.stops[data]
        found[1:] &= ~_IS_SPACE[data[:-1]]
        high = np.flatnonzero(found[1:] & (data[:-1] >= 0x80)) + 1
        if len(high):
            one, two, three = (data[np.maximum(high - k, 0)].astype(np.int64) for k in (1, 2, 3))
            found[high[np.isin(two << 8 | one, _PAIRS) | np.isin(three << 16 | two << 8 | one, _TRIPLES)]] = False
        found[begins] = True
        return np.flatnonzero(found)

    def tokens(self, segments: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers for segments that begin with a blank or another stop."""
        plain = [s.decode() for s in segments]
        a = [e.ids for e in self.a.encode_batch_fast(plain, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s.startswith(" ") else s for s in plain], num_threads=1)
        for k, s in enumerate(plain):
            if s == " ":
                b[k] = [self.lone]
            elif not s.startswith(" "):
                b[k] = b[k][1:]
        return a, b

    @staticmethod
    def _same(ids: list[list[int]], segments: list[bytes], raw: list[bytes], arrow: pa.Array) -> np.ndarray:
        """Whether the tokens' bytes are the segment's."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        joined = arrow.take(pa.array(np.fromiter((i for own in ids for i in own), np.int64, int(sizes.sum()))))
        ends = np.concatenate([[0], np.asarray(pc.binary_length(joined)).cumsum()]).astype(np.int64)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        whole = b"".join(joined.to_pylist())
        if np.array_equal(np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])]), lengths) and whole == b"".join(segments):
            return np.ones(len(ids), bool)
        return np.array([b"".join(raw[i] for i in own) == s for own, s in zip(ids, segments, strict=True)], bool)

    def aligned(self, segments: list[bytes]) -> tuple[np.ndarray, dict[str, list | np.ndarray]]:
        """Which segments both tokenizers give back; of those, A's tokens, links (a pair of ids each) and groups with ``;`` before each."""
        a, b = self.tokens(segments)
        good = self._same(a, segments, self.a_raw, self.a_arrow) & self._same(b, segments, self.b_raw, self.b_arrow)
        kept = np.flatnonzero(good).tolist()
        a, b = [a[k] for k in kept], [b[k] for k in kept]
        ends = np.cumsum(np.array([len(segments[k]) for k in kept], np.int64))
        a_ids, b_ids = (np.array([i for own in ids for i in own], np.int64) for ids in (a, b))
        a_ends, b_ends = np.cumsum(self.a_lengths[a_ids]), np.cumsum(self.b_lengths[b_ids])
        # between two ends that follow one another lies the overlap of one token of each kind
        both = np.union1d(a_ends, b_ends)
        links = a_ids[np.searchsorted(a_ends, both)] << _PAIR_SHIFT | b_ids[np.searchsorted(b_ends, both)]
        common = np.intersect1d(a_ends, b_ends)
        a_stop, b_stop = np.searchsorted(a_ends, common, "right").tolist(), np.searchsorted(b_ends, common, "right").tolist()
        a_names, b_names = [self.a_names[i] for i in a_ids], [self.b_names[i] for i in b_ids]
        groups, i, j = [], 0, 0
        for x, y in zip(a_stop, b_stop, strict=True):
            groups.append(f";{','.join(a_names[i:x])}|{','.join(b_names[j:y])}")
            i, j = x, y
        link_ends, group_ends = np.searchsorted(both, ends, "right"), np.searchsorted(common, ends, "right")
        parts = zip([0, *group_ends.tolist()], group_ends.tolist())
        return good, {
            "n_a": pa.array([len(x) for x in a], pa.int64()),
            "links": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], link_ends]), pa.int32()), pa.array(links)),
            "groups": pa.array(["".join(groups[x:y]).encode() for x, y in parts], pa.binary()),
        }


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(files: tuple[str, str]) -> Pair:
    if files not in _pairs:
        _pairs[files] = Pair(*files)
    return _pairs[files]


def _block(pair: Pair, ids: list[pa.Array], contents: list[bytes], path: str) -> pa.Array:
    """Write a block's file; the block's distinct segments, with how often each comes (an Arrow struct array)."""
    sizes = np.fromiter((len(t) + 1 if t else 0 for t in contents), np.int64, len(contents))
    data = np.frombuffer(b" ".join([b"", *filter(None, contents)]), np.uint8)
    contents.clear()  # they would only lie beside their copy
    ends = np.cumsum(sizes)
    cuts = pair.cuts(data, (ends - sizes)[sizes > 0])
    offsets = np.append(cuts, len(data)).astype(np.int64)
    segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = segments.dictionary_encode()
    codes = np.asarray(coded.indices)
    counts = np.bincount(codes, minlength=len(coded.dictionary))
    order = np.argsort(-counts, kind="stable")  # frequent segments get small numbers
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    names = pa.chunked_array(ids).combine_chunks()
    numbers = np.asarray(pc.fill_null(names, 0)).astype("<i8")
    put_arrays(path, [
        numbers, np.asarray(names.is_null()).astype("u1"), np.diff(np.searchsorted(cuts, ends), prepend=0).astype("<u4"), *_packed(rank[codes]),
    ])
    return pa.StructArray.from_arrays([coded.dictionary.take(pa.array(order)).cast(pa.binary()), pa.array(counts[order])], ["segment", "n"])


def _packed(codes: np.ndarray) -> list[np.ndarray]:
    """Numbers below 2^32 as compressed planes of their bytes; high planes are mostly zeros."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return [np.frombuffer(pa.compress(np.ascontiguousarray(p).tobytes(), "zstd", asbytes=True), np.uint8) for p in planes]


def _read_block(folder: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which of them are null, numbers of segments, and the segments of a block's documents."""
    names, missing, sizes, *planes = read_arrays(f"{folder}/{block}")
    codes = np.empty((int(sizes.sum()), 4), np.uint8)
    for k, plane in enumerate(planes):
        codes[:, k] = np.frombuffer(pa.decompress(plane.tobytes(), len(codes), "zstd", asbytes=True), np.uint8) if len(codes) else 0
    return names, missing, sizes, codes.view("<u4")[:, 0]


def _split(docs: DataFrame, files: tuple[str, str], folder: str, block_bytes: int) -> DataFrame:
    """block, place, segment and n (times in the block) of the blocks' distinct segments; a block without any has a row of nulls."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(files)

        def rows(ids: list[pa.Array], contents: list[bytes]) -> Iterator[pa.RecordBatch]:
            name = int.from_bytes(os.urandom(8)) >> 1  # an attempt of a task has blocks of its own
            found = _block(pair, ids, contents, f"{folder}/{name}")
            for at in range(0, max(len(found), 1), _ROWS):
                part = found[at : at + _ROWS]
                n = max(len(part), 1)
                columns = [part.field("segment"), part.field("n")] if len(part) else [pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())]
                places = pa.array(np.arange(at, at + n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), places, *columns], ["block", "place", "segment", "n"])

        ids: list[pa.Array] = []
        contents: list[bytes] = []
        held = 0
        for batch in batches:
            for piece in slices(batch, "text", block_bytes):
                own = texts(piece.column("text"))
                if held and held + sum(map(len, own)) > block_bytes:
                    yield from rows(ids, contents)
                    ids, contents, held = [], [], 0
                ids.append(piece.column("doc_id"))
                contents += own
                held += sum(map(len, own))
                del own
        if ids:
            yield from rows(ids, contents)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(arrow_map, split, "block long, place int, segment binary, n long")


def _align(distinct: DataFrame, files: tuple[str, str]) -> DataFrame:
    """Distinct segments (segment, n) with n_a, links and groups, which are null where the bytes differ."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(files)
        for batch in batches:
            for piece in slices(batch, "segment", 4 << 20):
                good, found = pair.aligned(piece.column("segment").to_pylist())
                at = pa.array(np.cumsum(good) - 1, mask=~good)
                yield pa.RecordBatch.from_arrays([piece.column("segment"), piece.column("n"), *(c.take(at) for c in found.values())], ["segment", "n", *found])

    return distinct.transform(arrow_map, align, "segment binary, n long, n_a long, links array<long>, groups binary")


def _lost(rows: DataFrame, failed: DataFrame, folder: str) -> DataFrame:
    """segment and n: occurrences in documents that hold a segment whose bytes differ; such documents have no tokens."""

    def count(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        _, _, sizes, codes = _read_block(folder, block)
        bad = np.isin(codes, np.asarray(group.column("place")))
        of = np.repeat(np.arange(len(sizes)), sizes)
        ill = np.zeros(len(sizes), bool)
        ill[of[bad]] = True
        place, n = np.unique(codes[ill[of]], return_counts=True)
        return pa.table([pa.array(np.full(len(place), block)), pa.array(place.astype(np.int32)), pa.array(n)], ["block", "place", "gone"])

    touched = rows.join(failed, "segment", "left_semi").select("block", "place")
    gone = touched.groupBy("block").applyInArrow(count, "block long, place int, gone long")
    return rows.join(gone, ["block", "place"]).groupBy("segment").agg(F.sum("gone").alias("gone"))


def _counted(aligned: DataFrame) -> DataFrame:
    """pair, count and best of every linked pair of ids; best: no pair of its B id has a higher count.

    A B id has no more pairs than the other vocabulary has tokens.
    """
    links = aligned.where("n > 0").select("n", F.explode("links").alias("pair"))
    counts = links.groupBy("pair").agg(F.sum("n").alias("count"))
    own = Window.partitionBy(F.col("pair").bitwiseAND((1 << _PAIR_SHIFT) - 1))
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(own)).cast("long").alias("best"))


def _shard(pairs: np.ndarray) -> np.ndarray:
    return ((pairs >> _PAIR_SHIFT) * 7 + (pairs & ((1 << _PAIR_SHIFT) - 1))) % _SHARDS


def _put_pairs(pairs: DataFrame, folder: str) -> None:
    """Write the counted pairs as sorted arrays: pairs, counts, and which are best."""

    def put(group: pa.Table) -> pa.Table:
        own = group.sort_by("pair")
        number = int(own.column("shard")[0].as_py())
        put_arrays(f"{folder}/{number}", [np.asarray(own.column(c)).astype(kind) for c, kind in (("pair", "<i8"), ("count", "<i8"), ("best", "u1"))])
        return pa.table([pa.array([number], pa.int32())], ["shard"])

    low = F.col("pair").bitwiseAND((1 << _PAIR_SHIFT) - 1)
    shard = ((F.shiftright("pair", _PAIR_SHIFT) * 7 + low) % _SHARDS).cast("int")
    pairs.withColumn("shard", shard).groupBy("shard").applyInArrow(put, "shard int").collect()


def _values(aligned: DataFrame, folder: str) -> DataFrame:
    """segment, tokens (of A, and best links in the low 32 bits), count_sum and groups of each aligned segment."""

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = batch.column("links")
            pairs = np.asarray(links.flatten())
            begins = np.cumsum(np.asarray(links.value_lengths())) - np.asarray(links.value_lengths())
            found, shards = np.zeros((2, len(pairs)), np.int64), _shard(pairs)
            order = np.argsort(shards, kind="stable")
            stops = np.searchsorted(shards[order], np.arange(_SHARDS + 1))
            for k, (low, high) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)):
                own = order[low:high]
                if len(own) and (arrays := open_arrays(f"{folder}/{k}")):
                    keys, counts, best = arrays
                    at = np.minimum(np.searchsorted(keys, pairs[own]), len(keys) - 1)
                    hit = keys[at] == pairs[own]  # pairs of documents without tokens are not counted
                    found[0, own], found[1, own] = np.where(hit, counts[at], 0), hit & (best[at] != 0)
            sums, best = np.add.reduceat(found, begins, axis=1) if len(begins) else found
            tokens = np.asarray(batch.column("n_a")) << 32 | best
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(tokens), pa.array(sums), batch.column("groups")], ["segment", "tokens", "count_sum", "groups"])

    good = aligned.where("n_a IS NOT NULL").select("segment", "n_a", "links", "groups")
    return good.transform(arrow_map, value, "segment binary, tokens long, count_sum long, groups binary")


def _composed(values: DataFrame, folder: str, with_groups: bool) -> DataFrame:
    def compose(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        names, missing, sizes, codes = _read_block(folder, group.column("block")[0].as_py())
        tokens, sums = (group.column(c).combine_chunks() for c in ("tokens", "count_sum"))
        good = np.asarray(tokens.is_valid())
        parts = group.column("groups").combine_chunks().cast(pa.large_binary())
        tokens = np.asarray(pc.fill_null(tokens, 0))
        n_a, n_groups = tokens >> 32, np.asarray(pc.fill_null(pc.count_substring(parts, ";"), 0)).astype(np.int64)
        n_b = 2 * n_groups + np.asarray(pc.fill_null(pc.count_substring(parts, ","), 0)) - n_a
        # each end of a token ends a link, and ends that both have are the groups'
        numbers = np.stack([n_a, n_b, n_groups, n_a + n_b - n_groups, tokens & 0xFFFFFFFF, np.asarray(pc.fill_null(sums, 0))]).T
        total, digests, whole = np.zeros((len(names), len(_NUMBERS)), np.int64), [""] * len(names), [""] * len(names)
        end = 0
        for d, n in enumerate(sizes.tolist()):
            begin, end = end, end + n
            if not n or not good[codes[begin:end]].all():
                continue
            state, held, skip = hashlib.sha256(), [], 1
            for at in range(begin, end, _STRETCH):
                own = codes[at : min(at + _STRETCH, end)]
                total[d] += numbers[own].sum(axis=0)
                taken = parts.take(pa.array(own))
                last = np.frombuffer(taken.buffers()[1], np.int64)[len(own)]
                text = memoryview(taken.buffers()[2])[skip:last]
                state.update(text)
                if with_groups:
                    held.append(bytes(text))
                skip = 0
            digests[d], whole[d] = state.hexdigest(), b"".join(held).decode()
        ids = pa.array(names, pa.int64(), mask=missing.astype(bool))
        del group, parts, numbers, codes
        release()
        more = {"groups": pa.array(whole, pa.string())} if with_groups else {}
        return pa.table({"doc_id": ids} | {c: total[:, k] for k, c in enumerate(_NUMBERS)} | {"groups_sha256": pa.array(digests, pa.string())} | more)

    return values.groupBy("block").applyInArrow(compose, SCHEMA + ", groups string" * with_groups)


def _prepared(docs: DataFrame, files: tuple[str, str] | None, block_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Blocks' segments, aligned distinct segments, counted pairs, and the folder of the blocks' files."""
    files = files or public_files()
    _pair(files)  # files that do not fit fail here
    folder = work_dir(docs.sparkSession, "blocks")
    rows = stored(_split(docs, files, folder, block_bytes), "segments", "zstd")
    distinct = rows.where("segment IS NOT NULL").groupBy("segment").agg(F.sum("n").alias("n"))
    aligned = stored(_align(distinct, files), "aligned", "zstd")
    failed = aligned.where("n_a IS NULL").select("segment")
    counted = aligned.where("n_a IS NOT NULL")
    if not failed.isEmpty():
        lost = _lost(rows, failed, folder)
        counted = counted.join(lost, "segment", "left").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0)))
    return rows, aligned, stored(_counted(counted), "pairs"), folder


def link_counts(docs: DataFrame, files: tuple[str, str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """a, b, count, best: how many links of the corpus hold each pair of ids, and whether no pair of b has more."""
    pairs = _prepared(docs, files, block_bytes)[2]
    low = (1 << _PAIR_SHIFT) - 1
    return pairs.select(F.shiftright("pair", _PAIR_SHIFT).alias("a"), F.col("pair").bitwiseAND(low).alias("b"), "count", F.col("best").cast("boolean").alias("best"))


def align_documents(docs: DataFrame, files: tuple[str, str] | None = None, with_groups: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Numbers of tokens, groups and links of every document (doc_id, text), and the digest of its groups.

    ``with_groups`` adds the groups themselves (``a1,a2|b1;a3|b2,b3``).  Texts that are null or empty, or that a
    tokenizer does not give back byte for byte, have no tokens: zeros and the empty text; their links count nowhere.
    Every row gives one row, repeated rows and rows without an id too; long texts are whole, and composed in
    stretches.  No rows give no rows.
    """
    rows, aligned, pairs, folder = _prepared(docs, files, block_bytes)
    counted = work_dir(docs.sparkSession, "counted")
    _put_pairs(pairs, counted)
    values = rows.select("block", "place", "segment").join(_values(aligned, counted), "segment", "left").drop("segment")
    return _composed(values, folder, with_groups)

"""LM scoring with an interpolated modified Kneser-Ney model of order 2 or 3.

Counting happens in Spark in three passes.  Words are counted by hash; in a shard of hashes the more
frequent word has the smaller id, so that ids pack well.  Triples of ids are counted per shard of a hash of
their first two words, and pairs per shard of a hash of the pair, so no frequent word or pair meets in one
task; counts travel as sorted, compressed blocks.  In order 3 a pair counts as many words as come before it.
Every shard then holds the whole count of its pairs, so what each word needs (how often and how variously it
is followed, after how many words it comes) is a sum of the shards' parts, gathered per shard of words.

The model is a set of sorted hash arrays and arrays by id in the shared folder, which workers memory-map.
A hash array keeps 32 bits of each hash and an index by the bits before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import arrow_map, key_crc, mix64, open_arrays, put_arrays, slices, stored, texts, work_dir
from slotloom.llm.words import Words, distinct, spread

#: Hash of the end of a text, which counts as a word, and the id that stands before its first word.
END = 1
#: About so many words of text per shard of words, and words of text per shard of pairs or triples.
SHARD_WORDS = 8_000_000
SHARD_PAIRS = 3_000_000
_BATCH_TOKENS = 2_000_000
_BATCH_WORDS = 1_500_000
_SLICE_BYTES = 6 << 20
HELD_OUT = 10
_FIRST = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


@dataclass
class Model:
    """Where the arrays are, and the handful of numbers that belong to the whole corpus.

    Files are named by the number of their shard; a shard without words or pairs has none.
    """

    folder: str
    bits: int
    shards: int
    order: int
    vocabulary: int
    tokens: int
    texts: int
    first_kinds: np.ndarray
    pair_types: int
    word_discounts: np.ndarray
    pair_discounts: np.ndarray
    triple_discounts: np.ndarray
    lower_weight: float


# sorted hash arrays


def place_in_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each hash by its upper half, and what is left of it, in 64 bits and the same order."""
    product = (hashes >> _HALF) * np.uint64(shards)
    return (product >> _HALF).astype(np.int64), product << _HALF | hashes & _FIRST


def index_of(places: np.ndarray) -> list[np.ndarray]:
    """Starts of buckets by the first bits of ascending places, and the 32 bits after those of each place."""
    bits = max(0, int(len(places) // 8).bit_length() - 1)
    bucket = (places >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(places), np.int64)
    starts = np.zeros((1 << bits) + 1, "<u4")
    starts[1:] = np.cumsum(np.bincount(bucket, minlength=1 << bits))
    return [starts, (places >> np.uint64(32 - bits) & _FIRST).astype("<u4")]


def find_places(index: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """Where each place stands in an index; -1 where it does not."""
    starts, marks = index
    if not len(marks):
        return np.full(len(places), -1, np.int64)
    bits = (len(starts) - 1).bit_length() - 1
    bucket = (places >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(places), np.int64)
    wanted = (places >> np.uint64(32 - bits) & _FIRST).astype(np.uint32)
    return _bisect(marks, starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64), wanted)


def _bisect(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in its own ascending stretch of ``values``; -1 where it does not."""
    last = len(values) - 1
    ends = high.copy()
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (values[np.minimum(middle, last)] < wanted) & (middle < high)
        low = np.where(less, middle + 1, low)
        high = np.where(less, high, np.minimum(middle, high))
    return np.where((low < ends) & (values[np.minimum(low, last)] == wanted), low, -1)


def _small(counts: np.ndarray) -> list[np.ndarray]:
    """Counts in a byte each, with 255 for greater ones, which follow with their positions."""
    large = np.flatnonzero(counts >= 255)
    return [np.minimum(counts, 255).astype("u1"), large.astype("<u4"), counts[large].astype("<i8")]


def _counts_at(small: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """The counts at some positions; 0 at -1."""
    counts, large, values = small
    if not len(counts):
        return np.zeros(len(at), np.int64)
    found = np.where(at >= 0, counts[np.maximum(at, 0)], 0).astype(np.int64)
    full = np.flatnonzero(found == 255)
    found[full] = values[np.searchsorted(large, at[full])]
    return found


# blocks of counts on their way


def _planes(*columns: np.ndarray) -> bytes:
    """32-bit columns by bytes of equal weight, compressed."""
    return pa.compress(np.concatenate([x.astype("<u4").view(np.uint8).reshape(-1, 4).T.reshape(-1) for x in columns]).tobytes(), codec="zstd", asbytes=True)


def _columns(blob: bytes, k: int, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob, 4 * k * n, codec="zstd", asbytes=True), np.uint8).reshape(k, 4, n)
    return [np.ascontiguousarray(p.T).view("<u4").reshape(-1) for p in planes]


def _apart(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending 64-bit keys as steps of their upper halves, and their lower halves."""
    return np.diff(keys >> _HALF, prepend=np.uint64(0)), keys & _FIRST


def _together(steps: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64) << _HALF | lower.astype(np.uint64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = _firsts(keys)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _firsts(*ascending: np.ndarray) -> np.ndarray:
    """Where a run of equal items begins."""
    new = np.zeros(len(ascending[0]), bool)
    new[:1] = True
    for x in ascending:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _summed_triples(contexts: np.ndarray, ids: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples by context and id, with the sums of their counts (1 each, if none are given)."""
    order = np.argsort(contexts)
    contexts = contexts[order]
    first = _firsts(contexts)
    rank = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(first, append=len(contexts)))
    keys = rank << _HALF | ids[order].astype(np.uint64)
    if counts is None:
        keys.sort()
        at = _firsts(keys)
        sums = np.diff(at, append=len(keys))
        keys = keys[at]
    else:
        keys, sums = _summed(keys, counts[order])
    return contexts[first][(keys >> _HALF).astype(np.int64)], (keys & _FIRST).astype(np.uint32), sums


def _by_shard(of: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(of.astype(np.uint16) if shards <= 1 << 16 else of, kind="stable")
    edges = [*_firsts(of[order]).tolist(), len(of)]
    return [(int(of[order[a]]), order[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


_BLOCK_SCHEMA = "shard int, n int, block binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["shard", "n", "block"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "block")), strict=True)


# words


def _word_shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


class Vocabulary:
    """Ids of words, from memory-mapped sorted hashes; -1 for words that the corpus lacks."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.end = self.ids(np.array([END], np.uint64))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        order = np.argsort(hashes)
        ordered = hashes[order]
        found = np.full(len(hashes), -1, np.int64)
        of = _word_shard(ordered, self.bits)
        edges = [*_firsts(of).tolist(), len(of)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            k = int(of[a])
            if arrays := open_arrays(f"{self.folder}/words-{k:06d}"):
                keys, ranks, _ = arrays
                at = np.minimum(np.searchsorted(keys, ordered[a:b]), len(keys) - 1)
                found[order[a:b]] = np.where(keys[at] == ordered[a:b], ranks[at].astype(np.int64) << self.bits | k, -1)
        return found

    def encode(self, all_texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct words, with the end as the last; which of them each word is, the end after each text; and the place after each text's last."""
        words = Words(all_texts)
        keys, of = distinct(words.hashes)
        ends = np.cumsum(words.counts + 1)
        chain = np.full(int(ends[-1]) if len(ends) else 0, len(keys))
        inner = np.ones(len(chain), bool)
        inner[ends - 1] = False
        chain[inner] = of
        return np.concatenate([self.ids(keys), self.end]), chain, ends


def _count_words(train: DataFrame, folder: str) -> tuple[int, int, int, int]:
    """Write the shards of words; bits of their number, distinct words, words, and texts."""
    n_texts, size = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = (size // (6 * SHARD_WORDS)).bit_length()  # six bytes a word, about
    shards = 1 << bits

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = ends = 0

        def out() -> pa.RecordBatch:
            hashes, counts = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            of = _word_shard(hashes, bits)
            edges = [*_firsts(of).tolist(), len(of)]
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                steps = np.diff(hashes[a:b], prepend=np.uint64(0))
                rows.append((int(of[a]), b - a, _planes(steps >> _HALF, steps & _FIRST, counts[a:b] >> 32, counts[a:b] & 0xFFFFFFFF)))
            return _batch(rows)

        for batch in batches:
            for piece in slices(batch, "text"):
                ends += piece.num_rows
                keys, of = distinct(Words(texts(piece.column("text"))).hashes)
                held.append((keys, np.bincount(of, minlength=len(keys))))
                size += len(keys)
                if size > 2 * _BATCH_WORDS:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > _BATCH_WORDS:
                        yield out()
                        held, size = [], 0
        if ends:
            held.append((np.array([END], np.uint64), np.array([ends])))
            yield out()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for shard, n, block in _blocks(batches):
            upper, lower, more, less = (x.astype(np.uint64) for x in _columns(block, 4, n))
            own = held.setdefault(shard, [[], 0])
            own[0].append((np.cumsum(upper << _HALF | lower, dtype=np.uint64), (more << _HALF | less).astype(np.int64)))
            own[1] += n
            if own[1] > 2 * _BATCH_WORDS and len(own[0]) > 1:
                own[0], own[1] = [_summed(*(np.concatenate(x) for x in zip(*own[0], strict=True)))], 0
        for shard in list(held):
            hashes, counts = _summed(*(np.concatenate(x) for x in zip(*held.pop(shard)[0], strict=True)))
            by_count = np.argsort(-counts, kind="stable")
            ranks = np.empty(len(hashes), "<u4")
            ranks[by_count] = np.arange(len(hashes))
            put_arrays(f"{folder}/words-{shard:06d}", [hashes.astype("<u8"), ranks, counts[by_count].astype("<i8")])
            yield pa.RecordBatch.from_pylist([{"words": len(hashes), "tokens": int(counts.sum())}])

    blocks = train.transform(arrow_map, counted, _BLOCK_SCHEMA).repartitionById(shards, F.col("shard"))
    sizes = blocks.transform(arrow_map, write, "words long, tokens long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "tokens"))).first()
    return bits, *sizes, n_texts


# pairs and triples


def _contexts(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id before each word and the one before that; the first of a text follows a mark, as does the mark."""
    before = np.full(len(ids), _FIRST, np.uint64)
    before[1:] = ids[:-1]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    before[starts] = _FIRST
    second = np.full(len(ids), _FIRST, np.uint64)
    second[1:] = before[:-1]
    second[starts] = _FIRST
    return before, second


def _pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return place_in_shard(mix64(keys), shards)[0]


def _pair_rows(keys: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple[int, int, bytes]]:
    return [(k, len(at), _planes(*_apart(keys[at]), counts[at] >> 32, counts[at] & 0xFFFFFFFF)) for k, at in _by_shard(_pair_shard(keys, shards), shards)]


def _counted(train: DataFrame, folder: str, bits: int, shards: int, order: int) -> DataFrame:
    """Blocks of pairs (order 2) or of triples (order 3), by shards."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(folder, bits)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            contexts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if order == 2:
                return _batch(_pair_rows(*_summed(contexts << _HALF | ids, np.ones(len(ids), np.int64)), shards))
            contexts, ids, counts = _summed_triples(contexts, ids, None)
            # all texts share the context of their first words, so those are dealt by word
            spread_ = np.where(contexts & _FIRST == _FIRST, contexts ^ ids.astype(np.uint64), contexts)
            found = _by_shard(_pair_shard(spread_, shards), shards)
            return _batch([(k, len(at), _planes(*_apart(contexts[at]), ids[at], counts[at])) for k, at in found])

        for batch in batches:
            for piece in slices(batch, "text", _SLICE_BYTES):
                keys, of, ends = vocabulary.encode(texts(piece.column("text")))
                ids = keys[of].astype(np.uint32)
                before, second = _contexts(ids, ends)
                held.append((before if order == 2 else second << _HALF | before, ids))
                size += len(ids)
                if size > _BATCH_TOKENS:
                    yield out()
                    size = 0
        if size:
            yield out()

    return train.transform(arrow_map, counted, _BLOCK_SCHEMA).repartitionById(shards, F.col("shard"))


def _merge_triples(blocks: DataFrame, folder: str, shards: int) -> DataFrame:
    """Write what follows each context, and give blocks of pairs for the level below.

    A pair counts there as many as different words come before it, and at the start of a text as often as it is.
    Rows whose n is -1 have the numbers of triples counted 1, 2, 3 and 4 times.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for shard, n, block in _blocks(batches):
            steps, lower, ids, counts = _columns(block, 4, n)
            own = held.setdefault(shard, [[], 0])
            own[0].append((_together(steps, lower), ids, counts))
            own[1] += n
            if own[1] > 2 * SHARD_PAIRS and len(own[0]) > 1:
                own[0], own[1] = [_summed_triples(*(np.concatenate(x) for x in zip(*own[0], strict=True)))], 0
        for shard in list(held):
            contexts, ids, counts = _summed_triples(*(np.concatenate(x) for x in zip(*held.pop(shard)[0], strict=True)))
            first = contexts & _FIRST == _FIRST
            pairs = _summed((contexts & _FIRST) << _HALF | ids, np.where(first, counts, 1))
            yield _batch(_pair_rows(*pairs, shards))
            contexts, ids, counts = contexts[~first], ids[~first], counts[~first]
            kinds = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
            _write_contexts(f"{folder}/after-{shard:06d}", contexts, ids, counts, shards)
            yield _batch([(shard, -1, kinds.astype("<i8").tobytes())])

    return blocks.transform(arrow_map, merge, _BLOCK_SCHEMA).repartitionById(shards, F.col("shard"))


def _write_contexts(path: str, contexts: np.ndarray, ids: np.ndarray, counts: np.ndarray, shards: int) -> None:
    """Contexts seen once with the word after them; and the others with their four numbers and all words after them."""
    at = _firsts(contexts)
    size = np.diff(at, append=len(contexts))
    sums = [np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for x in (counts, counts == 1, counts == 2, counts >= 3)]
    places = place_in_shard(mix64(contexts[at]), shards)[1]
    order = np.argsort(places)
    once = sums[0][order] == 1
    one, more = order[once], order[~once]
    after = spread(at[more], size[more])
    put_arrays(path, [
        *index_of(places[one]), ids[at[one]].astype("<u4"), *index_of(places[more]), *(a for x in sums for a in _small(x[more])),
        np.concatenate([[0], np.cumsum(size[more])]).astype("<u4"), ids[after].astype("<u4"), *_small(counts[after]),
    ])


def _by_word(ids: np.ndarray, columns: list[np.ndarray], kind: int, bits: int) -> list[dict]:
    """Sums of columns by id as blocks for the shards of words."""
    turned = (ids & ((1 << bits) - 1)) << 32 | ids >> bits
    order = np.argsort(turned)
    turned = turned[order]
    at = _firsts(turned)
    if not len(at):
        return []
    sums = [np.add.reduceat(x[order].astype(np.int64), at) for x in columns]
    of, local = turned[at] >> 32, turned[at] & 0xFFFFFFFF
    edges = [*_firsts(of).tolist(), len(of)]
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        halves = [h for x in sums for h in (x[a:b] >> 32, x[a:b] & 0xFFFFFFFF)]
        rows.append({"kind": kind, "shard": int(of[a]), "n": b - a, "block": _planes(np.diff(local[a:b], prepend=0), *halves)})
    return rows


def _merge_pairs(blocks: DataFrame, folder: str, bits: int, shards: int) -> DataFrame:
    """Write the pairs' counts, and give each word's parts of them (kinds 1 and 2), numbers of pairs (0) and of triples (-1)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("block", pa.binary()), ("numbers", pa.list_(pa.int64()))])
        for shard, n, block in _blocks(batches):
            if n < 0:
                yield pa.RecordBatch.from_pylist([{"kind": -1, "numbers": np.frombuffer(block, "<i8").tolist()}], schema)
                continue
            steps, lower, more, less = _columns(block, 4, n)
            own = held.setdefault(shard, [[], 0])
            own[0].append((_together(steps, lower), more.astype(np.int64) << 32 | less))
            own[1] += n
            if own[1] > 2 * SHARD_PAIRS and len(own[0]) > 1:  # what repeats is summed before more comes
                own[0], own[1] = [_summed(*(np.concatenate(x) for x in zip(*own[0], strict=True)))], 0
        for shard in list(held):
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*held.pop(shard)[0], strict=True)))
            places = place_in_shard(mix64(keys), shards)[1]
            order = np.argsort(places)
            put_arrays(f"{folder}/pairs-{shard:06d}", [*index_of(places[order]), *_small(counts[order])])
            left, right = (keys >> _HALF).astype(np.int64), (keys & _FIRST).astype(np.int64)
            first = left == int(_FIRST)
            kinds = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
            starts = np.bincount(np.minimum(counts[first], 3), minlength=4)[1:4]
            rows = [{"kind": 0, "numbers": [*kinds.tolist(), *starts.tolist()]}]
            inner = counts[~first]
            rows += _by_word(left[~first], [inner == 1, inner == 2, inner >= 3, inner], 1, bits)
            rows += _by_word(right, [np.ones(len(keys), np.int64)], 2, bits)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return blocks.transform(arrow_map, merge, "kind int, shard int, n int, block binary, numbers array<long>")


def kneser_ney_discounts(kinds: np.ndarray) -> np.ndarray:
    """Discounts for counts 1, 2 and 3 or more from the numbers of items counted 1 to 4 times.

    Where those numbers give none (too few items), 0.5, 1 and 1.5 are taken.
    """
    n1, n2, n3, n4 = (float(x) for x in kinds)
    if n1 <= 0 or n2 <= 0:
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 > 0 else 1.5]
    return np.array([d if 0 < d < k else 0.5 * k for k, d in enumerate(found, 1)])


def _discount(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], discounts])[np.minimum(counts, 3)]


def train_model(train: DataFrame, order: int = 2) -> Model:
    """Count all texts of ``train`` and write the model of order 2 or 3 to the shared folder.

    Null texts are empty and count one end each; repeated rows count as often as they come; a table without
    rows gives a model that knows no word.  Texts may be of any length.
    """
    folder = work_dir(train.sparkSession, "ngrams")
    train = train.select("text")
    bits, vocabulary, tokens, n_texts = _count_words(train, folder)
    shards = max(1, -(-tokens // SHARD_PAIRS))
    blocks = _counted(train, folder, bits, shards, order)
    if order == 3:
        blocks = _merge_triples(blocks, folder, shards)
    merged = stored(_merge_pairs(blocks, folder, bits, shards), "pairs")
    summed = merged.where("kind <= 0").groupBy("kind").agg(*(F.sum(F.try_element_at("numbers", F.lit(k))) for k in range(1, 8))).collect()
    numbers = {0: np.zeros(7, np.int64), -1: np.zeros(4, np.int64)} | {kind: np.array([x for x in found if x is not None]) for kind, *found in summed}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for kind, shard, n, block in zip(*(batch.column(c).to_pylist() for c in ("kind", "shard", "n", "block")), strict=True):
                if shard not in held:
                    held[shard] = np.zeros((5, len(open_arrays(f"{folder}/words-{shard:06d}")[0])), np.int64)
                steps, *halves = (x.astype(np.int64) for x in _columns(block, 9 if kind == 1 else 3, n))
                at = np.cumsum(steps)
                for row, upper, lower in zip((1, 2, 3, 4) if kind == 1 else (0,), halves[::2], halves[1::2], strict=True):
                    held[shard][row, at] += upper << 32 | lower
        for shard, table in held.items():
            put_arrays(f"{folder}/stats-{shard:06d}", [x.astype("<i8" if x.max(initial=0) > 0xFFFFFFFF else "<u4") for x in table])
            kinds = np.bincount(np.minimum(table[0], 5), minlength=6)[1:5]
            row = {"kinds": kinds.astype("<i8").tobytes(), "more": int((table[0] >= 3).sum()), "total": int(table[0].sum())}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("kinds", pa.binary()), ("more", pa.int64()), ("total", pa.int64())]))

    dealt = merged.where("kind > 0").repartitionById(1 << bits, F.col("shard"))
    word_kinds, more, types = np.zeros(4, np.int64), 0, 0
    for r in dealt.transform(arrow_map, gather, "kinds binary, more long, total long").collect():
        word_kinds, more, types = word_kinds + np.frombuffer(r.kinds, "<i8"), more + r.more, types + r.total
    discounts = kneser_ney_discounts(word_kinds)
    lower = float(discounts @ np.array([word_kinds[0], word_kinds[1], more])) / types if types else 1.0
    return Model(
        folder, bits, shards, order, vocabulary, tokens, n_texts, numbers[0][4:], types,
        discounts, kneser_ney_discounts(numbers[0][:4]), kneser_ney_discounts(numbers[-1]), lower,
    )


class Scorer:
    """Looks up probabilities in the memory-mapped arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = Vocabulary(model.folder, model.bits)

    def words(self, ids: np.ndarray) -> np.ndarray:
        """For ids, six rows: count, number of words before it, of followers counted 1, 2, 3 or more times, and their sum; zeros for -1."""
        out = np.zeros((6, len(ids)), np.int64)
        known = np.flatnonzero(ids >= 0)
        bits = self.model.bits
        for k, at in _by_shard(ids[known] & ((1 << bits) - 1), 1 << bits):
            own, local = known[at], ids[known[at]] >> bits
            out[0, own] = open_arrays(f"{self.model.folder}/words-{k:06d}")[2][local]
            for row, values in enumerate(open_arrays(f"{self.model.folder}/stats-{k:06d}"), 1):
                out[row, own] = values[local]
        return out

    def _parts(self, keys: np.ndarray, name: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Keys by shards: where they stand among ``keys``, their places in the shard, and the shard's arrays."""
        hashes = mix64(keys)
        order = np.argsort(hashes)
        of, places = place_in_shard(hashes[order], self.model.shards)
        edges = [*_firsts(of).tolist(), len(of)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if arrays := open_arrays(f"{self.model.folder}/{name}-{int(of[a]):06d}"):
                yield order[a:b], places[a:b], arrays

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of pair keys; 0 if the corpus lacks one."""
        out = np.zeros(len(keys), np.int64)
        for at, places, (*index, small, large, values) in self._parts(keys, "pairs"):
            out[at] = _counts_at([small, large, values], find_places(index, places))
        return out

    def after(self, contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For contexts of two words, five rows: how often they are followed, by how many words once, twice, 3 or more times, and how often by ``ids``."""
        out = np.zeros((5, len(contexts)), np.int64)
        for at, places, arrays in self._parts(contexts, "after"):
            found = find_places(arrays[:2], places)
            once = found >= 0
            out[:2, at[once]] = 1
            out[4, at[once]] = arrays[2][found[once]] == ids[at[once]]
            at, places = at[~once], places[~once]
            found = find_places(arrays[3:5], places)
            at, found = at[found >= 0], found[found >= 0]
            for row in range(4):
                out[row, at] = _counts_at(arrays[5 + 3 * row : 8 + 3 * row], found)
            starts, followers = arrays[17], arrays[18]
            own = _bisect(followers, starts[found].astype(np.int64), starts[found + 1].astype(np.int64), ids[at].astype(np.uint32)) if len(found) else found
            out[4, at] = _counts_at(arrays[19:22], own)
        return out

    def score(self, all_texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: words with the end, known ones, base score, and log10 probability by the model."""
        m = self.model
        distinct_, of, ends = self.vocabulary.encode(all_texts)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        table = self.words(distinct_)
        base = np.log10((table[0] + 0.1) / (m.tokens + 0.1 * (m.vocabulary + 1)))
        lower = np.maximum(table[1] - _discount(table[1], m.word_discounts), 0) / max(m.pair_types, 1) + m.lower_weight / (m.vocabulary + 1)
        total = table[5].astype(float)
        back = np.where(total > 0, (m.pair_discounts @ table[2:5]) / np.maximum(total, 1), 1.0)
        ids = distinct_[of]
        first = np.zeros(len(ids), bool)
        first[starts] = True
        previous = np.concatenate([of[:1], of[:-1]])
        context = np.where(first, float(m.texts), total[previous])
        weight = np.where(first, float(m.pair_discounts @ m.first_kinds) / m.texts if m.texts else 1.0, back[previous])
        before, second = _contexts(ids.astype(np.uint32), ends)
        known = ids >= 0
        known_before = first | np.concatenate([[False], known[:-1]])
        at = np.flatnonzero(known & known_before)
        counts = np.zeros(len(ids), np.int64)
        counts[at] = self.pair_counts(before[at] << _HALF | ids[at].astype(np.uint64))
        p = np.where(context > 0, (counts - _discount(counts, m.pair_discounts)) / np.maximum(context, 1), 0) + weight * lower[of]
        if m.order == 3:
            second_known = np.concatenate([[False], known_before[:-1]])
            at = np.flatnonzero(~first & known_before & second_known)
            found = self.after(second[at] << _HALF | before[at], ids[at])
            d = m.triple_discounts
            seen = np.maximum(found[0], 1)
            by_pair = np.where(found[0] > 0, (d @ found[1:4]) / seen, 1.0)
            p[at] = np.where(found[0] > 0, (found[4] - _discount(found[4], d)) / seen, 0) + by_pair * p[at]
        sums = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        return np.diff(ends, prepend=0), sums(known.astype(np.int64)), sums(base[of]), sums(np.log10(p))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Null texts are empty: one end.  Repeated rows score alike, an empty table gives no rows, and a text of any
    length has one score.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for piece in slices(batch, "text", _SLICE_BYTES):
                n, known, base, score = scorer.score(texts(piece.column("text")))
                columns = [pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), *columns], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    inputs = docs.select("doc_id", "text", (key_crc("doc_id") % HELD_OUT == 0).alias("held_out"))
    return inputs.transform(arrow_map, scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_held_out(docs: DataFrame, order: int = 2) -> DataFrame:
    """Train on the documents that are not held out and score all of them."""
    return score_documents(docs, train_model(docs.where(key_crc("doc_id") % HELD_OUT != 0), order))

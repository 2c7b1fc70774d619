"""Jaccard self-join of shingle sets by PartEnum signatures, exact, with components of linked documents.

Sets fall into size bands whose ratio is the threshold, so linked sets lie in one band or in neighbours.
For each pair of neighbours the threshold bounds the symmetric difference by k.  The feature domain is
partitioned at random in two levels; with (k + 1) / 2 parts of three cells each, some part of two sets
within distance k differs in one feature at most, so two of its three cells agree: one signature per part
and pair of cells, and linked sets share one.  Two empty cells say nothing about a set.  Spare parts make up
for them: with m parts more, m + 1 parts differ in one feature at most, so a set with such cells in m parts or
fewer needs no signature of them.  Other sets, if they are small, are partitioned once more by other draws, and a
signature of empty cells counts together with one of that level.

Equal sets are one class from the start.  Signatures of classes travel as sorted, compressed blocks
dealt by their own hash.  In a shard, classes that share a signature are compared exactly unless links
found there already connect them; what is left out is thus implied.  Where very many classes that are
not connected share a signature, they are partitioned anew among themselves.  Sets are memory-mapped from the
shared folder.  Each shard yields a spanning forest, and a distributed star algorithm joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.llm.components import components
from slotloom.llm.shared import arrow_map, mix64, open_arrays, put_arrays, slices, stored, texts, work_dir
from slotloom.llm.words import Words, spread

CELLS = 3
#: Classes with one signature from which they are compared one against all.
CROWD = 12
#: Parts below which a set has no spare ones, and from which it is not partitioned once more.
FEW_PARTS = 4
MANY_PARTS = 24
#: Passes of one against all after which a crowd with so many classes left is partitioned anew, and how often.
PASSES = 8
BIG = 1_000
LEVELS = 3
#: Features that a crowd holds at once.
_HELD_FEATURES = 3_000_000
#: Bits of a mark for each feature of a crowd's largest set, at least, and 64-bit words of marks that a crowd holds.
_MARK_BITS = 8
_HELD_MARKS = 8 << 20
#: Signatures per shard, about, and signatures in a block before it is sent off.
SHARD_SIGNATURES = 1_500_000
_BLOCK_SIGNATURES = 500_000
#: Bytes of text, and features, that a task works on at once.
_SLICE_BYTES = 4 << 20
_SIGNED_FEATURES = 400_000
_LOW = np.uint64(0xFFFFFFFFFFFF)  # signatures keep 48 bits
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(all_texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of word shingles as ascending 64-bit features, their offsets, and two 64-bit sums of each whole set.

    A text of fewer words is one shingle; texts without words have empty sets.
    """
    found = Words(all_texts)
    begins = np.cumsum(found.counts) - found.counts
    rolled: dict[int, np.ndarray] = {}
    for n in np.unique(np.minimum(found.counts, words)).tolist():
        own = np.zeros(max(len(found.hashes) - n + 1, 0), np.uint64)
        for k in range(n):
            own = mix64(own + found.hashes[k : k + len(own)] + _STEP)
        rolled[n] = own
    parts, offsets = [], np.zeros(len(all_texts) + 1, np.int64)
    for i, (a, count) in enumerate(zip(begins.tolist(), found.counts.tolist(), strict=True)):
        if count:
            n = min(words, count)
            own = np.sort(rolled[n][a : a + count - n + 1])
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            parts.append(own[new])
            offsets[i + 1] = len(parts[-1])
    offsets = np.cumsum(offsets)
    features = np.concatenate([np.empty(0, np.uint64), *parts])
    sums = np.zeros((2, len(all_texts)), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    for row, salt in enumerate((0, 0x2545F4914F6CDD1D)):
        if len(full):
            sums[row, full] = np.add.reduceat(mix64(features ^ np.uint64(salt)), offsets[full])
    return features, offsets, sums


def size_bands(sizes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """First sizes of the bands up to the largest size (and two more), and the band of each size."""
    firsts = [1]
    top = int(sizes.max()) if len(sizes) else 1
    while firsts[-1] <= top:
        firsts.append(firsts[-1] * 100 // threshold + 1)
    for _ in range(2):
        firsts.append(firsts[-1] * 100 // threshold + 1)
    edges = np.array(firsts)
    return edges, np.searchsorted(edges, sizes, side="right") - 1


def signatures(features: np.ndarray, offsets: np.ndarray, threshold: int, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures of all (non-empty) sets and the set that each belongs to, by the draws of a level.

    A set takes part in the join of its band with the one below and with the one above.  Where only equal sets
    can link, the whole set is the signature.
    """
    sizes = np.diff(offsets)
    edges, bands = size_bands(sizes, threshold)
    out, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for above in (0, 1):
        largest = edges[bands + above + 1] - 1
        distance = 2 * largest * (100 - threshold) // (100 + threshold)
        some = np.flatnonzero(distance)
        own = features[spread(offsets[:-1][some], sizes[some])]
        smallest = edges[np.maximum(bands + above - 1, 0)]
        signature, who = _signatures(own, sizes[some], (bands + above)[some], distance[some], smallest[some], level)
        out.append(signature)
        of.append(some[who])
        same = np.flatnonzero(distance == 0)
        if len(same) and not above:
            own = mix64(features[spread(offsets[:-1][same], sizes[same])])
            out.append(mix64(np.add.reduceat(own, np.cumsum(sizes[same]) - sizes[same])))
            of.append(same)
    return np.concatenate(out), np.concatenate(of)


def _spare_parts(parts: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """Parts to add so that few sets of a band, down to its smallest ones, have more parts with two empty cells than that."""
    apart = np.where(parts < 16, 1.5, np.where(parts < 48, 2.0, 3.0))
    spare = np.zeros(len(parts))
    for _ in range(2):  # spare parts make all of them sparser
        expected = 3.0 * (parts + spare) * np.exp(-2 / 3 * smallest / (parts + spare))
        spare = np.where(parts < FEW_PARTS, 0, np.ceil(expected + apart * np.sqrt(expected)))
    return spare.astype(np.int64)


def _signatures(features: np.ndarray, sizes: np.ndarray, bands: np.ndarray, distances: np.ndarray, smallest: np.ndarray, level: int, again: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets within given distances; those of empty cells alone only of large sets, of which few have too many."""
    parts = (distances + 2) // 2
    spare = _spare_parts(parts, smallest)
    parts = parts + spare
    start = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    draw = mix64(features + (bands[owner].astype(np.uint64) + np.uint64((level << 40) + 1)) * _STEP)
    part = (draw >> np.uint64(34)).astype(np.int64) % parts[owner]
    cell = ((draw & np.uint64(0xFFFFFF)) % np.uint64(CELLS)).astype(np.int64)
    at = (start[owner] + part) * CELLS + cell
    rows = int(parts.sum())
    sums = np.zeros(rows * CELLS, np.uint64)
    np.add.at(sums, at, mix64(features + np.uint64(0x51ED270B)))
    sums = sums.reshape(rows, CELLS)
    empty = np.bincount(at, minlength=rows * CELLS).reshape(rows, CELLS) == 0
    row_owner = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(rows) - start[row_owner]
    tag = mix64((bands[row_owner].astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)) + np.uint64(level << 56))
    plain = (parts >= MANY_PARTS) | again
    sparse = np.bincount(row_owner, empty.sum(axis=1) >= CELLS - 1, len(sizes)) > spare
    out, of, bare = [], [], []
    for left_out in range(CELLS):
        kept = [c for c in range(CELLS) if c != left_out]
        whole = tag + np.uint64((left_out + 1) * int(_STEP) % 2**64)
        for c in kept:
            whole = mix64(whole + sums[:, c])
        nothing = empty[:, kept].all(axis=1)
        said = ~nothing | (sparse & plain)[row_owner]
        out.append(whole[said])
        of.append(row_owner[said])
        nothing &= ~said & sparse[row_owner]
        bare.append((whole[nothing], row_owner[nothing]))
    first, who = (np.concatenate(x) for x in zip(*bare, strict=True))
    if len(who):
        few, of_few = np.unique(who, return_inverse=True)
        begins = np.cumsum(sizes) - sizes
        deeper, theirs = _signatures(features[spread(begins[few], sizes[few])], sizes[few], bands[few], distances[few], smallest[few], level + 1, True)
        order = np.argsort(theirs, kind="stable")
        n = np.bincount(theirs, minlength=len(few))
        pairs = order[spread((np.cumsum(n) - n)[of_few], n[of_few])]
        out.append(mix64(np.repeat(first, n[of_few]) ^ deeper[pairs]))
        of.append(np.repeat(who, n[of_few]))
    return np.concatenate(out), np.concatenate(of)


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether 100 * intersection >= threshold * union, for ascending features."""
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    common = _common(a, b)
    return 100 * common >= threshold * (len(a) + len(b) - common)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


class Sets:
    """Sets of the slices, memory-mapped and read per set."""

    def __init__(self, folder: str):
        self.folder = folder
        self.slices: dict[int, list[np.ndarray]] = {}

    def _slice(self, number: int) -> list[np.ndarray]:
        if number not in self.slices:
            self.slices[number] = open_arrays(f"{self.folder}/sets-{number}")
        return self.slices[number]

    def offsets(self, number: int) -> np.ndarray:
        return self._slice(number)[0]

    def take(self, number: int, local: int) -> np.ndarray:
        offsets, features = self._slice(number)
        return features[offsets[local] : offsets[local + 1]]


class Forest:
    """Union-find over the classes of one shard, with exact comparisons on demand."""

    def __init__(self, sets: Sets, threshold: int):
        self.sets, self.threshold = sets, threshold
        self.parent: dict[int, int] = {}
        self.held: dict[int, np.ndarray] = {}
        self.size = 0
        self.apart: set[tuple[int, int]] = set()
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def _set(self, x: int) -> np.ndarray:
        return self.sets.take(x >> 20, x & 0xFFFFF)

    def features(self, x: int) -> np.ndarray:
        found = self.held.get(x)
        if found is None:
            if self.size > 4_000_000:
                self.held.clear()
                self.size = 0
            found = self.held[x] = np.array(self._set(x))
            self.size += len(found)
        return found

    def link(self, x: int, y: int) -> bool:
        """Compare two classes; a link joins their trees and is kept as an edge."""
        pair = (x, y) if x < y else (y, x)
        if pair in self.apart:
            return False
        if linked(self.features(x), self.features(y), self.threshold):
            self.edges.append(pair)
            self.parent[self.find(x)] = self.find(y)
            return True
        if len(self.apart) < 2_000_000:
            self.apart.add(pair)
        return False

    def group(self, members: list[int], level: int = 0) -> None:
        """Settle all pairs of classes that share a signature."""
        if len({self.find(x) for x in members}) == 1:
            return
        if len(members) >= CROWD:
            self._crowd(members, level)
            return
        for i, x in enumerate(members):
            for y in members[:i]:
                if self.find(x) != self.find(y):
                    self.link(x, y)

    def _crowd(self, members: list[int], level: int) -> None:
        """As ``group``, with one class against all others in one pass over their marks, some features at a time.

        Marks bound how far two sets are apart from below; what they leave over is compared exactly.  Once all classes
        but those of the largest tree have been compared with everyone, no pair of classes in two trees is left.  If
        very many are left after some passes, those that can link share a signature of the next level too.
        """
        tree = np.unique([self.find(x) for x in members], return_inverse=True)[1]
        parts = [self._set(x) for x in members]
        sizes = np.array([len(p) for p in parts])
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // _HELD_FEATURES)) + 1
        spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(members)], strict=True))
        marks = _marks(parts, sizes, spans)
        open_ = np.ones(len(members), bool)
        passes = 0
        while True:
            left = np.flatnonzero(open_ & (tree != np.bincount(tree).argmax()))
            if not len(left):
                return
            if passes >= PASSES and len(left) > BIG and level < LEVELS:
                self._anew(members, spans, level + 1)
                return
            passes += 1
            x = int(left[0])
            open_[x] = False
            others = np.flatnonzero(tree != tree[x])
            apart = np.bitwise_count(marks[others] ^ marks[x]).sum(axis=1, dtype=np.int64)
            near = others[(100 + self.threshold) * apart <= (100 - self.threshold) * (sizes[others] + sizes[x])]
            for y in near.tolist():
                if tree[y] != tree[x] and self.link(members[x], members[y]):
                    tree[tree == tree[y]] = tree[x]

    def _anew(self, members: list[int], spans: list[tuple[int, int]], level: int) -> None:
        """Partition members by the draws of another level and settle the groups that this gives."""
        found = []
        for a, b in spans:
            own = [self._set(y) for y in members[a:b]]
            signature, of = signatures(np.concatenate(own), np.cumsum([0, *map(len, own)]), self.threshold, level)
            found.append((signature, of + a))
        signature, of = (np.concatenate(x) for x in zip(*found, strict=True))
        for own in _groups(signature, of):
            self.group([members[k] for k in own.tolist()], level)


def _marks(parts: list[np.ndarray], sizes: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Per part a row of bits: the parity of how many of its features fall on each bit.

    Of two parts, no more bits differ than features are in one of them only.
    """
    words = 1 << max(3, int(_MARK_BITS * sizes.max() // 64).bit_length())
    while words > 8 and words * len(parts) > _HELD_MARKS:
        words //= 2
    marks = np.zeros(len(parts) * words, np.uint64)
    for a, b in spans:
        held = np.concatenate(parts[a:b])
        row = np.repeat(np.arange(a, b), sizes[a:b])
        at = row * words + ((held >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64)
        np.bitwise_xor.at(marks, at, np.uint64(1) << (held & np.uint64(63)))
    return marks.reshape(len(parts), words)


def _groups(signature: np.ndarray, of: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct owners of each signature that has more than one."""
    order = np.argsort(signature)
    ordered = signature[order]
    same = np.concatenate([[False], ordered[1:] == ordered[:-1], [False]]) if len(ordered) else np.zeros(1, bool)
    begins, ends = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:]) + 1
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        yield np.unique(of[order[a:b]])


def shingle_classes(docs: DataFrame, words: int, folder: str) -> DataFrame:
    """Write the sets to the shared folder; per row doc_id, text_hash, n_shingles, class key and its second part, and place (slice and row).

    Null texts count as empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            for piece in slices(batch, "text", _SLICE_BYTES):
                features, offsets, sums = shingle_sets(texts(piece.column("text")), words)
                put_arrays(f"{folder}/sets-{number}", [offsets.astype("<i8"), features.astype("<u8")])
                places = (number << 20) + np.arange(piece.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("text_hash"), pa.array(np.diff(offsets)), *(pa.array(x.view(np.int64)) for x in sums), pa.array(places)],
                    ["doc_id", "text_hash", "n_shingles", "class", "class_2", "place"],
                )
                number += 1

    inputs = docs.select("doc_id", "text", text_hash().alias("text_hash"))
    return stored(inputs.transform(arrow_map, shingled, f"doc_id {kind}, text_hash long, n_shingles long, class long, class_2 long, place long"), "shingles")


def class_links(classes: DataFrame, folder: str, threshold: int) -> DataFrame:
    """Links (u, v: places) that connect all classes of equal sets that have a link; one row per link found.

    ``classes`` has one place for each class.  Links that others imply may be missing, no connection is.
    """
    total = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    shards = max(1, -(-(6 * total // 10) // SHARD_SIGNATURES))
    by_slice = classes.withColumn("slice", F.shiftright("place", 20)).groupBy("slice").agg(F.collect_list((F.col("place") % (1 << 20)).cast("int")).alias("rows"))
    parts = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(folder)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            signature, place = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(signature)
            signature, place = signature[order], place[order]
            local, which = np.unique(place, return_inverse=True)
            of = (mix64(signature) % np.uint64(shards)).astype(np.int64)
            rows = []
            for k in np.unique(of):
                own = of == k
                used, at = np.unique(which[own], return_inverse=True)
                apart = np.diff(signature[own], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                planes = np.concatenate([apart.T.reshape(-1), at.astype("<u4").view(np.uint8).reshape(-1, 4).T.reshape(-1)])
                steps = np.diff(local[used], prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.reshape(-1)
                packed = pa.compress(np.concatenate([planes, steps]).tobytes(), codec="zstd", asbytes=True)
                rows.append((int(k), len(at), len(used), packed))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["shard", "n", "m", "block"])

        for batch in batches:
            for number, rows in zip(batch.column("slice").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                rows = np.sort(np.array(rows))
                begin = 0
                while begin < len(rows):
                    sizes = np.diff(sets.offsets(number))[rows[begin:]]
                    end = begin + max(1, int(np.searchsorted(np.cumsum(sizes), _SIGNED_FEATURES)))
                    own = [sets.take(number, int(r)) for r in rows[begin:end]]
                    signature, of = signatures(np.concatenate(own), np.cumsum([0, *map(len, own)]), threshold)
                    held.append((signature & _LOW, (number << 20) + rows[begin:end][of]))
                    size += len(signature)
                    begin = end
                    if size > _BLOCK_SIGNATURES:
                        yield out()
                        held, size = [], 0
        if size:
            yield out()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for shard, n, m, block in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "m", "block")), strict=True):
                planes = np.frombuffer(pa.decompress(block, 10 * n + 8 * m, codec="zstd", asbytes=True), np.uint8)
                apart = np.zeros((n, 8), np.uint8)
                apart[:, :6] = planes[: 6 * n].reshape(6, n).T
                at = np.ascontiguousarray(planes[6 * n : 10 * n].reshape(4, n).T).view("<u4").reshape(-1)
                places = np.cumsum(np.ascontiguousarray(planes[10 * n :].reshape(8, m).T).view("<i8").reshape(-1))
                blocks.setdefault(shard, []).append((np.cumsum(apart.view("<u8").reshape(-1), dtype=np.uint64), places[at]))
        for own in blocks.values():
            signature, place = np.concatenate([b[0] for b in own]), np.concatenate([b[1] for b in own])
            own.clear()
            forest = Forest(Sets(folder), threshold)
            for members in _groups(signature, place):
                forest.group(members.tolist())
            if forest.edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in forest.edges], pa.int64()) for k in (0, 1)], ["u", "v"])

    dealt = by_slice.repartitionById(parts, F.pmod(F.xxhash64("slice"), F.lit(parts)).cast("int"))
    packed = dealt.transform(arrow_map, signed, "shard int, n int, m int, block binary")
    return packed.repartitionById(shards, F.col("shard")).transform(arrow_map, joined, "u long, v long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _settled(docs: DataFrame, words: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their class, and per class of non-empty sets the first member (doc_id, text_hash) of its component."""
    folder = work_dir(docs.sparkSession, "sets")
    rows = shingle_classes(docs, words, folder)
    member = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_hash"))
    full = rows.where("n_shingles > 0")
    classes = stored(full.groupBy(*CLASS).agg(F.min("place").alias("place"), F.min(member).alias("least")), "classes")
    roots = components(class_links(classes.select("place", "n_shingles"), folder, threshold))
    rooted = stored(classes.join(roots, classes.place == roots.node, "left").select(*CLASS, "least", F.coalesce("root", "place").alias("root")), "rooted")
    # written on its own, so that the join's rows of one large component can be split
    first = stored(rooted.groupBy("root").agg(F.min("least").alias("first")).withColumnRenamed("root", "its_root"), "firsts")
    return rows, stored(rooted.join(first, rooted.root == first.its_root).select(*(F.col(c).alias(f"its_{c}") for c in CLASS), "first"), "components")


#: Equal sets are one class: by number of shingles and 128 bits of sums.
CLASS = ("class", "class_2", "n_shingles")


def _with_first(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """Rows of non-empty sets with the first member of their component."""
    same = [F.col(c) == F.col(f"its_{c}") for c in CLASS]
    return rows.where("n_shingles > 0").join(settled, same[0] & same[1] & same[2])


def linked_components(docs: DataFrame, words: int = 4, threshold: int = 85) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= ``threshold`` * union of their sets of ``words``-word
    shingles (the whole text, if shorter).  component_id is the smallest doc_id that links reach.  Empty
    sets link with nothing and keep their own doc_id; null ids take part, but are never the smallest.
    """
    rows, settled = _settled(docs, words, threshold)
    joined = _with_first(rows, settled).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))
    return joined.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


#: Keys of rows to drop up to which they are broadcast (16 bytes each); beyond, the join is by shuffle.
BROADCAST_KEYS = 300_000


def keep_one_of_each(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each group of linked documents, with all columns of ``docs``: the one with the smallest doc_id.

    Documents without words link with nothing and all stay.  Repeated rows (one id and text) count as
    copies of each other.
    """
    rows, settled = _settled(docs, words, threshold)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    judged = _with_first(rows, settled).select("doc_id", "text_hash", same.alias("stays"))
    keys = stored(judged.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("n")), "judged")
    dropped = keys.where("not stays").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    n_dropped, repeated = keys.agg(F.count(F.when(~F.col("stays"), 1)), F.count(F.when(F.col("stays") & (F.col("n") > 1), 1))).first()
    hashed = docs.withColumn("__text_hash", text_hash())
    here = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    kept = hashed.join(F.broadcast(dropped) if n_dropped <= BROADCAST_KEYS else dropped, here, "left_anti")
    if repeated:  # rows that repeat a kept row, words or none: only those with words are copies
        bare = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", "")) == 0
        once = kept.where(~bare).dropDuplicates(["doc_id", "__text_hash"])
        kept = once.unionByName(kept.where(bare))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

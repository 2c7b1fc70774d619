"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and decoding.

The vocabulary is a public model that stays as it is.  A segmentation is drawn with probability
proportional to the product of its pieces' weights.  No piece holds a word boundary inside, so the lattice
of a text factors at blanks and line ends; forward sums are worked out once per distinct chunk, and
backward sampling walks all chunks of a batch together.  Every random number is a hash of the row's
key, the chunk's place and the place within the chunk, so reruns and any partitioning give the same pieces.

Long chunks are cut into blocks for the forward sums: what a block makes of the sums before it is a
matrix, all blocks' matrices come at once, and their product gives each block its true start.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import arrow_map, mix64, slices, texts, unit
from slotloom.llm.words import Slots, distinct, first_places, hash_spans, spread

#: Lattice nodes that one worker keeps, and as many of the round before.
CACHE_NODES = 600_000
#: Characters from which a chunk is cut, characters of a block, and blocks whose matrices are made at once.
LONG_CHUNK = 2_048
BLOCK = 512
_BLOCKS_AT_ONCE = 512
_BLANK = "▁"
_PLACE = np.uint64(0xD1B54A32D192ED03)


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.empty(max(n - len(x), len(x) // 2), x.dtype)])


class Lattices:
    """Lattices of chunks by the chunk's hash: a node for each character, and its incoming edges in a row.

    An edge has the cumulative probability up to it, its piece, and its length in characters.
    """

    def __init__(self) -> None:
        self.slots = Slots()
        self.nodes = self.edges = 0
        self.head, self.size = np.empty(1 << 12, np.int32), np.empty(1 << 12, np.int32)
        self.first = np.zeros(1 << 12, np.int32)
        self.cdf, self.piece, self.length = np.empty(1 << 14), np.empty(1 << 14, np.int32), np.empty(1 << 14, np.uint8)

    def add(self, keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, cdf: np.ndarray, piece: np.ndarray, length: np.ndarray) -> None:
        """Chunks by hash, with their numbers of nodes, those nodes' numbers of edges, and the edges."""
        n, nodes, edges = self.slots.count + len(keys), self.nodes + len(counts), self.edges + len(cdf)
        self.head, self.size = (_room(x, n) for x in (self.head, self.size))
        self.head[self.slots.count : n] = self.nodes + np.cumsum(sizes) - sizes
        self.size[self.slots.count : n] = sizes
        self.slots.add(keys)
        self.first = _room(self.first, nodes + 1)
        self.first[self.nodes + 1 : nodes + 1] = self.edges + np.cumsum(counts)
        self.cdf, self.piece, self.length = (_room(x, edges) for x in (self.cdf, self.piece, self.length))
        for held, new in ((self.cdf, cdf), (self.piece, piece), (self.length, length)):
            held[self.edges : edges] = new
        self.nodes, self.edges = nodes, edges

    def part(self, slots: np.ndarray) -> tuple[np.ndarray, ...]:
        """What ``add`` was given for some chunks."""
        head, size = self.head[slots].astype(np.int64), self.size[slots].astype(np.int64)
        at = spread(head, size)
        begins, ends = self.first[head].astype(np.int64), self.first[head + size].astype(np.int64)
        edges = spread(begins, ends - begins)
        return size, self.first[at + 1] - self.first[at], self.cdf[edges], self.piece[edges], self.length[edges]


class PieceSampler:
    """Encoder and decoder for one model file; ``alpha`` sharpens (> 1) or flattens (< 1) the weights."""

    def __init__(self, model_file: str, alpha: float = 1.0, seed: int = 0, cache_nodes: int = CACHE_NODES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = [0] * 256
        raw: list[bytes] = [b""] * size
        self.weight: dict[str, tuple[float, int]] = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:-1], 16)
                self.byte_ids[value], raw[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain = name.replace(_BLANK, " ")
                raw[i] = plain.encode()
                # BPE scores are merge ranks; Zipf's law turns a rank into a weight
                rank = min(-model.get_score(i), float(size))
                self.weight[plain] = ((100.0 / (rank + 2.0)) ** alpha, i)
        if any(re.search(r"[^ ] |\n", p) for p in self.weight):
            raise ValueError("a piece crosses a word or line boundary; chunks would not be independent")
        self.raw = pa.array(raw, pa.binary())
        self.longest = max(map(len, self.weight))
        self._plant()
        self.seed = seed
        self.cache_nodes = cache_nodes
        self.before, self.known = Lattices(), Lattices()

    def _plant(self) -> None:
        """A tree of the pieces' characters: the step from a node by a character leads to one further node."""
        steps: dict[tuple[int, str], int] = {}
        ends: dict[int, str] = {}
        for name in self.weight:
            node = 0
            for c in name:
                node = steps.setdefault((node, c), len(steps) + 1)
            ends[node] = name
        self.tree = Slots(int(4 * len(steps)).bit_length())
        self.tree.add(self._steps(np.array([n for n, _ in steps]), np.array([ord(c) for _, c in steps], np.uint32)))
        self.piece_at, self.weight_at = np.full(len(steps) + 1, -1, np.int32), np.zeros(len(steps) + 1)
        for node, name in ends.items():
            self.weight_at[node], self.piece_at[node] = self.weight[name]

    @staticmethod
    def _steps(nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Keys of steps: one to one, and never 0."""
        return mix64((nodes.astype(np.uint64) << np.uint64(21) | points.astype(np.uint64)) + np.uint64(1))

    def _edges(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Number of incoming edges of each character, and the edges' weights, pieces and lengths, short ones first.

        A character that no piece ends with gets an edge that stands for its bytes.
        """
        stop = np.repeat(np.cumsum(sizes), sizes)
        counts = np.zeros(len(points), np.int64)
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.longest):  # from each character, a step down the tree
            node = self.tree.find(self._steps(node, points[at])) + 1
            on = np.flatnonzero(node)
            at, node = at[on], node[on]
            whole = np.flatnonzero(self.piece_at[node] >= 0)
            ends = at[whole]
            found.append((ends, node[whole], counts[ends]))
            counts[ends] += 1
            at = at + 1
            on = np.flatnonzero(at < stop[at - 1])
            at, node = at[on], node[on]
            if not len(at):
                break
        bare = np.flatnonzero(counts == 0)
        counts[bare] = 1
        first = np.cumsum(counts) - counts
        weight, piece, length = np.empty(int(counts.sum())), np.empty(int(counts.sum()), np.int32), np.empty(int(counts.sum()), np.uint8)
        for n, (ends, nodes, rank) in enumerate(found, 1):
            edge = first[ends] + rank
            weight[edge], piece[edge], length[edge] = self.weight_at[nodes], self.piece_at[nodes], n
        weight[first[bare]], piece[first[bare]], length[first[bare]] = 1e-6, -1 - points[bare].astype(np.int32), 1
        return counts, weight, piece, length

    def _forward(self, sizes: np.ndarray, first: np.ndarray, counts: np.ndarray, weight: np.ndarray, length: np.ndarray, history: np.ndarray, cdf: np.ndarray | None) -> np.ndarray:
        """Forward sums of lanes of characters, all lanes at once, one place after another.

        ``history`` has, for each lane, the sums of the ``longest`` places before it, for one or more starts.
        Gives those of the last places of each lane, and puts running sums of edges in ``cdf``.  Sums are scaled
        anew every ``longest`` places, which leaves their ratios as they are.
        """
        back = self.longest
        begins = np.cumsum(sizes) - sizes
        lane = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(lane)) - begins[lane]
        sums = np.zeros((len(lane) + back * len(sizes), history.shape[2]))
        start = begins + back * np.arange(len(sizes))  # where a lane's history begins in sums
        sums[start[:, None] + np.arange(back)] = history
        order = np.argsort(place, kind="stable")
        bounds = np.cumsum(np.bincount(place))
        low = 0
        for j, high in enumerate(bounds.tolist()):
            at = order[low:high]
            own = start[lane[at]] + back + j
            total = np.zeros((len(at), history.shape[2]))
            sub, n, e = slice(None), counts[at], first[at]
            for r in range(int(n.max())):
                if r:
                    sub = np.flatnonzero(n > r)
                edge = e[sub] + r
                total[sub] += weight[edge, None] * sums[own[sub] - length[edge]]
                if cdf is not None:
                    cdf[edge] = total[sub, 0]
            sums[own] = total
            if j % back == back - 1:
                rows = own[:, None] - np.arange(back)
                sums[rows] /= sums[rows].max(axis=(1, 2), keepdims=True)
            low = high
        return sums[(start + sizes)[:, None] + np.arange(back)]

    def _histories(self, size: int, first: np.ndarray, counts: np.ndarray, weight: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The sums before each block of one long chunk."""
        back = self.longest
        sizes = np.full(-(-size // BLOCK), BLOCK)
        sizes[-1] = size - BLOCK * (len(sizes) - 1)
        found = np.zeros((len(sizes), back, 1))
        now = np.zeros(back)
        now[-1] = 1.0
        for a in range(0, len(sizes), _BLOCKS_AT_ONCE):
            own = sizes[a : a + _BLOCKS_AT_ONCE]
            nodes = slice(a * BLOCK, a * BLOCK + int(own.sum()))
            made = self._forward(own, first[nodes], counts[nodes], weight, length, np.broadcast_to(np.eye(back), (len(own), back, back)), None)
            for k in range(len(own)):
                found[a + k, :, 0] = now
                now = made[k] @ now
                now /= now.max()
        return found

    def _learn(self, keys: np.ndarray, new: list[str]) -> None:
        """Forward filtering of new chunks, some 200,000 characters at a time."""
        begin, held = 0, 0
        for k, chunk in enumerate(new):
            if held and held + len(chunk) > 200_000:
                self._filter(keys[begin:k], new[begin:k])
                begin, held = k, 0
            held += len(chunk)
        self._filter(keys[begin:], new[begin:])

    def _filter(self, keys: np.ndarray, new: list[str]) -> None:
        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        counts, weight, piece, length = self._edges(points, sizes)
        first = np.cumsum(counts) - counts
        lanes, histories, at = [], [], 0
        plain = np.zeros((1, self.longest, 1))
        plain[0, -1, 0] = 1.0
        if sizes.max(initial=0) <= LONG_CHUNK:
            lanes, histories = [sizes], [np.broadcast_to(plain, (len(sizes), *plain.shape[1:]))]
        else:
            for size in sizes.tolist():
                if size > LONG_CHUNK:
                    histories.append(self._histories(size, first[at : at + size], counts[at : at + size], weight, length))
                    lanes.append(np.minimum(BLOCK, size - BLOCK * np.arange(len(histories[-1]))))
                else:
                    histories.append(plain)
                    lanes.append(np.array([size]))
                at += size
        cdf = np.empty(len(weight))
        self._forward(np.concatenate(lanes), first, counts, weight, length, np.concatenate(histories), cdf)
        cdf /= np.repeat(cdf[first + counts - 1], counts)
        self.known.add(keys, sizes, counts, cdf, piece, length)

    def encode(self, all_texts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts (UTF-8) in one array, and the offsets at which each text's ids begin and end."""
        if self.known.nodes > self.cache_nodes:  # the chunks of the last round stay at hand once more
            self.before, self.known = self.known, Lattices()
        sizes = np.fromiter(map(len, all_texts), np.int64, len(all_texts))
        full = np.flatnonzero(sizes)
        blob = b" ".join([b"", *(all_texts[k] for k in full.tolist())])  # a blank before the first word of each text
        starts = np.cumsum(sizes[full] + 1) - sizes[full] - 1
        begins, ends = self._chunks(np.frombuffer(blob, np.uint8), starts)
        counts = np.zeros(len(all_texts), np.int64)
        counts[full] = np.diff(np.searchsorted(begins, starts), append=len(begins))
        slots = self._slots(blob, begins, ends)
        firsts = np.cumsum(counts) - counts
        text_of = np.repeat(np.arange(len(all_texts)), counts)
        salt = mix64(np.asarray(keys).astype(np.int64).view(np.uint64) + np.uint64(self.seed * 2 + 1))
        place = (np.arange(len(slots)) - firsts[text_of]).astype(np.uint64)
        base = mix64(salt[text_of] + place * np.uint64(0x9E3779B97F4A7C15))
        length, ids = self._sample(slots, base)
        text_of = np.repeat(text_of, length)
        if (ids < 0).any():  # edges that stand for the bytes of a character
            spelled = {int(x): [self.byte_ids[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")] for x in np.unique(ids[ids < 0])}
            times = np.ones(len(ids), np.int64)
            for x, own in spelled.items():
                times[ids == x] = len(own)
            begin = np.cumsum(times) - times
            out = np.repeat(ids, times)
            for x, own in spelled.items():
                for k, b in enumerate(own):
                    out[begin[ids == x] + k] = b
            ids, text_of = out, np.repeat(text_of, times)
        return ids, np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=len(all_texts)))])

    @staticmethod
    def _chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of chunks: a word with the blanks before it, a line end, or blanks before a line end or the text's end."""
        blank, line = data == 32, data == 10
        edge = line.copy()
        edge[1:] |= line[:-1] | blank[1:] & ~blank[:-1]
        edge[starts] = True
        begins = np.flatnonzero(edge)
        return begins, np.append(begins[1:], len(data))

    def _slots(self, blob: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The lattice of each chunk; new ones are made."""
        keys, of = distinct(hash_spans(np.frombuffer(blob, np.uint8), begins, ends, False))
        slots = self.known.slots.find(keys)
        if (slots < 0).any():
            new = slots < 0
            earlier = self.before.slots.find(keys)
            again = np.flatnonzero(new & (earlier >= 0))
            self.known.add(keys[again], *self.before.part(earlier[again]))
            fresh = np.flatnonzero(new & (earlier < 0))
            at = first_places(of, len(keys))[fresh]
            spans = zip(begins[at].tolist(), ends[at].tolist(), strict=True)
            self._learn(keys[fresh], [blob[a:b].decode("utf-8", "surrogatepass") for a, b in spans])
            slots = self.known.slots.find(keys)
        return slots[of]

    def _edge(self, nodes: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Of each node's edges the one that a number in [0, 1) falls to."""
        edge = self.known.first[nodes]
        open_ = np.flatnonzero(self.known.cdf[edge] <= draws)
        while len(open_):
            edge[open_] += 1
            open_ = open_[self.known.cdf[edge[open_]] <= draws[open_]]
        return edge

    def _sample(self, slots: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling: number of pieces of each chunk, and the pieces.  A node's number is a hash of its place."""
        k = self.known
        size, head = k.size[slots], k.head[slots]
        length = np.zeros(len(slots), np.int64)
        far = np.flatnonzero(size > LONG_CHUNK)
        walked = {c: self._walk(int(head[c]), int(size[c]), base[c]) for c in far.tolist()}
        for c, found in walked.items():
            length[c] = len(found)
        live = np.flatnonzero(size <= LONG_CHUNK)
        left, head, own = size[live], head[live], base[live]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            edge = self._edge(head + left - 1, unit(mix64(own + left.astype(np.uint64) * _PLACE)))
            steps.append((live, k.piece[edge]))
            length[live] += 1
            left = left - k.length[edge]
            on = np.flatnonzero(left)
            live, left, head, own = live[on], left[on], head[on], own[on]
        ends = np.cumsum(length)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for n, (who, got) in enumerate(steps):
            ids[ends[who] - 1 - n] = got
        for c, found in walked.items():
            ids[ends[c] - len(found) : ends[c]] = found
        return length, ids

    def _walk(self, head: int, size: int, base: np.uint64) -> np.ndarray:
        """The pieces of one long chunk: every node's edge is drawn at once, and then the way back is followed."""
        places = np.arange(1, size + 1)
        edge = self._edge(head + places - 1, unit(mix64(base + places.astype(np.uint64) * _PLACE)))
        step = self.known.length[edge].tolist()
        way = []
        left = size
        while left:
            way.append(left - 1)
            left -= step[left - 1]
        return self.known.piece[edge[np.array(way[::-1])]]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of texts from their ids; the blank before the first word that encoding adds is taken off."""
        taken = self.raw.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(taken.buffers()[1], np.int32, len(ids) + 1) if len(ids) else np.zeros(1, np.int32)
        blob = taken.buffers()[2].to_pybytes() if len(ids) else b""
        return [blob[a + 1 : b] for a, b in zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist(), strict=True)]


_samplers: dict[tuple, PieceSampler] = {}


def _sampler(model_file: str, alpha: float, seed: int) -> PieceSampler:
    key = (model_file, alpha, seed)
    if key not in _samplers:
        _samplers[key] = PieceSampler(*key)
    return _samplers[key]


def encode_documents(docs: DataFrame, model_file: str | None = None, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, piece_ids, decoded_crc32, lossless.

    Null texts count as empty; the empty text has no pieces.  Rows with one key and text get one
    segmentation, null keys share a key; repeated rows stay as often as they come, and an empty table gives no
    rows.  A text of any length is one row; unbroken stretches of any length take time in proportion.  The
    crc32 is that of the bytes decoded from ``piece_ids`` alone, ``lossless`` whether they are the text's.
    """
    model_file = model_file or public_model()

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model_file, alpha, seed)
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                raw = texts(piece.column("text"))
                ids, offsets = sampler.encode(raw, np.asarray(piece.column("key")))
                decoded = sampler.decode(ids, offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                same = pa.array([a == b for a, b in zip(decoded, raw, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), lists, pa.array(list(map(zlib.crc32, decoded)), pa.int64()), same],
                    ["doc_id", "piece_ids", "decoded_crc32", "lossless"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    inputs = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    return inputs.transform(arrow_map, sampled, f"doc_id {kind}, piece_ids array<int>, decoded_crc32 long, lossless boolean")


def decode_documents(rows: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and piece_ids; null lists count as empty and give the empty text."""
    model_file = model_file or public_model()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model_file, 1.0, 0)
        for batch in batches:
            lists = [x or [] for x in batch.column("piece_ids").to_pylist()]
            offsets = np.cumsum([0, *map(len, lists)])
            found = sampler.decode(np.array([i for x in lists for i in x], np.int32), offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "piece_ids").transform(arrow_map, decoded, f"doc_id {kind}, text string")

"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel.  Normal equations are summed per partition and fold, so the
fit moves one small matrix per partition, whatever the number of rows.  Scores out of their own fold
calibrate the model; a histogram of them, not the rows, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import arrow_map, key_crc, labelled_sample, slices, stored, texts

#: At most about so many labelled rows are learned from.
FIT_ROWS = 20_000
FOURIER = 256
RIDGE = 0.3
SEED = 7
THRESHOLD = 0.3
_BINS = 2_000
_FOLDS = 5


def _byte_classes() -> np.ndarray:
    """256 x 8 indicator matrix: lower, upper, digit, blank, newline, stops, marks, other (above ASCII)."""
    kinds = np.full(256, 6)
    kinds[128:] = 7
    for low, high, kind in ((97, 122, 0), (65, 90, 1), (48, 57, 2)):
        kinds[low : high + 1] = kind
    for text, kind in ((b" \t\x0b\x0c\r", 3), (b"\n", 4), (b".,;:'\"-?()", 5)):
        kinds[list(text)] = kind
    return np.eye(8)[kinds]


_CLASSES = _byte_classes()
STATISTICS = (
    "log_bytes", "log_words", "lower", "upper", "digit", "blank", "newline", "stops", "marks", "other", "capital_share",
    "word_bytes", "distinct_words", "distinct_power", "repeats", "distinct_lines", "bare_marks",
)


def statistics(text: bytes) -> list[float]:
    """The numbers in ``STATISTICS`` for one whole text; the empty text has all zeros but the ratios of distinct parts, 1."""
    n = len(text)
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES if n else np.zeros(8)
    words = text.split()
    count = len(words)
    distinct = len(set(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = kinds[0] + kinds[1] + kinds[7]
    return [
        np.log1p(n), np.log1p(count), *(kinds / max(n, 1)), kinds[1] / max(letters, 1), np.log1p(n / max(count, 1)),
        distinct / count if count else 1.0, np.log1p(distinct) / np.log1p(count) if count else 1.0,
        sum(map(eq, words, words[1:])) / max(count, 1), len(set(lines)) / len(lines) if lines else 1.0,
        sum(map(words.count, (b"|", b"-", b"*"))) / max(count, 1),
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts(column)]).reshape(-1, len(STATISTICS))


@dataclass
class Model:
    """Everything that scoring needs; a few hundred kilobytes, independent of the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / self.frequencies.shape[1])
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(0.999 * level + 0.001 * np.clip(raw, 0, 1), 0, 1)  # the second part only breaks ties


def pool_adjacent(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of mean labels on ascending scores: mean score and level of each block."""
    blocks: list[list[float]] = []
    for s, y, n in zip(scores, labels, counts, strict=True):
        blocks.append([s * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _solve(sums: list[tuple[np.ndarray, np.ndarray, float]], ridge: float) -> np.ndarray:
    gram, moment, rows = (sum(x[i] for x in sums) for i in range(3))
    penalty = np.eye(len(moment)) * ridge * max(rows, 1) ** 0.5 * 0.01
    penalty[-1, -1] = 1e-9 * max(rows, 1)
    return np.linalg.solve(gram + penalty, moment)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fourier: int = FOURIER, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Learn from labelled documents that are not held out.

    ``fit_rows`` bounds the labelled ids that are used, and so the broadcast of them.  Null texts are empty and
    repeated rows count as often as they come.  With no labelled rows the model scores 0.4995 throughout: a level of 0.5, less what breaks ties.
    """
    sample = labelled_sample(labels, "quality", fit_rows, _FOLDS)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id"))
    inputs = chosen.select("text", (key_crc("doc_id") % _FOLDS).cast("int").alias("fold"), (F.col("grade") > 0).cast("int").alias("y"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = [x.tobytes() for x in _matrix(piece.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), piece.column("fold"), piece.column("y")], ["x", "fold", "y"])

    train = stored(inputs.transform(arrow_map, measure, "x binary, fold int, y int"), "quality")

    def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, len(STATISTICS))
        return x, np.asarray(batch.column("fold")), np.asarray(batch.column("y")).astype(float)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(STATISTICS)))
        rows = 0
        for batch in batches:
            x = unpack(batch)[0]
            total += [x.sum(0), (x * x).sum(0)]
            rows += len(x)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([rows], pa.int64())], ["sums", "n"])

    parts = train.coalesce(16).transform(arrow_map, moments, "sums binary, n long").collect()
    width = len(STATISTICS)
    rng = np.random.default_rng(seed)
    frequencies = rng.normal(0, 1 / np.sqrt(width), (width, fourier))
    phases = rng.uniform(0, 2 * np.pi, fourier)
    if not parts:
        return Model(np.zeros(width), np.ones(width), frequencies, phases, np.zeros(fourier + 1), np.array([0.0]), np.array([0.5]))
    rows = sum(p.n for p in parts)
    total = sum(np.frombuffer(p.sums).reshape(2, width) for p in parts)
    mean = total[0] / rows
    scale = np.sqrt(np.maximum(total[1] / rows - mean**2, 1e-12)) + 1e-6
    bare = Model(mean, scale, frequencies, phases, np.zeros(fourier + 1), np.zeros(1), np.zeros(1))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            x, folds, y = unpack(batch)
            z = bare.features(x)
            for fold in np.unique(folds):
                part, own = z[folds == fold], y[folds == fold]
                held = sums.setdefault(int(fold), [0.0, 0.0, 0])
                sums[int(fold)] = [held[0] + part.T @ part, held[1] + part.T @ own, held[2] + len(own)]
        for fold, (gram, moment, count) in sums.items():
            packed = [pa.array([v], t) for v, t in ((fold, pa.int32()), (gram.tobytes(), pa.binary()), (moment.tobytes(), pa.binary()), (count, pa.int64()))]
            yield pa.RecordBatch.from_arrays(packed, ["fold", "gram", "moment", "n"])

    folds: dict[int, list] = {}
    for p in train.coalesce(16).transform(arrow_map, equations, "fold int, gram binary, moment binary, n long").collect():
        folds.setdefault(p.fold, []).append((np.frombuffer(p.gram).reshape(fourier + 1, -1), np.frombuffer(p.moment), p.n))
    weights = _solve([s for own in folds.values() for s in own], ridge)
    others = {f: _solve([s for g, own in folds.items() if g != f for s in own], ridge) if len(folds) > 1 else weights for f in folds}

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own, y = unpack(batch)
            z = bare.features(x)
            raw = np.array([z[i] @ others[int(f)] for i, f in enumerate(own)])
            bins = np.floor(np.clip(raw, -0.5, 1.5) * _BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(y)], ["bin", "y"])

    seen = train.transform(arrow_map, apart, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    knots, levels = pool_adjacent(
        np.array([(r.bin + 0.5) / _BINS for r in seen]), np.array([r.y for r in seen]), np.array([float(r.n) for r in seen])
    )
    return Model(mean, scale, frequencies, phases, weights, knots, levels)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score and predicted.

    Null texts score as empty ones, repeated rows alike, texts of any length count whole, and an empty table gives
    no rows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                score = model.score(_matrix(piece.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    inputs = docs.select("doc_id", "text", (key_crc("doc_id") % _FOLDS == 0).alias("held_out"))
    return inputs.transform(arrow_map, scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, repeated ones too, with all their columns; null texts score as empty ones."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield piece.filter(pa.array(model.score(_matrix(piece.column("text"))) >= threshold))

    return docs.transform(arrow_map, kept, docs.schema)

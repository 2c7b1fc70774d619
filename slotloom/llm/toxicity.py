"""Toxicity: cumulative-link ordinal regression on sparse text features, giving expected severity.

Features are whole words and word beginnings.  A chi-square test against the labels, counted in Spark,
selects a bounded vocabulary; one weight vector is shared by all ordered thresholds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import arrow_map, labelled_sample, slices, stored, texts

#: At most about so many labelled rows are learned from.  That bounds the features too: all that pass the test are kept.
FIT_ROWS = 20_000
#: A feature is kept if its chi-square shows that it is no accident, or its square of phi that it all but decides.  The
#: second holds for samples of up to 80 documents, which the first asks too much of; in larger ones it says nothing more.
#: A feature of fewer than 3 documents is an accident in any sample.
CHI_SQUARE = 24.0
PHI_SQUARE = 0.3
GRADES = 4
#: Probability of any grade over 0 from which a document counts as toxic.
THRESHOLD = 0.35
_HELD_OUT = 5
_CACHE = 200_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())


def word_features(word: str) -> tuple[str, ...]:
    """The features of one lower-case word: itself, and its first 4 to 7 letters if it is longer."""
    bare = word.strip(_EDGES)
    if len(bare) < 3:
        return ()
    return (bare, *(f"{bare[:n]}*" for n in (4, 5, 6, 7) if len(bare) > n))


def _words(text: bytes) -> Counter:
    return Counter(text.decode("utf-8", "replace").lower().split())


@dataclass
class Model:
    """Selected features with weights, and ascending thresholds; bounded by the rows that were learned from."""

    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    _known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def vector(self, text: bytes) -> dict[int, float]:
        """Sparse features of one whole text: log(1 + count) of each selected feature."""
        found: Counter = Counter()
        known, index = self._known, self.index
        for word, n in _words(text).items():
            ids = known.get(word)
            if ids is None:
                if len(known) > _CACHE:
                    known.clear()
                ids = known[word] = tuple(index[f] for f in word_features(word) if f in index)
            for i in ids:
                found[i] += n
        return {i: float(np.log1p(n)) for i, n in found.items()}

    def probabilities(self, all_texts: list[bytes]) -> np.ndarray:
        """Per text, the probability of each grade."""
        eta = np.array([sum(self.weights[i] * x for i, x in self.vector(t).items()) for t in all_texts], dtype=float)
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - eta[:, None], -40, 40)))
        edges = np.concatenate([np.zeros((len(eta), 1)), below, np.ones((len(eta), 1))], axis=1)
        return np.diff(edges, axis=1)

    def severity(self, all_texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text, the expected grade and the probability of any grade over 0."""
        p = self.probabilities(all_texts)
        return p @ np.arange(p.shape[1]), 1 - p[:, 0]


def fit_ordinal(rows: list[dict[int, float]], grades: np.ndarray, width: int, levels: int, ridge: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model, by Adam on the penalised likelihood.

    Thresholds are a first one plus positive gaps, so they stay ordered.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([i for r in rows for i in r], dtype=np.int64)
    value = np.array([x for r in rows for x in r.values()])
    share = np.cumsum(np.bincount(grades, minlength=levels))[:-1] / max(len(grades), 1)
    first = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    gaps = np.log(np.maximum(np.diff(first), 0.2))
    p = np.concatenate([np.zeros(width), first[:1], gaps])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    sigma = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        w, theta = p[:width], p[width] + np.concatenate([[0], np.cumsum(np.exp(p[width + 1 :]))])
        eta = np.bincount(at, value * w[column], minlength=len(rows))
        upper = np.where(grades < levels - 1, sigma(theta[np.minimum(grades, levels - 2)] - eta), 1.0)
        lower = np.where(grades > 0, sigma(theta[np.maximum(grades - 1, 0)] - eta), 0.0)
        density_up, density_low = upper * (1 - upper), lower * (1 - lower)
        inverse = 1 / np.maximum(upper - lower, 1e-9) / max(len(rows), 1)
        by_eta = (density_up - density_low) * inverse
        by_theta = np.zeros(levels - 1)
        np.add.at(by_theta, np.minimum(grades, levels - 2), -density_up * inverse)
        np.add.at(by_theta, np.maximum(grades - 1, 0), density_low * inverse)
        by_gap = np.cumsum(by_theta[::-1])[::-1]
        gradient = np.concatenate([np.bincount(column, value * by_eta[at], minlength=width) + ridge * w, by_gap[:1], by_gap[1:] * np.exp(p[width + 1 :])])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        p -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return p[:width], p[width] + np.concatenate([[0], np.cumsum(np.exp(p[width + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, grades: int = GRADES) -> Model:
    """Learn from labelled documents whose crc32 of the id modulo 5 is not 0.

    Labels say toxic or not; grade 0 is not toxic, and toxic documents are graded 1 to ``grades`` - 1 by
    quantiles of the number of words that carry features over-represented in toxic documents.  Labels
    that already hold grades up to ``grades`` - 1 are used as they are.  ``fit_rows`` bounds the labelled
    ids and so their broadcast.  Null texts are empty, repeated rows count as often as they come, and texts of any
    length count whole.  Without labelled rows of both kinds, as in an empty table, nothing is toxic.
    """
    sample = labelled_sample(labels, "toxic", fit_rows, _HELD_OUT)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id"))
    train = stored(chosen.select("text", "grade"), "toxicity")
    sizes = {int(r.toxic): r.n for r in train.groupBy((F.col("grade") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, np.zeros(0), np.full(grades - 1, 20.0) + np.arange(grades - 1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], ["feature", "toxic", "docs"])
        for batch in batches:
            for text, grade in zip(texts(batch.column("text")), batch.column("grade").to_pylist(), strict=True):
                for feature in {f for w in _words(text) for f in word_features(w)}:
                    pair = held.setdefault(feature, [0, 0])
                    pair[0] += grade > 0
                    pair[1] += 1
                if len(held) > _CACHE:
                    yield out()
                    held.clear()
        yield out()

    pos, total = float(sizes[1]), float(sizes[0] + sizes[1])
    a, n = F.col("toxic").cast("double"), F.col("docs").cast("double")
    cross = a * F.lit(total) - n * F.lit(pos)
    chi = cross * cross * F.lit(total) / (F.lit(pos * (total - pos)) * n * (F.lit(total) - n))
    sums = train.transform(arrow_map, counted, "feature string, toxic long, docs long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    top = sums.where((F.col("docs") >= 3) & (n < total)).withColumn("chi", chi).where((F.col("chi") >= CHI_SQUARE) | (F.col("chi") >= PHI_SQUARE * total)).orderBy(F.desc("chi"), "feature").collect()
    index = {r.feature: i for i, r in enumerate(top)}
    raised = np.array([r.toxic * total > r.docs * pos for r in top], dtype=bool)
    bare = Model(index, np.zeros(len(index)), np.zeros(grades - 1))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [bare.vector(t) for t in texts(batch.column("text"))]
            packed = [pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.float64())), batch.column("grade")]
            yield pa.RecordBatch.from_arrays(packed, ["at", "value", "grade"])

    seen = train.transform(arrow_map, vectors, "at array<int>, value array<double>, grade int").collect()
    rows = [dict(zip(r["at"], r["value"], strict=True)) for r in seen]
    given = np.array([r["grade"] for r in seen])
    if given.max() > 1:
        graded = np.minimum(given, grades - 1)
    else:
        hits = np.array([sum(np.expm1(x) for i, x in r.items() if raised[i]) for r in rows])
        cuts = np.quantile(hits[given > 0], np.arange(1, grades - 1) / (grades - 1))
        graded = np.where(given > 0, 1 + (hits[:, None] > cuts[None, :]).sum(1), 0)
    weights, thresholds = fit_ordinal(rows, graded.astype(np.int64), len(index), grades)
    return Model(index, weights, thresholds)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, severity (expected grade), p_toxic, toxic.

    Null texts count as empty, repeated rows score alike, texts of any length count whole, and an empty table gives
    no rows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                severity, toxic = model.severity(texts(piece.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(severity), pa.array(toxic), pa.array(toxic >= threshold)], ["doc_id", "severity", "p_toxic", "toxic"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(arrow_map, scored, f"doc_id {kind}, severity double, p_toxic double, toxic boolean")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, repeated ones too, with all their columns; null texts count as empty."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield piece.filter(pa.array(model.severity(texts(piece.column("text")))[1] < threshold))

    return docs.transform(arrow_map, kept, docs.schema)

"""Vector codes: parts of vectors named by their nearest entries of small codebooks, found by VA-file filtering.

Components are whole numbers (floor of 256 x).  Vectors are cut into equal consecutive parts; each part position has
a codebook.  A codebook's entries are known by a few bits a coordinate: the cell that the coordinate falls into.  A
part is the query: one table for each coordinate holds the least and the greatest squared difference to each
cell, sums of looked-up values bound the distances to all entries, and only entries whose lower bound does not
exceed the least upper bound are compared in whole numbers.

Each round is one pass over the table; tasks sum the parts of each entry, so what meets is one row for each task and
entry.  Codebooks have a stated number of entries, whatever the table's size, and travel with the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import arrow_map, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Bits that an entry's coordinate is known by.
CELL_BITS = 4
#: Vectors that are compared at once.
_STEP = 2_048


def finite_vectors(table: DataFrame, vector: str, *columns: str) -> DataFrame:
    """``columns`` and x (doubles) of the rows whose vector is neither null nor holds null or non-finite components."""
    x = F.transform(vector, lambda e: e.cast("double"))
    fit = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return table.select(*columns, x.alias("x")).where(F.col("x").isNotNull() & F.coalesce(fit, F.lit(False)))


def _whole(x: float) -> int:
    n, d = x.as_integer_ratio()
    return 256 * n // d


def whole_parts(column: pa.Array, parts: int, size: int) -> np.ndarray:
    """Rows x parts x size whole numbers of a column of vectors; missing components count as zero.

    They are 64 bits wide where no sum of squared differences can exceed that, and Python's integers otherwise.
    """
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    values = np.asarray(column.flatten())
    if np.abs(values).max(initial=0.0) < 2.0**40:
        cells, kind = np.floor(values * 256.0).astype(np.int64), np.int64
    else:
        cells, kind = np.array([_whole(v) for v in values.tolist()], object), object
    out = np.zeros((len(lengths), parts * size), kind)
    out[np.arange(parts * size) < lengths[:, None]] = cells
    return out.reshape(len(lengths), parts, size)


class Codebook:
    """The entries of one part position, with their cells; ``nearest`` filters by bounds and refines in whole numbers."""

    def __init__(self, entries: list[list[int]], bits: int = CELL_BITS):
        self.entries = np.array(entries, object).reshape(len(entries), -1)
        self.most = max((abs(c) for row in entries for c in row), default=0)
        self.small = self.entries.astype(np.int64) if self.most < 1 << 62 else None
        # the bounds are doubles of 256ths, widened by more than rounding can take off
        near = np.array([[_as_double(c) for c in row] for row in entries], float).reshape(self.entries.shape)
        n, size = near.shape
        place = np.argsort(np.argsort(near, axis=0, kind="stable"), axis=0, kind="stable")
        self.cells = place * min(n, 1 << bits) // max(n, 1)
        self.low, self.high = (np.full((size, 1 << bits), np.inf) * s for s in (1, -1))
        for at in range(size):
            np.minimum.at(self.low[at], self.cells[:, at], near[:, at])
            np.maximum.at(self.high[at], self.cells[:, at], near[:, at])
        used = np.isfinite(self.low)
        self.low[used] -= 1e-12 * np.abs(self.low[used])
        self.high[used] += 1e-12 * np.abs(self.high[used])

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (parts x entries) of the squared distances of parts given as doubles."""
        lower, upper = np.zeros((2, len(parts), len(self.cells)))
        for at in range(parts.shape[1]):
            x = parts[:, at, None]
            off, on = self.low[at] - x, x - self.high[at]
            least = np.maximum(np.maximum(off, on), 0.0) ** 2 * (1 - 1e-9)
            most = np.maximum(np.abs(off), np.abs(on)) ** 2 * (1 + 1e-9)
            lower += least[:, self.cells[:, at]]
            upper += most[:, self.cells[:, at]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry, ties to the lower index."""
        if not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        doubles = parts / 256.0 if parts.dtype == np.int64 else np.array([[_as_double(c) for c in row] for row in parts])
        with np.errstate(over="ignore"):
            lower, upper = self.bounds(doubles)
        part, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        reach = max(self.most, int(np.abs(parts).max(initial=0)))
        plain = parts.dtype == np.int64 and parts.shape[1] * (2 * reach) ** 2 < 1 << 63
        gap = parts[part] - self.small[entry] if plain else parts[part].astype(object) - self.entries[entry]
        distance = (gap * gap).sum(axis=1)
        begins = np.searchsorted(part, np.arange(len(parts)))
        least = np.minimum.reduceat(distance, begins)
        hits = np.flatnonzero(distance == least[part])
        first = hits[np.searchsorted(part[hits], np.arange(len(parts)))]
        return entry[first], least


def _as_double(whole: int) -> float:
    return whole / 256  # true division of integers rounds once, at any size


def _steps(batches: Iterator[pa.RecordBatch], parts: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            piece = batch.slice(at, _STEP)
            yield piece, whole_parts(piece.column("x"), parts, size)


def _improved(rows: DataFrame, books: list[list[list[int]]], size: int) -> list[list[list[int]]]:
    """Codebooks whose entries are the floored means of the parts that are nearest to them; unused entries stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        n = np.zeros((len(books), len(books[0])), np.int64)
        total = np.zeros((len(books), len(books[0]), size), object)
        for _, vectors in _steps(batches, len(books), size):
            for p, book in enumerate(found):
                index, _ = book.nearest(vectors[:, p])
                n[p] += np.bincount(index, minlength=n.shape[1])
                # sums of some thousand numbers below 2^48 fit in 64 bits
                step = np.zeros(total[p].shape, vectors.dtype)
                np.add.at(step, index, vectors[:, p])
                total[p] += step
        p, e = np.nonzero(n)
        texts = [[str(c) for c in total[i, j]] for i, j in zip(p.tolist(), e.tolist(), strict=True)]
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(texts, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    def means(group: pa.Table) -> pa.Table:
        n = sum(group.column("n").to_pylist())
        mean = [str(sum(map(int, column)) // n) for column in zip(*group.column("total").to_pylist(), strict=True)]
        return pa.table([group.column("part")[:1], group.column("entry")[:1], pa.array([mean], pa.list_(pa.string()))], ["part", "entry", "mean"])

    parted = rows.select("x").transform(arrow_map, sums, "part int, entry int, n long, total array<string>")
    new = [[list(row) for row in book] for book in books]
    for r in parted.groupBy("part", "entry").applyInArrow(means, "part int, entry int, mean array<string>").collect():  # a row for each entry
        new[r.part][r.entry] = [int(c) for c in r["mean"]]
    return new


def train_codebooks(rows: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """Codebooks by part position and entry, from the parts of the first vectors by ``key``; ``rows`` has x.

    First vectors are rows by ascending key, null keys last, rows of one key by their vectors.
    """
    width = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    size = -(-width // parts)
    first = rows.orderBy(F.col(key).asc_nulls_last(), "x").limit(entries).select("x").collect()
    cut = whole_parts(pa.array([r.x for r in first], pa.list_(pa.float64())), parts, size)
    books = [[[int(c) for c in row] for row in cut[:, p]] for p in range(parts)]
    for _ in range(rounds if first else 0):
        books = _improved(rows, books, size)
    return books


def encode(rows: DataFrame, books: list[list[list[int]]], *columns: str) -> DataFrame:
    """``columns``, code (two hex digits a part) and error (squared distances summed over the parts) of each row of x.

    An error beyond 64 bits ends the query with an error.
    """
    size = len(books[0][0])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        for piece, vectors in _steps(batches, len(books), size):
            index, distance = zip(*(book.nearest(vectors[:, p]) for p, book in enumerate(found)), strict=True)
            codes = [bytes(row).hex() for row in np.stack(index, axis=1).astype(np.uint8)]
            errors = [sum(row) for row in zip(*(d.tolist() for d in distance), strict=True)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), pa.array(codes), pa.array(errors, pa.int64())], [*columns, "code", "error"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select(*columns, "x").transform(arrow_map, coded, f"{kinds}, code string, error long")


def codebook_digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for row in book for c in row).encode()).hexdigest()


def code_table(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector of ``table`` (vec_id, embedding, label).

    Rows whose vector is null or holds null or non-finite components are dropped.  Vectors of other lengths than the
    longest, which is rounded up to whole parts, are as if filled up with zeros; so are empty ones.  Null and
    repeated ids and labels are values like others, rows without a label are one label, and each row gives one row.
    With fewer rows than entries, codebooks have as many entries as there are rows.  No rows give no rows.
    """
    if entries > 256:
        raise ValueError("a part's index has two hex digits")
    spark = table.sparkSession
    rows = finite_vectors(table, "embedding", "vec_id", "label")
    books = train_codebooks(rows, "vec_id", parts, entries, rounds)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not books[0]:
        return spark.createDataFrame([], schema)
    coded = stored(encode(rows, books, "vec_id", "label"), "codes")
    # sums as a table, so that Spark knows their size and can split a label that holds many rows
    sums = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))

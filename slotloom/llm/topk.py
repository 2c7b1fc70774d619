"""Exact top-k inner products: norm-sorted vectors, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are whole numbers, kept as 256ths.  Ranges of norms become partitions; within one, vectors come by descending
length.  A rotation from the singular vectors of a sample gathers most of the length in the first
components, so a product over those plus the product of the remaining lengths bounds the score closely.
Queries are a stated set; they wait in the shared folder in blocks, with a first threshold each from the
longest vectors.  Blocks hold queries that candidates of like norms can still matter to, so a partition of
candidates reads only the blocks that its longest vector can reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.llm.shared import arrow_map, get_file, put_file, stored, work_dir

#: Vectors that the rotation is fitted on, at most about, and longest vectors that give first thresholds.
FIT_ROWS = 20_000
HEAD = 1_024
QUERY_BLOCK = 256
#: Candidates per partition, about, and per step.
PART_ROWS = 50_000
_STEP_ROWS = 2_048
#: Greatest norm of 256 times a vector for products in 64 bits: by Cauchy-Schwarz no sum exceeds the product of two norms.
LARGEST = float((1 << 31) - 1)


def whole_vectors(table: DataFrame) -> DataFrame:
    """vec_id, w (floor of 256 x per component, as 256ths) and norm of 256 w of the rows that take part.

    Null ids, null vectors, and vectors with null or non-finite components take no part.  Doubles hold w exactly.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    fit = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = table.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fit, F.lit(False)))
    # doubles of 2^50 and more are whole 256ths
    w = F.transform("x", lambda e: F.when(F.abs(e) < float(1 << 50), F.floor(e * 256.0).cast("double") / 256.0).otherwise(e))
    rows = rows.select("vec_id", w.alias("w"))
    return rows.withColumn("norm", _norm())


def _norm() -> Column:
    return F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, e: s + (e * 256.0) * (e * 256.0)))


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _rotation(rows: DataFrame, width: int, total: int, fit_rows: int) -> np.ndarray:
    """Singular vectors of the sample's second moments, summed per partition, as columns by falling value."""
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    sample = rows.where(share < int((1 << 30) * min(1.0, fit_rows / max(total, 1)))).select("w")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for batch in batches:
            x = _stack(batch.column("w"), width) * 256.0
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary())], ["gram"])

    parts = sample.coalesce(8).transform(arrow_map, moments, "gram binary").collect()
    return np.linalg.svd(sum((np.frombuffer(p.gram).reshape(width, width) for p in parts), np.zeros((width, width))))[0]


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores per query, ties to smaller ids."""
    order = np.lexsort((ids, -scores, query))
    ordered = query[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    rank = np.arange(len(ordered)) - np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))
    return order[rank < k]


def _rounding(width: int) -> float:
    """What a product of ``width`` doubles, rotated or not, can be off by, as a share of the product of the norms."""
    return (16 * width + 64) * 2.0**-52


class Block:
    """Some queries with their rotated vectors, thresholds, and best candidates so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, limits: np.ndarray, rotation: np.ndarray, head: int, k: int):
        self.ids, self.vectors, self.limits, self.k, self.head = ids, vectors, limits, k, head
        turned = vectors @ rotation
        self.front = turned[:, :head]
        self.rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))

    def meet(self, ids: np.ndarray, vectors: np.ndarray, front: np.ndarray, rest: np.ndarray, norms: np.ndarray) -> bool:
        """Compare with candidates by falling norm; False once no later ones can matter."""
        slack = 0.5 + _rounding(self.vectors.shape[1]) * self.norms * (norms[0] if len(norms) else 0.0)
        live = np.flatnonzero(self.norms * norms[0] + slack >= self.limits)
        if not len(live):
            return False
        bound = self.front[live] @ front.T + np.outer(self.rest[live], rest)
        query, candidate = np.nonzero(bound + slack[live, None] >= self.limits[live, None])
        query = live[query]
        other = self.ids[query] != ids[candidate]
        query, candidate = query[other], candidate[other]
        if len(query) > 0.1 * len(live) * len(ids):
            scores = np.rint(self.vectors[live] @ vectors.T) if self._exact(norms) else self.vectors[live].astype(np.int64) @ vectors.astype(np.int64).T
            scores = scores[np.searchsorted(live, query), candidate].astype(np.int64)
        else:
            kind = np.float64 if self._exact(norms) else np.int64
            parts = (slice(a, a + 65_536) for a in range(0, len(query), 65_536))
            scores = [np.einsum("ij,ij->i", self.vectors[query[p]].astype(kind), vectors[candidate[p]].astype(kind)) for p in parts]
            scores = np.concatenate([np.empty(0, kind), *scores]).astype(np.int64)  # whole numbers of 64 bits stay such
        keep = scores >= self.limits[query]
        joined = tuple(np.concatenate([a, b[keep]]) for a, b in zip(self.found, (query, ids[candidate], scores), strict=True))
        best = _best(*joined, self.k)
        self.found = tuple(x[best] for x in joined)
        query, _, scores = self.found
        full = np.flatnonzero(np.bincount(query, minlength=len(self.ids)) == self.k)
        worst = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(worst, query, scores)
        self.limits[full] = np.maximum(self.limits[full], worst[full])
        return True

    def _exact(self, norms: np.ndarray) -> bool:
        return bool(self.norms.max(initial=0) * norms[0] < 2**52)


def _first_rows(rows: DataFrame, k: int) -> DataFrame:
    """The rows of smallest vec_id, enough of them that k remain without those of any one id."""
    numbered = rows.select("vec_id").withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy("vec_id")))
    return numbered.where(F.col("copy") <= k).orderBy("vec_id").limit(2 * k).select("vec_id")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best_first = Window.partitionBy("query_id").orderBy(*([F.desc("side")] if "side" in found.columns else []), F.desc_nulls_last("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    if "side" in found.columns:
        beyond = F.raise_error(F.concat(F.lit("score beyond 64 bits: "), F.col("query_id"), F.lit(" x "), F.col("vec_id"))).cast("long")
        best = best.withColumn("score", F.when(F.col("side").isin(1, -1), beyond).otherwise(F.col("score")))
    return best.select("query_id", "rank", "vec_id", "score")


def _with_empty(found: DataFrame, rows: DataFrame, k: int, every: int) -> DataFrame:
    """Add products with empty vectors: they have no score and come after all others, by vec_id."""
    full = F.size("w") > 0
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.max(full).alias("full"))
    pairs = []
    for wanted, candidates in ((F.col("full"), rows.where(~full)), (~F.col("full"), rows)):
        first = [F.lit(r.vec_id).cast("long") for r in _first_rows(candidates, k).collect()]  # 2 k ids at most
        listed = F.array(*first) if first else F.array().cast("array<long>")
        pairs.append(asked.where(wanted).select("query_id", F.explode(listed).alias("vec_id")).where("query_id <> vec_id"))
    none = pairs[0].unionByName(pairs[1]).select("query_id", "vec_id", F.lit(None).cast("long").alias("score"))
    return found.unionByName(none.withColumn("side", F.lit(-2)) if "side" in found.columns else none)


def _integers(w: np.ndarray) -> list[int]:
    return [n * 256 // d for n, d in map(float.as_integer_ratio, w.tolist())]


def _scaled(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with components of 1 at most, by powers of two, the powers, and the norms of what is left."""
    powers = np.frexp(np.abs(w).max(axis=1))[1]
    rows = np.ldexp(w, -powers[:, None])
    return rows, powers, np.sqrt((rows**2).sum(axis=1))


def _log_norms(w: np.ndarray) -> np.ndarray:
    """Binary logarithms of the norms of 256 times the rows, not below the true ones; -inf for zeros."""
    _, powers, norms = _scaled(w)
    with np.errstate(divide="ignore"):
        return np.log2(norms) + powers + 8 + 1e-9


def _log(n: int) -> float:
    """The binary logarithm of a positive integer, not above the true one."""
    shift = max(n.bit_length() - 60, 0)
    return math.log2(n >> shift) + shift - 1e-9


def _exact_best(own: np.ndarray, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Query, candidate and exact score of each query's k best: doubles choose, within their error, whom integers score.

    Candidates come by falling norm; once no product of norms reaches a query's k-th score, the rest is left out.
    """
    size = _log_norms(vectors)
    order = np.lexsort((ids, -size))
    ids, vectors, size = ids[order], vectors[order], size[order]
    reach = _log_norms(asked)
    fine, of = np.unique(vectors, axis=0, return_inverse=True)
    of = of.reshape(-1)
    whole: dict[int, list[int]] = {}
    a, _, a_norms = _scaled(asked)
    best: list[list[tuple[int, int]]] = [[] for _ in own]
    mine = [_integers(w) for w in asked]
    for begin in range(0, len(ids), _STEP_ROWS):
        at = np.arange(begin, min(begin + _STEP_ROWS, len(ids)))
        live = [q for q, b in enumerate(best) if len(b) < k or b[-1][0] >= 0 or reach[q] + size[begin] >= _log(-b[-1][0])]
        if not live:
            break
        b, powers, b_norms = _scaled(vectors[at])
        shift = powers - powers.max()
        score = np.ldexp(a @ b.T, shift)
        error = np.ldexp(np.outer(a_norms, b_norms) * (2.0**-50 * vectors.shape[1]), shift) + 1e-300
        for q in live:
            other = np.flatnonzero(ids[at] != own[q])
            if len(other) > k:
                least = np.partition(score[q, other] - error[q, other], -k)[-k]
                other = other[score[q, other] + error[q, other] >= least]
            exact: dict[int, int] = {}
            for c in at[other].tolist():
                d = int(of[c])
                if d not in exact:
                    if d not in whole:
                        whole[d] = _integers(fine[d])
                    exact[d] = sum(map(mul, mine[q], whole[d]))
                best[q].append((-exact[d], int(ids[c])))
            best[q] = sorted(best[q])[:k]
    return [(int(i), c, -s) for i, found in zip(own, best, strict=True) for s, c in found]


def _exact_products(asked: DataFrame, candidates: DataFrame, width: int, k: int, folder: str) -> DataFrame:
    """query_id, vec_id, score and side of each query's best candidates in each part; side is 1 or -1 beyond 64 bits."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                piece = batch.slice(at, QUERY_BLOCK)
                path = f"{folder}-{TaskContext.get().partitionId()}-{number}"
                put_file(path, [np.asarray(piece.column("vec_id")).astype("<i8").tobytes(), _stack(piece.column("w"), width).tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([piece.num_rows], pa.int64())], ["path", "n"])
                number += 1

    blocks = [(r.path, r.n) for r in asked.select("vec_id", "w").transform(arrow_map, write, "path string, n long").collect()]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column("vec_id")), _stack(b.column("w"), width)) for b in batches if b.num_rows]
        if not parts:
            return
        ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        for path, n in blocks:
            blob = get_file(path)
            found = _exact_best(np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "<f8", n * width, 8 * n).reshape(n, width), ids, vectors, k)
            inside = [-(1 << 63) <= s < 1 << 63 for _, _, s in found]
            columns = [[q for q, _, _ in found], [c for _, c, _ in found], [s if i else 0 for (_, _, s), i in zip(found, inside, strict=True)]]
            sides = [0 if i else 1 if s > 0 else -1 for (_, _, s), i in zip(found, inside, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(sides, pa.int32())], ["query_id", "vec_id", "score", "side"])

    return candidates.select("vec_id", "w").transform(arrow_map, compared, "query_id long, vec_id long, score long, side int")


def top_products(table: DataFrame, k: int = 5, every: int = 50, fit_rows: int = FIT_ROWS, all_lengths: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` highest inner products.

    Queries are rows whose vec_id is divisible by ``every`` (of repeated ids the smallest vector);
    candidates all rows with another id, repeated rows once each.  No vectors or queries give no rows.
    With ``all_lengths`` a missing component counts as zero, but a product with an empty vector has no terms
    and is null, after all others, as in the query's SQL; without, vectors of another length than the longest take no
    part.  A repeated query id keeps the smallest of its vectors that are not empty, in the order of their components
    with missing ones as zero.
    """
    spark = table.sparkSession
    folder = work_dir(spark, "topk")
    result = "query_id long, vec_id long, score long"
    rows = whole_vectors(table)
    size = F.size("w")
    width, empty, long = rows.agg(F.coalesce(F.max(size), F.lit(0)), F.count_if(size == 0), F.count_if(F.col("norm") > LARGEST)).first()
    if not all_lengths:
        rows, empty = rows.where((size == width) & (size > 0)), 0
    every_row = rows
    rows = rows.where(size > 0)
    if all_lengths:
        rows = rows.withColumn("w", F.concat("w", F.array_repeat(F.lit(0.0), F.lit(width) - size)))
    rows = stored(rows, "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("w").alias("w"))
    beyond = None
    if long:  # some norms are too long for 64 bits: all products with those vectors are made apart
        asked = stored(asked.withColumn("norm", _norm()), "asked")
        every_full, ordinary = rows, F.col("norm") <= LARGEST
        beyond = _exact_products(asked.where(ordinary), every_full.where(~ordinary), width, k, f"{folder}/long")
        beyond = beyond.unionByName(_exact_products(asked.where(~ordinary), every_full, width, k, f"{folder}/all"))
        asked, rows = asked.where(ordinary), rows.where(ordinary)
    total = rows.count()
    parts = max(1, -(-total // PART_ROWS))
    if not total:
        none = beyond if long else spark.createDataFrame([], result)
        return _ranked(_with_empty(none, every_row, k, every) if empty else none, k)
    rotation = _rotation(rows, width, total, fit_rows)
    head = max(1, width // 4)
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(HEAD).select("vec_id", "w").collect()
    top_ids = np.array([r.vec_id for r in longest], np.int64)
    top = np.array([r.w for r in longest], np.float64).reshape(-1, width) * 256.0

    def limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                piece = batch.slice(at, QUERY_BLOCK)
                ids, vectors = np.asarray(piece.column("vec_id")), _stack(piece.column("w"), width) * 256.0
                # by how much a sum of doubles is off depends on the norms, however small the sum
                error = _rounding(width) * np.outer(np.sqrt((vectors**2).sum(axis=1)), np.sqrt((top**2).sum(axis=1)))
                scores = vectors @ top.T - error
                scores[ids[:, None] == top_ids[None, :]] = -np.inf
                limits = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
                limits = np.where(np.isfinite(limits), np.floor(limits) - 1, -(2.0**62)).astype(np.int64)
                # a shorter candidate's product stays below the limit
                norms = np.sqrt((vectors**2).sum(axis=1))
                reach = np.where(limits > 1, (limits - 1.0) / np.maximum(norms * (1 + 1e-8), 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("w"), pa.array(limits), pa.array(reach)], ["vec_id", "w", "limit", "reach"])

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                piece = batch.slice(at, QUERY_BLOCK)
                ids, limits, vectors = np.asarray(piece.column("vec_id")), np.asarray(piece.column("limit")), _stack(piece.column("w"), width) * 256.0
                path = f"{folder}/queries-{TaskContext.get().partitionId()}-{number}"
                put_file(path, [ids.astype("<i8").tobytes(), limits.astype("<i8").tobytes(), vectors.tobytes()])
                least = pa.array([float(np.asarray(piece.column("reach")).min())])
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(ids)], pa.int64()), least], ["path", "n", "least"])
                number += 1

    by_reach = asked.select("vec_id", "w").transform(arrow_map, limited, "vec_id long, w array<double>, limit long, reach double")
    by_reach = by_reach.repartitionByRange(max(1, total // (every * QUERY_BLOCK * 16)), "reach").sortWithinPartitions("reach")
    blocks = [(r.path, r.n, r.least) for r in by_reach.transform(arrow_map, queries, "path string, n long, least double").collect()]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_ = [(np.asarray(b.column("vec_id")), _stack(b.column("w"), width), np.asarray(b.column("norm"))) for b in batches if b.num_rows]
        if not parts_:
            return
        ids, vectors, norms = (np.concatenate(x) for x in zip(*parts_, strict=True))
        vectors = vectors * 256.0
        turned = vectors @ rotation
        front, rest = np.ascontiguousarray(turned[:, :head]), np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        for path, n, least in blocks:
            if norms[0] < least:
                continue
            blob = get_file(path)
            own, limits = np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "<i8", n, 8 * n).copy()
            block = Block(own, np.frombuffer(blob, "<f8", n * width, 16 * n).reshape(n, width), limits, rotation, head, k)
            for a in range(0, len(ids), _STEP_ROWS):
                b = a + _STEP_ROWS
                if not block.meet(ids[a:b], vectors[a:b], front[a:b], rest[a:b], norms[a:b]):
                    break
            query, candidate, scores = block.found
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(candidate), pa.array(scores)], ["query_id", "vec_id", "score"])

    longest_first = [F.desc("norm"), F.col("vec_id")]
    dealt = rows.repartitionByRange(parts, *longest_first).sortWithinPartitions(*longest_first)
    found = dealt.select("vec_id", "w", "norm").transform(arrow_map, compared, result)
    if long:
        found = found.withColumn("side", F.lit(0)).unionByName(beyond)
    return _ranked(_with_empty(found, every_row, k, every) if empty else found, k)

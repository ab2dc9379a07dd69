"""Exact top-k search by inner product, pruned with segment statistics from coarse to fine.

Split two vectors into segments; with each segment's mean and deviation, the squared distance is at least the sum of
length * ((mean - mean')**2 + (deviation - deviation')**2), so the inner product is at most the sum of
length * (mean * mean' + deviation * deviation'). A candidate whose bound falls under a query's k-th best score so far
is dropped for that query at the coarsest level that shows it; exact scores are computed for the pairs that survive.
Bounds are taken in single precision, with a slack for its rounding.

Queries are taken in blocks of a bounded number of rows, one after another, each broadcast to the tasks that read the
candidates once: no vector is shuffled, and a block's broadcast is given back before the next. Within a block, queries
stand by the direction of their coarsest means, so that the queries of a tile need the same candidates. A task returns
its k best for each query, and these meet by query.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids.
Vectors of other lengths than a query's are no candidates for it. Every other row is a candidate, so a repeated row may
take several ranks; all rows of a query's own id are excluded, and of repeated queries the one of the least vector is
asked. Ties go to the smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from rangeloom.llm.common import discard, written

#: Queries of a block, tiles of queries and candidates in a task, the segments of each level, pairs scored at once, and
#: the share of surviving pairs from which a tile is scored as a whole.
BLOCK, QUERY_TILE, CANDIDATE_TILE, LEVELS, PAIRS, DENSE = 16_384, 128, 4096, (8, 32), 1 << 16, 0.25
#: Single precision's rounding of a sum of products, as a share of the vectors' lengths; lengths beyond which it may overflow.
ROUNDING, LONGEST = 2e-5, 1e15


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and the vector of floor(scale * component)."""
    ints = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), ints.alias("v"))


@dataclass(frozen=True)
class Side:
    """Ids, vectors, their lengths, and each level's features, whose product bounds the inner product from above."""

    ids: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    features: tuple[np.ndarray, ...]


def side(ids: np.ndarray, vectors: np.ndarray) -> Side:
    out, x = [], vectors.astype("float64")
    for segments in LEVELS:
        cuts = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
        lengths = np.diff(cuts)
        means = np.add.reduceat(x, cuts[:-1], axis=1) / lengths
        squares = np.add.reduceat(x * x, cuts[:-1], axis=1) / lengths
        deviations = np.sqrt(np.maximum(squares - means * means, 0))
        out.append(np.concatenate([means * np.sqrt(lengths), deviations * np.sqrt(lengths)], axis=1).astype("float32"))
    return Side(ids, vectors, np.linalg.norm(x, axis=1), tuple(out))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where every sum is below 2**53."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype("float64") @ b.astype("float64").T).astype("int64")
    return a @ b.T


def ordered(own: Side) -> Side:
    """The side sorted by its vectors' largest coarse mean, and by that mean."""
    means = own.features[0][:, : own.features[0].shape[1] // 2]
    most = np.abs(means).argmax(1)
    order = np.lexsort((own.ids, means[np.arange(len(most)), most], most))
    return Side(own.ids[order], own.vectors[order], own.lengths[order], tuple(f[order] for f in own.features))


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: Side, k: int):
        self.queries, self.k = queries, k
        self.seen = self.dropped = 0  # pairs that bounds looked at, and those they dropped
        self.floor = np.full(len(queries.ids), -np.inf)
        self.rows = [np.zeros(0, "int64")] * 3  # query, id, score

    def add(self, candidates: Side) -> None:
        for q in range(0, len(self.queries.ids), QUERY_TILE):
            for c in range(0, len(candidates.ids), CANDIDATE_TILE):
                self._tile(slice(q, q + QUERY_TILE), slice(c, c + CANDIDATE_TILE), candidates)

    def _survivors(self, at: slice, of: slice, candidates: Side) -> tuple[np.ndarray, np.ndarray] | None:
        """The tile's pairs that no bound drops, or None where all (or very many) of them survive."""
        floor, mine, theirs = self.floor[at], self.queries.lengths[at], candidates.lengths[of]
        size = len(mine) * len(theirs)
        if not np.isfinite(floor).all() or mine.max() > LONGEST or theirs.max() > LONGEST:
            return None
        least = (floor - ROUNDING * mine * theirs.max() - 1e-3).astype("float64")
        columns = np.arange(of.start, of.start + len(theirs))
        for own, other in zip(self.queries.features, candidates.features):
            may = own[at] @ other[columns].T >= least[:, None]
            any_of = may.any(0)
            columns, may = columns[any_of], may[:, any_of]
        i, j = np.nonzero(may)
        self.seen, self.dropped = self.seen + size, self.dropped + size - len(i)
        return None if len(i) > DENSE * size else (i, columns[j])

    def _tile(self, at: slice, of: slice, candidates: Side) -> None:
        of = slice(of.start, min(of.stop, len(candidates.ids)))
        survivors = self._survivors(at, of, candidates)
        if survivors is None:
            score = products(self.queries.vectors[at], candidates.vectors[of])
            own = self.queries.ids[at][:, None] == candidates.ids[of][None, :]
            good = (score >= self.floor[at][:, None]) & ~own
            if score.shape[1] > self.k:
                best = np.partition(np.where(own, np.iinfo("int64").min, score), score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
                good &= score >= best[:, None]
            i, j = np.nonzero(good)
            j, score = j + of.start, score[i, j]
        else:
            i, j = survivors
            parts = [np.einsum("ij,ij->i", self.queries.vectors[at][i[k : k + PAIRS]], candidates.vectors[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]
            score = np.concatenate(parts) if parts else np.zeros(0, "int64")
            good = (score >= self.floor[at][i]) & (self.queries.ids[at][i] != candidates.ids[j])
            i, j, score = i[good], j[good], score[good]
        if not len(i):
            return
        rows = [np.concatenate(x) for x in zip(self.rows, (i + at.start, candidates.ids[j], score))]
        order = np.lexsort((rows[1], -rows[2], rows[0]))
        rows = [x[order] for x in rows]
        first = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        self.rows = [x[rank < self.k] for x in rows]
        full = rows[0][rank == self.k - 1]
        self.floor[full] = rows[2][rank == self.k - 1]


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors, and their components one after another."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.diff(column.offsets.to_numpy()), flat


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k candidates (vec_id, v) of highest inner product with each query."""
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n = asked.count()
    blocks = max(1, -(-n // block))
    if blocks > 1:
        asked = written(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "block")
    found = []
    for at in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.col("block") == at).drop("block")
        rows = own.toArrow().to_pandas().sort_values("vec_id")  # about a block: bounded
        sides = []
        for length, group in rows.groupby(rows["v"].map(len)):
            sides.append(ordered(side(group["vec_id"].to_numpy("int64"), np.array(group["v"].tolist(), "int64").reshape(-1, length))))
        shared = queries.sparkSession.sparkContext.broadcast(sides)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {s.vectors.shape[1]: Best(s, k) for s in shared.value}
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                lengths, flat = _matrix(batch.column(1))
                ends = np.cumsum(lengths)
                for length, b in best.items():
                    rows = np.flatnonzero(lengths == length)
                    if len(rows):
                        own = flat.reshape(-1, length) if len(rows) == len(ids) else np.array([flat[ends[r] - length : ends[r]] for r in rows])
                        b.add(side(ids[rows], own))
            for b in best.values():
                q, i, s = b.rows
                yield pa.RecordBatch.from_arrays([pa.array(b.queries.ids[q]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        part = candidates.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
        ranked = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found.append(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
        if blocks > 1:
            found[-1] = written(found[-1])
            shared.destroy()
    if blocks > 1:
        discard(asked)
    return reduce(DataFrame.unionByName, found)

"""Workload statistics: how queries spread over a dimension, how skewed that is, and where to cut it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.plans.model import RangeQuery, finite

#: A width that stands for an unbounded range when queries are compared.
UNBOUNDED = 1e6


def emd(p: np.ndarray, q: np.ndarray) -> float:
    """Earth mover's distance of two histograms over the same bins, each scaled to mass one."""
    p, q = (np.asarray(x, float) / s if (s := np.sum(x)) > 0 else np.zeros(len(x)) for x in (p, q))
    return float(np.abs(np.cumsum(p - q)).sum())


def query_histogram(spans: Sequence[tuple[float, float]], lo: float, hi: float, bins: int) -> np.ndarray:
    """Each query spreads one unit of mass evenly over the bins of [lo, hi] that it overlaps."""
    out, width = np.zeros(bins), (hi - lo) / bins
    for a, b in spans:
        if width <= 0 or b < lo or a > hi:
            continue
        first = int(np.clip((a - lo) / width, 0, bins - 1))
        last = int(np.clip(np.ceil((b - lo) / width) - 1, first, bins - 1))
        out[first : last + 1] += 1 / (last - first + 1)
    return out


def skew(histogram: np.ndarray) -> float:
    """Distance of a histogram from an even spread."""
    return emd(np.ones(len(histogram)), histogram) if len(histogram) and histogram.sum() > 0 else 0.0


def query_histogram_frame(queries: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """bin, mass over a large log of queries (lo, hi): each one's unit of mass spread over its bins."""
    width = (hi - lo) / bins
    first = F.least(F.greatest(F.floor((F.col("lo") - lo) / width), F.lit(0)), F.lit(bins - 1))
    last = F.least(F.greatest(F.ceil((F.col("hi") - lo) / width) - 1, first), F.lit(bins - 1))
    inside = queries.filter((F.col("hi") >= lo) & (F.col("lo") <= hi))
    spread = inside.select(F.explode(F.sequence(first, last)).alias("bin"), (1.0 / (last - first + 1)).alias("mass"))
    return spread.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.sum("mass").alias("mass"))


def query_types(queries: Sequence[RangeQuery], columns: Sequence[str], eps: float = 0.2) -> list[list[int]]:
    """Groups of queries whose range widths are alike: components of the graph of pairs within eps after scaling."""
    if not queries:
        return []

    def width(q: RangeQuery, c: str) -> float:
        r = q.where.ranges.get(c)
        return UNBOUNDED if r is None or r.lo is None or r.hi is None else min(r.hi - r.lo, UNBOUNDED)

    x = np.array([[width(q, c) for c in columns] for q in queries])
    span = np.ptp(x, axis=0)
    x = (x - x.min(0)) / np.where(span > 0, span, 1)
    group, left = np.full(len(x), -1), 0
    for k in range(len(x)):
        if group[k] < 0:
            group[k], reach = left, [k]
            while reach:
                near = np.flatnonzero((np.linalg.norm(x - x[reach.pop()], axis=1) <= eps) & (group < 0))
                group[near] = left
                reach += near.tolist()
            left += 1
    return [np.flatnonzero(group == g).tolist() for g in range(left)]


def best_cuts(histogram: np.ndarray, step: int = 2, least: int = 2, tolerance: float = 0.10) -> tuple[list[int], float]:
    """Bins at which to cut so that the segments' skews, weighted by their mass, add up to least; and the reduction.

    Cuts lie on multiples of ``step``; a segment has ``least`` steps or more. Neighbours are merged again while that
    costs no more than ``tolerance`` of their own skew.
    """
    leaves = len(histogram) // step
    if leaves < 2 * least:
        return [], 0.0
    cost = lambda i, j: skew(histogram[i * step : j * step]) * histogram[i * step : j * step].sum()
    best, cut = np.full(leaves + 1, np.inf), np.zeros(leaves + 1, int)
    best[0] = 0
    for j in range(least, leaves + 1):
        for i in range(0, j - least + 1):
            if best[i] < np.inf and (total := best[i] + cost(i, j)) < best[j] - 1e-12:
                best[j], cut[j] = total, i
    cuts, at = [leaves], leaves
    while at:
        at = int(cut[at])
        cuts.append(at)
    cuts.reverse()
    merged = True
    while merged and len(cuts) > 2:
        merged = False
        for k in range(1, len(cuts) - 1):
            if cost(cuts[k - 1], cuts[k + 1]) <= (1 + tolerance) * (cost(cuts[k - 1], cuts[k]) + cost(cuts[k], cuts[k + 1])):
                del cuts[k]
                merged = True
                break
    reduction = cost(0, leaves) - sum(cost(a, b) for a, b in zip(cuts, cuts[1:]))
    return [c * step for c in cuts[1:-1]], float(reduction)


def spans_of(queries: Sequence[RangeQuery], column: str, lo: float, hi: float) -> list[tuple[float, float]]:
    """The range that each query asks of a column, cut to [lo, hi]."""
    out = []
    for q in queries:
        r = q.where.ranges.get(column)
        out.append((finite(r.lo if r else None, lo), finite(r.hi if r else None, hi)))
    return out

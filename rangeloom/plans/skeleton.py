"""Grid skeletons: how each dimension is handled, and a cost model that chooses the numbers of parts."""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame

from rangeloom.functions.stats import LinearMap, empty_cell_fraction, equi_depth_bounds, linear_maps
from rangeloom.plans.model import RangeQuery, finite

INDEPENDENT, FUNCTIONAL, CONDITIONAL = "independent", "functional", "conditional"


@dataclass(frozen=True)
class Strategy:
    """A dimension's buckets: its own, none (it follows another one by a linear map), or inside another one's buckets."""

    kind: str = INDEPENDENT
    other: str | None = None
    map: LinearMap | None = None
    parts: int = 4


@dataclass(frozen=True)
class Skeleton:
    dims: dict[str, Strategy] = field(default_factory=dict)

    def active(self) -> list[str]:
        """Dimensions with buckets, bases before those that depend on them."""
        return sorted((c for c, s in self.dims.items() if s.kind != FUNCTIONAL), key=lambda c: (self.dims[c].kind == CONDITIONAL, list(self.dims).index(c)))

    def maps(self) -> list[LinearMap]:
        return [s.map for s in self.dims.values() if s.kind == FUNCTIONAL]

    def with_dim(self, column: str, strategy: Strategy) -> Skeleton:
        return Skeleton(self.dims | {column: strategy})

    def valid(self) -> bool:
        """Mapped dimensions follow active ones only, and bases are independent: no cycles, no chains."""
        return all(s.kind == INDEPENDENT or s.other != c and self.dims[s.other].kind == INDEPENDENT for c, s in self.dims.items()) and bool(self.active())

    def cells(self) -> int:
        return math.prod(self.dims[c].parts for c in self.active())

    def to_dict(self) -> dict:
        return {c: asdict(s) for c, s in self.dims.items()}

    @staticmethod
    def from_dict(d: dict) -> Skeleton:
        return Skeleton({c: Strategy(s["kind"], s["other"], LinearMap(**s["map"]) if s["map"] else None, s["parts"]) for c, s in d.items()})


@dataclass(frozen=True)
class Correlations:
    """What one pass each over the data says about pairs of dimensions."""

    maps: dict[tuple[str, str], LinearMap]
    empty: dict[tuple[str, str], float]


def correlations(df: DataFrame, columns: Sequence[str], grid: int = 8, exact: bool = True) -> Correlations:
    pairs = list(itertools.permutations(columns, 2))
    bounds: dict[str, list[float]] = {c: [] for c in columns}
    for r in equi_depth_bounds(df, list(columns), grid, exact).orderBy("column", "k").collect():  # grid + 1 rows a column
        bounds[r["column"]].append(r["bound"])
    flat = [p for p in pairs if p[0] < p[1]]
    empty = empty_cell_fraction(df, flat, bounds, grid) if flat else {}
    return Correlations({(m.x, m.y): m for m in linear_maps(df, pairs)}, empty | {(b, a): v for (a, b), v in empty.items()})


def initial_skeleton(columns: Sequence[str], found: Correlations, parts: int = 4, map_width: float = 0.10, empty_share: float = 0.25) -> Skeleton:
    """Each dimension takes the tightest map whose target stays active, else the first base it leaves cells empty with."""
    out = Skeleton({c: Strategy(parts=parts) for c in columns})
    used: set[str] = set()
    for c in columns:
        if c in used:
            continue
        tight = sorted((m for (x, y), m in found.maps.items() if x == c and m.width <= map_width), key=lambda m: m.width)
        options = [Strategy(FUNCTIONAL, m.y, m, parts) for m in tight] + [Strategy(CONDITIONAL, b, None, parts) for b in columns if b != c and found.empty.get((c, b), 0) > empty_share]
        for s in options:
            if (changed := out.with_dim(c, s)).valid():
                out = changed
                used.add(s.other)
                break
    return out


def plain_skeleton(columns: Sequence[str], parts: int = 2) -> Skeleton:
    """Every dimension with buckets of its own: a start for ``optimise`` that knows nothing of correlations."""
    return Skeleton({c: Strategy(parts=parts) for c in columns})


def most_filtered(columns: Sequence[str], queries: Sequence[RangeQuery]) -> str:
    """The column that most queries constrain: rows within a cell are sorted by it. The first one in doubt."""
    return max(columns, key=lambda c: (sum(c in q.where.ranges for q in queries), -list(columns).index(c)))


@dataclass(frozen=True)
class CostModel:
    """Time of a query over a grid: a cost for each run of cells read, and one for each row and active dimension."""

    rows: int
    domains: dict[str, tuple[float, float]]
    per_run: float = 1e-6
    per_value: float = 2e-9

    def features(self, skeleton: Skeleton, query: RangeQuery) -> tuple[float, float, int]:
        """Runs, rows scanned, active dimensions."""
        active, share = skeleton.active(), 1.0
        ranges = dict(query.where.ranges)
        for m in skeleton.maps():
            if m.x in ranges:
                implied = m.implied(ranges[m.x])
                ranges[m.y] = ranges[m.y].intersect(implied) if m.y in ranges else implied
        for c in active:
            lo, hi = self.domains[c]
            r = ranges.get(c)
            if r is not None:
                a, b = max(lo, finite(r.lo, lo)), min(hi, finite(r.hi, hi))
                share *= min(1.0, (max(0.0, b - a) / (hi - lo) if hi > lo else 1.0) + 1 / skeleton.dims[c].parts)
        scanned = self.rows * share
        return scanned / max(1.0, self.rows / skeleton.cells()), scanned, len(active)

    def predict(self, skeleton: Skeleton, query: RangeQuery) -> float:
        runs, scanned, dims = self.features(skeleton, query)
        return self.per_run * runs + self.per_value * scanned * dims

    def total(self, skeleton: Skeleton, queries: Sequence[RangeQuery]) -> float:
        return sum(self.predict(skeleton, q) for q in queries) / max(1, len(queries))

    def calibrated(self, skeleton: Skeleton, queries: Sequence[RangeQuery], run: Callable[[RangeQuery], object], reps: int = 3) -> CostModel:
        """Both costs fitted to measured times by least squares, neither below zero."""
        import numpy as np

        x, y = [], []
        for q in queries:
            runs, scanned, dims = self.features(skeleton, q)
            began = time.perf_counter()
            for _ in range(reps):
                run(q)
            x.append((runs, scanned * dims))
            y.append((time.perf_counter() - began) / reps)
        w, *_ = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)
        return replace(self, per_run=max(float(w[0]), 0.0), per_value=max(float(w[1]), 1e-15))

    def error(self, skeleton: Skeleton, query: RangeQuery, seconds: float) -> float:
        return abs(self.predict(skeleton, query) - seconds) / seconds


def neighbours(skeleton: Skeleton, found: Correlations, map_width: float = 0.10, empty_share: float = 0.25) -> list[Skeleton]:
    """Skeletons that differ in one dimension's strategy."""
    out = []
    for c, s in skeleton.dims.items():
        options = [replace(s, kind=INDEPENDENT, other=None, map=None)]
        options += [Strategy(FUNCTIONAL, y, m, s.parts) for (x, y), m in found.maps.items() if x == c and m.width <= map_width]
        options += [Strategy(CONDITIONAL, b, None, s.parts) for b in skeleton.dims if b != c and found.empty.get((c, b), 0) > empty_share]
        out += [k for o in options if o != s and (k := skeleton.with_dim(c, o)).valid()]
    return out


def optimise(skeleton: Skeleton, found: Correlations, model: CostModel, queries: Sequence[RangeQuery], iterations: int = 20, step: int = 2, max_cells: int = 4096, max_parts: int = 64) -> Skeleton:
    """Descend by steps of the parts of each dimension, then by the first better strategy; stop when neither helps."""
    best, cost = skeleton, model.total(skeleton, queries)
    for k in range(iterations):
        before = cost
        for c in best.active():
            for parts in (best.dims[c].parts + step, best.dims[c].parts - step):
                if 1 <= parts <= max_parts and (changed := best.with_dim(c, replace(best.dims[c], parts=parts))).cells() <= max_cells and (now := model.total(changed, queries)) < cost:
                    best, cost = changed, now
        for changed in neighbours(best, found):
            if changed.cells() <= max_cells and (now := model.total(changed, queries)) < cost:
                best, cost = changed, now
                break
        if before - cost < 1e-4 * before and k >= 1:
            break
    return best

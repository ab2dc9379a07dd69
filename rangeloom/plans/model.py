"""Queries as values: ranges per column, aggregates, row selections, and their Spark columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QueryError(ValueError):
    """A query that cannot be answered as written."""


@dataclass(frozen=True)
class Range:
    """An interval of one column; None is unbounded, and each end may be open."""

    lo: float | None = None
    hi: float | None = None
    lo_open: bool = False
    hi_open: bool = False

    def intersect(self, other: Range) -> Range:
        lo, lo_open = max(((r.lo, r.lo_open) for r in (self, other) if r.lo is not None), default=(None, False))
        hi, hi_open = min(((r.hi, not r.hi_open) for r in (self, other) if r.hi is not None), default=(None, True))
        return Range(lo, hi, lo_open, not hi_open)

    @property
    def empty(self) -> bool:
        return self.lo is not None and self.hi is not None and (self.lo > self.hi or self.lo == self.hi and (self.lo_open or self.hi_open))

    def column(self, name: str) -> Column:
        col, out = F.col(f"`{name}`"), F.lit(True)
        if self.lo is not None:
            out = col > self.lo if self.lo_open else col >= self.lo
        if self.hi is not None:
            upper = col < self.hi if self.hi_open else col <= self.hi
            out = upper if self.lo is None else out & upper
        return out

    def contains(self, value: float) -> bool:
        return (self.lo is None or value > self.lo or value == self.lo and not self.lo_open) and (self.hi is None or value < self.hi or value == self.hi and not self.hi_open)


AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Aggregate:
    """One aggregate; no column means all rows, which only COUNT takes."""

    fn: str
    column: str | None = None

    def __post_init__(self):
        if self.fn not in AGGREGATES:
            raise QueryError(f"unknown aggregate {self.fn!r}; known: {', '.join(AGGREGATES)}")
        if self.column is None and self.fn != "count":
            raise QueryError(f"{self.fn.upper()} needs a column")

    @property
    def name(self) -> str:
        return f"{self.fn}_{self.column or 'all'}"

    def over(self) -> Column:
        # rows with nulls are cleaned away at loading, so COUNT(x) counts rows
        return F.count(F.lit(1)) if self.fn == "count" else getattr(F, self.fn)(F.col(f"`{self.column}`"))


@dataclass(frozen=True)
class Selection:
    """A conjunction of ranges and of values to leave out."""

    ranges: dict[str, Range] = field(default_factory=dict)
    unequal: tuple[tuple[str, float], ...] = ()

    def narrowed(self, column: str, to: Range) -> Selection:
        return replace(self, ranges=self.ranges | {column: self.ranges.get(column, Range()).intersect(to)})

    @property
    def empty(self) -> bool:
        return any(r.empty for r in self.ranges.values())

    def predicate(self) -> Column:
        if self.empty:
            return F.lit(False)
        out = None
        for one in [r.column(c) for c, r in self.ranges.items()] + [F.col(f"`{c}`") != v for c, v in self.unequal]:
            out = one if out is None else out & one
        return F.lit(True) if out is None else out

    def matches(self, row: dict[str, float]) -> bool:
        return all(r.contains(row[c]) for c, r in self.ranges.items()) and all(row[c] != v for c, v in self.unequal)


@dataclass(frozen=True)
class RangeQuery:
    """SELECT aggregates WHERE selection."""

    aggregates: tuple[Aggregate, ...] = (Aggregate("count"),)
    where: Selection = field(default_factory=Selection)
    label: str = ""


@dataclass(frozen=True)
class RowQuery:
    """SELECT columns WHERE selection ORDER BY one column LIMIT n; no columns means all."""

    columns: tuple[str, ...] = ()
    where: Selection = field(default_factory=Selection)
    order_by: str | None = None
    descending: bool = False
    limit: int | None = 50


def bounds_of(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each column, in one pass (from file footers where the source allows)."""
    row = df.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo{k}"], row[f"hi{k}"]) for k, c in enumerate(columns)}


def finite(value: float | None, default: float) -> float:
    return default if value is None or math.isinf(value) else value

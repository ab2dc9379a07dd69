"""The plain way to answer a query: filter and aggregate, or filter, sort and cut. It defines every other answer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.plans.model import Aggregate, QueryError, RangeQuery, RowQuery


def aggregate(df: DataFrame, query: RangeQuery) -> DataFrame:
    """One row: each aggregate and n_matched. Of no rows, COUNT is 0 and the others are null."""
    return df.filter(query.where.predicate()).agg(*[a.over().alias(a.name) for a in query.aggregates], F.count(F.lit(1)).alias("n_matched"))


def compat_zero(answer: DataFrame) -> DataFrame:
    """Nulls of empty aggregates as 0.0."""
    return answer.na.fill(0.0)


def rows(df: DataFrame, query: RowQuery, tiebreak: Iterable[str] = ()) -> DataFrame:
    """Selected rows; sorting and cutting run as one top-k. ``tiebreak`` columns make equal rows' order certain."""
    out = df.filter(query.where.predicate())
    if query.order_by:
        key = F.col(f"`{query.order_by}`")
        out = out.orderBy(key.desc() if query.descending else key.asc(), *tiebreak)
    if query.limit is not None:
        out = out.limit(query.limit)
    return out.select(*[F.col(f"`{c}`") for c in query.columns]) if query.columns else out


def total_matched(df: DataFrame, query: RowQuery) -> DataFrame:
    return df.filter(query.where.predicate()).agg(F.count(F.lit(1)).alias("n_matched"))


def partials(columns: Iterable[str]) -> list[Column]:
    """What merges: rows, and each column's sum, least and greatest value."""
    return [F.count(F.lit(1)).alias("n"), *[f for c in columns for f in (F.sum(c).alias(f"sum_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]]


def merged(parts: DataFrame, aggregates: Iterable[Aggregate]) -> DataFrame:
    """The answer from rows of partials; an average is the sum of sums over the sum of rows."""
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    forms = {
        "count": lambda c: n,
        "sum": lambda c: F.sum(f"sum_{c}"),
        "avg": lambda c: F.sum(f"sum_{c}") / F.when(F.sum("n") != 0, F.sum("n")),
        "min": lambda c: F.min(f"min_{c}"),
        "max": lambda c: F.max(f"max_{c}"),
    }
    return parts.agg(*[forms[a.fn](a.column).alias(a.name) for a in aggregates], n.alias("n_matched"))


def group_by_region(df: DataFrame, regions: DataFrame, latitude: str, longitude: str, query: RangeQuery) -> DataFrame:
    """The aggregates of many named boxes at once: regions (name, lat_lo, lat_hi, lon_lo, lon_hi), at most 10,000 of them.

    An extension: a range join, broadcast because the table of regions is small by contract, which is checked.
    """
    if regions.limit(10_001).count() > 10_000:
        raise QueryError("too many regions to send to every task")
    inside = F.col(latitude).between(F.col("lat_lo"), F.col("lat_hi")) & F.col(longitude).between(F.col("lon_lo"), F.col("lon_hi"))
    return df.filter(query.where.predicate()).join(F.broadcast(regions), inside).groupBy("name").agg(*[a.over().alias(a.name) for a in query.aggregates])

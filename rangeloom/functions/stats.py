"""Statistics as DataFrame expressions: equi-depth bounds, bucket ids, linear maps between columns, cell occupancy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.plans.model import Range


def equi_depth(column: str, parts: int, exact: bool = True, accuracy: int = 10_000) -> Column:
    """Aggregate: the parts + 1 quantiles that cut a column into equally full buckets. Inexact ones need less memory."""
    at = [k / parts for k in range(parts + 1)]
    return F.percentile(column, at) if exact else F.percentile_approx(F.col(column), at, accuracy)


def equi_depth_bounds(df: DataFrame, columns: list[str], parts: int, exact: bool = True) -> DataFrame:
    """column, k, bound: the quantiles of all columns in one pass."""
    row = df.agg(*[equi_depth(c, parts, exact).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bounds")) for c in columns]))
    return row.select(each.alias("r")).select("r.column", F.posexplode("r.bounds").alias("k", "bound"))


def bucket(value: Column, bounds: list[float] | Column) -> Column:
    """Index of the bucket (b_i, b_i+1] that holds a value: the number of inner bounds below it. Arrays may be columns."""
    if isinstance(bounds, list):
        inner = [F.when(value > F.lit(float(b)), 1).otherwise(0) for b in bounds[1:-1]]
        return sum(inner[1:], inner[0]).cast("int") if inner else F.lit(0)
    inner = F.slice(bounds, F.lit(2), F.greatest(F.size(bounds) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda b: value > b))


def conditional_bounds(df: DataFrame, column: str, base: str, base_bounds: list[float], parts: int, exact: bool = True) -> DataFrame:
    """base_bucket, bounds: the quantiles of a column inside each bucket of another one."""
    return df.groupBy(bucket(F.col(base), base_bounds).alias("base_bucket")).agg(equi_depth(column, parts, exact).alias("bounds"))


@dataclass(frozen=True)
class LinearMap:
    """x = slope * y + intercept, off by ``below`` at most on one side and ``above`` on the other; width is their sum's share."""

    x: str
    y: str
    slope: float
    intercept: float
    below: float
    above: float
    width: float

    def implied(self, x_range: Range) -> Range:
        """The range of y in which all rows with x in the given range lie."""
        if abs(self.slope) < 1e-12:
            return Range()
        lo = None if x_range.lo is None else (x_range.lo - self.above - self.intercept) / self.slope
        hi = None if x_range.hi is None else (x_range.hi + self.below - self.intercept) / self.slope
        lo, hi = (lo, hi) if self.slope > 0 else (hi, lo)
        # room for rounding of the residuals, which are exact extremes of computed values
        pad = 1e-9 * (1 + max(abs(v) for v in (lo or 0.0, hi or 0.0)))
        return Range(None if lo is None else lo - pad, None if hi is None else hi + pad)

    def forward(self, y_range: Range) -> Range:
        """The range of x in which all rows with y in the given range lie."""
        lo, hi = (y_range.lo, y_range.hi) if self.slope >= 0 else (y_range.hi, y_range.lo)
        lo = None if lo is None else self.slope * lo + self.intercept - self.below
        hi = None if hi is None else self.slope * hi + self.intercept + self.above
        pad = 1e-9 * (1 + max(abs(v) for v in (lo or 0.0, hi or 0.0)))
        return Range(None if lo is None else lo - pad, None if hi is None else hi + pad)


def linear_maps(df: DataFrame, pairs: list[tuple[str, str]], divide_by: str = "x") -> list[LinearMap]:
    """Least-squares maps of many pairs (x, y): one pass fits all, one more finds their extreme residuals.

    ``divide_by``: whose range makes the width a share; "x" has the units of the residuals, "y" is the published formula.
    """
    if not pairs:
        return []
    columns = sorted({c for p in pairs for c in p})
    fits = [f for k, (x, y) in enumerate(pairs) for f in (F.regr_slope(x, y).alias(f"s{k}"), F.regr_intercept(x, y).alias(f"i{k}"))]
    ends = [f for c in columns for f in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    one = df.agg(F.count(F.lit(1)).alias("n"), *fits, *ends).first()
    usable = [(k, x, y) for k, (x, y) in enumerate(pairs) if one["n"] >= 4 and one[f"s{k}"] is not None]
    if not usable:
        return []
    rest = {k: F.col(x) - (F.lit(one[f"s{k}"]) * F.col(y) + F.lit(one[f"i{k}"])) for k, x, y in usable}
    two = df.agg(*[f for k, r in rest.items() for f in (F.min(r).alias(f"b{k}"), F.max(r).alias(f"a{k}"))]).first()
    out = []
    for k, x, y in usable:
        below, above = max(0.0, -two[f"b{k}"]), max(0.0, two[f"a{k}"])
        span = (one[f"hi_{x}"] - one[f"lo_{x}"]) if divide_by == "x" else (one[f"hi_{y}"] - one[f"lo_{y}"])
        out.append(LinearMap(x, y, one[f"s{k}"], one[f"i{k}"], below, above, (below + above) / span if span else float("inf")))
    return out


def functional_fit(df: DataFrame, x: str, y: str, divide_by: str = "x") -> DataFrame:
    """x, y, slope, intercept, below, above, width of one map, as a DataFrame (two passes, no driver)."""
    fit = df.agg(F.regr_slope(x, y).alias("slope"), F.regr_intercept(x, y).alias("intercept"), (F.max(x) - F.min(x)).alias("span_x"), (F.max(y) - F.min(y)).alias("span_y"))
    rest = F.col(x) - (F.col("slope") * F.col(y) + F.col("intercept"))
    both = df.select(x, y).crossJoin(F.broadcast(fit))  # one row
    out = both.groupBy("slope", "intercept", "span_x", "span_y").agg(F.greatest(F.lit(0.0), -F.min(rest)).alias("below"), F.greatest(F.lit(0.0), F.max(rest)).alias("above"))
    return out.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "slope", "intercept", "below", "above", ((F.col("below") + F.col("above")) / F.col(f"span_{divide_by}")).alias("width"))


def empty_cell_fraction(df: DataFrame, pairs: list[tuple[str, str]], bounds: dict[str, list[float]], parts: int) -> dict[tuple[str, str], float]:
    """For each pair of columns, the share of the parts x parts quantile cells without a row; one pass for all pairs."""
    ids = {c: bucket(F.col(c), bounds[c]) for p in pairs for c in p}
    row = df.agg(*[F.count_distinct(ids[a] * parts + ids[b]).alias(str(k)) for k, (a, b) in enumerate(pairs)]).first()
    return {p: 1 - row[str(k)] / parts**2 for k, p in enumerate(pairs)}

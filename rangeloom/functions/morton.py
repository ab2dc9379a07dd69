"""Z-order codes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeloom.plans.model import Range


def bits_for(dims: int) -> int:
    """Bits of each dimension, so that a code fits a long."""
    return min(60 // dims, 10)


def level(value: Column | float, lo: float, hi: float, bits: int) -> Column:
    """The value's step among 2**bits between lo and hi; it never falls as the value rises."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    top = (1 << bits) - 1
    share = (value - lo) / (hi - lo) if hi > lo else F.lit(0.0)
    return F.least(F.greatest(F.floor(share * top), F.lit(0)), F.lit(top)).cast("long")


def interleave(levels: list[Column], bits: int) -> Column:
    """Bit b of dimension d goes to place b * dims + d."""
    dims = len(levels)
    parts = [F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1).cast("long")), b * dims + d) for b in range(bits) for d, x in enumerate(levels)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def zcode(columns: list[str], bounds: dict[str, tuple[float, float]], bits: int | None = None) -> Column:
    bits = bits or bits_for(len(columns))
    return interleave([level(F.col(f"`{c}`"), *bounds[c], bits) for c in columns], bits)


def zrange(columns: list[str], bounds: dict[str, tuple[float, float]], ranges: dict[str, Range], bits: int | None = None) -> tuple[int, int]:
    """Least and greatest code of a box: every row of the box has a code between them."""
    bits = bits or bits_for(len(columns))
    top = (1 << bits) - 1

    def step(value: float, lo: float, hi: float) -> int:
        return min(max(int((value - lo) / (hi - lo) * top // 1) if hi > lo else 0, 0), top)

    def code(values: dict[str, int]) -> int:
        return sum((values[c] >> b & 1) << b * len(columns) + d for b in range(bits) for d, c in enumerate(columns))

    low = {c: 0 if (r := ranges.get(c)) is None or r.lo is None else step(r.lo, *bounds[c]) for c in columns}
    high = {c: top if (r := ranges.get(c)) is None or r.hi is None else step(r.hi, *bounds[c]) for c in columns}
    return code(low), code(high)

"""Where results go: files, and text for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str, kind: str = "csv") -> None:
    """Results as CSV (with a header), Parquet or JSON files."""
    writer = results.write.mode("overwrite")
    {"csv": writer.option("header", True).csv, "parquet": writer.parquet, "json": writer.json}[kind](path)


def formatted(value: float | int | None) -> str:
    """A number for reading: whole ones with separators, others to four digits, nothing as NULL."""
    if value is None:
        return "NULL"
    return f"{int(value):,}" if float(value).is_integer() and abs(value) < 1e15 else f"{value:,.4f}" if abs(value) >= 1 else f"{value:.4g}"


def formatted_column(column: Column, places: int = 2) -> Column:
    return F.format_number(column, places)


def as_text(df: DataFrame, most: int = 50) -> str:
    """The first rows as an aligned table."""
    rows = [df.columns, *[[formatted(v) if isinstance(v, (int, float)) or v is None else str(v) for v in r] for r in df.limit(most).collect()]]
    wide = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    lines = ["  ".join(v.rjust(w) for v, w in zip(r, wide)) for r in rows]
    return "\n".join([lines[0], "  ".join("-" * w for w in wide), *lines[1:]])

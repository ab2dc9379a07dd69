"""Running workloads: timings of several access paths, agreement of their answers, percentiles, speed-up by region."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.operators.execute import aggregate
from rangeloom.plans.layout import Layout
from rangeloom.plans.model import RangeQuery
from rangeloom.plans.rewrite import answer, scan_metrics

RESULT = "dataset string, group string, query_no int, query string, path string, ms double, answer double, n_matched long, scan_share double, match boolean"


def timed(run: Callable[[], DataFrame], reps: int = 3) -> tuple[float, tuple]:
    """Mean milliseconds of some runs after one warm-up, and the answer's row."""
    row = tuple(run().first())
    began = time.perf_counter()
    for _ in range(reps):
        run().collect()  # one row
    return (time.perf_counter() - began) * 1000 / reps, row


def agrees(a: float | None, b: float | None, tolerance: float = 1e-4) -> bool:
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=tolerance, abs_tol=1e-9)


def run_group(layout: Layout, table: DataFrame, queries: Sequence[RangeQuery], dataset: str = "data", group: str = "A", reps: int = 3, others: dict[str, Callable[[RangeQuery], DataFrame]] | None = None) -> DataFrame:
    """A row for each query and access path: the layout, the full scan and any ``others``. No query is left out."""
    out = []
    for k, q in enumerate(queries, 1):
        paths = {"scan": lambda q=q: aggregate(table, q), "layout": lambda q=q: answer(layout, q)} | {n: (lambda q=q, f=f: f(q)) for n, f in (others or {}).items()}
        share = float(scan_metrics(layout, q).first()["scan_share"])
        wanted = None
        for name, run in paths.items():
            ms, row = timed(run, reps)
            wanted = row if wanted is None else wanted
            value = None if row[0] is None else float(row[0])
            out.append((dataset, group, k, q.label, name, ms, value, int(row[-1]), share if name == "layout" else 1.0, agrees(row[0], wanted[0])))
    return table.sparkSession.createDataFrame(out, RESULT)


def latency_percentiles(results: DataFrame) -> DataFrame:
    """path, queries, mean, p50, p95, p99 milliseconds, queries a second, and mean scanned share."""
    p = lambda x: F.percentile("ms", x)
    return results.groupBy("group", "path").agg(
        F.count(F.lit(1)).alias("queries"), F.avg("ms").alias("mean_ms"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"), p(0.99).alias("p99_ms"), (1000 * F.count(F.lit(1)) / F.sum("ms")).alias("per_second"), F.avg("scan_share").alias("scan_share")
    )


def speedups(results: DataFrame, path: str = "layout", against: str = "scan") -> DataFrame:
    """A row a query: the times of two paths and their ratio."""
    key = ["dataset", "group", "query_no", "query"]
    pick = lambda p, n: results.filter(F.col("path") == p).select(*key, F.col("ms").alias(n))
    return pick(path, "ms").join(pick(against, "against_ms"), key).withColumn("speedup", F.col("against_ms") / F.col("ms"))


def speedup_by_region(each: DataFrame, kinds: Sequence[str] = ("place", "neighbourhood", "zone")) -> DataFrame:
    """Mean and median speed-up by the region that a query's text names; '' where it names none."""
    name = F.regexp_extract("query", rf"(?i)\b(?:{'|'.join(kinds)})s?\s*=\s*'([^']*)'", 1)
    return each.groupBy("group", name.alias("region")).agg(F.count(F.lit(1)).alias("queries"), F.avg("speedup").alias("mean"), F.median("speedup").alias("median"), (F.sum("against_ms") / F.sum("ms")).alias("of_totals"))


def query_log(spark: SparkSession, queries: Sequence[RangeQuery], columns: Sequence[str]) -> DataFrame:
    """A workload as rows (query_no, column, lo, hi); unbounded ends are null."""
    rows = [(k, c, r.lo, r.hi) for k, q in enumerate(queries, 1) for c, r in q.where.ranges.items() if c in columns]
    return spark.createDataFrame(rows, "query_no int, column string, lo double, hi double")

"""Runs groups of queries over a layout built for a training workload, and reports and writes what they took."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from rangeloom.operators import batch
from rangeloom.operators.zorder import ZOrderTable
from rangeloom.session import SYNTHETIC, SYNTHETIC_ROWS, Session
from rangeloom.sources.shared import fresh_path
from rangeloom.sources.sinks import as_text, write_results
from rangeloom.sources.tables import load_numeric


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("file", nargs="?")
    parser.add_argument("-w", "--workload", required=True)
    parser.add_argument("--group-a", required=True, help="queries like the workload")
    parser.add_argument("--group-b", help="queries unlike it")
    parser.add_argument("-n", "--max-rows", type=int, help=f"rows read of a file (default: all), rows of a synthetic table (default: {SYNTHETIC_ROWS:,})")
    parser.add_argument("--dataset", choices=tuple(SYNTHETIC), default="housing")
    parser.add_argument("--csv-out")
    parser.add_argument("--reps", type=int, default=3)
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("rangeloom").getOrCreate()
    session = Session(load_numeric(spark, given.file, given.max_rows) if given.file else SYNTHETIC[given.dataset](spark, SYNTHETIC_ROWS if given.max_rows is None else given.max_rows).persist())

    def read(path: str):
        with open(path, encoding="utf-8") as f:
            return session.workload(f.readlines())[0]

    layout = session.build(read(given.workload))
    zorder = ZOrderTable.build(session.table, session.table.columns, fresh_path(spark, "zorder"))
    results = None
    for group, path in (("A", given.group_a), ("B", given.group_b)):
        if path:
            own = batch.run_group(layout, session.table, read(path), given.file or given.dataset, group, given.reps, {"zorder": zorder.query})
            results = own if results is None else results.unionByName(own)
    if given.csv_out:
        write_results(results, given.csv_out)
    each = batch.speedups(results)
    return "\n\n".join(as_text(x) for x in (batch.latency_percentiles(results), batch.speedup_by_region(each)))


if __name__ == "__main__":
    print(main())

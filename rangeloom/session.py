"""A table, its layout and the query language behind one object; and a prompt for it."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from rangeloom.operators import execute
from rangeloom.plans.dialect import parse, parse_workload
from rangeloom.plans.layout import Layout, LayoutOptions, build_layout
from rangeloom.plans.model import QueryError, RangeQuery, RowQuery, bounds_of
from rangeloom.plans.rewrite import answer, scan_metrics
from rangeloom.sources.lookups import LookupRegistry, default_registry
from rangeloom.sources.shared import fresh_path
from rangeloom.sources.sinks import as_text
from rangeloom.sources.tables import load_numeric, synthetic_forest, synthetic_housing, synthetic_trips


SYNTHETIC = {"housing": synthetic_housing, "trips": synthetic_trips, "forest": synthetic_forest}
SYNTHETIC_ROWS = 200_000


class Session:
    """Answers queries over one table: by its layout if one is built, by scanning otherwise."""

    def __init__(self, table: DataFrame, registry: LookupRegistry | None = None, bounds: str = "closed"):
        self.table, self.registry, self.bounds, self.layout = table, registry or default_registry(), bounds, None
        table.createOrReplaceTempView("data")

    def parse(self, sql: str) -> RangeQuery | RowQuery:
        return parse(sql, self.table.columns, self.registry, self.bounds)

    def build(self, workload: Sequence[RangeQuery] = (), path: str | None = None, options: LayoutOptions = LayoutOptions()) -> Layout:
        spark = self.table.sparkSession
        self.layout = build_layout(self.table, self.table.columns, list(workload), path or fresh_path(spark, "layout"), options)
        return self.layout

    def workload(self, lines: Sequence[str]) -> tuple[list[RangeQuery], list[tuple[int, str]]]:
        return parse_workload(lines, self.table.columns, self.registry, self.bounds)

    def sql(self, text: str) -> DataFrame:
        query = self.parse(text)
        if isinstance(query, RowQuery):
            return execute.rows(self.table, query)
        return answer(self.layout, query) if self.layout else execute.aggregate(self.table, query)

    def metrics(self, text: str) -> DataFrame:
        query = self.parse(text)
        if self.layout is None or isinstance(query, RowQuery):
            raise QueryError("scan metrics need a layout and an aggregate query")
        return scan_metrics(self.layout, query)

    def columns(self) -> DataFrame:
        found = bounds_of(self.table, self.table.columns)
        return self.table.sparkSession.createDataFrame([(c, float(a), float(b)) for c, (a, b) in found.items()], "column string, lo double, hi double")


HELP = "SELECT ...; columns; tables; a kind of region; workload FILE; load FILE; help; quit"


def command(session: Session, line: str) -> tuple[Session, str | None]:
    """Run one line of the prompt; returns the session to go on with, and text (None to stop)."""
    line = line.strip().rstrip(";")
    word, _, rest = line.partition(" ")
    spark = session.table.sparkSession
    try:
        if word.lower() in ("quit", "exit", "q"):
            return session, None
        if word.lower() == "help" or not line:
            return session, HELP
        if word.lower() == "columns":
            return session, as_text(session.columns())
        if word.lower() == "tables":
            return session, "data"
        if session.registry.kind(word) and not rest:
            return session, as_text(session.registry.frame(spark).filter(f"kind = '{session.registry.kind(word).kind}'").drop("kind"), 1000)
        if word.lower() == "workload":
            with open(rest.strip(), encoding="utf-8") as f:
                queries, errors = session.workload(f.readlines())
            session.build(queries)
            return session, f"{len(queries)} queries, {len(errors)} errors" + "".join(f"\n  line {k}: {e}" for k, e in errors[:5])
        if word.lower() == "load":
            fresh = Session(load_numeric(spark, rest.strip()), session.registry, session.bounds)
            fresh.build()
            return fresh, f"{fresh.layout.rows:,} rows, {len(fresh.table.columns)} columns"
        return session, as_text(session.sql(line))
    except (QueryError, OSError) as e:
        return session, f"error: {e}"


def main(args: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("file", nargs="?")
    parser.add_argument("-w", "--workload")
    parser.add_argument("-n", "--max-rows", type=int, help=f"rows read of a file (default: all), rows of a synthetic table (default: {SYNTHETIC_ROWS:,})")
    parser.add_argument("--dataset", choices=tuple(SYNTHETIC), default="housing")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("rangeloom").getOrCreate()
    session = Session(load_numeric(spark, given.file, given.max_rows) if given.file else SYNTHETIC[given.dataset](spark, SYNTHETIC_ROWS if given.max_rows is None else given.max_rows))
    text: str | None = command(session, f"workload {given.workload}")[1] if given.workload else HELP
    while text is not None:
        print(text)
        try:
            session, text = command(session, input("data> "))
        except EOFError:
            return


if __name__ == "__main__":
    main()

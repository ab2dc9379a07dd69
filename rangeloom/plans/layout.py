"""The clustered layout: regions as partitions, rows sorted by cell, and per cell a zone map with pre-aggregates.

Files: ``main`` (rows with region_id, cell_id, cell_key and _row_id), ``cells`` (a row a cell: rows, and each dimension's
least, greatest value and sum) and ``meta`` (tree, skeleton and dimensions as JSON).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.stats import bucket, equi_depth
from rangeloom.operators.execute import partials
from rangeloom.plans.model import QueryError, RangeQuery
from rangeloom.plans.skeleton import CONDITIONAL, CostModel, Skeleton, correlations, initial_skeleton, most_filtered, optimise
from rangeloom.plans.tree import Node, TreeOptions, build_tree, region_column, touching


#: Cells that the driver may hold as a zone map.
ZONE_MAP_CELLS = 200_000


@dataclass(frozen=True)
class LayoutOptions:
    """``max_cells`` bounds the cells of a region, and with the tree's ``max_regions`` the size of the zone map."""

    tree: TreeOptions = TreeOptions()
    parts: int = 4
    map_width: float = 0.10
    empty_share: float = 0.25
    iterations: int = 20
    max_cells: int = 1024


def assign_cells(df: DataFrame, tree: Node, skeleton: Skeleton) -> DataFrame:
    """Add region_id and cell_id. Bounds are quantiles of each region (and of each bucket of a base inside it)."""
    out = df.withColumn("region_id", region_column(tree).cast("int"))
    own = [c for c in skeleton.active() if skeleton.dims[c].kind != CONDITIONAL]
    inside = [c for c in skeleton.active() if skeleton.dims[c].kind == CONDITIONAL]
    # a row a region (and bucket): the number of both is bounded by the options
    first = out.groupBy("region_id").agg(*[equi_depth(c, skeleton.dims[c].parts, exact=False).alias(f"_bounds_{c}") for c in own])
    out = out.join(F.broadcast(first), "region_id")
    out = out.withColumns({f"_bucket_{c}": bucket(F.col(c), F.col(f"_bounds_{c}")) for c in own})
    for c in inside:
        base = f"_bucket_{skeleton.dims[c].other}"
        second = out.groupBy("region_id", base).agg(equi_depth(c, skeleton.dims[c].parts, exact=False).alias(f"_bounds_{c}"))
        out = out.join(F.broadcast(second), ["region_id", base]).withColumn(f"_bucket_{c}", bucket(F.col(c), F.col(f"_bounds_{c}")))
    cell = F.lit(0)
    for c in skeleton.active():
        cell = cell * skeleton.dims[c].parts + F.col(f"_bucket_{c}")
    return out.withColumn("cell_id", cell.cast("int")).select(*[F.col(f"`{c}`") for c in df.columns], "region_id", "cell_id")


def cell_key(region, cell):
    """One number for a region's cell, in the order of the files: its ranges reach the scan's own filters."""
    return region * (1 << 31) + cell


def refuse_odd(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise where a dimension holds null, NaN or an infinity: zone maps could not tell what such rows match."""
    odd = F.lit(False)
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        odd = odd | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    if not df.filter(odd).isEmpty():
        raise QueryError(f"null, NaN or infinite values in {', '.join(columns)}: clean the rows first")


def cell_table(main: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The zone map and pre-aggregates of rows with region_id and cell_id."""
    return main.groupBy("region_id", "cell_id").agg(*partials(columns))


@dataclass(frozen=True)
class Layout:
    """A written layout."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    tree: Node
    skeleton: Skeleton
    rows: int

    @cached_property
    def main(self) -> DataFrame:
        """The clustered rows. A layout's files do not change, so they are listed once."""
        return self.spark.read.parquet(f"{self.path}/main")

    @cached_property
    def cells(self) -> DataFrame:
        """The zone map and pre-aggregates."""
        return self.spark.read.parquet(f"{self.path}/cells")

    @cached_property
    def zone_map(self) -> pd.DataFrame | None:
        """The cells on the driver, or None where they are more than ZONE_MAP_CELLS: then plans read them as a table."""
        if self.cells.limit(ZONE_MAP_CELLS + 1).count() > ZONE_MAP_CELLS:
            return None
        found = self.cells.toArrow().to_pandas()
        found["cell_key"] = cell_key(found["region_id"].astype("int64"), found["cell_id"])
        return found.sort_values("cell_key", ignore_index=True)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Layout:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return Layout(spark, path, tuple(meta["columns"]), Node.from_dict(meta["tree"]), Skeleton.from_dict(meta["skeleton"]), meta["rows"])

    def describe(self) -> DataFrame:
        """region_id, box, rows, cells of each region."""
        boxes = self.spark.createDataFrame([(n.region, json.dumps(n.box)) for n in self.tree.leaves()], "region_id int, box string")
        return boxes.join(self.cells.groupBy("region_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("cells")), "region_id", "left").na.fill(0)

    def stats(self) -> DataFrame:
        """One row: rows, dims, regions, cells, rows of the smallest and largest region."""
        by = self.cells.groupBy("region_id").agg(F.sum("n").alias("r"), F.count(F.lit(1)).alias("c"))
        return by.agg(F.lit(self.rows).alias("rows"), F.lit(len(self.columns)).alias("dims"), F.count(F.lit(1)).alias("regions"), F.sum("c").alias("cells"), F.min("r").alias("least_rows"), F.max("r").alias("most_rows"))


def choose_skeleton(df: DataFrame, columns: Sequence[str], queries: Sequence[RangeQuery], domains: dict[str, tuple[float, float]], rows: int, options: LayoutOptions) -> Skeleton:
    # over all rows at every size: maps prune rows, so their residuals must hold for every one
    found = correlations(df, columns, exact=False)
    parts = options.parts
    while parts > 1 and parts ** len(columns) > options.max_cells:
        parts -= 1
    start = initial_skeleton(columns, found, parts, options.map_width, options.empty_share)
    if not queries:
        return start
    return optimise(start, found, CostModel(rows, domains), queries, options.iterations, max_cells=options.max_cells)


def sort_columns(tree: Node, columns: Sequence[str], queries: Sequence[RangeQuery]) -> dict[int, str]:
    """Each region's column to sort a cell's rows by: the one that most of the queries that meet its box constrain."""
    return {leaf.region: most_filtered(columns, touching(queries, leaf.box) or queries) for leaf in tree.leaves()}


def sort_value(chosen: dict[int, str]):
    """The value of a row that its region is sorted by."""
    out = None
    for c in sorted(set(chosen.values())):
        mine = F.col("region_id").isin([r for r, own in chosen.items() if own == c])
        value = F.col(f"`{c}`").cast("double")
        out = F.when(mine, value) if out is None else out.when(mine, value)
    return out


def build_layout(df: DataFrame, columns: Sequence[str], queries: Sequence[RangeQuery], path: str, options: LayoutOptions = LayoutOptions()) -> Layout:
    """Write a clustered copy of df for a sample workload. Rows with a null, NaN or infinite dimension are refused."""
    columns = tuple(columns)
    if not columns:
        raise QueryError("a layout needs a dimension")
    refuse_odd(df, columns)
    tree = build_tree(df, columns, queries, options.tree)
    skeleton = choose_skeleton(df, columns, queries, tree.box, tree.rows, options)
    placed = assign_cells(df.withColumn("_row_id", F.monotonically_increasing_id().cast("string")), tree, skeleton)
    placed = placed.withColumn("cell_key", cell_key(F.col("region_id").cast("long"), F.col("cell_id")))
    # a range shuffle splits large regions over tasks and keeps each region's cells in order
    placed.repartitionByRange("cell_key").sortWithinPartitions("cell_key", sort_value(sort_columns(tree, columns, queries))).write.mode("overwrite").partitionBy("region_id").parquet(f"{path}/main")
    spark = df.sparkSession
    cell_table(spark.read.parquet(f"{path}/main"), columns).write.mode("overwrite").parquet(f"{path}/cells")
    meta = json.dumps({"columns": columns, "tree": tree.to_dict(), "skeleton": skeleton.to_dict(), "rows": tree.rows})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return Layout(spark, path, columns, tree, skeleton, tree.rows)

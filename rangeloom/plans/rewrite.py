"""Exact rewriting of range queries over a layout: prune regions, answer whole cells from sums, filter the rest."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.operators.execute import merged, partials
from rangeloom.plans.layout import Layout, cell_key
from rangeloom.plans.model import Range, RangeQuery, Selection


def tightened(layout: Layout, where: Selection) -> Selection:
    """Add the ranges that linear maps imply; they hold for every row of the layout."""
    for m in layout.skeleton.maps():
        if m.x in where.ranges:
            where = where.narrowed(m.y, m.implied(where.ranges[m.x]))
        if m.y in where.ranges:
            where = where.narrowed(m.x, m.forward(where.ranges[m.y]))
    return where


def overlaps(column: str, r: Range) -> Column:
    out = F.lit(True)
    if r.lo is not None:
        out = out & (F.col(f"max_{column}") > r.lo if r.lo_open else F.col(f"max_{column}") >= r.lo)
    if r.hi is not None:
        out = out & (F.col(f"min_{column}") < r.hi if r.hi_open else F.col(f"min_{column}") <= r.hi)
    return out


def inside(column: str, r: Range) -> Column:
    out = F.lit(True)
    if r.lo is not None:
        out = out & (F.col(f"min_{column}") > r.lo if r.lo_open else F.col(f"min_{column}") >= r.lo)
    if r.hi is not None:
        out = out & (F.col(f"max_{column}") < r.hi if r.hi_open else F.col(f"max_{column}") <= r.hi)
    return out


@dataclass(frozen=True)
class CellSplit:
    """Cells of a query: wholly inside, and on the boundary."""

    interior: DataFrame
    boundary: DataFrame


def split_cells(layout: Layout, where: Selection, dirty: DataFrame | None = None) -> CellSplit:
    """``dirty`` cells (region_id, cell_id) have lost rows: their sums do not hold, so they count as boundary."""
    hit, whole = F.lit(not where.empty), F.lit(True)
    for c, r in where.ranges.items():
        hit, whole = hit & overlaps(c, r), whole & inside(c, r)
    for c, v in where.unequal:
        whole = whole & ((F.col(f"min_{c}") > v) | (F.col(f"max_{c}") < v))
    cells = layout.cells.filter(hit)
    if dirty is not None:
        cells = cells.join(dirty.select("region_id", "cell_id").distinct().withColumn("_dirty", F.lit(True)), ["region_id", "cell_id"], "left")
        whole = whole & F.col("_dirty").isNull()
    return CellSplit(cells.filter(whole), cells.filter(~whole))


def boundary_rows(layout: Layout, where: Selection, cells: CellSplit, extra: list[str] | None = None) -> DataFrame:
    """Rows of boundary cells that match. Region ids (a bounded number) become a partition filter."""
    found = cells.boundary.groupBy("region_id").count().collect()
    pruned = layout.main.filter(F.col("region_id").isin([r["region_id"] for r in found])).filter(where.predicate())
    return pruned.join(cells.boundary.select("region_id", "cell_id"), ["region_id", "cell_id"], "left_semi")


#: Ranges of cells that a plan lists.
LISTED_RANGES = 48


def cell_ranges(keys: np.ndarray, rows: np.ndarray, kind: np.ndarray, most: int = LISTED_RANGES) -> tuple[list[tuple[int, int]], np.ndarray]:
    """At most ``most`` closed ranges of keys (ascending) that hold every boundary cell, and the cells that they hold.

    ``kind`` is 0 for cells without a match, 1 for boundary cells, 2 for cells wholly inside. Cells without a match may
    lie in a range, since the filter drops their rows; of those wholly inside, the gaps with the fewest rows are scanned
    instead of answered from sums where there would be more ranges.
    """
    edge = np.flatnonzero(kind == 1)
    if not len(edge):
        return [], np.zeros(len(keys), bool)
    inside = np.concatenate([[0], np.cumsum(np.where(kind == 2, rows, 0))])
    gaps = inside[edge[1:]] - inside[edge[:-1] + 1]  # rows of whole cells between neighbours
    cut = np.zeros(len(gaps), bool)
    wide = np.argsort(-gaps, kind="stable")[: most - 1]
    cut[wide[gaps[wide] > 0]] = True
    first, last = edge[np.r_[True, cut]], edge[np.r_[cut, True]]
    held = np.zeros(len(keys), bool)
    for a, b in zip(first, last):
        held[a : b + 1] = True
    return [(int(keys[a]), int(keys[b])) for a, b in zip(first, last)], held


def _masks(zone_map: pd.DataFrame, where: Selection) -> tuple[pd.Series, pd.Series]:
    """Which cells a selection touches, and which lie inside it wholly."""
    hit = pd.Series(not where.empty, zone_map.index)
    whole = hit.copy()
    for c, r in where.ranges.items():
        lo, hi = zone_map[f"min_{c}"], zone_map[f"max_{c}"]
        if r.lo is not None:
            hit &= hi > r.lo if r.lo_open else hi >= r.lo
            whole &= lo > r.lo if r.lo_open else lo >= r.lo
        if r.hi is not None:
            hit &= lo < r.hi if r.hi_open else lo <= r.hi
            whole &= hi < r.hi if r.hi_open else hi <= r.hi
    for c, v in where.unequal:
        whole &= (zone_map[f"min_{c}"] > v) | (zone_map[f"max_{c}"] < v)
    return hit, hit & whole


def _from_zone_map(layout: Layout, where: Selection, columns: list[str]) -> list[DataFrame] | None:
    """Partials of a clean layout planned on the driver: whole cells as one row of constants, the others as one scan.

    None where the zone map is too large for that. The scan's filters are ranges of the stored cell key.
    """
    zone_map = layout.zone_map
    if zone_map is None:
        return None
    hit, whole = _masks(zone_map, where)
    ranges, held = cell_ranges(zone_map["cell_key"].to_numpy(), zone_map["n"].to_numpy(), np.where(whole, 2, np.where(hit, 1, 0)))
    sure = zone_map[whole & ~held]
    number = lambda v: f"CAST('{float(v)!r}' AS DOUBLE)"
    known = {f"{f}_{c}": number(getattr(sure[f"{f}_{c}"], f)()) for c in columns for f in ("sum", "min", "max")} if len(sure) else {}
    if not ranges and known:
        return [layout.spark.range(1, numPartitions=1).selectExpr(f"CAST({int(sure['n'].sum())} AS BIGINT) AS n", *[f"{v} AS `{k}`" for k, v in known.items()])]
    # one expression each, since a plan built of many small ones takes longer to build than to run
    regions = ", ".join(map(str, sorted(set(zone_map["region_id"][held & hit].tolist())))) or "NULL"
    listed = " OR ".join(f"cell_key BETWEEN {a} AND {b}" for a, b in ranges) or "false"
    found = layout.main.filter(f"region_id IN ({regions}) AND ({listed})").filter(where.predicate()).agg(*partials(columns))
    if known:
        both = {"sum": "coalesce(`{0}`, 0D) + {1} AS `{0}`", "min": "least(`{0}`, {1}) AS `{0}`", "max": "greatest(`{0}`, {1}) AS `{0}`"}
        found = found.selectExpr(f"n + {int(sure['n'].sum())} AS n", *[both[k[:3]].format(k, v) for k, v in known.items()])
    return [found]


def answer(layout: Layout, query: RangeQuery, tombstones: DataFrame | None = None, delta: DataFrame | None = None) -> DataFrame:
    """One row: each aggregate and n_matched, equal to filtering and aggregating the live rows."""
    columns = sorted({a.column for a in query.aggregates if a.column})
    where = tightened(layout, query.where)
    parts = _from_zone_map(layout, where, columns) if tombstones is None else None
    if parts is None:
        cells = split_cells(layout, where, tombstones)
        rows = boundary_rows(layout, where, cells)
        if tombstones is not None:
            rows = rows.join(tombstones.select("_row_id"), "_row_id", "left_anti")
        keep = ["n", *[f"{f}_{c}" for c in columns for f in ("sum", "min", "max")]]
        parts = [cells.interior.select(*keep), rows.agg(*partials(columns))]
    if delta is not None:
        # the maps were fitted without these rows
        parts.append(delta.filter(query.where.predicate()).agg(*partials(columns)))
    return merged(reduce(DataFrame.unionByName, parts), query.aggregates)


def scan_metrics(layout: Layout, query: RangeQuery) -> DataFrame:
    """One row: cells and regions touched, rows answered from sums, rows scanned, and the scanned share."""
    cells = split_cells(layout, tightened(layout, query.where))
    both = cells.interior.select("n", "region_id", F.lit(0).alias("scan")).unionByName(cells.boundary.select("n", "region_id", F.lit(1).alias("scan")))
    scanned = F.coalesce(F.sum(F.col("n") * F.col("scan")), F.lit(0))
    return both.agg(
        F.count_distinct("region_id").alias("n_regions"),
        F.count(F.lit(1)).alias("n_cells"),
        F.coalesce(F.sum(F.col("n") * (1 - F.col("scan"))), F.lit(0)).alias("n_from_sums"),
        scanned.alias("n_scanned"),
        (scanned / layout.rows).alias("scan_share"),
    )


def row_ids(layout: Layout, query: RangeQuery) -> DataFrame:
    """_row_id of each matching row."""
    where = tightened(layout, query.where)
    touched = split_cells(layout, where)
    found = touched.interior.unionByName(touched.boundary).groupBy("region_id").count().collect()  # a row a region
    return layout.main.filter(F.col("region_id").isin([r["region_id"] for r in found])).filter(where.predicate()).select("_row_id")

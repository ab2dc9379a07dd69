"""Region trees: half-open boxes cut where the workload is skewed; rows are counted with one Spark job a level."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.workload import best_cuts, query_histogram, query_types, spans_of
from rangeloom.plans.model import RangeQuery, bounds_of


@dataclass
class Node:
    """A box; inner nodes are cut along one column into children [b_k, b_k+1), open at both outer ends."""

    box: dict[str, tuple[float, float]]
    column: str | None = None
    cuts: list[float] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    region: int = -1
    rows: int = 0

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children), default=-1)

    def to_dict(self) -> dict:
        return {"box": self.box, "column": self.column, "cuts": self.cuts, "region": self.region, "rows": self.rows, "children": [c.to_dict() for c in self.children]}

    @staticmethod
    def from_dict(d: dict) -> Node:
        return Node({k: tuple(v) for k, v in d["box"].items()}, d["column"], d["cuts"], [Node.from_dict(c) for c in d["children"]], d["region"], d["rows"])

    def json(self) -> str:
        return json.dumps(self.to_dict())


@dataclass(frozen=True)
class TreeOptions:
    max_depth: int = 6
    bins: int = 128
    min_reduction: float = 0.05
    min_rows: float = 0.01
    min_queries: float = 0.01
    max_regions: int = 4096


def region_column(node: Node) -> Column:
    """The region id of a row. Outer regions take whatever lies beyond their edge, so every row has one."""
    if not node.children:
        return F.lit(node.region)
    out, col = None, F.col(f"`{node.column}`")
    for cut, child in zip(node.cuts, node.children):
        out = F.when(col < cut, region_column(child)) if out is None else out.when(col < cut, region_column(child))
    return out.otherwise(region_column(node.children[-1]))


def touching(queries: Sequence[RangeQuery], box: dict[str, tuple[float, float]]) -> list[RangeQuery]:
    """The queries that meet a box."""
    def meets(q: RangeQuery) -> bool:
        return all((r.lo is None or r.lo <= box[c][1]) and (r.hi is None or r.hi >= box[c][0]) for c, r in q.where.ranges.items() if c in box)

    return [q for q in queries if meets(q)]


def _best_split(node: Node, queries: Sequence[RangeQuery], columns: Sequence[str], options: TreeOptions) -> tuple[str, list[float]] | None:
    """The column, and the cuts of its most skewed type of queries, with the largest reduction summed over the types."""
    kinds = query_types(queries, columns)
    best: tuple[float, str, list[float]] | None = None
    for c in columns:
        lo, hi = node.box[c]
        if not hi > lo:
            continue
        total, top, cuts = 0.0, 0.0, []
        for kind in kinds:
            found, gain = best_cuts(query_histogram(spans_of([queries[k] for k in kind], c, lo, hi), lo, hi, options.bins))
            total += gain
            if found and gain > top:
                top, cuts = gain, found
        if cuts and (best is None or total > best[0]):
            best = (total, c, [lo + (hi - lo) * b / options.bins for b in cuts])
    return (best[1], best[2]) if best and best[0] >= options.min_reduction * len(queries) else None


def build_tree(df: DataFrame, columns: Sequence[str], queries: Sequence[RangeQuery], options: TreeOptions = TreeOptions()) -> Node:
    """Cut the table's box until depth, rows, queries or the skew's reduction run out; no workload gives one region."""
    columns = list(columns)
    root = Node(bounds_of(df, columns))
    root.rows = total = df.count()
    frontier = [(root, list(queries))]
    leaves = 1
    for _ in range(options.max_depth):
        split = []
        for node, own in frontier:
            if node.rows < 2 * options.min_rows * total or len(own) < max(1, options.min_queries * len(queries)):
                continue
            found = _best_split(node, own, columns, options)
            if found and leaves + len(found[1]) <= options.max_regions:
                node.column, node.cuts = found
                edges = [node.box[node.column][0], *node.cuts, node.box[node.column][1]]
                node.children = [Node(node.box | {node.column: (a, b)}) for a, b in zip(edges, edges[1:])]
                leaves += len(found[1])
                split.append((node, own))
        if not split:
            break
        for k, leaf in enumerate(root.leaves()):
            leaf.region = k
        counts = {r["region"]: r["count"] for r in df.groupBy(region_column(root).alias("region")).count().collect()}  # a row a region
        for leaf in root.leaves():
            leaf.rows = counts.get(leaf.region, 0)
        frontier = []
        for node, own in split:
            if any(c.rows < options.min_rows * total for c in node.children) and min(c.rows for c in node.children) == 0:
                _merge_empty(node)
            frontier += [(c, touching(own, c.box)) for c in node.children]
    for k, leaf in enumerate(root.leaves()):
        leaf.region = k
    return root


def _merge_empty(node: Node) -> None:
    """Join children without rows to a neighbour."""
    k = 0
    while len(node.children) > 1 and k < len(node.children):
        if node.children[k].rows:
            k += 1
            continue
        j = k - 1 if k else 1
        a, b = sorted((j, k))
        lo, hi = node.children[a].box[node.column][0], node.children[b].box[node.column][1]
        kept = Node(node.box | {node.column: (lo, hi)}, rows=node.children[a].rows + node.children[b].rows)
        node.children[a : b + 1] = [kept]
        del node.cuts[a]
        k = max(0, a)
    if len(node.children) == 1:
        node.children, node.cuts, node.column = [], [], None

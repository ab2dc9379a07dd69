"""Exact threshold pairs of embeddings by dual traversal of cover trees.

A cover tree nests levels of centres with halving radii: every point lies within its centre's radius, and a centre is
its own child. Two nodes are compared by the distance of their centres and their covering radii: too far apart, they
hold no pair; close enough, every pair links and they are counted as a whole; otherwise their children are compared, in
matrix blocks. Distances are angles, for which the triangle inequality holds.

Vectors of one label are compared only with each other. Labels with many vectors are dealt by the top level of such a
tree: a bounded number of pivots (a net of a sample, broadcast), each with a core of the points within a quarter of the
threshold angle and a shell of the others that are nearest to it. All points of a core link with each other, and a point
that reaches a whole core links with all of it: both are counted without a pair or a copy, so that a dense ball of near
copies costs one row a point. Where the bounds decide nothing, a point is sent to the lower cell that it may have a link
into; cells with very many vectors are dealt into parts that meet pairwise. Equal vectors of a label are one point with a
weight. A task returns one row per linked point: its weight of links and a spanning link, never its pairs.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing, nor does
one whose label is null. Vectors of different lengths do not link. A null id takes no part and returns with nulls. Rows
of the same id are separate vectors (each counts its own links) of one vertex (they have one component). A cosine within
1e-12 of the threshold is computed again from correctly rounded sums. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import written
from rangeloom.llm.components import components
from rangeloom.llm.topk import usable

#: Points of a cell, pivots in all, points of a part, points of a leaf, and centres compared in one matrix block.
CELL, PIVOTS, PART, LEAF, TILE = 8192, 32_768, 32_768, 24, 1024
#: Slack of angles, and of cosines at the threshold; rows whose distances to all pivots are computed at once.
SLACK, EDGE, ROWS = 1e-7, 1e-12, 256


class Node:
    """Points of a tree (indices), their centre, its covering radius and children."""

    __slots__ = ("points", "centre", "radius", "children", "vectors", "radii")

    def __init__(self, points: np.ndarray, centre: int, radius: float):
        self.points, self.centre, self.radius = points, centre, radius
        self.children: list[Node] | None = None
        self.vectors = self.radii = None


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """From correctly rounded sums of products of double precision."""
    dot = lambda a, b: fsum((a * b).tolist())
    return dot(x, y) / sqrt(dot(x, x) * dot(y, y))


class Tree:
    """A cover tree over vectors, split on demand."""

    def __init__(self, raw: np.ndarray, unit: np.ndarray, points: np.ndarray):
        self.raw, self.unit = raw, unit
        self.root = None
        if len(points):
            away = angles(unit[points], unit[points[:1]])[:, 0]
            self.root = Node(points, int(points[0]), float(away.max()))

    def children(self, node: Node) -> list[Node]:
        """Centres at least half the radius apart that cover the node's points; the node's own centre comes first."""
        if node.children is None:
            half = node.radius / 2
            rest = np.r_[node.centre, node.points[node.points != node.centre]]
            node.children = []
            while len(rest):
                # a batch of uncovered points is thinned to centres, which then cover the rest
                batch = rest[:256]
                near = self.unit[batch] @ self.unit[batch].T >= np.cos(half)
                chosen: list[int] = []
                taken = np.zeros(len(batch), bool)
                for k in range(len(batch)):
                    if not taken[k]:
                        chosen.append(k)
                        taken |= near[k]
                centres = batch[chosen]
                cosine = self.unit[rest] @ self.unit[centres].T
                owner = cosine.argmax(1)
                # a centre owns itself even if an equal vector comes first
                owner[chosen] = np.arange(len(chosen))
                closest = cosine[np.arange(len(rest)), owner]
                covered = closest >= np.cos(half)
                covered[chosen] = True
                order = np.argsort(owner[covered], kind="stable")
                own, who, close = rest[covered][order], owner[covered][order], closest[covered][order]
                cuts = np.searchsorted(who, np.arange(len(centres) + 1))
                for k, c in enumerate(centres):
                    a, b = cuts[k], cuts[k + 1]
                    radius = float(np.arccos(np.clip(close[a:b].min(), -1, 1))) if b - a > 1 else 0.0
                    node.children.append(Node(own[a:b], int(c), radius))
                rest = rest[~covered]
            node.children.sort(key=lambda c: c.radius > 0)
            node.vectors = self.unit[[c.centre for c in node.children]]
            node.radii = np.array([c.radius for c in node.children])
        return node.children


def linking(tree: Tree, found: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which of the found cosines of points a and b (of one shape with them) reach the threshold."""
    good = found >= least
    for at in zip(*np.nonzero(np.abs(found - least) <= EDGE)):
        good[at] = cosine(tree.raw[a[at]], tree.raw[b[at]]) >= least
    return good


class Links:
    """Weight of links of each point, and a forest that spans them."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count, self.parent = weights, np.zeros(len(weights), "int64"), np.arange(len(weights))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(int(x)), self.find(int(y))
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def whole(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every point of a links with every point of b."""
        self.count[a] += self.weights[b].sum()
        self.count[b] += self.weights[a].sum()
        for x in a[1:]:
            self.join(a[0], x)
        for y in b:
            self.join(a[0], y)

    def within(self, a: np.ndarray) -> None:
        """All points of a link with each other."""
        self.count[a] += self.weights[a].sum() - self.weights[a]
        for x in a[1:]:
            self.join(a[0], x)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.weights[b])
        np.add.at(self.count, b, self.weights[a])
        for x, y in zip(a, b):
            self.join(x, y)


def traverse(left: Tree, right: Tree, least: float, links: Links) -> None:
    """Record all pairs with cosine of ``least`` or more between two trees, or within one if both are the same."""
    if left.root is None or right.root is None:
        return
    unit, theta, same = left.unit, float(np.arccos(least)), left is right
    away = float(angles(unit[[left.root.centre]], unit[[right.root.centre]])[0, 0])
    stack: list[tuple[Node, Node, float]] = [(left.root, right.root, away)]
    while stack:
        a, b, away = stack.pop()
        mirror = same and a is b
        if away > a.radius + b.radius + theta + SLACK:
            continue
        if (2 * a.radius if mirror else away + a.radius + b.radius) <= theta - SLACK:
            links.within(a.points) if mirror else links.whole(a.points, b.points)
            continue
        if len(a.points) <= LEAF and len(b.points) <= LEAF:
            near = unit[a.points] @ unit[b.points].T
            i, j = np.nonzero(linking(left, near, *np.broadcast_arrays(a.points[:, None], b.points[None, :]), least))
            if mirror:
                i, j = i[i < j], j[i < j]
            links.pairs(a.points[i], b.points[j])
            continue
        split_a = mirror or (len(a.points) > 1 and (a.radius >= b.radius or len(b.points) == 1))
        split_b = mirror or not split_a
        mine, theirs = left.children(a) if split_a else [a], right.children(b) if split_b else [b]
        x, rx = (a.vectors, a.radii) if split_a else (unit[[a.centre]], np.array([a.radius]))
        y, ry = (b.vectors, b.radii) if split_b else (unit[[b.centre]], np.array([b.radius]))
        for s in range(0, len(mine), TILE):
            for t in range(s if mirror else 0, len(theirs), TILE):
                cosine = x[s : s + TILE] @ y[t : t + TILE].T
                widest = rx[s : s + TILE].max() + ry[t : t + TILE].max() + theta + SLACK
                i, j = np.nonzero(cosine >= (np.cos(widest) if widest < np.pi else -2))
                if mirror and s == t:
                    i, j = i[i <= j], j[i <= j]
                apart = np.arccos(np.clip(cosine[i, j], -1, 1))
                i, j = i + s, j + t
                near = apart <= rx[i] + ry[j] + theta + SLACK
                i, j, apart = i[near], j[near], apart[near]
                single = (rx[i] == 0) & (ry[j] == 0) & np.array([len(mine[k].points) == 1 for k in i], bool) & np.array([len(theirs[k].points) == 1 for k in j], bool)
                if single.any():
                    p, q = np.array([mine[k].centre for k in i[single]]), np.array([theirs[k].centre for k in j[single]])
                    good = linking(left, np.einsum("ij,ij->i", unit[p], unit[q]), p, q, least) & (p != q)
                    links.pairs(p[good], q[good])
                stack += [(mine[k], theirs[m], float(d)) for k, m, d in zip(i[~single], j[~single], apart[~single])]


def _links_of(least: float):
    """Of one cell's pair of parts: each linked point's weight of links, and its place in a spanning forest.

    The points of a core have been linked with each other before.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in rows.groupby(rows["embedding"].map(len)):
            group = group.sort_values(["id", "home"], ignore_index=True)
            x = np.array(group["embedding"].tolist(), "float64").reshape(len(group), -1)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            links = Links(group["w"].to_numpy("int64"))
            home, second = group["home"].to_numpy(bool), group["second"].to_numpy(bool)
            tree = {(h, s): Tree(x, unit, np.flatnonzero((home == h) & (second == s))) for h in (True, False) for s in (True, False)}
            core = bool(group["core"].iloc[0])
            if group["alone"].iloc[0]:
                if not core:
                    traverse(tree[True, False], tree[True, False], least, links)
                traverse(tree[True, False], tree[False, False], least, links)
            else:
                if not core:
                    traverse(tree[True, False], tree[True, True], least, links)
                traverse(tree[True, False], tree[False, True], least, links)
                traverse(tree[False, False], tree[True, True], least, links)
            hit = np.flatnonzero(links.count)
            roots = [links.find(int(k)) for k in hit]
            out.append(pd.DataFrame({"id": group["id"].to_numpy()[hit], "links": links.count[hit], "root": group["id"].to_numpy()[roots]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "links": [], "root": []})

    return run


def net(unit: np.ndarray, apart: float) -> np.ndarray:
    """Of unit vectors, those kept so that all lie within the angle of a kept one and no two kept ones do."""
    kept = unit[:0]
    for k in range(0, len(unit), 256):
        rest = unit[k : k + 256]
        if len(kept):
            rest = rest[(rest @ kept.T).max(1) < np.cos(apart)]
        while len(rest):
            kept = np.concatenate([kept, rest[:1]])
            rest = rest[rest @ rest[0] < np.cos(apart)]
    return kept


def _pivots(points: DataFrame, cell: int, apart: float) -> dict[tuple, np.ndarray]:
    """Pivots of each (label, length) with more points than a cell holds: a net of a sample, in all about PIVOTS / 2 at most."""
    sizes = points.groupBy("label").count().filter(F.col("count") > cell).orderBy(F.desc("count"), "label").limit(PIVOTS // 2).collect()
    wanted = {r["label"]: -(-r["count"] // cell) for r in sizes}
    if not wanted:
        return {}
    shrink = max(1.0, sum(wanted.values()) / (PIVOTS // 2))
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["label"], min(1.0, max(2.0, wanted[r["label"]] / shrink) / r["count"]))])
    chosen = points.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40)) < F.coalesce(F.try_element_at(share, F.col("label")), F.lit(0.0)) * (1 << 40))
    found: dict[tuple, list[np.ndarray]] = {}
    for r in chosen.select("label", "id", "embedding").orderBy("label", "id").collect():
        v = np.array(r["embedding"], "float64")
        found.setdefault((r["label"], len(v)), []).append(v / np.linalg.norm(v))
    return {k: net(np.array(v), apart) for k, v in found.items()}


#: Kinds of dealt rows: a point to be compared (or home in a core), links counted for a point, and for all of a core.
POINT, COUNTED, WHOLE = 0, 1, 2


def _deal(pivots, theta: float, cores):
    """Deal points to cells: 2 * pivot for its core, and one more for its shell. Without cores (first pass), the home cell
    and its distance only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, ids, weights = batch.column(0).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            flat, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
            groups: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(labels, lengths.tolist())):
                groups.setdefault(key, []).append(k)
            out: list[list] = [[] for _ in range(7)]  # row, kind, w, cell, home, far, root

            def put(*columns) -> None:
                for held, c in zip(out, columns):
                    held.append(np.broadcast_to(c, len(columns[0])))

            for (label, length), rows in groups.items():
                rows = np.array(rows)
                own = pivots.value.get((label, length))
                if own is None:
                    put(rows, POINT, weights[rows], 0, True, 0.0, -1)
                    continue
                for at in range(0, len(rows), ROWS):
                    part = rows[at : at + ROWS]
                    v = flat[(ends[part] - length)[:, None] + np.arange(length)].astype("float64")
                    away = np.arccos(np.clip((v / np.linalg.norm(v, axis=1, keepdims=True)) @ own.T, -1, 1))
                    mine = away.argmin(1)
                    nearest = away[np.arange(len(part)), mine]
                    inner = nearest <= theta / 4
                    home = 2 * mine + ~inner
                    put(part, POINT, weights[part], home, True, nearest, -1)
                    if cores is None:
                        continue
                    radius, weight, least = cores.value[label, length]
                    # all of a core link with each other
                    put(part[inner], COUNTED, weight[home[inner]] - weights[part[inner]], home[inner], False, 0.0, least[home[inner]])
                    close = (away <= nearest[:, None] + 2 * theta + SLACK) & (np.arange(away.shape[1])[None, :] <= mine[:, None])
                    i, j = np.nonzero(close)
                    for side in (0, 1):
                        c = 2 * j + side
                        d, r = away[i, j], radius[c]
                        lower = (c < home[i]) & (d <= r + theta + SLACK)
                        sure = lower & (d + r <= theta - SLACK) if side == 0 else np.zeros(len(c), bool)
                        x = part[i[sure]]
                        put(x, COUNTED, weight[c[sure]], c[sure], False, 0.0, least[c[sure]])
                        put(x, WHOLE, weights[x], c[sure], False, 0.0, -1)
                        x = part[i[lower & ~sure]]
                        put(x, POINT, weights[x], c[lower & ~sure], False, 0.0, -1)
            pick, kind, w, cells, home, far, root = (np.concatenate(c) if c else np.zeros(0) for c in out)
            taken = batch.select([0, 1, 2]).take(pa.array(pick.astype("int64")))
            more = [pa.array(w.astype("int64")), pa.array(cells.astype("int32")), pa.array(home.astype(bool)), pa.array(far.astype("float64")), pa.array(kind.astype("int32")), pa.array(root.astype("int64"))]
            yield pa.RecordBatch.from_arrays([*taken.columns, *more], [*batch.schema.names[:3], "w", "cell", "home", "far", "kind", "root"])

    return run


def _dealt(points: DataFrame, least: float, cell: int) -> tuple[DataFrame, DataFrame | None]:
    """Points (label, embedding, id, w) dealt to cells, as rows to compare; and links (id, links, root) that need no comparison."""
    points = points.select("label", "embedding", "id", "w")
    theta = float(np.arccos(least)) + SLACK
    pivots = _pivots(points, cell, theta / 4)
    if not pivots:
        return points.withColumns({"cell": F.lit(0), "home": F.lit(True), "core": F.lit(False)}), None
    schema = f"label {dict(points.dtypes)['label']}, embedding {dict(points.dtypes)['embedding']}, id long, w long, cell int, home boolean, far double, kind int, root long"
    shared = points.sparkSession.sparkContext.broadcast(pivots)
    cores = {k: (np.full(2 * len(v), -np.inf), np.zeros(2 * len(v), "int64"), np.full(2 * len(v), -1)) for k, v in pivots.items()}
    keys = F.broadcast(points.sparkSession.createDataFrame([(*k, True) for k in cores], f"label {dict(points.dtypes)['label']}, d int, dealt boolean"))  # a row a label with pivots
    first = points.withColumn("d", F.size("embedding")).join(keys, ["label", "d"], "left_semi").select(*points.columns).mapInArrow(_deal(shared, theta, None), schema)
    sums = first.groupBy("label", F.size("embedding").alias("d"), "cell").agg(F.max("far").alias("far"), F.sum("w").alias("w"), F.min("id").alias("id"))
    for r in sums.collect():  # two rows a pivot at most
        radius, weight, least_id = cores[r["label"], r["d"]]
        radius[r["cell"]], weight[r["cell"]], least_id[r["cell"]] = r["far"] + SLACK, r["w"], r["id"]
    dealt = written(points.mapInArrow(_deal(shared, theta, points.sparkSession.sparkContext.broadcast(cores)), schema))
    rows = dealt.withColumn("d", F.size("embedding")).join(keys, ["label", "d"], "left")
    rows = rows.withColumn("core", F.coalesce("dealt", F.lit(False)) & (F.col("cell") % 2 == 0))
    counted = rows.filter(F.col("kind") == COUNTED).select("id", F.col("w").alias("links"), "root")
    # two rows a pivot at most, so both tables are broadcast
    sums = rows.filter(F.col("kind") == WHOLE).groupBy("label", "d", "cell").agg(F.sum("w").alias("links"))
    whole = rows.filter((F.col("kind") == POINT) & F.col("home") & F.col("core")).join(F.broadcast(sums), ["label", "d", "cell"]).select("id", "links", F.col("id").alias("root"))
    visited = rows.filter((F.col("kind") == POINT) & ~F.col("home")).select("label", "cell").distinct()
    points_left = rows.filter(F.col("kind") == POINT).drop("far", "kind", "root", "d", "dealt", "links")
    asked = points_left.filter("core").join(F.broadcast(visited), ["label", "cell"], "left_semi").select(*points_left.columns)
    return points_left.filter("NOT core").unionByName(asked), counted.unionByName(whole).groupBy("id", "root").agg(F.sum("links").alias("links")).select("id", "links", "root")


def _cells(dealt: DataFrame, part: int) -> DataFrame:
    """Deal very large cells into parts that meet pairwise: adds first, last (a pair of parts), second, alone."""
    large = dealt.groupBy("label", "cell").count().filter(F.col("count") > part).withColumn("parts", F.ceil(F.col("count") / part).cast("int")).drop("count")
    dealt = dealt.join(large, ["label", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")
    dealt = dealt.withColumn("p", own).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("label", "cell", F.least("p", "q").alias("first"), F.greatest("p", "q").alias("last"), "embedding", "id", "w", "home", "core", (F.col("p") > F.col("q")).alias("second"), (F.col("p") == F.col("q")).alias("alone"))


def near_pairs(rows: DataFrame, least: float = 0.93, cell: int = CELL, part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row (vec_id, embedding, label)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    # minus zero equals zero but is another bit pattern; added to zero it becomes plus zero
    plain = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))
    fit = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = rows.filter(fit).withColumn("embedding", plain)
    keyed = written(good.withColumn("key", F.sha2(F.to_json(F.struct("label", "embedding")).cast("binary"), 256)).select("vec_id", "key", "label", "embedding"))
    points = written(keyed.groupBy("key").agg(F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("vertex"), F.count("*").alias("w")))
    # the same least id may stand for several points: they are one vertex, but count apart
    points = points.withColumn("id", F.xxhash64("key", F.lit(3)))
    dealt, counted = _dealt(points, least, cell)
    compared = _cells(dealt, part).groupBy("label", "cell", "first", "last").applyInPandas(_links_of(least), "id long, links long, root long")
    found = written(compared if counted is None else compared.unionByName(counted))
    vertex = points.select("id", "vertex")
    spans = found.select("id", "root").distinct().join(vertex, "id").withColumnRenamed("vertex", "a").drop("id").join(vertex.select(F.col("id").alias("root"), F.col("vertex").alias("b")), "root").select("a", "b")
    repeated = keyed.groupBy("vec_id").count().filter("count > 1").select("vec_id")
    same = keyed.join(repeated, "vec_id", "left_semi").join(points.select("key", "vertex"), "key").select(F.col("vec_id").alias("a"), F.col("vertex").alias("b"))
    joined = components(spans.unionByName(same))
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = points.select("key", "id", "vertex", "w").join(totals, "id", "left").join(joined.withColumnRenamed("node", "vertex"), "vertex", "left")
    named = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "vertex").alias("component_id"))
    linked = keyed.select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    # a row that links with nothing may share its id with one that does
    rest = rows.filter(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    also = linked.join(rest.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("component_id").alias("component_id"))
    rest = rest.join(also, "vec_id", "left").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))

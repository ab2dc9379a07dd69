import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.functions import stats, workload
from rangeloom.functions.morton import zrange
from rangeloom.operators.delta import DeltaTable, MergePolicy
from rangeloom.operators.execute import aggregate
from rangeloom.operators.zorder import ZOrderTable
from rangeloom.plans import rewrite
from rangeloom.plans.layout import Layout, LayoutOptions, build_layout, sort_columns, sort_value
from rangeloom.plans.model import Aggregate, QueryError, Range, RangeQuery, Selection
from rangeloom.plans.skeleton import CONDITIONAL, FUNCTIONAL, Correlations, CostModel, Skeleton, Strategy, initial_skeleton, optimise
from rangeloom.plans.tree import Node, TreeOptions
from rangeloom.sources import tables
from rangeloom.streaming.ingest import stream_inserts
from rangeloom.streaming.shift import ShiftMonitor

FIVE = (Aggregate("count"), Aggregate("sum", "d1"), Aggregate("avg", "d2"), Aggregate("min", "d0"), Aggregate("max", "d1"))


def query(**ranges):
    return RangeQuery(FIVE, Selection({k: Range(*v) for k, v in ranges.items()}))


WORKLOAD = [query(d0=(a, a + 10), d2=(70, 95)) for a in range(5, 30)] + [query(d1=(b, b + 40)) for b in range(0, 40, 4)]


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(3)
    d0 = np.round(r.uniform(0, 100, 6000), 1)
    d0[:300] = 50.0
    rows = np.column_stack([d0, 0.85 * d0 + r.normal(0, 1.0, 6000), r.uniform(0, 100, 6000)])
    df = spark.createDataFrame([tuple(map(float, x)) for x in rows], "d0 double, d1 double, d2 double").persist()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def layout(table, tmp_path_factory):
    return build_layout(table, ["d0", "d1", "d2"], WORKLOAD, str(tmp_path_factory.mktemp("layout")), LayoutOptions(tree=TreeOptions(max_depth=3, min_rows=0.02), max_cells=64))


def same(a, b):
    x, y = tuple(a.first()), tuple(b.first())
    assert x == pytest.approx(y, rel=1e-9) if None not in x else x == y


def test_each_region_is_sorted_by_the_column_that_its_queries_constrain(table, tmp_path):
    queries = [query(d0=(a, a + 5)) for a in range(5, 40)] + [query(d2=(b, b + 5), d0=(70, 99)) for b in range(0, 60, 2)] + [query(d2=(b, b + 9)) for b in range(20)]
    low, high = Node({"d0": (0.0, 60.0)}, region=0), Node({"d0": (60.0, 100.0)}, region=1)
    chosen = sort_columns(Node({"d0": (0.0, 100.0)}, "d0", [60.0], [low, high]), ["d0", "d1", "d2"], queries)
    assert chosen == {0: "d0", 1: "d2"}
    path = str(tmp_path / "sorted")
    placed = table.withColumn("region_id", (F.col("d0") >= 60).cast("int")).repartition(1).sortWithinPartitions("region_id", sort_value(chosen))
    placed.write.parquet(path)
    rows = table.sparkSession.read.parquet(path).collect()
    for region, column in chosen.items():
        own = [r[column] for r in rows if r["region_id"] == region]
        assert own == sorted(own) and len(own) > 100


def test_best_cuts_reach_the_least_skew_of_all_ways_to_cut():
    rng = np.random.default_rng(5)
    for _ in range(20):
        histogram = rng.choice([0.0, 1.0, 5.0, 20.0], 16) + 0.01
        cost = lambda ends: sum(workload.skew(histogram[a:b]) * histogram[a:b].sum() for a, b in zip(ends, ends[1:]))
        ways = [(0, *c, 16) for n in range(8) for c in combinations(range(2, 16, 2), n)]
        least = min(cost(w) for w in ways if all(b - a >= 4 for a, b in zip(w, w[1:])))
        cuts, gain = workload.best_cuts(histogram, tolerance=-1.0)  # nothing is merged again
        assert gain == pytest.approx(cost((0, 16)) - least)
        assert cost((0, *cuts, 16)) == pytest.approx(least)


def test_layout_prunes_and_keeps_every_row(layout, table):
    assert layout.main.count() == 6000 and len(layout.tree.leaves()) > 1
    assert layout.cells.agg(F.sum("n")).first()[0] == 6000
    again = Layout.open(layout.spark, layout.path)
    assert again.skeleton == layout.skeleton and again.tree.json() == layout.tree.json()
    m = rewrite.scan_metrics(layout, query(d0=(8, 15), d2=(80, 90))).first()
    assert 0 < m["scan_share"] < 0.6


def test_random_boxes_agree_with_the_plain_scan(layout, table):
    rnd = random.Random(4)
    edges = [c for n in layout.tree.leaves() for lo, hi in n.box.values() for c in (lo, hi)]
    boxes = [query(d0=(50, 50)), query(d0=(200, 300)), query(d0=(60, 40)), query(), query(d0=(None, 0.0)), query(d2=(99.9, None))]
    for _ in range(6):
        a, b = sorted(rnd.choice(edges + [rnd.uniform(0, 100)]) for _ in range(2))
        boxes.append(query(**{rnd.choice(["d0", "d1", "d2"]): (a, b, rnd.random() < 0.5, rnd.random() < 0.5), "d2": (rnd.uniform(0, 50), rnd.uniform(50, 100))}))
    for q in boxes:
        same(rewrite.answer(layout, q), aggregate(table, q))
    # the distributed plan, as for zone maps too large for the driver
    for q in boxes[:3] + boxes[-2:]:
        where = rewrite.tightened(layout, q.where)
        cells = rewrite.split_cells(layout, where)
        n = (cells.interior.agg(F.sum("n")).first()[0] or 0) + rewrite.boundary_rows(layout, where, cells).count()
        assert n == aggregate(table, q).first()["n_matched"] == rewrite.row_ids(layout, q).count()


def test_unequal_is_exact(layout, table):
    q = RangeQuery(FIVE, Selection({"d2": Range(10, 90)}, (("d0", 50.0),)))
    same(rewrite.answer(layout, q), aggregate(table, q))


def test_zorder_is_exact(table, tmp_path):
    z = ZOrderTable.build(table, ["d0", "d2"], str(tmp_path / "z"))
    for q in (query(d0=(10, 20), d2=(30, 40)), query(d0=(50, 50)), query(d1=(3, 9)), query(d0=(-5, 0))):
        same(z.query(q), aggregate(table, q))
    lo, hi = zrange(["d0", "d2"], {"d0": (0, 100), "d2": (0, 100)}, {})
    assert lo == 0 and hi == (1 << 20) - 1


def test_changes_are_exact(spark, table, tmp_path):
    base = table.filter("d0 < 90")
    t = DeltaTable(build_layout(base, ["d0", "d1", "d2"], WORKLOAD, str(tmp_path / "base"), LayoutOptions(tree=TreeOptions(max_depth=1), max_cells=27)), MergePolicy(rows=10))
    q = query(d0=(20, 95), d2=(10, 80))
    assert not t.due()
    assert t.insert(table.filter("d0 >= 90")).count() == table.filter("d0 >= 90").count()
    same(t.query(q), aggregate(table, q))
    t.delete(t.live().filter("d0 = 50 OR d0 > 94"))
    left = table.filter("NOT (d0 = 50 OR d0 > 94)")
    same(t.query(q), aggregate(left, q))
    t.update(t.live().filter("d0 < 25").withColumn("d0", F.lit(97.0)))
    now = left.withColumn("d0", F.when(F.col("d0") < 25, 97.0).otherwise(F.col("d0")))
    same(t.query(q), aggregate(now, q))
    assert t.due()
    done = t.compact(str(tmp_path / "next"), WORKLOAD)
    assert done is not t and done.delta is None and done.layout.rows == now.count()
    same(done.query(q), aggregate(now, q))


def test_streamed_inserts(spark, table, tmp_path):
    t = DeltaTable(build_layout(table.filter("d0 < 50"), ["d0", "d1", "d2"], [], str(tmp_path / "s"), LayoutOptions(max_cells=8)))
    table.filter("d0 >= 50").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream_inserts(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), t, str(tmp_path / "cp")).awaitTermination(120)
    same(t.query(query(d2=(5, 60))), aggregate(table, query(d2=(5, 60))))


@pytest.mark.parametrize("order", ["insert stream insert", "stream insert stream"])
def test_inserts_and_streams_mix(spark, table, tmp_path, order):
    t = DeltaTable(build_layout(table.filter("d0 < 40"), ["d0", "d1", "d2"], [], str(tmp_path / "m"), LayoutOptions(max_cells=8)))
    parts = ["d0 >= 40 AND d0 < 60", "d0 >= 60 AND d0 < 80", "d0 >= 80"]
    for k, (way, where) in enumerate(zip(order.split(), parts)):
        rows = table.filter(where)
        if way == "insert":
            assert t.insert(rows).count() == rows.count()
        else:
            rows.write.parquet(str(tmp_path / f"in{k}"))
            stream_inserts(spark.readStream.schema(table.schema).parquet(str(tmp_path / f"in{k}")), t, str(tmp_path / f"cp{k}")).awaitTermination(120)
        same(t.query(query(d2=(5, 60))), aggregate(table.filter(f"d0 < {(60, 80, 1000)[k]}"), query(d2=(5, 60))))
    assert t.live().select("_row_id").distinct().count() == table.count()
    t.delete(t.live().filter("d0 >= 70"))
    same(t.query(query(d2=(5, 60))), aggregate(table.filter("d0 < 70"), query(d2=(5, 60))))
    # what cannot be read is no empty delta
    (tmp_path / "m" / "delta" / "batch=broken").mkdir()
    (tmp_path / "m" / "delta" / "batch=broken" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        t.query(query(d2=(5, 60))).collect()


def test_odd_values_are_refused(spark, layout, tmp_path):
    for odd in (float("nan"), float("inf"), None):
        df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, odd, 3.0)], "d0 double, d1 double, d2 double")
        with pytest.raises(QueryError):
            build_layout(df, ["d0", "d1", "d2"], [], str(tmp_path / "odd"))
        with pytest.raises(QueryError):
            DeltaTable(layout).insert(df)
    assert DeltaTable(layout).delta is None


def test_cell_ranges_hold_every_boundary_cell():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 60)
        keys, rows = np.cumsum([rng.randint(1, 5) for _ in range(n)]), np.array([rng.randint(1, 100) for _ in range(n)])
        kind = np.array(rng.choices([0, 1, 2], k=n))
        ranges, held = rewrite.cell_ranges(keys, rows, kind, most=rng.choice([1, 3, 50]))
        inside = np.array([any(a <= k <= b for a, b in ranges) for k in keys])
        assert (inside == held).all() and held[kind == 1].all()
    ranges, held = rewrite.cell_ranges(np.arange(6), np.array([1, 9, 1, 2, 1, 1]), np.array([1, 2, 1, 2, 1, 0]), most=2)
    assert ranges == [(0, 0), (2, 4)] and held.tolist() == [True, False, True, True, True, False]


def test_the_cell_key_is_pushed(layout):
    plan = rewrite.answer(layout, query(d0=(8, 15), d2=(80, 90)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(cell_key" in plan and "PartitionFilters: [region_id" in plan


def test_maps_hold_for_every_row(table):
    (m,) = stats.linear_maps(table, [("d1", "d0")])
    assert m.width < 0.1
    r = m.implied(Range(10, 20))
    assert table.filter(f"d1 BETWEEN 10 AND 20 AND NOT (d0 BETWEEN {r.lo} AND {r.hi})").isEmpty()
    r = m.forward(Range(40, 45))
    assert table.filter(f"d0 BETWEEN 40 AND 45 AND NOT (d1 BETWEEN {r.lo} AND {r.hi})").isEmpty()
    published = stats.linear_maps(table, [("d1", "d0")], divide_by="y")[0]
    assert published.width == pytest.approx(m.width * 0.85, rel=0.2)


def test_skeletons():
    m = stats.LinearMap("b", "a", 2.0, 0.0, 0.1, 0.1, 0.01)
    back = stats.LinearMap("a", "b", 0.5, 0.0, 0.1, 0.1, 0.01)
    found = Correlations({("b", "a"): m, ("a", "b"): back}, {("c", "b"): 0.5, ("b", "c"): 0.5})
    s = initial_skeleton(["a", "b", "c"], found)
    kinds = [x.kind for x in s.dims.values()]
    assert s.valid() and kinds.count(FUNCTIONAL) == 1 and not (s.dims["a"].kind == s.dims["b"].kind == FUNCTIONAL)
    assert not Skeleton({"a": Strategy(FUNCTIONAL, "b", back), "b": Strategy(FUNCTIONAL, "a", m)}).valid()
    assert not Skeleton({"a": Strategy(CONDITIONAL, "b"), "b": Strategy(CONDITIONAL, "c"), "c": Strategy()}).valid()
    assert Skeleton.from_dict(s.to_dict()) == s
    model = CostModel(100_000, dict.fromkeys("abc", (0.0, 100.0)))
    queries = [RangeQuery(where=Selection({"c": Range(k, k + 1)})) for k in range(20)]
    best = optimise(s, found, model, queries)
    assert model.total(best, queries) < model.total(s, queries) and best.dims["c"].parts > 4 and best.valid()
    tuned = model.calibrated(best, queries, lambda q: None, 1)
    assert tuned.per_run >= 0 and model.error(best, queries[0], 1.0) > 0


def test_workload_statistics():
    assert workload.emd(np.array([1, 0, 0]), np.array([0, 0, 1])) == pytest.approx(2)
    h = workload.query_histogram([(0, 10), (0, 1), (20, 30)], 0, 10, 10)
    assert h.sum() == pytest.approx(2) and h[0] == pytest.approx(1.1)
    assert workload.skew(np.ones(8)) == 0
    corner = np.r_[np.full(16, 10.0), np.zeros(48)]
    cuts, gain = workload.best_cuts(corner)
    assert 16 in cuts and gain > 0
    assert workload.best_cuts(np.ones(64)) == ([], 0.0)
    assert workload.query_types([], ["d0"]) == []
    assert len(workload.query_types(WORKLOAD, ["d0", "d1", "d2"])) == 2


def test_shift_monitor():
    m = ShiftMonitor(WORKLOAD, {"d0": (0.0, 100.0)}, least=20, window=40)
    assert not any(m.observe(q, 0.0) for q in WORKLOAD[::-1])
    events = [e for k in range(40) for e in m.observe(query(d2=(k, k + 1)), 100.0)]
    assert {e.kind for e in events} >= {"types", "frequency"}
    assert len([e for e in events if e.kind == "types"]) == 1  # cooldown


def test_tables(spark, tmp_path):
    assert tables.sanitised_names(["a b", "a-b", "%", "A_B"]) == ["a_b", "a_b_2", "col_2", "A_B_3"]
    rows = [(1.0, float("nan"), "x", None), (2.0, 3.0, "y", None), (float("inf"), 4.0, "z", None), (5.0, None, "w", None), (6.0, 7.0, "v", None)]
    df = spark.createDataFrame(rows, "a double, `b c` double, s string, nothing double")
    assert sorted(map(tuple, tables.clean(df).collect())) == [(2.0, 3.0), (6.0, 7.0)]
    assert tables.clean(df.limit(0)).count() == 0
    path = str(tmp_path / "x.csv")
    wide = spark.range(500).selectExpr("id", "id % 3 AS few", "id * 1.5 AS `two words`", "timestamp_seconds(id * 4000) AS at")
    wide.coalesce(1).write.csv(path, header=True)
    loaded = tables.load_numeric(spark, path, max_rows=400)
    assert loaded.count() == 400 and set(loaded.columns) == {"id", "two_words", "at_epoch"}
    small = tables.resized(loaded, 100)
    assert small.count() == 100 == small.join(loaded, loaded.columns, "left_semi").count() == small.distinct().count()
    assert [tables.resized(loaded, n).count() for n in (400, 401, 1000)] == [400, 401, 1000] and tables.resized(loaded.limit(0), 5).count() == 0
    trips = tables.synthetic_trips(spark, 5000)
    assert trips.count() == 5000
    assert trips.stat.corr("trip_distance", "fare_amount") > 0.95 and trips.stat.corr("Latitude", "dropoff_lat") > 0.6
    for df, dims in ((trips, tables.TRIPS), (tables.synthetic_housing(spark, 5000), tables.HOUSING)):
        for c, d in dims.items():
            lo, hi = df.selectExpr(f"min({c})", f"max({c})").first()
            assert d.lo <= lo < hi <= d.hi

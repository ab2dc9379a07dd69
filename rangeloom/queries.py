"""The registered queries of the range-aggregate engine over lineitem, orders and events, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions import stats, workload
from rangeloom.functions.morton import zcode
from rangeloom.operators import batch, execute
from rangeloom.operators.delta import DeltaTable
from rangeloom.operators.zorder import ZOrderTable
from rangeloom.plans import rewrite
from rangeloom.plans.dialect import parse
from rangeloom.plans.layout import Layout, LayoutOptions, build_layout
from rangeloom.plans.model import RangeQuery, RowQuery, bounds_of
from rangeloom.plans.tree import Node, TreeOptions, region_column
from rangeloom.sources import tables
from rangeloom.sources.lookups import Lookup, default_registry
from rangeloom.sources.shared import fresh_path
from rangeloom.streaming.ingest import stream_inserts

DIMS = ("l_quantity", "l_extendedprice", "l_partkey", "ship_day")
ROWS_SQL = "(SELECT *, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS ship_day FROM lineitem)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("double")
    return df.withColumn("ship_day", day)


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).select(*[F.col(c).cast("double").alias(c) for c in DIMS])


def read_query(df: DataFrame, sql: str, bounds: str = "closed", registry=None) -> RangeQuery | RowQuery:
    return parse(sql, df.columns, registry, bounds)


def _plain(name: str, select: str, where: str, sql_where: str | None = None, bounds: str = "closed", answer: str | None = None) -> None:
    """Register one aggregate over lineitem; ``answer``: how the value is compared (sums of doubles are rounded)."""
    text = f"SELECT {select} FROM data" + (f" WHERE {where}" if where else "")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lineitem(spark, sf_dir)
        out = execute.aggregate(df, read_query(df, text, bounds))
        return out.select(F.round(out.columns[0], 2).alias("answer") if "(*)" not in select else F.col(out.columns[0]).alias("answer"), "n_matched")

    value = select if "(*)" in select else f"round({select}, 2)"
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {value} AS answer, count(*) AS n_matched FROM {ROWS_SQL}" + (f" WHERE {sql_where or where}" if where else "")


BOX = "l_quantity BETWEEN 10 AND 20 AND l_extendedprice >= 50000"
_plain("range_count", "COUNT(*)", BOX)
for _fn in ("sum", "avg", "min", "max"):
    _plain(f"range_{_fn}", f"{_fn.upper()}(l_extendedprice)", BOX)
_plain("range_count_closed", "COUNT(*)", "l_quantity > 25 AND l_discount < 0.05", "l_quantity >= 25 AND l_discount <= 0.05")
_plain("range_count_ansi", "COUNT(*)", "l_quantity > 25 AND l_discount < 0.05", bounds="ansi")
_plain("range_multi_dim", "AVG(l_extendedprice)", "l_quantity BETWEEN 5 AND 30 AND l_extendedprice <= 60000 AND l_partkey >= 100 AND ship_day BETWEEN 8500 AND 9800")
_plain("range_empty", "SUM(l_extendedprice)", "l_quantity BETWEEN 30 AND 20")
_plain("range_empty_count", "COUNT(*)", "l_quantity >= 1000")
_plain("range_eq_min_edge", "COUNT(*)", "l_quantity = 1")
_plain("range_equals_intersects", "COUNT(*)", "l_quantity >= 5 AND l_quantity = 3")
_plain("range_not_equal", "COUNT(*)", "l_quantity != 7 AND l_quantity <= 10")
_plain("range_all_rows", "AVG(l_quantity)", "")


@registered(f"SELECT count(*) AS count_all, round(sum(l_quantity), 2) AS sum_q, min(l_extendedprice) AS min_p, max(l_extendedprice) AS max_p, count(*) AS n_matched FROM {ROWS_SQL} WHERE {BOX}")
def range_many_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir)
    out = execute.aggregate(df, read_query(df, f"SELECT COUNT(*), SUM(l_quantity), MIN(l_extendedprice), MAX(l_extendedprice) FROM data WHERE {BOX}"))
    return out.select("count_all", F.round("sum_l_quantity", 2).alias("sum_q"), F.col("min_l_extendedprice").alias("min_p"), F.col("max_l_extendedprice").alias("max_p"), "n_matched")


@registered("SELECT coalesce(sum(l_quantity), 0) AS sum_l_quantity, count(*) AS n_matched FROM lineitem WHERE l_quantity <= 0")
def range_empty_as_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir)
    return execute.compat_zero(execute.aggregate(df, read_query(df, "SELECT SUM(l_quantity) FROM data WHERE l_quantity <= 0")))


@registered(f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM {ROWS_SQL} WHERE l_quantity BETWEEN 10 AND 20 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def row_filter_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir)
    query = read_query(df, "SELECT l_orderkey, l_linenumber, l_extendedprice FROM data WHERE l_quantity BETWEEN 10 AND 20 ORDER BY l_extendedprice DESC LIMIT 25")
    return execute.rows(df, query, ("l_orderkey", "l_linenumber"))


@registered(f"SELECT l_orderkey, l_quantity FROM {ROWS_SQL} WHERE l_extendedprice <= 2000 ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 50")
def row_default_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir)
    return execute.rows(df, read_query(df, "SELECT l_orderkey, l_quantity FROM data WHERE l_extendedprice <= 2000 ORDER BY l_extendedprice"), ("l_orderkey", "l_linenumber"))


@registered("SELECT count(*) AS n_matched FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def row_total_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir)
    return execute.total_matched(df, read_query(df, "SELECT * FROM data WHERE l_quantity BETWEEN 10 AND 20"))


def _segments() -> dict:
    return {"Small Cheap": {"l_quantity": (1.0, 10.0), "l_extendedprice": (0.0, 10000.0)}, "Middle": {"l_quantity": (20.0, 30.0), "l_extendedprice": (20000.0, 50000.0)}, "Large Dear": {"l_quantity": (40.0, 50.0), "l_extendedprice": (60000.0, 200000.0)}}


@registered("SELECT round(avg(l_extendedprice), 2) AS answer, count(*) AS n_matched FROM lineitem WHERE l_quantity BETWEEN 20 AND 30 AND l_extendedprice BETWEEN 20000 AND 50000 AND l_partkey >= 50")
def named_region_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = default_registry()
    registry.register(Lookup("segment", _segments()))
    df = lineitem(spark, sf_dir)
    out = execute.aggregate(df, read_query(df, "SELECT AVG(l_extendedprice) FROM data WHERE segment = 'middle' AND l_partkey >= 50", registry=registry))
    return out.select(F.round(out.columns[0], 2).alias("answer"), "n_matched")


@registered("""
SELECT name, count(*) AS count_all, round(sum(l_quantity), 2) AS sum_q
FROM lineitem JOIN (VALUES ('Small Cheap', 1, 10, 0, 10000), ('Middle', 20, 30, 20000, 50000), ('Large Dear', 40, 50, 60000, 200000)) b(name, a, b, c, d)
  ON l_quantity BETWEEN b.a AND b.b AND l_extendedprice BETWEEN b.c AND b.d GROUP BY name
""")
def many_regions_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = [(n, *b["l_quantity"], *b["l_extendedprice"]) for n, b in _segments().items()]
    regions = spark.createDataFrame(boxes, "name string, lat_lo double, lat_hi double, lon_lo double, lon_hi double")
    df = lineitem(spark, sf_dir)
    out = execute.group_by_region(df, regions, "l_quantity", "l_extendedprice", read_query(df, "SELECT COUNT(*), SUM(l_quantity) FROM data"))
    return out.select("name", "count_all", F.round("sum_l_quantity", 2).alias("sum_q"))


def _named(name: str, grid: dict[str, str], where: str, sql_where: str) -> None:
    """Register an aggregate over a named region of lineitem with made columns; the SQL states the region's numbers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({c: F.expr(e) for c, e in grid.items()})
        out = execute.aggregate(df, read_query(df, f"SELECT COUNT(*), AVG(l_extendedprice) FROM data WHERE {where}"))
        return out.select("count_all", F.round("avg_l_extendedprice", 2).alias("mean"), "n_matched")

    made = ", ".join(f'{e} AS "{c}"' for c, e in grid.items()).replace("D ", "::DOUBLE ")
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT count(*) AS count_all, round(avg(l_extendedprice), 2) AS mean, count(*) AS n_matched FROM (SELECT *, {made} FROM lineitem) WHERE {sql_where}"


_COAST = {"Latitude": "33.005D + l_partkey % 200 / 100D", "Longitude": "-119.005D + l_orderkey % 200 / 100D"}
_CITY = {"Latitude": "40.6005D + l_partkey % 250 / 1000D", "Longitude": "-74.0505D + l_orderkey % 300 / 1000D"}
_named("place_region_agg", _COAST, "place = 'irvine' AND l_quantity >= 5", "Latitude BETWEEN 33.60 AND 33.75 AND Longitude BETWEEN -117.90 AND -117.70 AND l_quantity >= 5")
_named("place_part_of_name_agg", _COAST, "places = 'river'", "Latitude BETWEEN 33.80 AND 34.10 AND Longitude BETWEEN -117.60 AND -117.20")
_named("neighbourhood_region_agg", _CITY, "neighbourhood = 'Harlem' AND l_quantity <= 45", "Latitude BETWEEN 40.800 AND 40.830 AND Longitude BETWEEN -73.960 AND -73.920 AND l_quantity <= 45")
_named("zone_region_agg", {"Elevation": "1800D + l_partkey % 2000", "Slope": "l_quantity"}, "zone = 'subalpine'", "Elevation BETWEEN 2800 AND 3200 AND Slope BETWEEN 8 AND 22")
_named("zone_missing_column_agg", {"Elevation": "1800D + l_partkey % 2000"}, "zone = 'Montane' AND l_discount < 0.08", "Elevation BETWEEN 2400 AND 2800 AND l_discount <= 0.08")


@registered()
def lookup_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default_registry().frame(spark)


def _profile_sql(columns: list[str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM lineitem" for c in columns)
    return f"SELECT \"column\", CAST(sum(k) AS BIGINT) AS n, count(value) AS \"distinct\", max(k) / sum(k) AS top_share, min(value) AS lo, max(value) AS hi FROM (SELECT \"column\", value, count(*) AS k FROM ({each}) GROUP BY ALL) GROUP BY \"column\""


PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey"]


@registered("SELECT min(l_quantity) AS lo_q, max(l_quantity) AS hi_q, min(l_extendedprice) AS lo_p, max(l_extendedprice) AS hi_p FROM lineitem")
def profile_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir)
    return df.agg(F.min("l_quantity").alias("lo_q"), F.max("l_quantity").alias("hi_q"), F.min("l_extendedprice").alias("lo_p"), F.max("l_extendedprice").alias("hi_p"))


@registered(f"SELECT *, top_share < 0.75 AND \"distinct\" >= 50 AS eligible FROM ({_profile_sql(PROFILED)})")
def column_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.eligible_columns(lineitem(spark, sf_dir), columns=PROFILED)


@registered("""
SELECT CAST(hour(ts) AS DOUBLE) AS ts_hour, CAST(isodow(ts) - 1 AS DOUBLE) AS ts_dayofweek, CAST(month(ts) AS DOUBLE) AS ts_month,
       count(*) AS n, sum(floor(epoch(ts))) AS seconds FROM events GROUP BY 1, 2, 3
""")
def datetime_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.with_datetime_features(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts"))
    return df.groupBy("ts_hour", "ts_dayofweek", "ts_month").agg(F.count(F.lit(1)).alias("n"), F.sum("ts_epoch").alias("seconds"))


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    odd = F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("inf")).when(k % 13 != 0, v)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", odd.alias("odd value"), F.lit(None).cast("double").alias("nothing"), "event_type")


@registered("SELECT count(*) AS n, round(sum(value), 2) AS total, CAST(sum(event_id) AS DOUBLE) AS ids FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0")
def clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.clean(_dirty(spark, sf_dir))
    df = df.toDF(*tables.sanitised_names(df.columns))
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("odd_value"), 2).alias("total"), F.sum("event_id").alias("ids"))


@registered("SELECT count(*) // 3 AS n_small, count(*) * 2 + 1 AS n_large, count(*) // 3 AS n_known FROM lineitem")
def resized_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of a table's rows, all of them rows of it, and twice as many and one, by copies with noise."""
    df = lineitem(spark, sf_dir).select(F.col("l_orderkey").cast("double"), F.col("l_linenumber").cast("double"), "l_quantity")
    n = df.count()
    small, large = tables.resized(df, n // 3), tables.resized(df, 2 * n + 1)
    known = small.distinct().join(df.distinct(), df.columns, "left_semi").count() + small.count() - small.distinct().count()
    return spark.createDataFrame([(small.count(), large.count(), known)], "n_small long, n_large long, n_known long")


@registered()
def synthetic_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    housing, trips = tables.synthetic_housing(spark, 5000), tables.synthetic_trips(spark, 5000)
    return tables.column_profile(housing).withColumn("of", F.lit("housing")).unionByName(tables.column_profile(trips).withColumn("of", F.lit("trips")))


def _quantile_sql(column: str, parts: int) -> str:
    return f"quantile_cont({column}, [{', '.join(f'{k}/{parts}.0' for k in range(parts + 1))}])"


@registered(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS k, round(unnest(b), 4) AS bound FROM (SELECT {_quantile_sql(f'CAST({c} AS DOUBLE)', 8)} AS b FROM lineitem)" for c in ("l_quantity", "l_extendedprice")))
def equi_depth_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.equi_depth_bounds(dims(spark, sf_dir), ["l_quantity", "l_extendedprice"], 8)
    return found.withColumn("bound", F.round("bound", 4))


EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 51.0]


@registered("SELECT CAST((l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 30)::INT + (l_quantity > 40)::INT AS INTEGER) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def bucket_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims(spark, sf_dir).groupBy(stats.bucket(F.col("l_quantity"), EDGES).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@registered(f"""
SELECT base_bucket, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS k, round(unnest(b), 4) AS bound FROM (
  SELECT CAST((l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 30)::INT + (l_quantity > 40)::INT AS INTEGER) AS base_bucket, {_quantile_sql('l_extendedprice', 4)} AS b FROM lineitem GROUP BY 1)
""")
def conditional_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.conditional_bounds(dims(spark, sf_dir), "l_extendedprice", "l_quantity", EDGES, 4)
    return found.select("base_bucket", F.posexplode("bounds").alias("k", "bound")).withColumn("bound", F.round("bound", 4))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("seconds"), F.col("event_id").cast("double").alias("event_id"))


@registered("""
WITH e AS (SELECT CAST(floor(epoch(ts)) AS DOUBLE) AS x, CAST(event_id AS DOUBLE) AS y FROM events),
f AS (SELECT regr_slope(x, y) AS s, regr_intercept(x, y) AS i, max(x) - min(x) AS span FROM e),
r AS (SELECT s, i, span, min(x - (s * y + i)) AS lo, max(x - (s * y + i)) AS hi FROM e, f GROUP BY ALL)
SELECT round(s, 4) AS slope, round((greatest(0, -lo) + greatest(0, hi)) / span, 5) AS width, (greatest(0, -lo) + greatest(0, hi)) / span <= 0.10 AS accepted FROM r
""")
def functional_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.functional_fit(_events(spark, sf_dir), "seconds", "event_id")
    return found.select(F.round("slope", 4).alias("slope"), F.round("width", 5).alias("width"), (F.col("width") <= 0.10).alias("accepted"))


@registered("""
WITH b AS (SELECT (l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 30)::INT + (l_quantity > 40)::INT AS q,
  (l_extendedprice > 10000)::INT + (l_extendedprice > 20000)::INT + (l_extendedprice > 90000)::INT + (l_extendedprice > 104000)::INT AS p FROM lineitem)
SELECT 1 - count(DISTINCT q * 5 + p) / 25.0::DOUBLE AS empty_share FROM b
""")
def empty_cell_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = {"l_quantity": EDGES, "l_extendedprice": [0.0, 10000.0, 20000.0, 90000.0, 104000.0, 1e9]}
    found = stats.empty_cell_fraction(dims(spark, sf_dir), [("l_quantity", "l_extendedprice")], bounds, 5)
    return spark.createDataFrame([(v,) for v in found.values()], "empty_share double")


@registered("""
WITH q AS (SELECT o_totalprice AS lo, o_totalprice + 20000 AS hi FROM orders),
b AS (SELECT least(greatest(floor(lo / 10000), 0), 31) AS f, least(greatest(ceil(hi / 10000) - 1, least(greatest(floor(lo / 10000), 0), 31)), 31) AS l FROM q WHERE hi >= 0 AND lo <= 320000)
SELECT CAST(bin AS INTEGER) AS bin, round(sum(1.0 / (l - f + 1)), 4) AS mass FROM (SELECT f, l, unnest(generate_series(CAST(f AS BIGINT), CAST(l AS BIGINT))) AS bin FROM b) GROUP BY 1
""")
def query_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_totalprice").alias("lo"), (F.col("o_totalprice") + 20000).alias("hi"))
    return workload.query_histogram_frame(log, 0.0, 320_000.0, 32).withColumn("mass", F.round("mass", 4))


#: A sample workload: mostly dear lines of middling quantity in a part of the time.
WORKLOAD = [f"SELECT COUNT(*) FROM data WHERE l_quantity BETWEEN {q} AND {q + 5} AND l_extendedprice >= {p}" for q in range(20, 45, 2) for p in (50000, 60000)] + [
    f"SELECT SUM(l_extendedprice) FROM data WHERE ship_day BETWEEN {d} AND {d + 120} AND l_quantity >= 30" for d in range(9000, 9600, 60)
]


def _workload(df: DataFrame) -> list[RangeQuery]:
    return [read_query(df, sql) for sql in WORKLOAD]


#: The ranges that WORKLOAD asks for, in SQL; an open end is null.
_LOG_SQL = """
log AS (
  SELECT CAST(2 * i + j AS INTEGER) AS query_no, CAST(20 + 2 * i AS DOUBLE) AS q_lo, CAST(25 + 2 * i AS DOUBLE) AS q_hi,
         CAST(50000 + 10000 * j AS DOUBLE) AS p_lo, CAST(NULL AS DOUBLE) AS d_lo, CAST(NULL AS DOUBLE) AS d_hi
  FROM range(13) a(i), range(2) b(j)
  UNION ALL
  SELECT CAST(26 + i AS INTEGER), 30, NULL, NULL, CAST(9000 + 60 * i AS DOUBLE), CAST(9120 + 60 * i AS DOUBLE) FROM range(10) a(i)
)
"""


@registered(f"""
WITH {_LOG_SQL}, spans AS (
  SELECT 'l_quantity' AS "column", q_lo AS a, q_hi AS b FROM log UNION ALL SELECT 'l_extendedprice', p_lo, NULL FROM log
  UNION ALL SELECT 'l_partkey', NULL, NULL FROM log UNION ALL SELECT 'ship_day', d_lo, d_hi FROM log
), ends AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS name, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {ROWS_SQL}" for c in DIMS)}
), bins AS (
  SELECT "column", least(greatest(floor((coalesce(a, lo) - lo) / ((hi - lo) / 128)), 0), 127) AS f, ceil((coalesce(b, hi) - lo) / ((hi - lo) / 128)) - 1 AS l
  FROM spans JOIN ends ON "column" = name WHERE coalesce(b, hi) >= lo AND coalesce(a, lo) <= hi
), spread AS (
  SELECT "column", unnest(generate_series(CAST(f AS BIGINT), CAST(least(greatest(l, f), 127) AS BIGINT))) AS bin, 1 / (least(greatest(l, f), 127) - f + 1) AS mass FROM bins
), histogram AS (
  SELECT name AS "column", n AS bin, coalesce(sum(mass), 0) AS mass FROM ends CROSS JOIN range(128) r(n) LEFT JOIN spread ON "column" = name AND bin = n GROUP BY 1, 2
), apart AS (
  SELECT "column", bin, CAST(1 AS DOUBLE) / 128 - mass / sum(mass) OVER (PARTITION BY "column") AS d FROM histogram
), moved AS (
  SELECT "column", abs(sum(d) OVER (PARTITION BY "column" ORDER BY bin)) AS e FROM apart
)
SELECT "column", round(sum(e), 6) AS skew FROM moved GROUP BY 1
""")
def column_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the workload's spread over each dimension is from an even one."""
    df = dims(spark, sf_dir)
    found = [(c, workload.skew(workload.query_histogram(workload.spans_of(_workload(df), c, lo, hi), lo, hi, 128))) for c, (lo, hi) in bounds_of(df, list(DIMS)).items()]
    return spark.createDataFrame(found, "column string, skew double").withColumn("skew", F.round("skew", 6))


@registered()
def workload_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dims(spark, sf_dir)
    out = []
    for c, (lo, hi) in bounds_of(df, list(DIMS)).items():
        histogram = workload.query_histogram(workload.spans_of(_workload(df), c, lo, hi), lo, hi, 128)
        cuts, gain = workload.best_cuts(histogram)
        out.append((c, workload.skew(histogram), len(cuts), gain))
    return spark.createDataFrame(out, "column string, skew double, cuts int, reduction double")


@registered(f"""
WITH RECURSIVE {_LOG_SQL}, widths AS (
  SELECT query_no, coalesce(q_hi - q_lo, 1e6) AS q, coalesce(d_hi - d_lo, 1e6) AS d FROM log
), scaled AS (
  SELECT query_no, (q - min(q) OVER ()) / greatest(max(q) OVER () - min(q) OVER (), 1) AS q, (d - min(d) OVER ()) / greatest(max(d) OVER () - min(d) OVER (), 1) AS d FROM widths
), near AS (
  SELECT a.query_no AS a, b.query_no AS b FROM scaled a JOIN scaled b ON sqrt(pow(a.q - b.q, 2) + pow(a.d - b.d, 2)) <= 0.2
), reach AS (
  SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a
)
SELECT CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS type, query_no FROM (SELECT a AS query_no, min(b) AS root FROM reach GROUP BY 1)
""")
def query_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dims(spark, sf_dir)
    kinds = workload.query_types(_workload(df), DIMS)
    return spark.createDataFrame([(k, q) for k, own in enumerate(kinds) for q in own], "type int, query_no int")


_ZBOX = "l_quantity BETWEEN 12 AND 18 AND l_extendedprice BETWEEN 15000 AND 25000"


@registered(f"SELECT count(*) AS count_all, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE {_ZBOX}")
def zorder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dims(spark, sf_dir)
    table = ZOrderTable.build(df, ["l_quantity", "l_extendedprice"], fresh_path(spark, "zorder"))
    out = table.query(read_query(df, f"SELECT COUNT(*), SUM(l_extendedprice) FROM data WHERE {_ZBOX}"))
    return out.select("count_all", F.round("sum_l_extendedprice", 2).alias("total"))


@registered("""
WITH l AS (SELECT CAST(floor(l_quantity / 51.0 * 3) AS BIGINT) AS a, CAST(floor(l_discount / 0.2 * 3) AS BIGINT) AS b FROM lineitem)
SELECT (a & 1) | ((b & 1) << 1) | (((a >> 1) & 1) << 2) | (((b >> 1) & 1) << 3) AS z, count(*) AS n FROM l GROUP BY 1
""")
def zorder_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = zcode(["l_quantity", "l_discount"], {"l_quantity": (0.0, 51.0), "l_discount": (0.0, 0.2)}, 2)
    return lineitem(spark, sf_dir).groupBy(code.alias("z")).agg(F.count(F.lit(1)).alias("n"))


def _fixed_tree() -> Node:
    box = {"l_quantity": (1.0, 50.0), "l_extendedprice": (0.0, 110000.0)}
    right = Node(box | {"l_quantity": (25.0, 50.0)}, "l_extendedprice", [30000.0], [Node(box, region=1), Node(box, region=2)])
    return Node(box, "l_quantity", [25.0], [Node(box, region=0), right])


_REGION = "CASE WHEN l_quantity < 25 THEN 0 WHEN l_extendedprice < 30000 THEN 1 ELSE 2 END"


@registered(f"SELECT CAST({_REGION} AS INTEGER) AS region_id, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dims(spark, sf_dir).withColumn("region_id", region_column(_fixed_tree()))
    return df.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


_OPTIONS = LayoutOptions(tree=TreeOptions(max_depth=3), max_cells=256)
_layouts: dict[tuple[str, str], Layout] = {}


def layout_of(spark: SparkSession, sf_dir: str) -> Layout:
    """The layout of one directory's lineitem, built once a session: it is an index, and queries share it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _layouts:
        df = dims(spark, sf_dir)
        _layouts[key] = build_layout(df, DIMS, _workload(df), fresh_path(spark, "layout"), _OPTIONS)
    return _layouts[key]


_IBOX = "l_quantity BETWEEN 22 AND 41 AND l_extendedprice >= 30000 AND ship_day <= 9500"
_FIVE = "COUNT(*), SUM(l_extendedprice), AVG(l_quantity), MIN(l_partkey), MAX(ship_day)"
_FIVE_SQL = "count(*) AS count_all, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS mean, CAST(min(l_partkey) AS DOUBLE) AS least, max(ship_day) AS most"


def _five(answer: DataFrame) -> DataFrame:
    return answer.select("count_all", F.round("sum_l_extendedprice", 2).alias("total"), F.round("avg_l_quantity", 6).alias("mean"), F.col("min_l_partkey").alias("least"), F.col("max_ship_day").alias("most"))


@registered(f"SELECT {_FIVE_SQL} FROM {ROWS_SQL} WHERE {_IBOX}")
def indexed_range_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dims(spark, sf_dir)
    return _five(rewrite.answer(layout_of(spark, sf_dir), read_query(df, f"SELECT {_FIVE} FROM data WHERE {_IBOX}")))


@registered(f"SELECT {_FIVE_SQL} FROM {ROWS_SQL} WHERE l_quantity = 1 AND l_extendedprice <= 1500")
def indexed_edge_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dims(spark, sf_dir)
    return _five(rewrite.answer(layout_of(spark, sf_dir), read_query(df, f"SELECT {_FIVE} FROM data WHERE l_quantity = 1 AND l_extendedprice <= 1500")))


@registered(f"SELECT {_FIVE_SQL} FROM {ROWS_SQL} WHERE l_quantity >= 99")
def indexed_empty_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dims(spark, sf_dir)
    return _five(rewrite.answer(layout_of(spark, sf_dir), read_query(df, f"SELECT {_FIVE} FROM data WHERE l_quantity >= 99")))


@registered("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem")
def cell_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = layout_of(spark, sf_dir).cells
    return cells.agg(F.sum("n").alias("n"), F.round(F.sum("sum_l_extendedprice"), 2).alias("total"), F.min("min_l_quantity").alias("least"), F.max("max_l_quantity").alias("most"))


@registered(f"SELECT {_FIVE_SQL} FROM {ROWS_SQL} WHERE l_quantity <= 40")
def cube_merge_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dims(spark, sf_dir)
    return _five(rewrite.answer(layout_of(spark, sf_dir), read_query(df, f"SELECT {_FIVE} FROM data WHERE l_quantity <= 40")))


@registered()
def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_of(spark, sf_dir).describe()


@registered()
def layout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_of(spark, sf_dir).stats()


@registered()
def layout_scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.scan_metrics(layout_of(spark, sf_dir), read_query(dims(spark, sf_dir), f"SELECT COUNT(*) FROM data WHERE {_IBOX}"))


@registered(f"SELECT count(*) AS n FROM {ROWS_SQL} WHERE {_IBOX}")
def indexed_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rewrite.row_ids(layout_of(spark, sf_dir), read_query(dims(spark, sf_dir), f"SELECT COUNT(*) FROM data WHERE {_IBOX}"))
    return found.agg(F.count_distinct("_row_id").alias("n"))


def _delta(spark: SparkSession, sf_dir: str, base: str = "true") -> DeltaTable:
    df = dims(spark, sf_dir).filter(base)
    return DeltaTable(build_layout(df, DIMS, _workload(df), fresh_path(spark, "delta"), _OPTIONS))


@registered(f"SELECT {_FIVE_SQL} FROM {ROWS_SQL} WHERE {_IBOX}")
def delta_insert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, df = _delta(spark, sf_dir, "l_partkey >= 20"), dims(spark, sf_dir)
    table.insert(df.filter("l_partkey < 20"))
    return _five(table.query(read_query(df, f"SELECT {_FIVE} FROM data WHERE {_IBOX}")))


@registered(f"SELECT {_FIVE_SQL} FROM {ROWS_SQL} WHERE {_IBOX} AND NOT (l_quantity = 30 AND l_partkey % 2 = 0)")
def delta_delete_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, df = _delta(spark, sf_dir), dims(spark, sf_dir)
    table.delete(table.live().filter("l_quantity = 30 AND l_partkey % 2 = 0"))
    return _five(table.query(read_query(df, f"SELECT {_FIVE} FROM data WHERE {_IBOX}")))


@registered(f"""
SELECT {_FIVE_SQL} FROM (SELECT CASE WHEN l_quantity = 30 THEN 35.0 ELSE l_quantity END AS l_quantity, l_extendedprice, l_partkey, ship_day FROM {ROWS_SQL}) WHERE {_IBOX}
""")
def delta_update_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, df = _delta(spark, sf_dir), dims(spark, sf_dir)
    table.update(table.live().filter("l_quantity = 30").withColumn("l_quantity", F.lit(35.0)))
    return _five(table.query(read_query(df, f"SELECT {_FIVE} FROM data WHERE {_IBOX}")))


@registered(f"SELECT {_FIVE_SQL} FROM {ROWS_SQL} WHERE {_IBOX}")
def delta_mixed_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows put in by a plain insert, then by a stream, then by an insert again: all of them count."""
    table, df = _delta(spark, sf_dir, "l_partkey >= 20"), dims(spark, sf_dir)
    source = fresh_path(spark, "stream")
    df.filter("l_partkey >= 5 AND l_partkey < 12").write.parquet(source)
    table.insert(df.filter("l_partkey >= 12 AND l_partkey < 20"))
    stream_inserts(spark.readStream.schema(df.schema).parquet(source), table, fresh_path(spark, "checkpoint")).awaitTermination()
    table.insert(df.filter("l_partkey < 5"))
    return _five(table.query(read_query(df, f"SELECT {_FIVE} FROM data WHERE {_IBOX}")))


@registered(f"SELECT {_FIVE_SQL} FROM {ROWS_SQL} WHERE {_IBOX} AND l_partkey % 7 <> 0 AND l_partkey % 11 <> 0")
def indexed_with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with NaN or null in a dimension are cleaned before a layout is built: the layout refuses them."""
    key, df = F.col("l_partkey"), dims(spark, sf_dir)
    odd = df.withColumn("l_quantity", F.when(key % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))).withColumn("l_partkey", F.when(key % 11 != 0, key))
    fit = tables.clean(odd)
    layout = build_layout(fit, DIMS, _workload(fit), fresh_path(spark, "clean"), _OPTIONS)
    return _five(rewrite.answer(layout, read_query(fit, f"SELECT {_FIVE} FROM data WHERE {_IBOX}")))


@registered(f"SELECT {_FIVE_SQL} FROM {ROWS_SQL} WHERE {_IBOX}")
def delta_compact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, df = _delta(spark, sf_dir, "l_partkey >= 20"), dims(spark, sf_dir)
    table.insert(df.filter("l_partkey < 20"))
    table = table.compact(fresh_path(spark, "compact"), _workload(df), force=True, options=_OPTIONS)
    return _five(table.query(read_query(df, f"SELECT {_FIVE} FROM data WHERE {_IBOX}")))


@registered()
def batch_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dims(spark, sf_dir)
    return batch.latency_percentiles(batch.run_group(layout_of(spark, sf_dir), df, _workload(df)))

"""Reading and preparing numeric tables: readers, features, cleaning, eligibility, sampling, synthetic data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeloom.plans.model import QueryError
from rangeloom.sources.shared import fresh_path

DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def read(spark: SparkSession, path: str, max_rows: int | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV, Parquet, ORC, JSON or Excel file as it is; ``max_rows`` holds for every format."""
    kind = re.sub(r".*\.", "", path.rstrip("/")).lower()
    if kind == "csv":
        df = spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)
    elif kind in ("parquet", "pq", "orc", "json"):
        reader = spark.read.schema(schema) if schema else spark.read
        df = {"parquet": reader.parquet, "pq": reader.parquet, "orc": reader.orc, "json": reader.json}[kind](path)
    elif kind in ("xlsx", "xls"):
        import pandas as pd

        try:
            df = spark.createDataFrame(pd.read_excel(path, nrows=max_rows))
        except ImportError as e:
            raise QueryError(f"reading {path} needs an Excel engine: {e}") from e
    else:
        raise QueryError(f"unknown kind of file: {path}")
    return df.limit(max_rows) if max_rows is not None else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def with_datetime_features(df: DataFrame, parse_text: bool = True) -> DataFrame:
    """Each date or time becomes hour, day of week (Monday 0), month and epoch seconds; text that parses counts as time."""
    out: list[Column] = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if parse_text and isinstance(f.dataType, T.StringType):
            col = F.try_to_timestamp(col)
        elif not isinstance(f.dataType, DATES):
            out.append(col)
            continue
        seconds = F.unix_timestamp(col.cast("timestamp")) if not isinstance(f.dataType, T.DateType) else F.unix_date(col) * 86400
        parts = {"hour": F.hour(col.cast("timestamp")), "dayofweek": F.weekday(col), "month": F.month(col), "epoch": seconds}
        out += [v.cast("double").alias(f"{f.name}_{k}") for k, v in parts.items()]
    return df.select(*out)


def sanitised_names(names: list[str]) -> list[str]:
    """Letters, digits and underscores only; clashes get a number."""
    out: list[str] = []
    for k, name in enumerate(names):
        plain = re.sub(r"\W", "", re.sub(r"[ -]", "_", name), flags=re.ASCII) or f"col_{k}"
        n, unique = 1, plain
        while unique.lower() in (x.lower() for x in out):
            n, unique = n + 1, f"{plain}_{n + 1}"
        out.append(unique)
    return out


def clean(df: DataFrame) -> DataFrame:
    """Numeric columns as doubles; infinities and NaN count as null; all-null columns go, then rows with any null."""
    names = numeric_columns(df)
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    df = df.select(*[F.when(~bad(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(c) for c in names])
    counts = df.agg(*[F.count(f"`{c}`").alias(str(k)) for k, c in enumerate(names)]).first() if names else None
    kept = [c for k, c in enumerate(names) if counts[str(k)]]
    return df.select(*[F.col(f"`{c}`") for c in kept]).na.drop() if kept else df.limit(0)


@dataclass(frozen=True)
class Eligibility:
    """A column makes a dimension if no value is too common and it has enough distinct ones."""

    top_share: float = 0.75
    least_distinct: int = 50


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, distinct, top_share, lo, hi of each column; one aggregation for all of them."""
    columns = columns or numeric_columns(df)
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])).alias("p")).select("p.*")
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("column").agg(
        F.sum("k").alias("n"),
        F.count("value").alias("distinct"),
        (F.max(F.when(F.col("value").isNotNull(), F.col("k"))) / F.sum("k")).alias("top_share"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )


def eligible_columns(df: DataFrame, rule: Eligibility = Eligibility(), columns: list[str] | None = None) -> DataFrame:
    """The profile with a verdict for each column."""
    ok = (F.col("top_share") < rule.top_share) & (F.col("distinct") >= rule.least_distinct)
    return column_profile(df, columns).withColumn("eligible", F.coalesce(ok, F.lit(False)))


def load_numeric(spark: SparkSession, path: str, max_rows: int | None = None, rule: Eligibility | None = Eligibility()) -> DataFrame:
    """A file as a table of dimensions: features, numbers, clean rows, plain names, eligible columns."""
    df = read(spark, path, max_rows)
    df = clean(with_datetime_features(df))
    df = df.toDF(*sanitised_names(df.columns))
    if rule:
        good = {r["column"] for r in eligible_columns(df, rule).filter("eligible").collect()}  # a row a column
        if not good:
            raise QueryError(f"no column of {path} makes a dimension")
        df = df.select(*[c for c in df.columns if c in good])
    return df


#: Buckets of random numbers in an exact sample: only rows of one of them are cut by a limit.
DRAWS = 1 << 16


def _exactly(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """A random sample of exactly ``rows`` rows, without a sort: whole buckets of random numbers, and a part of one more.

    The numbers are drawn once and written, so that both passes see the same ones.
    """
    path = fresh_path(df.sparkSession, "draws")
    df.withColumn("_draw", F.floor(F.rand(seed) * DRAWS).cast("int")).write.parquet(path)
    drawn = df.sparkSession.read.parquet(path)
    left, cut = rows, DRAWS
    for r in drawn.groupBy("_draw").count().orderBy("_draw").collect():  # a row a bucket
        if r["count"] > left:
            cut = r["_draw"]
            break
        left -= r["count"]
    whole = drawn.filter(F.col("_draw") < cut)
    return (whole.unionByName(drawn.filter(F.col("_draw") == cut).limit(left)) if left and cut < DRAWS else whole).drop("_draw")


def resized(df: DataFrame, rows: int, seed: int = 42, jitter: float = 0.01) -> DataFrame:
    """Exactly ``rows`` rows: a sample of a larger table, or copies of a smaller one with noise of jitter * deviation.

    An empty table stays empty.
    """
    n = df.count()
    if rows == n or not n:
        return df
    if rows < n:
        return _exactly(df, rows, seed)
    names = numeric_columns(df)
    spread = df.agg(*[F.stddev_pop(f"`{c}`").alias(str(k)) for k, c in enumerate(names)]).first()
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(-(-rows // n)))))
    noisy = [(F.col(f"`{c}`") + F.randn(seed + k) * (jitter * (spread[str(names.index(c))] or 0.0))).alias(c) if c in names else F.col(f"`{c}`") for k, c in enumerate(df.columns)]
    return _exactly(copies.select(*noisy), rows, seed)


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


@dataclass(frozen=True)
class Dimension:
    """A column of a synthetic table: its range, how it follows hidden factors, and how far its values crowd at the low end.

    A loading of 1 makes the column a function of its factor; what the loadings leave is noise of its own.
    """

    lo: float
    hi: float
    loads: dict[str, float] = field(default_factory=dict)
    crowding: float = 1.0


def synthetic(spark: SparkSession, rows: int, seed: int, dims: dict[str, Dimension]) -> DataFrame:
    """Rows of correlated dimensions: standard normal factors are mixed, flattened to 0..1, bent and stretched to the range."""
    factors = sorted({f for d in dims.values() for f in d.loads})
    df = spark.range(rows).select(*[F.randn(seed + k).alias(f"_{f}") for k, f in enumerate(factors)], F.lit(0).alias("_"))
    out = []
    for k, (name, d) in enumerate(dims.items()):
        own = max(0.0, 1.0 - sum(w * w for w in d.loads.values())) ** 0.5
        mixed = own * F.randn(seed + len(factors) + k)
        for f, w in d.loads.items():
            mixed = mixed + w * F.col(f"_{f}")
        flat = 1 / (1 + F.exp(-1.702 * mixed))  # close to the normal distribution's own function
        out.append((d.lo + (d.hi - d.lo) * F.pow(flat, F.lit(d.crowding))).alias(name))
    return df.select(*out)


#: The ranges are fixed values of the published tables.
HOUSING = {
    "MedInc": Dimension(0.5, 15.0, {"wealth": 0.9}, 2.5),
    "HouseAge": Dimension(1.0, 52.0),
    "AveRooms": Dimension(0.8, 20.0, {"size": 0.9}, 2.5),
    "AveBedrms": Dimension(0.3, 5.0, {"size": 0.85}, 2.5),
    "Population": Dimension(3.0, 10_000.0, {}, 4.0),
    "AveOccup": Dimension(0.7, 20.0, {}, 3.0),
    "Latitude": Dimension(32.54, 41.95, {"north": 0.95}),
    "Longitude": Dimension(-124.35, -114.31, {"north": -0.85}),
    "MedHouseVal": Dimension(0.15, 5.0, {"wealth": 0.75, "north": 0.1}, 1.5),
}
TRIPS = {
    "Latitude": Dimension(40.6, 40.85, {"up": 0.95}),
    "Longitude": Dimension(-74.05, -73.75, {"east": 0.95}, 1.5),
    "dropoff_lat": Dimension(40.6, 40.85, {"up": 0.9}),
    "dropoff_lon": Dimension(-74.05, -73.75, {"east": 0.9}, 1.5),
    "trip_distance": Dimension(0.1, 30.0, {"way": 0.999}, 3.5),
    "fare_amount": Dimension(2.5, 150.0, {"way": 0.995}, 3.5),
    "tip_amount": Dimension(0.0, 40.0, {"way": 0.9}, 4.0),
    "passenger_count": Dimension(1.0, 6.99, {}, 3.0),
    "duration_min": Dimension(1.0, 120.0, {"way": 0.93}, 3.0),
}


def synthetic_housing(spark: SparkSession, rows: int = 200_000, seed: int = 42) -> DataFrame:
    """Housing blocks: value follows income, bedrooms follow rooms, and the coast runs from north-west to south-east."""
    return synthetic(spark, rows, seed, HOUSING)


def synthetic_trips(spark: SparkSession, rows: int = 200_000, seed: int = 7) -> DataFrame:
    """Taxi trips whose fare follows distance, tip follows fare, and drop-off follows pick-up; the total is fare, tip and a fee."""
    df = synthetic(spark, rows, seed, TRIPS).withColumn("passenger_count", F.floor("passenger_count").cast("double"))
    return df.withColumn("total_amount", F.least(F.col("fare_amount") + F.col("tip_amount") + F.rand(seed - 1), F.lit(200.0)))


def synthetic_forest(spark: SparkSession, rows: int = 200_000, seed: int = 11) -> DataFrame:
    """Forest plots: slope and distances vary with elevation; the ranges of each column are fixed values."""
    df = spark.range(rows).select(_clip(2959 + 280 * F.randn(seed), 1863.0, 3858.0).alias("Elevation"), (360 * F.rand(seed + 1)).alias("Aspect"))
    high = (F.col("Elevation") - 1863) / 1995
    df = df.withColumn("Slope", _clip(8 + 12 * high + 6 * F.randn(seed + 2), 0.0, 66.0))
    df = df.withColumns({
        "Horiz_Dist_Hydrology": _clip(-180 * F.log(1 - F.rand(seed + 3)) * (0.5 + high), 0.0, 1397.0),
        "Horiz_Dist_Roadways": _clip(-2300 * F.log(1 - F.rand(seed + 4)) * (0.3 + high), 0.0, 7117.0),
        "Horiz_Dist_Fire_Points": _clip(-1900 * F.log(1 - F.rand(seed + 5)), 0.0, 7173.0),
    })
    light = F.cos(F.radians(F.col("Aspect") - 120)) * F.sin(F.radians("Slope"))
    return df.withColumns({
        "Vert_Dist_Hydrology": _clip(0.2 * F.col("Horiz_Dist_Hydrology") + 35 * F.randn(seed + 6), -173.0, 601.0),
        "Hillshade_9am": _clip(212 + 90 * light + 5 * F.randn(seed + 7), 0.0, 254.0),
        "Hillshade_Noon": _clip(224 - 60 * F.sin(F.radians("Slope")) + 5 * F.randn(seed + 8), 0.0, 254.0),
        "Hillshade_3pm": _clip(142 - 110 * light + 5 * F.randn(seed + 9), 0.0, 254.0),
    })

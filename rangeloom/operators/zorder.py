"""A table clustered along a Z-order curve, queried by code range and exact filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.morton import bits_for, zcode, zrange
from rangeloom.operators.execute import aggregate
from rangeloom.plans.model import RangeQuery, bounds_of


class ZOrderTable:
    """Rows sorted by code, so that a file's footers tell which codes it holds."""

    def __init__(self, df: DataFrame, columns: Sequence[str], bounds: dict[str, tuple[float, float]]):
        self.df, self.columns, self.bounds, self.bits = df, list(columns), bounds, bits_for(len(columns))

    @staticmethod
    def build(df: DataFrame, columns: Sequence[str], path: str, partitions: int | None = None) -> ZOrderTable:
        columns = list(columns)
        bounds = bounds_of(df, columns)
        coded = df.withColumn("_z", zcode(columns, bounds))
        dealt = coded.repartitionByRange(partitions, "_z") if partitions else coded.repartitionByRange("_z")
        dealt.sortWithinPartitions("_z").write.mode("overwrite").parquet(path)
        return ZOrderTable(df.sparkSession.read.schema(coded.schema).parquet(path), columns, bounds)

    def candidates(self, query: RangeQuery) -> DataFrame:
        """The rows whose code lies in the box's range of codes."""
        lo, hi = zrange(self.columns, self.bounds, query.where.ranges, self.bits)
        return self.df.filter(F.col("_z").between(lo, hi))

    def query(self, query: RangeQuery) -> DataFrame:
        return aggregate(self.candidates(query), query)

"""Inserts, updates and deletes over a layout: appended rows, tombstones, merged reads, and compaction."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.plans.layout import Layout, LayoutOptions, build_layout, refuse_odd
from rangeloom.plans.model import RangeQuery
from rangeloom.plans.rewrite import answer
from rangeloom.plans.tree import region_column
from rangeloom.sources.shared import exists


@dataclass(frozen=True)
class MergePolicy:
    rows: int = 5000
    seconds: float = 300
    share: float = 0.10


@dataclass
class DeltaTable:
    """A layout with pending changes beside it, each batch a folder of its own: a lost task is simply run again.

    A new row's id is its batch's name and its place there, so writers need not know of each other, and no id meets
    another one's. Inserts and streams write alike (``delta/batch=NAME``).
    """

    layout: Layout
    policy: MergePolicy = MergePolicy()
    merged_at: float = field(default_factory=time.time)

    def _read(self, name: str) -> DataFrame | None:
        path = f"{self.layout.path}/{name}"
        return self.layout.spark.read.parquet(path).drop("batch") if exists(self.layout.spark, path) else None

    @property
    def delta(self) -> DataFrame | None:
        """Pending rows that have not been deleted again."""
        found, gone = self._read("delta"), self.tombstones
        return found if found is None or gone is None else found.join(gone.select("_row_id"), "_row_id", "left_anti")

    @property
    def tombstones(self) -> DataFrame | None:
        return self._read("tombstones")

    def put(self, rows: DataFrame, batch: str) -> DataFrame:
        """Write rows (with the layout's columns) as one batch, each routed to its region; a batch of that name is replaced."""
        path = f"{self.layout.path}/delta/batch={batch}"
        ids = F.concat(F.lit(f"{batch}-"), F.monotonically_increasing_id().cast("string"))
        placed = rows.select(*self.layout.columns).withColumn("_row_id", ids).withColumn("region_id", region_column(self.layout.tree).cast("int"))
        refuse_odd(placed, self.layout.columns)
        placed.write.mode("overwrite").parquet(path)
        return self.layout.spark.read.schema(placed.schema).parquet(path)

    def insert(self, rows: DataFrame) -> DataFrame:
        """Append rows; returns them with their ids."""
        return self.put(rows, f"i{uuid.uuid4().hex}")

    def live(self) -> DataFrame:
        """Main rows without deleted ones, and pending rows."""
        columns, gone, pending = [*self.layout.columns, "_row_id"], self.tombstones, self.delta
        out = self.layout.main.select(*[c for c in self.layout.main.columns if c not in ("region_id", "cell_id", "cell_key")])
        if gone is not None:
            out = out.join(gone.select("_row_id"), "_row_id", "left_anti")
        return out.select(*columns) if pending is None else out.select(*columns).unionByName(pending.select(*columns))

    def delete(self, ids: DataFrame) -> None:
        """Mark the rows with the given _row_id as deleted; unknown and repeated ids do nothing."""
        wanted = ids.select("_row_id").distinct()
        main = self.layout.main.select("_row_id", "region_id", "cell_id").join(wanted, "_row_id", "left_semi")
        pending = self._read("delta")
        if pending is not None:
            main = main.unionByName(pending.join(wanted, "_row_id", "left_semi").select("_row_id", "region_id", F.lit(-1).alias("cell_id")))
        main.write.mode("append").parquet(f"{self.layout.path}/tombstones")

    def update(self, rows: DataFrame) -> DataFrame:
        """Replace the rows of the given _row_id: tombstones, and new rows routed by their new values."""
        self.delete(rows)
        return self.insert(rows.drop("_row_id"))

    def query(self, query: RangeQuery) -> DataFrame:
        return answer(self.layout, query, self.tombstones, self.delta)

    def pending(self) -> int:
        return sum(x.count() for x in (self._read("delta"), self.tombstones) if x is not None)

    def due(self) -> bool:
        n = self.pending()
        return n > 0 and (n >= self.policy.rows or n >= self.policy.share * self.layout.rows or time.time() - self.merged_at >= self.policy.seconds)

    def compact(self, path: str, queries: list[RangeQuery] = (), force: bool = False, options: LayoutOptions = LayoutOptions()) -> DeltaTable:
        """Where the policy (or ``force``) asks for it, a new layout of the live rows at another path; else this one."""
        if not (force or self.due()):
            return self
        return DeltaTable(build_layout(self.live().drop("_row_id"), self.layout.columns, list(queries), path, options), self.policy)

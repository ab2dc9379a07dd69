"""Connected components by alternating large and small stars; links stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import discard, written

#: Rows of a node that one task may hold at least, and nodes of more rows at most (their splits are broadcast).
ROWS, HOT_NODES = 256, 20_000


def _with_least(links: DataFrame, key: str, other: str, rows: int) -> DataFrame:
    """Each row with its key's least other end, m. Keys of many rows are split, so that no task gathers one of them."""
    most = max(ROWS, 2 * rows // HOT_NODES)
    least = links.groupBy(key).agg(F.min(other).alias("m"), F.ceil(F.count("*") / most).alias("splits"))
    hot = F.broadcast(least.filter("splits > 1").select(key, F.col("splits").alias("own")))  # HOT_NODES rows at most
    dealt = links.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("own", F.lit(1)))).drop("own")
    spread = least.select(key, "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("salt"))
    return dealt.join(spread, [key, "salt"])


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Join each node's larger neighbours to its smallest neighbour (or itself)."""
    around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = _with_least(around, "a", "b", 2 * rows).filter("b > a")
    return found.select(F.least("m", "a").alias("a"), "b").filter("a < b").distinct()


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Join each node and its smaller neighbours to the smallest of them."""
    found = _with_least(links, "b", "a", rows)
    up = F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))
    return found.select(F.explode(up).alias("s")).select("s.*").filter("a < b").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node and component (the smallest node reachable) of every node of links (a, b); a < b or b < a. Written.

    Null ends and self links are ignored, repeated links count once, and no links give no rows. Each round's links are
    written to the shared folder and those before deleted. Nodes of many links are split by salts, their number is bounded
    by what counts as many.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = F.struct(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)))
    before = links.select(mark.alias("m")).first()["m"]
    for _ in range(most):
        if before[0] == 0:
            break
        old, links = links, written(_small_star(_large_star(links, before[0]), before[0]))
        discard(old)
        now = links.select(mark.alias("m")).first()["m"]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    nodes = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    out = written(nodes.unionByName(links.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))))
    discard(links)
    return out

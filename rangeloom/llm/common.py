"""What the operators share: reading tables, cutting lineage in the shared folder, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.sources.shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table. Only Spark's readers touch the path, so any store will do."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    Lost executors cost only the tasks they ran: the files stay readable for every other one.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "stage")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of written frames, once nothing that is still to be computed reads them."""
    for df in frames:
        path = getattr(df, "_stage_path", None)
        if path:
            own = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(own, True)


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts. A null id has no fold (null)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 7) -> DataFrame:
    """About ``bound`` rows of df at most, chosen by a hash of the key: the same rows on each run and at each cluster size."""
    n = df.count()
    if n <= bound:
        return df
    cut = int(bound / n * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < cut)


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column of a table has it."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
        used.add(name.lower())
    return out

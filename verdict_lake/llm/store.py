"""Intermediate tables in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder, workers_find_package

#: A table is broadcast only if it was counted and, with ROW_BYTES a row and 8 a column, is no larger than this.
BROADCAST_BYTES, ROW_BYTES = 64_000_000, 16
#: The settings of an Arrow batch, Spark's own values and ours.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}
#: Spark types of 8 bytes at most, of which such a table consists.
FLAT = ("bigint", "int", "double", "boolean")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: short lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that stored() made, once nothing reads it any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder_ in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop(folder_)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_not(df: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint if its counted rows are within BROADCAST_BYTES; beyond that, and where a column
    has no fixed size, Spark joins it by a shuffle."""
    if any(kind not in FLAT for _, kind in df.dtypes):
        return df
    return F.broadcast(df) if df.count() * (ROW_BYTES + 8 * len(df.columns)) <= BROADCAST_BYTES else df


def python_ready(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts still fits a worker, unless the caller has set their size; and
    workers that find this package where it runs from a checkout."""
    for key, (usual, ours) in BATCH.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, ours)
    workers_find_package(spark)


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns of docs and all others as one struct, rest, so that no name of theirs meets an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*others) if others else F.lit(None)).alias("rest"))


def unpacked(df: DataFrame, docs: DataFrame, *used: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The columns of docs, and more, of what became of packed(docs, *used). Columns of docs named as one of more are left out."""
    own = [F.col(c) if c in used else F.col("rest").getField(c).alias(c) for c in docs.columns if c not in more]
    return df.select(*own, *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

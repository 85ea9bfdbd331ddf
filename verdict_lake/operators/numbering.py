"""Running numbers in a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_folder


def numbered(df: DataFrame, *order: str, name: str = "n", parts: int | None = None) -> DataFrame:
    """df with name: 1, 2, ... in the order given.

    Rows are range-partitioned and written to the shared folder, as a second partitioning need not have the same bounds;
    each partition's count gives the next one's offset (a row a partition), and rows are numbered within their own. The
    order must have no ties if numbers are to be the same each time.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_folder(spark)
    df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # at most parts rows
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, own + F.col("_before")).drop("_part", "_before")


def display_index(n: str = "n"):
    return F.format_string("meme_%05d", F.col(n).cast("int"))

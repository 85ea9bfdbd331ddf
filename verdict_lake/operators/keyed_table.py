"""A stored table that merges change bucket by bucket.

Rows lie in folders by a hash of their key. A merge reads the buckets of its updates alone, works out what they become by
operators.merge, and replaces those in which a row is really another; all other files stay as they are, by name. A merge
that changes nothing writes nothing, so that it may run again after it broke off.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from .merge import delete_keys, merge

BUCKETS = 256


class KeyedTable:
    """The table under path with these columns, keys among them; buckets stays the same for its life."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        self.kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
        self.columns = list(self.kinds)

    def _typed(self, rows: DataFrame) -> DataFrame:
        """rows with the table's types: the hash of a number depends on its type."""
        return rows.select(*(F.col(c).cast(self.kinds[c]).alias(c) if c in self.kinds else F.col(c) for c in rows.columns))

    def bucket(self) -> Column:
        """The bucket of a row: by its key, or by all of it where a key is null, as such rows meet no others."""
        whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in self.keys))
        return F.pmod(F.when(whole, F.xxhash64(*self.keys)).otherwise(F.xxhash64(*self.columns)), F.lit(self.buckets)).cast("int")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or the rows of some buckets, of which only the files are read."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        rows = rows if buckets is None else rows.filter(F.col("bucket").isin(*buckets))
        return rows.select(*self.columns)

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: numbers, as many as there are buckets at most."""
        return [r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]

    def _replace(self, rows: DataFrame, buckets: Sequence[int]) -> None:
        """Put rows in place of all rows of the buckets; one that gets none stays as a file without rows."""
        mine = rows.withColumn("bucket", self.bucket()).filter(F.col("bucket").isin(*buckets))
        # a bucket of which all rows are gone must be written too: Spark replaces the partitions that it gets rows for
        left = {r.bucket for r in mine.select("bucket").distinct().collect()}
        mine.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for bucket in set(buckets) - left:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _staged(self, rows: DataFrame) -> DataFrame:
        """rows written apart: what replaces a bucket must not be read from it meanwhile."""
        path = scratch_folder(self.spark)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _change(self, touched: Sequence[int], make: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """Replace the touched buckets' rows by what make makes of them where they differ; returns that, None if there is nothing."""
        if not touched:
            return None
        before = self.read(touched)
        after = self._staged(make(before))
        # each way is a row that the other side does not have, as often
        one, other = (df.select(*self.columns) for df in (before, after))
        differing = self._touched(one.exceptAll(other).unionByName(other.exceptAll(one)))
        if differing:
            self._replace(after.select(*self.columns), differing)
        return after

    def merge(self, updates: DataFrame, policy: str, order: str = "seq", **how) -> DataFrame:
        """Merge the updates as operators.merge does, and return merge_action and n: how many rows of the touched buckets it kept,
        inserted and updated. Updates under a null key are inserted each time."""
        updates = self._typed(updates)
        after = self._change(self._touched(updates), lambda rows: merge(rows, updates, self.keys, policy, order, **how))
        if after is None:
            return self.spark.createDataFrame([], "merge_action string, n long")
        return after.groupBy("merge_action").agg(F.count("*").alias("n"))

    def delete(self, gone: DataFrame) -> None:
        """Take the rows with the keys of gone away."""
        wanted = self._typed(gone.select(*self.keys)).filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in self.keys)))
        # a row of null keys lies elsewhere, and the bucket of a key asks for no other column
        keyed = wanted.select(F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")).distinct()
        self._change([r.bucket for r in keyed.collect()], lambda rows: delete_keys(rows, wanted, self.keys))

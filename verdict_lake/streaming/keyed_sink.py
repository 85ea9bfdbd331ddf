"""A table by spans of time that takes each key once, and finds its keys without being read as a whole.

Beside the rows lie a filter's words: for each span the bits of its keys, four of a key's in one of WORDS words. A key is
looked up only in the spans whose word holds its four bits, and there exactly; a batch so reads the files of those spans
alone, whatever the table has grown to. A full filter sends keys to its span's files too often, and never misses one.

A batch writes its keys' bits first, as a new version of the filter, and then its rows: a batch that broke off between the
two and runs again finds bits without rows, which cost a look and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import first_of

#: Words of 64 bits of a span's filter: 128 KB, some 120,000 keys before a span is looked at for one key in ten.
WORDS = 1 << 14


def bits(key: str) -> tuple[Column, Column]:
    """The word of a key, and its bits there."""
    one = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 'bits'), {6 * k}) & 63 as int))")
    return F.pmod(F.xxhash64(key), F.lit(WORDS)).cast("int"), one(0).bitwiseOR(one(1)).bitwiseOR(one(2)).bitwiseOR(one(3))


class KeyedTable:
    """Rows under path by since, the first day of a span; filters under path/_filters, a version each."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Versions of the filter that were written in full."""
        if not self.fs.exists(self.fs_path(f"{self.path}/_filters")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.fs_path(f"{self.path}/_filters"))]
        return sorted(int(n) for n in names if n.isdigit() and self.fs.exists(self.fs_path(f"{self.path}/_filters/{n}/_SUCCESS")))

    def _filter(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.schema("since date, word int, bits long").parquet(f"{self.path}/_filters/{versions[-1]}") if versions else None

    def spans_of(self, keys: DataFrame) -> list:
        """The first days of the spans that may hold some of the keys."""
        held = self._filter()
        if held is None:
            return []
        word, mask = bits(self.key)
        asked = keys.select(word.alias("word"), mask.alias("mask")).distinct()
        met = asked.join(held, "word").filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        return [r.since for r in met.select("since").distinct().collect()]

    def known(self, keys: DataFrame) -> DataFrame | None:
        """The table's rows in the spans that may hold some of the keys; None if there are none. Only their files are read."""
        folders = [f"{self.path}/since={since}" for since in self.spans_of(keys)]
        there = [f for f in folders if self.fs.exists(self.fs_path(f))]
        return self.spark.read.option("basePath", self.path).parquet(*there) if there else None

    def among(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose column is a key of the table."""
        found = self.known(rows.select(F.col(column).alias(self.key)))
        return rows.limit(0) if found is None else rows.join(found.select(F.col(self.key).alias(column)), column, "left_semi")

    def insert_if_absent(self, rows: DataFrame, since: Column, order: Sequence[str]) -> None:
        """Append the first row by order of each key that the table does not have."""
        columns = rows.columns
        first = first_of(rows.withColumn("_order", F.struct(*order)), [self.key], "_order").select(*columns, since.alias("since"))
        # files instead of a cache, whose shuffles would stay as long as the driver knows it
        came = f"{self.path}/_came"
        first.write.mode("overwrite").option("compression", "zstd").parquet(came)
        first = self.spark.read.schema(first.schema).parquet(came)
        if not first.isEmpty():
            known = self.known(first)
            fresh = first if known is None else first.join(known.select(self.key), self.key, "left_anti")
            self._add_bits(first)
            fresh.hint("rebalance", "since").write.mode("append").option("compression", "zstd").partitionBy("since").parquet(self.path)
        self.fs.delete(self.fs_path(came), True)

    def _add_bits(self, rows: DataFrame) -> None:
        versions = self._versions()
        word, mask = bits(self.key)
        every = rows.select("since", word.alias("word"), mask.alias("bits"))
        held = self._filter()
        every = every if held is None else held.unionByName(every)
        after = versions[-1] + 1 if versions else 0
        merged = every.groupBy("since", "word").agg(F.bit_or("bits").alias("bits"))
        # 16 bytes a word that has bits
        merged.coalesce(4).write.mode("overwrite").parquet(f"{self.path}/_filters/{after}")
        for old in versions[:-1]:
            self.fs.delete(self.fs_path(f"{self.path}/_filters/{old}"), True)

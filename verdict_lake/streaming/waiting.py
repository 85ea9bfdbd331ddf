"""Comments that wait for their posts, in files by batch, instead of the state of a join of two streams.

path/posts holds the ids of the posts of each batch, path/comments its comments that have met no post (met=false), path/clock when the
newest of each arrived. A batch looks up its comments among the posts of all batches that are kept, and the comments that wait
among its own posts alone; nothing that waits is written again. What has waited long enough is settled once, by the table of
posts, and its folder removed. A batch that runs again writes its folders again and appends nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLOCK = "batch int, comments timestamp, posts timestamp, last_comment timestamp, last_post timestamp"


class Waiting:
    """batch: the rows of a batch (is_post, post_id, arrived, and the columns of comments)."""

    def __init__(self, spark: SparkSession, path: str, wait: str, disorder: str):
        self.spark, self.path, self.wait, self.disorder = spark, path.rstrip("/"), wait, disorder
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _there(self, folder: str) -> bool:
        return self.fs.exists(self.fs_path(f"{self.path}/{folder}"))

    def _batches(self, folder: str) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.fs_path(f"{self.path}/{folder}"))] if self._there(folder) else []
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))

    def _read(self, folders: list[str], schema) -> DataFrame | None:
        there = [f"{self.path}/{f}" for f in folders if self._there(f)]
        return self.spark.read.schema(schema).parquet(*there) if there else None

    def _write(self, rows: DataFrame, folder: str, *by: str) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.path}/{folder}")

    def _remove(self, folder: str) -> None:
        self.fs.delete(self.fs_path(f"{self.path}/{folder}"), True)

    def settle(self, batch: DataFrame, n: int, known: Callable[[DataFrame], DataFrame], append: Callable[[DataFrame], None]) -> None:
        """append the comments that have met a post, and those that have waited in vain and whose post is known."""
        # parsed once
        self._write(batch, "rows")
        rows = self._read(["rows"], batch.schema)
        comment = rows.filter("not is_post").drop("is_post").schema
        posts, said = rows.filter("is_post").select("post_id"), rows.filter("not is_post").drop("is_post")
        newest = rows.groupBy("is_post").agg(F.max("arrived").alias("x")).collect()  # two rows
        came = {r.is_post: r.x for r in newest}
        before = [k for k in self._batches("comments") if k < n]
        for folder in ("comments", "posts"):
            self._remove(f"{folder}/batch={n}")
        if True in came:
            self._write(posts, f"posts/batch={n}")
        if False in came:
            met = self._read([f"posts/batch={k}" for k in self._batches("posts") if k <= n], posts.schema)
            flagged = said.withColumn("met", F.lit(False))
            if met is not None:
                flagged = said.join(met.distinct().withColumn("met", F.lit(True)), "post_id", "left").withColumn("met", F.coalesce("met", F.lit(False)))
            self._write(flagged.select(*comment.names, "met"), f"comments/batch={n}", "met")
        self._remove("rows")
        if True in came and (waited := self._read([f"comments/batch={k}/met=false" for k in before], comment)) is not None:
            append(waited.join(self._read([f"posts/batch={n}"], posts.schema), "post_id", "left_semi").select(*comment.names))
        if (found := self._read([f"comments/batch={n}/met=true"], comment)) is not None:
            append(found)
        self._remove(f"comments/batch={n}/met=true")
        self._expire(n, came, known, append, comment)

    def _expire(self, n: int, came: dict, known: Callable[[DataFrame], DataFrame], append: Callable[[DataFrame], None], comment) -> None:
        old = self._read([f"clock/batch={k}" for k in self._batches("clock") if k < n], CLOCK)
        own = self.spark.createDataFrame([(n, came.get(False), came.get(True), came.get(False), came.get(True))], CLOCK)
        every = own if old is None else old.unionByName(own)
        last = every.agg(F.max("last_comment").alias("last_comment"), F.max("last_post").alias("last_post"))
        self._write(own.drop("last_comment", "last_post").crossJoin(last).coalesce(1), f"clock/batch={n}")
        over = lambda c: f"{c} is null or coalesce(least_last - interval {self.disorder} > {c} + interval {self.wait}, false)"
        least = F.when(F.col("last_comment").isNotNull() & F.col("last_post").isNotNull(), F.least("last_comment", "last_post"))
        ages = every.select("batch", "comments", "posts").crossJoin(last.select(least.alias("least_last")))
        for k, said, posts in sorted(ages.selectExpr("batch", over("comments"), over("posts")).collect()):  # a row a batch within wait
            if said and (alone := self._read([f"comments/batch={k}/met=false"], comment)) is not None:
                append(known(alone))
            for done, folder in ((said, "comments"), (posts, "posts"), (said and posts and k < n, "clock")):
                if done:
                    self._remove(f"{folder}/batch={k}")

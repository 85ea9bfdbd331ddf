"""A text index for searches: blocks of rows by the trigrams of their texts, and the texts by block.

A row (source, key, post_id and its texts) is in one of BLOCKS blocks by a hash of its key. path/grams holds (gram, block) once, so
that it is bounded by the trigrams that there are, not by the length of all texts; path/texts holds the rows in parts, by block in
each part. Both have a folder for each version, and grow by the changed rows of each refresh. A search reads its own trigrams, and
the texts of the blocks that hold all of them alone. There each text is tested by the same ILIKE as a scan would use, and rows
that have a later version are dropped, so that trigrams of texts that have changed since, or of other rows, never add a result.

A large refresh goes in ROUNDS rounds over the parts, and a round's shuffled rows are removed before the next begins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..session import shuffles_removed, workers_find_package
from .inspect import like_any

#: Bytes of UTF-8 in a trigram, so that it is a number of 24 bits.
GRAM = 3
#: Parts of the texts; a search for few blocks reads about as many parts.
PARTS = 64
BLOCKS = 4096
#: Rows up to which a refresh is one round, and the rounds of a larger one.
ROUND_ROWS, ROUNDS = 4_000_000, 4
ROW = "source string, key string, post_id string, text string"
STORED = "source string, key string, block int, post_id string, texts array<string>, replaced boolean, version int, part int"


def texts_of(name: str, df: DataFrame, key: str, columns: Iterable[str], post: str = "post_id") -> DataFrame:
    """source, key, post_id, text: a row for each row of df, with an array of its columns to search."""
    texts = F.array(*(F.col(c).cast("string") for c in columns))
    return df.select(F.lit(name).alias("source"), F.col(key).cast("string").alias("key"), F.col(post).cast("string").alias("post_id"), texts.alias("text"))


def in_part(rows: DataFrame) -> DataFrame:
    block = F.pmod(F.xxhash64("key"), F.lit(BLOCKS)).cast("int")
    return rows.withColumn("block", block).withColumn("part", F.pmod("block", F.lit(PARTS)).cast("int"))


def byte_grams(data: np.ndarray) -> np.ndarray:
    """The number of the trigram at each byte but the last two."""
    wide = data.astype(np.int64)
    return (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]


def held_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram and block of the trigrams of batches of block and text, each once a batch."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        if ends[-1] - ends[0] < GRAM:
            continue
        grams = byte_grams(np.frombuffer(text.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]])
        lengths = np.diff(ends)
        block = np.repeat(batch.column("block").to_numpy().astype(np.int64), lengths)[: len(grams)]
        end = np.repeat(ends[1:] - ends[0], lengths)[: len(grams)]
        held = pd.unique(((block << 24) | grams)[np.arange(len(grams)) + GRAM <= end])
        yield pa.RecordBatch.from_arrays([pa.array((held & 0xFFFFFF).astype(np.int32)), pa.array((held >> 24).astype(np.int32))], ["gram", "block"])


def literal_parts(needle: str) -> list[str]:
    """The runs of literal characters of a LIKE pattern."""
    parts, at = [""], 0
    while at < len(needle):
        c = needle[at]
        if c == "\\" and at + 1 < len(needle):
            at += 1
            parts[-1] += needle[at]
        elif c in "%_":
            parts.append("")
        else:
            parts[-1] += c
        at += 1
    return [p for p in parts if p]


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, name: str) -> list[int]:
        """The values of name of the partitions in a folder."""
        path = self.fs_path(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{name}="))

    def _versions(self) -> list[int]:
        """Versions that were written in full: trigrams come last."""
        return [v for v in self._numbers("grams", "version") if self.fs.exists(self.fs_path(f"{self.path}/grams/version={v}/_SUCCESS"))]

    def _read(self, folder: str, schema: str, within: list[str]) -> DataFrame:
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{folder}")
        return rows.parquet(*(f"{self.path}/{folder}/{w}" for w in within)) if within else self.spark.createDataFrame([], schema)

    def texts(self, parts: Iterable[int] | None = None) -> DataFrame:
        """All versions of the texts, or those in some parts: then only their files are listed and read."""
        wanted = None if parts is None else set(parts)
        there = [(v, p) for v in self._versions() for p in self._numbers(f"texts/version={v}", "part") if wanted is None or p in wanted]
        return self._read("texts", STORED, [f"version={v}/part={p}" for v, p in there])

    def grams(self) -> DataFrame:
        return self._read("grams", "gram int, block int, version int", [f"version={v}" for v in self._versions()])

    def refresh(self, rows: DataFrame) -> None:
        """Bring the index to the state of rows (source, key, post_id and text, a string or an array of them); only what changed
        is written.

        Rows without a post, a key or a text are not searched; rows that are gone leave a mark without texts. Of rows of one
        source and key the smallest counts.
        """
        texts = F.array_compact("text" if isinstance(rows.schema["text"].dataType, ArrayType) else F.array("text"))
        now = in_part(rows.filter("post_id is not null and key is not null")).select("source", "key", "block", "part", "post_id", texts.alias("texts"))
        rounds = ROUNDS if rows.count() > ROUND_ROWS else 1
        for k in range(rounds):
            with shuffles_removed(self.spark):
                self._refresh_parts(now.filter(F.size("texts") > 0), k, rounds)

    def _refresh_parts(self, now: DataFrame, first: int, step: int) -> None:
        """The refresh of every step-th part from the first; a version of its own."""
        parts = list(range(first, PARTS, step))
        if not parts:
            return
        digest = F.xxhash64("post_id", "texts")
        new = F.struct("post_id", "texts")
        held = self.texts(parts)
        now = now.filter(F.pmod("part", F.lit(step)) == first).select("source", "key", "block", "part", new.alias("new"), F.lit(None).cast("struct<version:int,digest:bigint>").alias("old"))
        old = F.struct("version", F.when(F.col("texts").isNotNull(), digest).alias("digest"))
        held = held.select("source", "key", "block", "part", F.lit(None).cast(now.schema["new"].dataType).alias("new"), old.alias("old"))
        # a task has a part, and one shuffle serves the comparison and the files
        dealt = now.unionByName(held).withColumn("slot", F.expr(f"cast(part div {step} as int)")).repartitionById(len(parts), "slot")
        both = dealt.groupBy("slot", "part", "block", "source", "key").agg(F.min("new").alias("new"), F.max("old").alias("old"))
        both = both.select("part", "block", "source", "key", "new.*", F.col("old").isNotNull().alias("replaced"), F.col("old.digest").alias("old_digest"))
        changed = both.filter(~F.when(F.col("texts").isNotNull(), digest).eqNullSafe(F.col("old_digest"))).drop("old_digest")
        version = max(self._versions(), default=-1) + 1
        self._write(changed.sortWithinPartitions("part", "block"), f"texts/version={version}", "part")
        written = [f"version={version}/part={p}" for p in self._numbers(f"texts/version={version}", "part")]
        if written:
            workers_find_package(self.spark)
            # texts of a row are joined, as trigrams across them cost a look and nothing else
            lines = self._read("texts", STORED, written).filter("texts is not null").select("block", F.lower(F.array_join("texts", "\0")).alias("text"))
            found = lines.mapInArrow(held_grams, "gram int, block int").distinct()
            self._write(found.sortWithinPartitions("gram", "block"), f"grams/version={version}")

    def _write(self, rows: DataFrame, folder: str, *by: str) -> None:
        """A version that broke off is written again."""
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.path}/{folder}")

    def candidates(self, needle: str) -> DataFrame | None:
        """The blocks that hold every trigram of the needle's runs of literal characters; None if it has none."""
        # as ILIKE does: the whole pattern in lower case
        low = self.spark.range(1).select(F.lower(F.lit(needle))).first()[0]
        runs = [np.frombuffer(part.encode(), dtype=np.uint8) for part in literal_parts(low)]
        wanted = {int(g) for run in runs for g in byte_grams(run)}
        if not wanted:
            return None
        held = self.grams().filter(F.col("gram").isin(*sorted(wanted)))
        return held.groupBy("block").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted)).select("block")

    def _among(self, needle: str) -> tuple[list[int] | None, list[int] | None]:
        """The blocks, and their parts, among whose rows a search for the needle decides; None for all."""
        found = self.candidates(needle)
        blocks = None if found is None else sorted(r.block for r in found.collect())  # BLOCKS at most
        return (None, None) if blocks is None or len(blocks) == BLOCKS else (blocks, sorted({b % PARTS for b in blocks}))

    def read_for(self, needle: str) -> DataFrame:
        """The texts among which a search for the needle decides."""
        return self._texts_in(*self._among(needle))

    def _texts_in(self, blocks: list[int] | None, parts: list[int] | None) -> DataFrame:
        return self.texts() if blocks is None else self.texts(parts).filter(F.col("block").isin(*blocks))

    def search(self, needle: str) -> DataFrame:
        """post_id of posts with the needle in any of their texts, as a scan with like_any finds them."""
        rows = self._texts_in(*self._among(needle))
        hits = rows.select("source", "key", "version", "post_id", F.explode("texts").alias("text")).filter(like_any(needle, "text")).drop("text")
        later = rows.filter("replaced").select("source", "key", F.col("version").alias("later"))
        newest = hits.alias("h").join(later.alias("l"), F.expr("h.source = l.source and h.key = l.key and l.later > h.version"), "left_anti")
        return newest.select("post_id").distinct()

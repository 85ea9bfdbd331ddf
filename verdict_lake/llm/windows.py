"""Repeated windows of fixed length over sequences of units (bytes or words), found from winnowed positions.

Of the hashes of all short grams in a window the smallest marks the window's anchor (the leftmost of equals), so equal
windows have equal anchors at equal places. Neighbouring windows share an anchor: an anchor row stands for the run of
windows [low, high] that it marks, about two rows for each window length of input, instead of a row a position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rolling import BASES, Pair, Sums, U, Units, same_as, scattered
from .store import drop, small_or_not, stored

#: Window starts handled at once; positions within a stretch take the low bits of the keys.
STRETCH, LOW_BITS = 1 << 20, 21
NO_ID = -(1 << 63)

#: at: the anchor's place; a window that starts at s has offset at - s. name: the anchor's gram's hash; run and more: both
#: hashes of the text of all windows of the run and of their offsets; right and left: hashes of half a window after and
#: before the anchor. Text is only ever removed because run and more are both equal, or both hashes of a window.
ANCHOR = "doc long, body long, at long, low long, high long, name long, run long, more long, right long, left long"


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every width neighbours."""
    least, size = keys, 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    return np.minimum(least[: len(keys) - width + 1], least[width - size : len(keys) - size + 1]) if size < width else least


def anchors(units: Units, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """at, low, high, gram, run, more, right, left of a sequence, a stretch of window starts at a time."""
    half = length // 2
    for start in range(0, len(units[0]) - length + 1, STRETCH):
        part, other = (u[start : start + STRETCH + length - 1] for u in units)
        sums = Sums(part)
        grams = sums.of_width(gram)
        keys = (grams & ~U((1 << LOW_BITS) - 1)) | np.arange(len(grams), dtype=U)
        place = (sliding_least(keys, length - gram + 1) & U((1 << LOW_BITS) - 1)).astype(np.int64)
        low = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        high = np.concatenate([low[1:], [len(place)]]) - 1
        at = place[low]
        shape = scattered(((at - low) << 20 | (high - low)).astype(U))
        run = scattered(sums.hashes(low, high + length) ^ shape)
        more = Sums(other, BASES[1]).hashes(low, high + length) ^ shape
        # half windows: all windows of offset up to half hold the one on the right, the others that on the left
        n = len(part)
        has_right = (at - high <= half) & (at + half <= n)
        has_left = at - low > half
        right = np.where(has_right, sums.hashes(at, np.minimum(at + half, n)), U(0))
        left = np.where(has_left, sums.hashes(np.maximum(at - half, 0), at), U(0))
        yield at + start, low + start, high + start, grams[at], run, more, right, left


def anchor_rows(units_of: Callable[[str], Units], length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(10)]
            for doc, body, text in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist(), batch.column("text")):
                for found in anchors(units_of(text.as_py()), length, gram):
                    size = len(found[0])
                    for column, part in zip(columns, (np.full(size, doc, np.int64), np.full(size, body, np.int64), *found)):
                        column.append(part if part.dtype != U else part.view(np.int64))
            if columns[0]:
                names = [c.split()[0] for c in ANCHOR.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id, null as -2^63), body (a 64-bit hash that tells texts under one doc_id apart) and text (null as empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))


def repeats_of(texts: DataFrame) -> DataFrame:
    """doc, body, copies of keyed texts that several rows repeat; stored."""
    return stored(texts.groupBy("doc", "body").agg(F.count("*").alias("copies")).filter("copies > 1"))


def once(texts: DataFrame, repeats: DataFrame) -> DataFrame:
    """A row for each doc and body of keyed texts; only repeated ones are shuffled."""
    if repeats.isEmpty():
        return texts
    keys = small_or_not(repeats.select("doc", "body"))
    single = texts.join(keys, ["doc", "body"], "left_anti")
    many = texts.join(keys, ["doc", "body"], "left_semi").groupBy("doc", "body").agg(F.any_value("text").alias("text"))
    return single.unionByName(many)


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts compressed, for a shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("body"), pa.array(packed, pa.binary())], ["doc", "body", "packed"])


def squeezed(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(squeeze, "doc long, body long, packed binary")


def unsqueeze(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def window_hashes(units: Units, low: int, high: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the windows that start in [low, high]."""
    return tuple(Sums(u[low : high + length], base).of_width(length) for u, base in zip(units, BASES))


def covered(starts: list[int], ends: list[int], size: int) -> np.ndarray:
    """Which units any of the ranges [start, end) covers."""
    edges = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edges, np.asarray(starts, dtype=np.int64), 1)
    np.add.at(edges, np.asarray(ends, dtype=np.int64), -1)
    return np.cumsum(edges[:-1]) > 0


def with_marks(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """packed texts with the lists of their marked window runs (null: none).

    Runs whose windows touch are made one before they are listed, so that a text of n units has n / length at most.
    marks are of one row for each doc and body; only this join gives them to the repeated rows.
    """
    before = Window.partitionBy("doc", "body").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.when(F.col("low") <= F.max("high").over(before) + length, 0).otherwise(1)
    upto = Window.partitionBy("doc", "body").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = marks.withColumn("apart", apart).withColumn("span", F.sum("apart").over(upto)).groupBy("doc", "body", "span").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    listed = spans.groupBy("doc", "body").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    return squeezed(docs).join(listed, ["doc", "body"], "left")


#: Groups of at most so many pieces are settled inside one task each; larger ones block by block across tasks.
GROUP = 256
PIECE = "key long, doc long, body long, at long, low long, high long, owner long, n long, content binary"
MARK = "doc long, body long, low long, high long"
BLOCK = "name long, run long, more long, owner long, key long, doc long, body long, at long, base long, low long, high long"


class Finder:
    """Finds the windows of a fixed length that occur elsewhere, with what counts as elsewhere given by its kind.

    earlier: a window counts if an equal one starts in a document of a smaller doc_id; otherwise if an equal one starts
    anywhere else. units_of: the values of a text's units; cut: the text of a range of units.
    """

    def __init__(self, length: int, gram: int, earlier: bool, units_of: Callable[[bytes], Units], cut: Callable[[bytes, int, int], bytes]):
        self.length, self.gram, self.earlier, self.units_of, self.cut = length, gram, earlier, units_of, cut

    def owner(self):
        return F.col("doc") if self.earlier else F.xxhash64("doc", "body", "at")

    def shared(self, by: DataFrame, *keys: str, more=()) -> DataFrame:
        """The keys that occur where it counts, with their first owner and number."""
        counts = by.groupBy(*keys).agg(F.min("owner").alias("first"), F.max("owner").alias("last"), F.count("*").alias("n"), *more)
        return counts.filter("first < last" if self.earlier else "n > 1")

    def hit(self):
        """Whether a row joined to its shared key is marked."""
        return F.col("owner") > F.col("first") if self.earlier else F.col("n") > 1

    def contents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each listed piece with the units of its windows."""
        for batch in batches:
            rows: list[tuple] = []
            for doc, body, packed, pieces in zip(*(batch.column(c).to_pylist() for c in ("doc", "body", "packed", "pieces"))):
                text = unsqueeze(packed)
                for p in pieces:
                    rows.append((p["key"], doc, body, p["at"], p["low"], p["high"], p["owner"], p["n"], self.cut(text, p["low"], p["high"] + self.length)))
                if len(rows) >= 2000:
                    yield batch_of(rows, PIECE)
                    rows = []
            yield batch_of(rows, PIECE)

    def settled(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks in groups of pieces that stand together, ordered by key."""
        group: list[dict] = []
        for batch in batches:
            marks: list[tuple] = []
            for row in batch.to_pylist():
                if group and row["key"] != group[0]["key"]:
                    marks += self.marks_in(group)
                    group = []
                group.append(row)
            yield batch_of(marks, MARK)
        if group:
            yield batch_of(self.marks_in(group), MARK)

    def marks_in(self, group: list[dict]) -> list[tuple]:
        hashes = [window_hashes(self.units_of(p["content"]), 0, p["high"] - p["low"], self.length) for p in group]
        owners = np.repeat(np.array([p["owner"] for p in group], dtype=np.int64), [len(h) for h, _ in hashes])
        where, counts = same_as(*(np.concatenate(h) for h in zip(*hashes)))
        if self.earlier:
            first = np.full(len(counts), np.iinfo(np.int64).max)
            np.minimum.at(first, where, owners)
            marked = owners > first[where]
        else:
            marked = counts[where] > 1
        out, at = [], 0
        for p, (h, _) in zip(group, hashes):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], marked[at : at + len(h)].astype(np.int8), [0]])))
            out += [(p["doc"], p["body"], p["low"] + a, p["low"] + b - 1) for a, b in edges.reshape(-1, 2).tolist()]
            at += len(h)
        return out

    def blocks(self, size: int):
        """A row for each block of up to size windows of the pieces' ranges, cut by offsets, so that equal windows of
        two pieces are in blocks of one place. name: what all windows of the block's place share; run, more: all of the row's."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[tuple] = []
                for p in batch.to_pylist():
                    at = p["at"]
                    places, spans = [], []
                    for r in p["ranges"]:
                        first, last = at - r["high"], at - r["low"]
                        for b in range(first // size, last // size + 1):
                            o1, o2 = max(first, b * size), min(last, b * size + size - 1)
                            places.append((at - b * size, at - b * size - size + 1 + self.length))
                            spans.append((at - o2, at - o1 + self.length, b))
                    sums = Pair(self.units_of(p["content"]))
                    cores, wholes = (np.array([x[:2] for x in xs], dtype=np.int64) - p["low"] for xs in (places, spans))
                    key = scattered(np.array([p["key"]], dtype=np.int64).view(U) + np.array([x[2] for x in spans], dtype=U))
                    names = scattered(sums.first.hashes(cores[:, 0], cores[:, 1]) ^ key)
                    # where a row's windows lie in the block's place belongs to their name
                    shape = names ^ scattered((cores[:, 0] - wholes[:, 0]).astype(U))
                    runs, more = (scattered(h ^ shape) for h in sums.hashes(wholes[:, 0], wholes[:, 1]))
                    for name, run_, more_, (low, end, _) in zip(*(x.view(np.int64).tolist() for x in (names, runs, more)), spans):
                        rows.append((name, run_, more_, p["owner"], p["key"], p["doc"], p["body"], at, p["low"], low, end - self.length))
                yield batch_of(rows, BLOCK)

        return run

    def narrowed(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Marked rows, and those to look into further, of stored rows with name, run and owner.

        Rows whose name is not shared leave. Those whose whole run is found elsewhere are marked at once; of each kind
        of run only the first goes on, and only where its name has other runs.
        """
        ends = [f(c).alias(f"{c}_{k}") for c in ("run", "more") for k, f in enumerate((F.min, F.max))]
        names = self.shared(rows.select("name", "run", "more", "owner"), "name", more=ends)
        names = stored(names.select("name", F.expr("run_0 <> run_1 or more_0 <> more_1").alias("several")))
        seeds = stored(rows.join(small_or_not(names), "name"))
        runs = stored(seeds.groupBy("run", "more").agg(F.min("owner").alias("first"), F.count("*").alias("n")))
        joined = seeds.join(small_or_not(runs), ["run", "more"])
        whole = stored(joined.filter(self.hit()).select("doc", "body", "low", "high"))
        rest = stored(joined.filter("several and owner = first").drop("first", "n", "several", "run", "more"))
        drop(seeds)
        return whole, rest

    def large_groups(self, pieces: DataFrame) -> DataFrame:
        """Marks of pieces in groups of any size: blocks of windows are named and grouped, smaller ones each round."""
        open_ = pieces.withColumn("ranges", F.array(F.struct("low", "high")))
        sizes = sorted({max(1, self.length // 8), max(1, self.length // 64), 1}, reverse=True)
        out = None
        for size in sizes:
            whole, rest = self.narrowed(stored(open_.mapInArrow(self.blocks(size), BLOCK)))
            out = whole if out is None else out.unionByName(whole)
            if size > 1:
                ranges = rest.groupBy("key", "doc", "body", "at", F.col("base").alias("low")).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
                open_ = pieces.join(ranges, ["key", "doc", "body", "at", "low"])
        return out

    def marks(self, docs: DataFrame) -> DataFrame:
        """doc, body, low, high: runs of marked window starts of keyed documents (they may overlap).

        The rounds work on anchors, a thinned set of positions: first grams, then halves of a window, then windows are
        named by hashes and sorted by Spark into groups, and what is alone in its group leaves. Whole runs of windows
        that occur elsewhere are marked at once, so that of each kind of run only its first goes on.
        """
        rows = stored(docs.mapInArrow(anchor_rows(lambda t: self.units_of(t.encode("utf-8", "surrogatepass")), self.length, self.gram), ANCHOR))
        whole, rest = self.narrowed(rows.withColumn("owner", self.owner()))
        drop(rows)
        half = F.lit(self.length // 2)
        right = rest.filter("right <> 0").select(F.xxhash64("name", "right", F.lit(1)).alias("key"), "doc", "body", "at", F.greatest("low", F.col("at") - half).alias("low"), "high", "owner")
        left = rest.filter("left <> 0").select(F.xxhash64("name", "left", F.lit(2)).alias("key"), "doc", "body", "at", "low", F.least("high", F.col("at") - half - 1).alias("high"), "owner")
        pieces = stored(right.unionByName(left))
        keys = stored(self.shared(pieces.select("key", "owner"), "key").select("key", "n"))
        listed = pieces.join(small_or_not(keys), "key").groupBy("doc", "body").agg(F.collect_list(F.struct("key", "at", "low", "high", "owner", "n")).alias("pieces"))
        found = stored(squeezed(docs).join(listed, ["doc", "body"]).mapInArrow(self.contents, PIECE))
        tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        small = found.filter(F.col("n") <= GROUP).repartition(tasks, "key").sortWithinPartitions("key")
        large = self.large_groups(found.filter(F.col("n") > GROUP))
        return whole.unionByName(small.mapInArrow(self.settled, MARK)).unionByName(large)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

"""Exact top-k search by inner product with a table of distances to pivots.

The table holds each vector's distances to many pivots, computed once. For a query and a candidate the largest difference of
their distances to a pivot is a lower bound of their own distance, and so an upper bound of their inner product. Vectors
lie sorted by nearest pivot, so that a strip of them is tight: a query whose bound for the whole strip is below its k-th
score so far passes it by, and in the others candidates are scored in the order of their bounds until the next bound is
below the k-th score.

Queries go to the tasks in blocks of a fixed number of bytes; for each block all vectors are read once, none is shuffled, and
a task returns at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import python_ready, stored
from .vectors import gathered, matrix, with_integers

#: Pivots, and the rows among which they are picked: their choice changes the work, never a result.
PIVOTS, PICKED_FROM = 64, 2048
#: Vectors, about, that are bounded together, candidates that are scored at first, each next time four times as many, and bytes
#: of the queries in a block.
STRIP, STEP, BLOCK_BYTES = 4096, 64, 32_000_000
#: Pivots by which candidates are bounded before those below the floor go.
AT_ONCE = 16
#: Share of the largest squared distance by which a bound is raised: distances are floats, rounded by 2^-24, so that their
#: differences' squares are wrong by 2^-22 of it at most, and their halves by 2^-23.
SLACK = 2.0**-21


def squared(x: np.ndarray) -> np.ndarray:
    """Squared norms of rows of longs as doubles."""
    y = x.astype(np.float64)
    return np.einsum("ij,ij->i", y, y)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for k, p in enumerate(pivots):
        y = x.astype(np.float64) - p.astype(np.float64)
        out[:, k] = np.sqrt(np.einsum("ij,ij->i", y, y))
    return out


def picked(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those before."""
    chosen = [0]
    away = distances(rows, rows[:1])[:, 0]
    while len(chosen) < min(count, len(rows)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of longs, exact: by doubles where all sums stay below 2^53."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[-1]
    if reach < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def with_distances(pivots: np.ndarray):
    """vec_id, x, d: distances to the pivots; home, away: the nearest one and how far it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            d = distances(x, pivots) if len(x) else np.zeros((0, len(pivots)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, len(pivots), dtype=np.int32)), pa.array(d.reshape(-1)))
            home = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            columns = [batch.column("vec_id"), batch.column("x"), lists, pa.array(home.astype(np.int32)), pa.array(d.min(axis=1, initial=np.inf))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "d", "home", "away"])

    return run


class Best:
    """The k best (score, vec_id) so far of each query; ties to the smaller vec_id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * queries

    def add(self, q: int, ids: np.ndarray, found: np.ndarray) -> None:
        keep = found >= self.floor[q]
        if not keep.any():
            return
        ids, found = np.concatenate([self.ids[q], ids[keep]]), np.concatenate([self.scores[q], found[keep]])
        order = np.lexsort((ids, -found))[: self.k]
        self.ids[q], self.scores[q] = ids[order], found[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], found[order[-1]])


class Strip:
    """Vectors that are bounded together: their distances a row for each pivot, and what their scores need."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, d: np.ndarray):
        self.ids, self.x, self.norms = ids, x, squared(x)
        self.d = np.ascontiguousarray(d.T, dtype=np.float32)
        self.near, self.far = self.d.min(axis=1), self.d.max(axis=1)
        self.most = float(np.abs(x).max(initial=0))
        self.doubles = x.astype(np.float64)

    def scores(self, q: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Exact inner products of a query with some of the vectors, by doubles where all sums stay below 2^53."""
        if float(np.abs(q).max(initial=0)) * self.most * len(q) >= 2.0**53:
            return self.x[some] @ q
        if 4 * len(some) > len(self.ids):
            return (self.doubles @ q.astype(np.float64))[some].astype(np.int64)
        return (self.doubles[some] @ q.astype(np.float64)).astype(np.int64)


class Block:
    """Queries with their pivot distances and the least score that a result of theirs can have."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, d: np.ndarray, floor: np.ndarray):
        self.ids, self.x, self.d, self.floor, self.norms = ids, x, d.astype(np.float32), floor, squared(x)
        # the pivots of a query from the nearest on: they tell the most
        self.order = np.argsort(d, axis=1, kind="stable")

    def bounds(self, q: int, strip: Strip, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in a strip whose upper bound by all pivots reaches the floor, and their bounds."""
        left = np.arange(len(strip.ids))
        below = np.zeros(len(left), dtype=np.float32)
        slack = SLACK * max(float(strip.far.max()), float(self.d[q].max())) ** 2 + 0.5
        upper = np.zeros(0)
        for at in range(0, self.d.shape[1], AT_ONCE):
            pivots = self.order[q, at : at + AT_ONCE]
            d = strip.d[pivots] if len(left) == len(strip.ids) else strip.d[np.ix_(pivots, left)]
            below = np.maximum(below, np.abs(d - self.d[q, pivots, None]).max(axis=0))
            upper = (self.norms[q] + strip.norms[left] - below.astype(np.float64) ** 2) / 2 + slack
            keep = upper >= floor
            if not keep.all():
                left, below, upper = left[keep], below[keep], upper[keep]
            if not len(left):
                break
        return left, upper

    def strip_bounds(self, strip: Strip) -> np.ndarray:
        """For each query an upper bound over a whole strip, from the ranges of its distances."""
        below = np.maximum(np.maximum(strip.near - self.d, self.d - strip.far), 0).max(axis=1).astype(np.float64)
        slack = SLACK * np.maximum(float(strip.far.max()), self.d.max(axis=1).astype(np.float64)) ** 2 + 0.5
        return (self.norms + strip.norms.max() - below * below) / 2 + slack


def search(block: Block, best: Best, strip: Strip) -> None:
    """Candidates of a strip in the order of their bounds, some at a time, until no bound reaches the k-th score."""
    for q in np.flatnonzero(block.strip_bounds(strip) >= best.floor):
        left, upper = block.bounds(q, strip, best.floor[q])
        other = strip.ids[left] != block.ids[q]
        left, upper, step = left[other], upper[other], STEP
        while len(left):
            if len(left) > step:
                part = np.argpartition(-upper, step)
                some, left, upper = left[part[:step]], left[part[step:]], upper[part[step:]]
            else:
                some, left = left, left[:0]
                upper = upper[:0]
            best.add(q, strip.ids[some], strip.scores(block.x[q], some))
            keep = upper >= best.floor[q]
            left, upper, step = left[keep], upper[keep], 4 * step


def searched(block, k: int):
    """query_id, vec_id, score of the best of a task's vectors for each query of a broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        best = Best(len(b.ids), k, b.floor)
        for batch in gathered(batches, STRIP):
            if batch.num_rows:
                search(b, best, Strip(batch.column("vec_id").to_numpy(), matrix(batch.column("x")), matrix(batch.column("d"))))
        sizes = [len(i) for i in best.ids]
        if sum(sizes):
            columns = [np.repeat(b.ids, sizes), np.concatenate(best.ids), np.concatenate(best.scores)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def start_floors(ids: np.ndarray, x: np.ndarray, known_ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among some known rows under other ids; the least long where they are fewer."""
    out = np.full(len(ids), np.iinfo(np.int64).min)
    if len(known) > k:
        for at in range(0, len(ids), 1024):
            found = scores(x[at : at + 1024], known)
            found[ids[at : at + 1024, None] == known_ids[None, :]] = np.iinfo(np.int64).min
            out[at : at + 1024] = np.sort(found, axis=1)[:, -k]
    return out


def on_driver(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """vec_id and x of a bounded number of rows."""
    found = rows.select("vec_id", "x").toArrow().combine_chunks()
    return found["vec_id"].to_numpy(), matrix(found["x"].combine_chunks())


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the largest inner products for each query; ties to the smaller vec_id.

    queries, rows: vec_id (long), x (array of longs, all of one length). A row under the query's own id is no candidate; all are
    returned where there are fewer than k. Rows without an id take no part. Rows that repeat an id and a vector are one; of
    several vectors under one id as a query the smallest is the query, and each is a candidate. Empty tables give no
    rows. Inner products that pass 64 bits are not supported.
    """
    spark = rows.sparkSession
    python_ready(spark)
    rows, queries = (df.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "x") for df in (rows, queries))
    known_ids, known = on_driver(rows.orderBy(F.xxhash64("vec_id", "x")).limit(PICKED_FROM))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not len(known):
        return empty
    # a floor must hold for distinct candidates
    _, first = np.unique(np.column_stack([known_ids, known]), axis=0, return_index=True)
    known_ids, known = known_ids[first], known[first]
    pivots = picked(known, PIVOTS)
    schema = "vec_id long, x array<long>, d array<double>, home int, away double"
    table = stored(rows.distinct().mapInArrow(with_distances(pivots), schema))
    table = stored(table.repartitionByRange("home", "away", "vec_id").sortWithinPartitions("home", "away", "vec_id").select("vec_id", "x", "d"))
    per_block = max(1, BLOCK_BYTES // (8 * (known.shape[1] + len(pivots) + 8)))
    one = stored(queries.groupBy("vec_id").agg(F.min("x").alias("x")))
    blocks = -(-one.count() // per_block)
    found = None
    for number in range(blocks):
        # a block is bounded by BLOCK_BYTES but for the spread of a hash
        ids, x = on_driver(one.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number))
        if not len(x):
            continue
        sent = spark.sparkContext.broadcast(Block(ids, x, distances(x, pivots), start_floors(ids, x, known_ids, known, k)))
        part = table.mapInArrow(searched(sent, k), "query_id long, vec_id long, score long")
        part = stored(part) if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    if found is None:
        return empty
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: A query of the report is a row whose vec_id this divides.
QUERY_STEP = 50

ORACLE = f"""with v as (
  select vec_id, [cast(floor(256 * cast(e as double)) as bigint) for e in embedding] as x from embeddings
  where len(embedding) > 0 and len([e for e in embedding if e is null or not isfinite(e)]) = 0
), pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_inner_product(cast(q.x as double[]), cast(c.x as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {QUERY_STEP} = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs
)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 5"""


def topk_report(table: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score of every row whose vec_id is divisible by QUERY_STEP against all rows. Vectors that are null,
    empty, of another length than most, or hold nulls or numbers that are not finite take no part."""
    rows = stored(with_integers(table.select("vec_id", "embedding")).select("vec_id", "x"))
    return top_k(rows.filter(F.col("vec_id") % QUERY_STEP == 0), rows)

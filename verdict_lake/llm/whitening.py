"""Embedding whitening by an exact scatter matrix of bit planes.

Each distinct integer vector counts once. A task shifts a batch of rows so that no entry is negative, packs every bit plane of
every dimension across the rows into 64-bit words, and gets the sums of products of two dimensions from the population
counts of the planes' conjunctions, weighted by powers of two: integers, exact whatever the number of rows. Spark adds
them up as decimals; the driver gets one matrix of dimensions by dimensions, centres it as integers and takes its
eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import packed, python_ready, stored, unpacked
from .vectors import gathered, matrix, with_integers

#: Rows, about, whose planes are compared at once (64 words a plane), and components that the report gives.
STRIP, SHOWN = 4096, 4
#: Eigenvalues below this share of the largest, times the dimensions, are rounding: such components are not whitened.
ROUNDING = np.finfo(np.float64).eps
SAFE = 1 << 62


def planes_of(shifted: np.ndarray) -> np.ndarray:
    """(bits, dimensions, words): the bit planes of non-negative rows, packed across the rows."""
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    rows = -(-len(shifted) // 64) * 64
    padded = np.zeros((rows, shifted.shape[1]), dtype=np.uint64)
    padded[: len(shifted)] = shifted
    ones = (padded[None] >> np.arange(bits, dtype=np.uint64)[:, None, None]) & np.uint64(1)
    return np.ascontiguousarray(np.packbits(ones.astype(np.uint8).transpose(0, 2, 1), axis=2)).view(np.uint64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (objects: integers of any size) and cross-products of the columns of an array of longs."""
    low = x.min(axis=0)
    planes = planes_of(np.ascontiguousarray(x).view(np.uint64) - low.view(np.uint64))  # wraps around to the true difference
    bits, dims, words = planes.shape
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64).astype(object)
    weights = np.array([1 << p for p in range(bits)], dtype=object)
    sums = weights @ ones
    every = planes.reshape(bits * dims, words)
    products = np.zeros((dims, dims), dtype=object)
    small = 2 * bits + len(x).bit_length() < 62
    for p in range(bits):
        for i in range(dims):
            both = np.bitwise_count(planes[p, i] & every).sum(axis=1, dtype=np.int64).reshape(bits, dims)
            products[i] += (weights.astype(np.int64) @ both).astype(object) << p if small else (weights @ both.astype(object)) * (1 << p)
    low = low.astype(object)
    return sums + len(x) * low, products + np.outer(low, sums) + np.outer(sums, low) + len(x) * np.outer(low, low)


def scattered_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each i <= j with the task's sum of products, and for each i with j = -1 its sum."""
    total = None
    for batch in gathered(batches, STRIP):
        part = scatter(matrix(batch.column("x")))
        total = part if total is None else (total[0] + part[0], total[1] + part[1])
    if total is not None:
        sums, products = total
        rows = [(i, j, products[i, j]) for i in range(len(sums)) for j in range(i, len(sums))] + [(i, -1, s) for i, s in enumerate(sums)]
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([str(r[2]) for r in rows])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "part"])


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums; components: unit eigenvectors as columns, by falling eigenvalue; explained: shares of the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    @property
    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > ROUNDING * len(self.sums) * max(0.0, self.values.max(initial=0.0))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: longs, or integers of any size where they might not fit."""
        sums = np.array(self.sums, dtype=object)
        reach = self.n * max(abs(int(x.min(initial=0))), int(x.max(initial=0))) + max(map(abs, self.sums), default=0)
        return x * np.int64(self.n) - sums.astype(np.int64) if reach < SAFE else x.astype(object) * self.n - sums

    def projected(self, centred: np.ndarray, shown: int) -> np.ndarray:
        """Whitened values of centred rows; NaN for components that are not usable."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.usable, 1.0 / (self.n * np.sqrt(np.abs(self.values))), np.nan)[:shown]
        return centred.astype(np.float64) @ self.components[:, :shown] * scale


def fitted(fit: DataFrame) -> Whitening | None:
    """The whitening of a table of distinct vectors (x); None if it has no rows."""
    n = fit.count()
    if not n:
        return None
    parts = fit.select("x").mapInArrow(scattered_parts, "i int, j int, part string")
    total = parts.groupBy("i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).cast("string").alias("total"))
    found = {(r.i, r.j): int(r.total) for r in total.collect()}  # a row for each pair of dimensions
    dims = 1 + max(i for i, _ in found)
    sums = tuple(found[i, -1] for i in range(dims))
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = Fraction(n * found[i, j] - sums[i] * sums[j], n * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], np.ascontiguousarray(vectors[:, ::-1])
    trace = float(np.trace(cov))
    return Whitening(n, sums, vectors, values, values / trace if trace > 0 else np.full(dims, np.nan))


def whitened_rows(model: Whitening, shown: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = model.centred(matrix(batch.column("x")))
            values = model.projected(centred, shown).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, shown, dtype=np.int32)), pa.array(values, mask=np.isnan(values)))
            deviation = pa.array([str(d) for d in (centred.astype(object) ** 2).sum(axis=1)])
            rest = [batch.column(c) for c in ("vec_id", "rest")]
            yield pa.RecordBatch.from_arrays([*rest, lists, deviation], ["vec_id", "rest", "whitened", "deviation"])

    return run


def identity_error(fit: DataFrame, model: Whitening, shown: int) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity, over usable components."""
    whole = [k for k in range(shown) if model.usable[k]]
    if not whole:
        return None
    rows = fit.select(F.lit(None).cast("long").alias("vec_id"), F.lit(None).alias("rest"), "x").withColumn("rest", F.lit(None).cast("string"))
    rows = rows.mapInArrow(whitened_rows(model, shown), "vec_id long, rest string, whitened array<double>, deviation string")
    w = lambda k: F.element_at("whitened", k + 1)
    # covar_pop centres as it goes, so the means are never taken as zero
    found = rows.agg(*(F.covar_pop(w(i), w(j)).alias(f"c{i}_{j}") for i in whole for j in whole if i <= j)).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in whole for j in whole if i <= j)


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct x once; copies are combined before the shuffle."""
    return stored(rows.select("x").distinct())


def with_whitened(table: DataFrame, shown: int | None = None) -> tuple[DataFrame, Whitening | None, DataFrame]:
    """The rows of table whose vector is usable with whitened (array of shown components, all by default) and deviation
    (decimal: the sum of (n * x - sums)^2), the model, and the fit list.

    Columns of table (vec_id, embedding, and others of any name) stay, but for those named whitened and deviation. Vectors that
    are null, empty, of another length than most, or hold nulls or numbers that are not finite are left out. Components without variance
    are null. Repeated rows are fitted once and returned each. An empty table gives no rows and no model.
    """
    python_ready(table.sparkSession)
    rest = F.col("rest") if len(table.columns) > 2 else F.col("rest").cast("string")
    rows = with_integers(packed(table, "vec_id", "embedding").select("vec_id", F.struct(rest.alias("rest"), "embedding").alias("rest"), "embedding"))
    rows = stored(rows.select("vec_id", "rest", "x"))
    fit = fit_list(rows)
    model = fitted(fit)
    schema = rows.schema
    made = "whitened array<double>, deviation string"
    if model is None:
        out = rows.select("vec_id", "rest", F.lit(None).cast("array<double>").alias("whitened"), F.lit(None).cast("string").alias("deviation"))
    else:
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        out = rows.mapInArrow(whitened_rows(model, min(shown or len(model.sums), len(model.sums))), f"vec_id {kinds['vec_id']}, rest {kinds['rest']}, {made}")
    out = out.select("vec_id", F.col("rest.embedding").alias("embedding"), F.col("rest.rest").alias("rest"), "whitened", F.col("deviation").cast("decimal(38,0)").alias("deviation"))
    return unpacked(out, table, "vec_id", "embedding", more=("whitened", "deviation")), model, fit


def whitening_report(table: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and each of the first
    SHOWN components; see with_whitened for odd rows. Without any variance whitened, explained and identity_error are null."""
    rows, model, fit = with_whitened(table.select("vec_id", "embedding"), SHOWN)
    shown = min(SHOWN, len(model.sums)) if model else 0
    error = identity_error(fit, model, shown) if model else None
    shares = F.array(*(F.lit(None if np.isnan(e) else float(e)).cast("double") for e in model.explained[:shown])) if shown else F.lit(None).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )

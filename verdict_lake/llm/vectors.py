"""Integer vectors of the embeddings table, as the operators on embeddings read them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only; false for nulls and empty ones."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda e: finite(e.cast("double"))), F.lit(False))


def as_integers(vector: Column) -> Column:
    """floor(256 * c) of each entry as a long."""
    return F.transform(vector, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double")))


def with_integers(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows of usable vectors with x, the integers.

    Vectors have the length that most usable ones have (the larger of two as frequent); others take no part, as those
    with nulls take none.
    """
    rows = table.filter(usable(F.col(vector)))
    most = rows.groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "length")).alias("x")).select("x.length").first()
    return rows.filter(F.size(vector) == F.lit(most.length or 0)).withColumn("x", as_integers(F.col(vector)))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of an array."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """A task's batches as larger ones: of that many rows or a batch more, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()

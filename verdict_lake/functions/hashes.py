"""Content hashes and perceptual hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_sha(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts one after another."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def prompt_id(role: Column, system: Column, template: Column) -> Column:
    return short_sha(role, system, template)


def packed_bits(bits: Column) -> Column:
    """An array of at most 64 booleans as 16 hex digits, the first bit the highest of 64 where there are 64."""
    number = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(F.when(b, 1).otherwise(0).cast("bigint")))
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def dhash(raster: Column, width: int = 9, height: int = 8) -> Column:
    """Whether each pixel is brighter than the one on its right, row by row; raster: width x height gray values."""
    places = F.array(*(F.lit(y * width + x) for y in range(height) for x in range(width - 1)))
    return packed_bits(F.transform(places, lambda i: F.get(raster, i) > F.get(raster, i + 1)))


def ahash(raster: Column) -> Column:
    """Whether each pixel is brighter than the mean."""
    total = F.aggregate(raster, F.lit(0.0), lambda a, x: a + x.cast("double"))
    mean = total / F.size(raster)
    return packed_bits(F.transform(raster, lambda x: x.cast("double") > mean))


def as_bits(hexa: Column) -> Column:
    """16 hex digits as a signed 64-bit integer."""
    return F.conv(hexa, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes; an error if their widths differ."""
    same = F.length(a) == F.length(b)
    return F.when(same, F.bit_count(as_bits(a).bitwiseXOR(as_bits(b)))).otherwise(F.raise_error(F.lit("hashes of unequal widths")).cast("int"))


def aspect_close(w1: Column, h1: Column, w2: Column, h2: Column, tolerance: float = 0.02) -> Column:
    """Whether two width to height ratios differ by at most the tolerance; not for sizes that are not positive."""
    positive = (w1 > 0) & (h1 > 0) & (w2 > 0) & (h2 > 0)
    near = F.abs(F.try_divide(w1.cast("double"), h1.cast("double")) - F.try_divide(w2.cast("double"), h2.cast("double"))) <= tolerance
    return F.coalesce(positive & near, F.lit(False))

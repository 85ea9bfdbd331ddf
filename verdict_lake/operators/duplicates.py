"""Near-duplicate images: pending posts matched to reviewed ones by file hash, or by perceptual hashes and then by pixels.

Of k + 2 bands of a hash at least two stay as they are when k bits change. So images meet on pairs of equal bands: for 4
bits of the difference hash 15 pairs of some 21 bits, for 2 bits of the average hash 6 pairs of 32 bits. The aspect ratio is in
the key as well. Every pair of images that the rule can accept meets, unrelated ones once in 2^21 at least, and the rule decides.

Rasters come last: hashes find the pairs, sums of blocks of pixels drop most of those that are not alike, and only the
rasters of what is left are sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import as_bits, aspect_close
from ..session import scratch_folder, workers_find_package
from .queues import without

DHASH, AHASH, WIDE_DHASH, PIXELS = 4, 2, 8, 4.0
#: The width of an aspect bucket: a little more than the tolerance of the ratios, for the rounding of their quotients.
BUCKET = 0.021
#: Runs of pixels whose sums bound the difference of two rasters, and pairs of one reviewed raster that a task compares.
BLOCKS, GROUP = 16, 64

#: Weights of red, green and blue in a gray value, in 65,536ths.
LUMA = (19595, 38470, 7471)
#: What images must share to be one row in the search.
SHAPE = ("dhash", "ahash", "width", "height")


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, for several readers."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bands(changed: int) -> list[tuple[int, int]]:
    """The first bit and the width of each of the changed + 2 parts into which 64 bits are cut."""
    parts = changed + 2
    edges = [64 * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def band_pairs(bits: Column, changed: int, tag: str) -> list[Column]:
    """(tag, band) structs of all pairs of the parts of 64 bits."""
    cut = [(F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << width) - 1)), width) for a, width in bands(changed)]
    return [
        F.struct(F.lit(f"{tag}{i}.{j}").alias("tag"), F.shiftleft(cut[i][0], cut[j][1]).bitwiseOR(cut[j][0]).alias("band")) for i, j in combinations(range(len(cut)), 2)
    ]


def shared_tags(differing: Column, changed: int, tag: str) -> list[Column]:
    """The tags of the pairs of parts in which no bit differs, in order; null for the others."""
    masks = [((1 << width) - 1) << a for a, width in bands(changed)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [F.when(differing.bitwiseAND(F.lit(signed(masks[i] | masks[j]))) == 0, F.lit(f"{tag}{i}.{j}")) for i, j in combinations(range(len(masks)), 2)]


def classes(prints: DataFrame, *more: str) -> DataFrame:
    """prints of equal hashes and shape (and more) as one row under their smallest post_id, so that a hash that very many
    images share is one key's one row."""
    return prints.groupBy(*SHAPE, *more).agg(F.min("post_id").alias("post_id"))


def difference(a: bytes | None, b: bytes | None) -> float | None:
    """Mean gray value of the absolute difference of two RGB rasters of one size; null without both."""
    if not a or not b or len(a) != len(b):
        return None
    p, q = (np.frombuffer(x, dtype=np.uint8).reshape(-1, 3).astype(np.int64) for x in (a, b))
    return float(((np.abs(p - q) @ np.array(LUMA) + 32768) >> 16).mean())


def exact_pairs(pending: DataFrame, reviewed: DataFrame) -> DataFrame:
    """pending_id, reviewed_id, exact, dh, ah of pending posts and the smallest reviewed post with the same file."""
    same = reviewed.groupBy("exact_hash").agg(F.min("post_id").alias("reviewed_id"))
    rows = pending.select(F.col("post_id").alias("pending_id"), "exact_hash").join(same, "exact_hash").filter("pending_id <> reviewed_id")
    return rows.select("pending_id", "reviewed_id", F.lit(True).alias("exact"), F.lit(0).alias("dh"), F.lit(0).alias("ah"))


def aspect_bucket(w: Column, h: Column) -> Column:
    """Images of close aspect ratios are in the same bucket or in neighbouring ones; null for sizes that are not positive."""
    return F.when((w > 0) & (h > 0), F.floor(F.try_divide(w.cast("double"), h.cast("double")) / F.lit(BUCKET)))


def banded(prints: DataFrame, side: str, dhash_bits: int, ahash_bits: int, around: int = 0) -> DataFrame:
    """tag, band, bucket and the fingerprint: a row for each pair of bands and for each aspect bucket up to around away."""
    names = ("id", "d", "a", "w", "h")
    cut = prints.select(F.col("post_id").alias("id"), as_bits(F.col("dhash")).alias("d"), as_bits(F.col("ahash")).alias("a"), F.col("width").alias("w"), F.col("height").alias("h"))
    own = aspect_bucket(F.col("w"), F.col("h"))
    pairs = [*band_pairs(F.col("d"), dhash_bits, "d"), *band_pairs(F.col("a"), ahash_bits, "a")]
    keys = F.array(*(F.struct(p.getField("tag").alias("tag"), p.getField("band").alias("band"), (own + k).alias("bucket")) for p in pairs for k in range(-around, around + 1)))
    return cut.filter(own.isNotNull()).select(F.inline(keys), *(F.col(n).alias(f"{side}_{n}") for n in names))


def large_bands(prints: DataFrame, least: int = 10_000, dhash_bits: int = DHASH, ahash_bits: int = AHASH) -> DataFrame:
    """tag, band, bucket, n: the keys on which at least so many fingerprints of different hashes or shape meet."""
    met = banded(classes(prints), "r", dhash_bits, ahash_bits).groupBy("tag", "band", "bucket").agg(F.count("*").alias("n"))
    return met.filter(F.col("n") >= least)


def near_pairs(pending: DataFrame, reviewed: DataFrame, dhash_bits: int = DHASH, wide_bits: int = WIDE_DHASH, ahash_bits: int = AHASH) -> DataFrame:
    """pending_id, reviewed_id, exact, dh, ah of all pairs of fingerprints that match but for the pixels.

    They meet on a pair of bands and an aspect bucket; the pending side looks into the neighbouring buckets too. Of the bands
    on which two fingerprints meet the first alone makes a row, so that near copies are a row a pair. Fingerprints have a
    row a post_id. Keys are shuffled: by the size of a file of fingerprints, which is all that Spark knows, it would broadcast
    them, but each fingerprint has 21 keys or more.
    """
    c = F.col
    asked = banded(pending, "q", dhash_bits, ahash_bits, around=1)
    d, a = (c(f"q_{x}").bitwiseXOR(c(f"r_{x}")) for x in "da")
    dh, ah = F.bit_count(d), F.bit_count(a)
    first = F.coalesce(*shared_tags(d, dhash_bits, "d"), *shared_tags(a, ahash_bits, "a"))
    held = banded(reviewed, "r", dhash_bits, ahash_bits).hint("merge")
    met = asked.join(held, ["tag", "band", "bucket"]).withColumns({"dh": dh, "ah": ah})
    close = aspect_close(c("q_w"), c("q_h"), c("r_w"), c("r_h")) & ((c("dh") <= dhash_bits) | (c("dh") <= wide_bits) & (c("ah") <= ahash_bits))
    pairs = met.filter(close & (c("tag") == first) & (c("q_id") != c("r_id")))
    return pairs.select(c("q_id").alias("pending_id"), c("r_id").alias("reviewed_id"), F.lit(False).alias("exact"), "dh", "ah")


def members(prints: DataFrame, *more: str) -> DataFrame:
    """class_id, post_id: which fingerprints each row of classes(prints, *more) stands for."""
    firsts = classes(prints, *more).withColumnRenamed("post_id", "class_id")
    same = [prints[c].eqNullSafe(firsts[c]) for c in (*SHAPE, *more)]
    return prints.join(firsts, same).select("class_id", "post_id")


def candidate_pairs(pending: DataFrame, reviewed: DataFrame, **bits) -> DataFrame:
    """pending_id, reviewed_id, exact, dh, ah of pairs of fingerprints that match but for the pixels.

    Fingerprints: post_id, exact_hash, dhash, ahash (hex), width, height. Every reviewed post of a matching class is listed;
    near_duplicates keeps classes as one row and is the way where very many images are alike.
    """
    near = near_pairs(pending, classes(reviewed), **bits).join(members(reviewed).withColumnRenamed("class_id", "reviewed_id"), "reviewed_id")
    every = near.select("pending_id", F.col("post_id").alias("reviewed_id"), "exact", "dh", "ah").filter("pending_id <> reviewed_id")
    return exact_pairs(pending, reviewed).unionByName(every)


def block_sums(raster: bytes) -> list[int]:
    """The sums of red, green and blue of BLOCKS runs of pixels."""
    pixels = np.frombuffer(raster, dtype=np.uint8).reshape(-1, 3)
    sums = np.concatenate([np.zeros((1, 3), np.int64), pixels.cumsum(axis=0, dtype=np.int64)])
    edges = block_edges(len(pixels))
    return (sums[edges[1:]] - sums[edges[:-1]]).reshape(-1).tolist()


def block_edges(pixels: int) -> np.ndarray:
    return np.arange(BLOCKS + 1) * pixels // BLOCKS


def summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """post_id, pixels (a digest), n (pixels) and sums of the blocks of each raster that is whole."""
    for batch in batches:
        rows = [(i, r) for i, r in zip(batch.column("post_id").to_pylist(), batch.column("raster").to_pylist()) if r and len(r) % 3 == 0]
        columns = [[i for i, _ in rows], [sha256(r).hexdigest() for _, r in rows], [len(r) // 3 for _, r in rows], [block_sums(r) for _, r in rows]]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["post_id", "pixels", "n", "sums"])


def least_difference(n: Column, a: Column, b: Column) -> Column:
    """A lower bound of the pixel difference of two rasters of n pixels each, from the sums of their blocks.

    Within a block and a color the mean of differences is no less than the difference of means. Rounding a pixel's gray
    value takes half of one at most.
    """
    weights = F.array(*map(F.lit, LUMA * BLOCKS))
    apart = F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x - y)), weights, lambda d, w: d * w)
    return F.aggregate(apart, F.lit(0).cast("long"), lambda s, x: s + x) / (n * 65536) - 0.5


def compared(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The pixel differences of the pending rasters of a group and one reviewed raster."""
    if right.empty:
        return left.iloc[:0][["pending_id", "reviewed_id"]].assign(diff=pd.Series(dtype="float64"))
    other = right["right_raster"].iloc[0]
    return left[["pending_id", "reviewed_id"]].assign(diff=[difference(x, other) for x in left["left_raster"]])


def pixel_differences(pairs: DataFrame, rasters: DataFrame) -> DataFrame:
    """pairs (pending_id, reviewed_id and more; each once) with diff, the pixel difference of their rasters (post_id, raster); null
    where they differ in size; pairs without both rasters are left out.

    A pending raster goes to each of its pairs, a reviewed one once to each group of GROUP of its pairs.
    """
    workers_find_package(pairs.sparkSession)
    counts = pairs.groupBy("reviewed_id").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.select("pending_id", "reviewed_id").join(counts, "reviewed_id")
    dealt = dealt.select("pending_id", "reviewed_id", F.pmod(F.xxhash64("pending_id"), "groups").alias("part"))
    left = dealt.join(rasters.select(F.col("post_id").alias("pending_id"), F.col("raster").alias("left_raster")), "pending_id")
    each = counts.select(F.col("reviewed_id").alias("right_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("right_part"))
    right = each.join(rasters.select(F.col("post_id").alias("right_id"), F.col("raster").alias("right_raster")), "right_id")
    tested = left.groupBy("reviewed_id", "part").cogroup(right.groupBy("right_id", "right_part")).applyInPandas(compared, "pending_id string, reviewed_id string, diff double")
    return pairs.join(tested, ["pending_id", "reviewed_id"]).select(*pairs.columns, "diff")


def near_duplicates(pending: DataFrame, reviewed: DataFrame, rasters: DataFrame, most: float = PIXELS, **bits) -> DataFrame:
    """pending_id, reviewed_id, exact, dh, ah: the best match of each pending post that has one.

    A match is an equal file, or hashes within bits whose rasters (post_id, raster) differ by at most most; a missing raster
    is no match. Hashes alone find the pairs of classes; only rasters of those are looked at, and summed up to a digest and
    the sums of blocks. Equal digests are one image; a pair that the sums keep apart is dropped, and only for what is left
    rasters are sent. Each pending image then gets its own row.
    """
    workers_find_package(pending.sparkSession)
    met = written(near_pairs(classes(pending), classes(reviewed), **bits))
    sides = []
    for df, side in ((pending, "pending"), (reviewed, "reviewed")):
        own = members(df).join(met.select(F.col(f"{side}_id").alias("class_id")), "class_id", "left_semi")
        summed = rasters.join(own.select("post_id"), "post_id", "left_semi").select("post_id", "raster").mapInArrow(summed_up, "post_id string, pixels string, n long, sums array<long>")
        sides.append(written(own.join(summed, "post_id")))

    def images(side: DataFrame, name: str) -> DataFrame:
        """The images of a class; the smallest post_id stands for each."""
        each = side.groupBy("class_id", "pixels", "n").agg(F.min("post_id").alias("image"), F.any_value("sums").alias("sums"))
        return each.select(F.col("class_id").alias(f"{name}_id"), *(F.col(c).alias(f"{name}_{c}") for c in ("image", "pixels", "n", "sums")))

    between = met.join(images(sides[0], "pending"), "pending_id").join(images(sides[1], "reviewed"), "reviewed_id").filter("pending_n = reviewed_n")
    between = between.withColumn("same", F.col("pending_pixels") == F.col("reviewed_pixels"))
    bound = least_difference(F.col("pending_n"), F.col("pending_sums"), F.col("reviewed_sums"))
    between = written(between.filter(F.col("same") | (bound <= most)).select(F.col("pending_image").alias("pending_id"), F.col("reviewed_image").alias("reviewed_id"), "exact", "dh", "ah", "same"))
    tested = pixel_differences(between.filter("not same"), rasters).filter(F.col("diff") <= most)
    near = between.filter("same").drop("same").unionByName(tested.drop("same", "diff"))
    of_image = sides[0].join(sides[0].groupBy("class_id", "pixels").agg(F.min("post_id").alias("image")), ["class_id", "pixels"]).select("image", "post_id")
    expanded = near.join(of_image, near["pending_id"] == of_image["image"]).select(F.col("post_id").alias("pending_id"), *near.columns[1:])
    return best_duplicate(exact_pairs(pending, reviewed).unionByName(expanded.filter("pending_id <> reviewed_id")))


def best_duplicate(pairs: DataFrame) -> DataFrame:
    """One match a pending post: exact first, then the smallest distance, then the smallest id."""
    key = F.struct((~F.col("exact")).alias("inexact"), (F.col("dh") + F.col("ah")).alias("distance"), "reviewed_id")
    best = pairs.groupBy("pending_id").agg(F.min_by(F.struct("reviewed_id", "exact", "dh", "ah"), key).alias("x"))
    return best.select("pending_id", "x.*")


def exclusions(best: DataFrame) -> DataFrame:
    """Review rows (post_id, status, reason) that exclude the matched posts; merge them with insert_if_absent."""
    return best.select(F.col("pending_id").alias("post_id"), F.lit("excluded").alias("status"), F.concat(F.lit("duplicate_image:"), "reviewed_id").alias("reason"))


def fingerprint_backfill(posts: DataFrame, prints: DataFrame) -> DataFrame:
    """Posts with an image path and no fingerprint yet."""
    return without(posts.filter("local_image_path is not null").select("post_id", "local_image_path"), prints, "post_id")


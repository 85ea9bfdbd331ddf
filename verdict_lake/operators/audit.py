"""Release checks: integrity and privacy of tables and exports, a row a check with the number of bad rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder
from .queues import within, without

# Keys that no published row may have at any depth.
FORBIDDEN_KEYS = (
    "author",
    "authors",
    "body",
    "comment",
    "comments",
    "comment_body",
    "created_utc",
    "gate_feedback",
    "image_url",
    "llm_call",
    "llm_calls",
    "local_image_path",
    "permalink",
    "prompt",
    "request_id",
    "response",
    "review",
    "review_reason",
    "review_status",
    "reviewer_notes",
    "source_comment_ids",
    "system_prompt",
    "user_prompt",
)


def check(name: str, rows: DataFrame, bad: Column | None = None) -> DataFrame:
    return rows.agg((F.count("*") if bad is None else F.count_if(bad)).cast("long").alias("bad")).select(F.lit(name).alias("check_name"), "bad")


def together(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for other in checks[1:]:
        out = out.unionByName(other)
    return out


def audit_tables(posts: DataFrame, ground_truths: DataFrame, reviews: DataFrame, expected: int) -> DataFrame:
    """Validated rows: how far their number is off, without a ground truth, marked as duplicates, without an image."""
    valid = reviews.filter("status = 'validated'")
    off = valid.agg(F.abs(F.count("*") - expected).alias("bad")).select(F.lit("validated_count").alias("check_name"), "bad")
    grounded = ground_truths.filter(F.trim("explanation") != "")
    return together(
        off,
        check("missing_ground_truth", without(valid, grounded, "post_id")),
        check("duplicate_reason", valid, F.ilike(F.coalesce("reason", F.lit("")), F.lit("%duplicate%"))),
        check("missing_image", within(posts, valid, "post_id"), F.coalesce("local_image_path", F.lit("")) == ""),
    )


def audit_source_ids(sources: DataFrame, comments: DataFrame) -> DataFrame:
    """post_id, problem: source ids that are no array of strings, or that are not all comments of the post."""
    kind = F.schema_of_variant(F.try_parse_json("source_comment_ids"))
    rows = sources.withColumn("ok", F.coalesce(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)))
    ids = rows.filter("ok").select("post_id", F.explode(F.from_json("source_comment_ids", "array<string>")).alias("comment_id")).distinct()
    unknown = ids.join(comments.select("post_id", "comment_id"), ["post_id", "comment_id"], "left_anti").select("post_id").distinct()
    return rows.filter("not ok").select("post_id", F.lit("not an array of strings").alias("problem")).unionByName(unknown.select("post_id", F.lit("unknown comment").alias("problem")))


def may_name(text: str) -> Column:
    """Whether a JSON text may have a forbidden key: a scan of the text tells most rows apart."""
    return F.rlike(text, F.lit('"(' + "|".join(FORBIDDEN_KEYS) + r')"\s*:'))


def kept(df: DataFrame) -> DataFrame:
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def audit_export_keys(lines: DataFrame) -> DataFrame:
    """key, n: forbidden keys of exported rows (value: a JSON text a row) at any depth, and how many rows have them.

    A round a level: the objects and lists that may still hold such a key become a row for each of their values. What names a
    key and is no JSON, or repeats a key within an object, counts as "(not JSON)".
    """
    spark = lines.sparkSession
    level = kept(lines.filter(may_name("value")).select(F.monotonically_increasing_id().alias("row"), "value"))
    broken = F.try_parse_json("value").isNull()
    found = level.filter(broken).select("row", F.lit("(not JSON)").alias("key"))
    level = level.filter(~broken)
    while not level.isEmpty():
        parsed = level.select("row", F.try_parse_json("value").alias("v"))
        inner = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("row", "key", F.to_json(F.col("value")).alias("value"))
        named = F.coalesce(F.col("key").isin(*FORBIDDEN_KEYS), F.lit(False))
        inner = kept(inner.filter(named | may_name("value")))
        found = found.unionByName(inner.filter(named).select("row", "key"))
        level = inner.filter(may_name("value")).select("row", "value")
    return found.distinct().groupBy("key").agg(F.count("*").alias("n"))


def audit_export_fk(memes: DataFrame, predictions: DataFrame, judgments: DataFrame, images: DataFrame, expected: int) -> DataFrame:
    """References of an export: posts of predictions, prediction ids, predictions of judgments, numbers of posts and images."""
    n = lambda df: df.agg(F.count("*").alias("n"))
    off = n(memes).select(F.lit("post_count").alias("check_name"), F.abs(F.col("n") - expected).alias("bad"))
    files = n(memes).crossJoin(n(images).withColumnRenamed("n", "m")).select(F.lit("image_count").alias("check_name"), F.abs(F.col("n") - F.col("m")).alias("bad"))
    return together(
        off,
        files,
        check("prediction_posts", without(predictions, memes, "post_id")),
        check("null_prediction_ids", predictions, F.col("prediction_id").isNull()),
        check("judgment_predictions", without(judgments, predictions, "prediction_id")),
    )

"""Snapshots by content, and the four published tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import strip
from ..session import workers_find_package
from .judging import judgment_history, latest_per_judge, leaderboard, voted_predictions, votes
from .queues import within
from .status import truncated


def curated_pairs(ground_truths: DataFrame, reviews: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """post_id, explanation of all, validated, or a snapshot's grounded posts."""
    rows = ground_truths.select("post_id", "explanation")
    rows = rows if reviews is None else within(rows, reviews.filter("status = 'validated'"), "post_id")
    return rows if members is None else within(rows, members, "post_id")


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The version of ordered lines, which pass through one hasher."""
    hasher = hashlib.sha256()
    for batch in batches:
        for line in batch.column("line"):
            hasher.update(line.as_py().encode())
    yield pa.RecordBatch.from_arrays([pa.array([hasher.hexdigest()[:16]])], ["version"])


def dataset_version(pairs: DataFrame) -> DataFrame:
    """One row, dataset_version: the first 16 hex digits of the SHA-256 of the pairs in post_id order, without separators.

    That value is serial, so one task sorts the lines, which may spill, and hashes them line by line: its time grows with the
    content, its memory does not.
    """
    workers_find_package(pairs.sparkSession)
    lines = pairs.select("post_id", F.concat("post_id", F.coalesce("explanation", F.lit(""))).alias("line")).filter("line is not null")
    hashed = lines.repartition(1).sortWithinPartitions("post_id", "line").select("line").mapInArrow(digest, "version string")
    return hashed.agg(F.coalesce(F.max("version"), F.lit(hashlib.sha256().hexdigest()[:16])).alias("dataset_version"))


def tree_version(pairs: DataFrame) -> DataFrame:
    """One row, dataset_version: the first 16 hex digits of the root of a tree of SHA-256 digests over the pairs.

    It names the same content as dataset_version by another value, which many tasks work out: rows are dealt to 16^4 leaves
    by a hash of their post_id, leaves to 16^2 nodes, and the root is over those. A leaf's digest is over the digests of its
    rows in their order; it gathers one in 65,536 of all rows, and what lies above is bounded. A null post_id has no row.
    """
    sha = lambda *parts: F.sha2(F.concat(*parts), 256)
    above = lambda df, key, *parts: df.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(*parts))), ""), 256).alias("digest"))
    rows = pairs.filter("post_id is not null").select(
        F.substring(F.sha2("post_id", 256), 1, 4).alias("leaf"), sha("post_id", F.lit("\x1f"), F.sha2(F.coalesce("explanation", F.lit("")), 256)).alias("digest")
    )
    leaves = above(rows, "leaf", "digest").withColumn("node", F.substring("leaf", 1, 2))
    nodes = above(leaves, "node", "leaf", "digest")
    root = nodes.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("node", "digest"))), ""), 256).alias("root"))
    return root.select(F.substring("root", 1, 16).alias("dataset_version"))


def create_snapshot(pairs: DataFrame, snapshots: DataFrame, version_of: Callable[[DataFrame], DataFrame] = dataset_version) -> DataFrame:
    """The row (snapshot_id, dataset_version, posts) to append: none if there is no content or a snapshot has it already."""
    version = version_of(pairs).crossJoin(pairs.agg(F.count("*").alias("posts"))).filter("posts > 0")
    new = version.join(snapshots.select("dataset_version"), "dataset_version", "left_anti")
    return new.select(F.concat(F.lit("v_"), "dataset_version").alias("snapshot_id"), "dataset_version", "posts")


def find_snapshot(snapshots: DataFrame, name: str) -> DataFrame:
    """The snapshot of that id, else the newest whose id starts with it."""
    ranked = snapshots.filter(F.startswith("snapshot_id", F.lit(name))).withColumn("inexact", F.col("snapshot_id") != name)
    return ranked.orderBy("inexact", F.col("created_at").desc(), "snapshot_id").limit(1).select("snapshot_id")


def newest_first(rows: DataFrame, order: str, key: str, n: int | None = None) -> DataFrame:
    """Rows newest first, ties by key, n at most."""
    listed = rows.orderBy(F.col(order).desc(), F.col(key).desc())
    return listed if n is None else listed.limit(n)


def image_file(post: str = "post_id", path: str = "local_image_path"):
    """<post_id>.<extension of the path, or jpg>."""
    ending = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return F.concat(post, F.lit("."), F.when(ending == "", "jpg").otherwise(ending))


def export_memes(members: DataFrame, posts: DataFrame, ground_truths: DataFrame) -> DataFrame:
    rows = members.join(posts.select("post_id", "title", "subreddit", "local_image_path"), "post_id").join(ground_truths.select("post_id", "explanation"), "post_id")
    return rows.select("snapshot_id", "post_id", "title", "subreddit", F.col("explanation").alias("ground_truth"), image_file().alias("image"))


def prediction_prompt(predictions: DataFrame, calls: DataFrame) -> DataFrame:
    """predictions with prompt_version of the newest successful prediction call of the same post, model and text.

    Texts meet by their SHA-256, so the shuffle carries no text.
    """
    good = calls.filter("role = 'predictor' and error is null and response is not null")
    keyed = good.select("post_id", F.col("model").alias("model_id"), F.sha2("response", 256).alias("text_hash"), "id", "prompt_version")
    newest = keyed.groupBy("post_id", "model_id", "text_hash").agg(F.max_by("prompt_version", "id").alias("prompt_version"))
    return predictions.withColumn("text_hash", F.sha2("prediction", 256)).join(newest, ["post_id", "model_id", "text_hash"], "left").drop("text_hash")


def export_predictions(members: DataFrame, predictions: DataFrame, judgments: DataFrame, calls: DataFrame) -> DataFrame:
    """Successful predictions of a snapshot with prompt, votes and majority verdict."""
    rows = prediction_prompt(within(predictions.filter("error is null"), members, "post_id"), calls).withColumnRenamed("id", "prediction_id")
    counted = votes(latest_per_judge(judgments)).select("prediction_id", "judges", "correct_n", "incorrect_n", "consensus_verdict")
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return rows.join(counted, "prediction_id", "left").select("prediction_id", "post_id", "model_id", "prediction", "prompt_version", zero("judges", "judges"), zero("correct_n", "correct_votes"), zero("incorrect_n", "incorrect_votes"), "consensus_verdict")


def export_judgments(members: DataFrame, predictions: DataFrame, judgments: DataFrame) -> DataFrame:
    """All judgments, with is_latest, of a snapshot's successful predictions."""
    mine = within(predictions.filter("error is null"), members, "post_id").select(F.col("id").alias("prediction_id"), "post_id", "model_id")
    return judgment_history(judgments.join(mine, "prediction_id")).select(F.col("id").alias("judgment_id"), "prediction_id", "post_id", "model_id", "judge_model", "verdict", "judge_prompt_version", "is_latest")


def export_leaderboard(members: DataFrame, predictions: DataFrame, judgments: DataFrame) -> DataFrame:
    return leaderboard(voted_predictions(within(predictions, members, "post_id"), judgments))


def dataset_info(snapshot_id: str, **tables: DataFrame) -> DataFrame:
    """snapshot_id, table_name, n of the exported tables."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def push_log(members: DataFrame, predictions: DataFrame) -> DataFrame:
    """The publish record of each snapshot: posts and distinct models with successful predictions."""
    good = predictions.filter("error is null").select("post_id", "model_id").distinct()
    posts = members.groupBy("snapshot_id").agg(F.count("*").alias("posts"))
    models = members.join(good, "post_id").select("snapshot_id", "model_id").distinct().groupBy("snapshot_id").agg(F.count("*").alias("models"))
    return posts.join(models, "snapshot_id", "left").select("snapshot_id", "posts", F.coalesce("models", F.lit(0)).alias("models"))


def curated_records(pairs: DataFrame, ground_truths: DataFrame, sources: DataFrame, posts: DataFrame) -> DataFrame:
    """A record a post for the predictor: texts, number of source ids and defaults for what is missing."""
    rows = pairs.select("post_id").join(posts.select("post_id", "title", "subreddit"), "post_id").join(ground_truths, "post_id").join(sources, "post_id", "left")
    ids = F.coalesce(F.from_json("source_comment_ids", "array<string>"), F.array().cast("array<string>"))
    return rows.select("post_id", "title", "subreddit", "explanation", F.coalesce("consensus_confidence", F.lit(0.0)).alias("confidence"), F.coalesce("num_agreeing_comments", F.lit(0)).alias("num_agreeing"), F.size(ids).alias("n_sources"), F.array_join(ids, ",").alias("source_ids"))


def reconstruct_posts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts with their comments nested, by score from the top, then id."""
    nested = comments.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "comment_id", "author", "body", "score"))).alias("c"))
    listed = F.transform("c", lambda x: F.struct(x["comment_id"].alias("comment_id"), x["author"].alias("author"), x["body"].alias("body"), x["score"].alias("score")))
    return posts.join(nested, "post_id", "left").withColumn("comments", F.coalesce(listed, F.array().cast("array<struct<comment_id:string,author:string,body:string,score:int>>"))).drop("c")


def regression_diff(regressions: DataFrame, new: DataFrame) -> DataFrame:
    """post_id, outcome (changed or unchanged) of flagged posts against new explanations; none counts as changed."""
    rows = regressions.select("post_id", "consensus_at_annotation").join(new.select("post_id", F.col("explanation").alias("now")), "post_id", "left")
    same = F.coalesce(strip(F.col("now")) == strip(F.coalesce("consensus_at_annotation", F.lit(""))), F.lit(False))
    return rows.select("post_id", F.when(same, "unchanged").otherwise("changed").alias("outcome"))


def regression_listing(regressions: DataFrame) -> DataFrame:
    return regressions.select("post_id", "status", truncated(F.col("consensus_at_annotation"), 220).alias("consensus"), truncated(F.col("canonical_explanation"), 120, "—").alias("canonical"), F.coalesce("failure_modes", F.lit("—")).alias("failure_modes"), F.substring(F.col("annotated_at").cast("string"), 1, 10).alias("date"))


def feedback_listing(feedback: DataFrame, n: int = 160) -> DataFrame:
    return feedback.select("post_id", "gate", F.coalesce("gate_decision", F.lit("—")).alias("gate_decision"), truncated(F.col("correct_decision"), 1 << 30, "—").alias("correct_decision"), truncated(F.col("notes"), n, "—").alias("notes"))


def latest_of(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each group with their position."""
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).desc())))
    return ranked.filter(F.col("position") <= n)

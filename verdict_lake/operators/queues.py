"""Work queues: what is still to do, as anti-joins.

The right sides are filtered before the join, so they are as small as they can be; left_anti has no NOT IN null trap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def within(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def few(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The distinct values of a column that has a handful, such as models or judges; an error if there are more than most."""
    values = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(values)


def each(values: list[str]) -> Column:
    """A row for each value."""
    return F.explode(F.array(*map(F.lit, values)) if values else F.array().cast("array<string>"))


def done_in(states: DataFrame, stage: str, model: str, prompt_version: str) -> DataFrame:
    """Posts in a terminal state of a stage under a model and prompt."""
    return states.filter((F.col("stage") == stage) & (F.col("model") == model) & (F.col("prompt_version") == prompt_version))


def pending_gate(posts: DataFrame, reviews: DataFrame, ground_truths: DataFrame, states: DataFrame | None = None, model: str = "", prompt_version: str = "") -> DataFrame:
    """post_id without a review, ground truth and, if states are given, terminal safety state for model and prompt."""
    todo = without(without(posts.select("post_id"), reviews, "post_id"), ground_truths, "post_id")
    return todo if states is None else without(todo, done_in(states, "safety", model, prompt_version), "post_id")


def pending_consensus(posts: DataFrame, reviews: DataFrame, ground_truths: DataFrame, states: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """post_id not excluded, without a ground truth or terminal consensus state for model and prompt."""
    todo = without(posts.select("post_id"), ground_truths, "post_id")
    todo = without(todo, reviews.filter("status = 'excluded'"), "post_id")
    return without(todo, done_in(states, "consensus", model, prompt_version), "post_id")


def pending_predictions(reviews: DataFrame, ground_truths: DataFrame, predictions: DataFrame, models: list[str], posts: DataFrame | None = None) -> DataFrame:
    """(post_id, model_id) of validated posts with a ground truth and no successful prediction of that model.

    models: a handful, a row each for every post; posts restricts it to a snapshot's members.
    """
    ready = within(ground_truths.select("post_id"), reviews.filter("status = 'validated'"), "post_id")
    ready = ready if posts is None else within(ready, posts, "post_id")
    done = predictions.filter(F.col("error").isNull() & F.col("model_id").isin(*models))
    return without(ready.withColumn("model_id", each(models)), done, "post_id", "model_id")


def pending_in_order(ids: DataFrame, ground_truths: DataFrame, reviews: DataFrame, predictions: DataFrame, model: str) -> DataFrame:
    """position, post_id of an explicit list (post_id, position) without exclusion and without a success of the model."""
    todo = within(ids, ground_truths, "post_id")
    todo = without(todo, reviews.filter("status = 'excluded'"), "post_id")
    return without(todo, predictions.filter((F.col("model_id") == model) & F.col("error").isNull()), "post_id").select("position", "post_id")


def pending_judgments(predictions: DataFrame, judgments: DataFrame, judges: list[str], reviews: DataFrame | None = None, posts: DataFrame | None = None) -> DataFrame:
    """(prediction_id, judge_model) not judged yet, of successful predictions.

    With reviews only validated posts count; a scoped run gives posts instead and needs no review. judges: a handful.
    """
    rows = predictions.filter("error is null").select(F.col("id").alias("prediction_id"), "post_id")
    rows = rows if reviews is None else within(rows, reviews.filter("status = 'validated'"), "post_id")
    rows = rows if posts is None else within(rows, posts, "post_id")
    pairs = rows.select("prediction_id", each(judges).alias("judge_model"))
    return without(pairs, judgments.filter(F.col("judge_model").isin(*judges)), "prediction_id", "judge_model")


def unjudged(predictions: DataFrame, judgments: DataFrame, reviews: DataFrame) -> DataFrame:
    """prediction_id of validated posts' successful predictions with no judgment at all."""
    rows = within(predictions.filter("error is null"), reviews.filter("status = 'validated'"), "post_id")
    return without(rows.select(F.col("id").alias("prediction_id")), judgments, "prediction_id")


def pending_rejudgments(latest: DataFrame, prompt_version: str) -> DataFrame:
    """prediction_id where any judge's newest judgment used the prompt; latest has judge_prompt_version."""
    return latest.filter(F.col("judge_prompt_version") == prompt_version).select("prediction_id").distinct()


def missing_images(posts: DataFrame, ground_truths: DataFrame, reviews: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Exclusions (post_id, status, reason) for grounded, unreviewed posts without an image file."""
    rows = posts.filter("local_image_path is null").select("post_id")
    rows = without(within(rows, ground_truths, "post_id"), reviews, "post_id")
    rows = rows if scope is None else within(rows, scope, "post_id")
    return rows.select("post_id", F.lit("excluded").alias("status"), F.lit("image_missing").alias("reason"))


def review_queue(ground_truths: DataFrame, reviews: DataFrame) -> DataFrame:
    return without(ground_truths.select("post_id"), reviews, "post_id")


def seeded_pick(rows: DataFrame, n: int, seed: str, key: str = "post_id") -> DataFrame:
    """n rows in the order of a hash of seed and key: random, yet the same each time; a top-n, not a full sort."""
    draw = F.sha2(F.concat(F.lit(seed), F.col(key)), 256)
    return rows.withColumn("_draw", draw).orderBy("_draw").limit(n).drop("_draw")


def remaining(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count("*").alias("remaining"))


def first_new_posts(candidates: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """position, post_id: the first n of candidates (post_id, seen, an order) that are not known, each once, numbered from 1."""
    first = candidates.groupBy("post_id").agg(F.min("seen").alias("seen"))
    chosen = without(first, known, "post_id").orderBy("seen", "post_id").limit(n)
    # at most n rows
    return chosen.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("seen", "post_id")).alias("position"), "post_id")

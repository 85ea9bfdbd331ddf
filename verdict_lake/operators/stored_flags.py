"""Where posts stand, stored once for many queues: tables in buckets by post_id.

A queue joins and groups by post_id alone, so that it reads the buckets where they lie and no large table is shuffled. What a
post has of predictions and judgments is a handful, and is compared within its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queues import done_in
from .status import consensus_ran, state

BUCKETS = 200


class StoredFlags:
    """Tables name_flags, name_predictions and name_judged of the session's catalog; their files lie in the warehouse."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    def _save(self, df: DataFrame, table: str) -> None:
        dealt = df.repartition(self.buckets, "post_id").write.mode("overwrite").bucketBy(self.buckets, "post_id").sortBy("post_id")
        dealt.saveAsTable(f"{self.name}_{table}")

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def store(self, posts: DataFrame, ground_truths: DataFrame, reviews: DataFrame, calls: DataFrame, predictions: DataFrame, judgments: DataFrame) -> None:
        """Store what the tables say of each post_id that any of posts, ground_truths and reviews has; rows without one are left out."""
        mark = lambda df, name, *more: df.filter("post_id is not null").select("post_id", *more, F.lit(True).alias(name))
        rows = mark(posts, "is_post", "subreddit", "title").join(mark(ground_truths, "has_gt"), "post_id", "full_outer")
        rows = rows.join(mark(reviews, "has_review", F.col("status").alias("review_status"), F.col("reason").alias("review_reason")), "post_id", "full_outer")
        rows = rows.join(mark(consensus_ran(calls), "ran"), "post_id", "left")
        flags = ("is_post", "has_gt", "has_review", "ran")
        self._save(rows.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags}), "flags")
        good = predictions.filter("error is null and post_id is not null").select("post_id", F.col("id").alias("prediction_id"), "model_id")
        self._save(good, "predictions")
        judged = judgments.filter("judge_model is not null").select("prediction_id", "judge_model").distinct()
        self._save(judged.join(good.select("post_id", "prediction_id"), "prediction_id"), "judged")

    def drop(self) -> None:
        for table in ("flags", "predictions", "judged"):
            self.spark.sql(f"drop table if exists {self.name}_{table}")

    def flags(self) -> DataFrame:
        return self.table("flags")

    def ready(self) -> DataFrame:
        """Validated posts with a ground truth."""
        return self.flags().filter("has_gt and review_status = 'validated'").select("post_id")

    def pending_gate(self, states: DataFrame | None = None, model: str = "", prompt_version: str = "") -> DataFrame:
        todo = self.flags().filter("is_post and not has_review and not has_gt").select("post_id")
        return todo if states is None else todo.join(done_in(states, "safety", model, prompt_version).select("post_id"), "post_id", "left_anti")

    def pending_consensus(self, states: DataFrame, model: str, prompt_version: str) -> DataFrame:
        todo = self.flags().filter("is_post and not has_gt and not (review_status <=> 'excluded')").select("post_id")
        return todo.join(done_in(states, "consensus", model, prompt_version).select("post_id"), "post_id", "left_anti")

    def pending_predictions(self, models: list[str]) -> DataFrame:
        """(post_id, model_id) of ready posts without a successful prediction of that model; models: a handful."""
        wanted = F.array(*map(F.lit, models)).cast("array<string>")
        done = self.table("predictions").filter(F.col("model_id").isin(*models)).groupBy("post_id").agg(F.collect_set("model_id").alias("done"))
        left = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        return self.ready().join(done, "post_id", "left").select("post_id", F.explode(left).alias("model_id"))

    def pending_judgments(self, judges: list[str]) -> DataFrame:
        """(prediction_id, judge_model) not judged yet, of successful predictions of validated posts; judges: a handful."""
        valid = self.flags().filter("review_status = 'validated'").select("post_id")
        mine = self.table("predictions").join(valid, "post_id", "left_semi").groupBy("post_id").agg(F.collect_list("prediction_id").alias("predictions"))
        seen = F.collect_set(F.struct("prediction_id", "judge_model")).alias("seen")
        judged = self.table("judged").filter(F.col("judge_model").isin(*judges)).groupBy("post_id").agg(seen)
        pairs = mine.join(judged, "post_id", "left").select(F.explode("predictions").alias("prediction_id"), "seen")
        pairs = pairs.select("prediction_id", F.explode(F.array(*map(F.lit, judges)).cast("array<string>")).alias("judge_model"), "seen")
        hit = F.exists("seen", lambda s: (s["prediction_id"] == F.col("prediction_id")) & (s["judge_model"] == F.col("judge_model")))
        return pairs.filter(~F.coalesce(hit, F.lit(False))).select("prediction_id", "judge_model")

    def states(self) -> DataFrame:
        """post_id, state."""
        return self.flags().filter("is_post").select("post_id", state().alias("state"))

    def listing(self, status: str | None = None, subreddit: str | None = None, title: str | None = None) -> DataFrame:
        """post_id, subreddit, title, review_status, filtered."""
        rows = self.flags().filter("is_post")
        shown = F.coalesce("review_status", F.when(F.col("has_gt"), "unreviewed").otherwise("no_consensus"))
        rows = rows.select("post_id", "subreddit", "title", shown.alias("review_status"))
        rows = rows if status is None else rows.filter(F.col("review_status") == status)
        rows = rows if subreddit is None else rows.filter(F.col("subreddit") == subreddit)
        return rows if title is None else rows.filter(F.ilike("title", F.lit(f"%{title}%")))

    def status_counts(self) -> DataFrame:
        """total, with_consensus, validated, excluded, unreviewed; one row."""
        counts = {"total": "is_post", "with_consensus": "has_gt", "validated": "review_status = 'validated'", "excluded": "review_status = 'excluded'", "unreviewed": "has_gt and not has_review"}
        return self.flags().agg(*(F.count_if(F.expr(c)).alias(n) for n, c in counts.items()))

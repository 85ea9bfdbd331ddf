"""Where posts stand: states, counts and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATE_ROLES = ("safety_gate", "quality_gate", "consensus")
#: Which gate a state points at, and which role logs a gate's calls.
STATE_GATE = {"safety_excluded": "safety", "quality_excluded": "quality", "no_consensus": "consensus"}
GATE_ROLE = {"safety": "safety_gate", "quality": "quality_gate", "consensus": "consensus"}


def consensus_ran(calls: DataFrame) -> DataFrame:
    return calls.filter("role = 'consensus'").select("post_id").distinct()


def post_flags(posts: DataFrame, ground_truths: DataFrame, reviews: DataFrame, calls: DataFrame) -> DataFrame:
    """posts with has_gt, review_status, review_reason and ran: the join that states and filters share."""
    truths = ground_truths.select("post_id", F.lit(True).alias("has_gt"))
    judged = reviews.select("post_id", F.col("status").alias("review_status"), F.col("reason").alias("review_reason"))
    ran = consensus_ran(calls).withColumn("ran", F.lit(True))
    rows = posts.join(truths, "post_id", "left").join(judged, "post_id", "left").join(ran, "post_id", "left")
    return rows.withColumns({"has_gt": F.coalesce("has_gt", F.lit(False)), "ran": F.coalesce("ran", F.lit(False))})


def state() -> Column:
    """The state of a row of post_flags. A null reason of an exclusion is a human one here."""
    reason = F.coalesce("review_reason", F.lit(""))
    excluded = F.when(F.startswith(reason, F.lit("safety:")), "safety_excluded").when(F.startswith(reason, F.lit("auto:")), "quality_excluded").when(reason == "image_missing", "image_missing").otherwise("human_excluded")
    open_ = F.when(F.col("has_gt"), "unreviewed").when(F.col("ran"), "no_consensus").otherwise("pending")
    return F.when(F.col("review_status") == "validated", "validated").when(F.col("review_status") == "excluded", excluded).otherwise(open_)


def classify_state(posts: DataFrame, ground_truths: DataFrame, reviews: DataFrame, calls: DataFrame) -> DataFrame:
    return post_flags(posts.select("post_id"), ground_truths, reviews, calls).select("post_id", state().alias("state"))


def review_status_listing(posts: DataFrame, ground_truths: DataFrame, reviews: DataFrame, status: str | None = None, subreddit: str | None = None, title: str | None = None) -> DataFrame:
    """post_id, subreddit, title, review_status (unreviewed or no_consensus without a review), filtered."""
    truths = ground_truths.select("post_id", F.lit(True).alias("gt"))
    rows = posts.select("post_id", "subreddit", "title").join(truths, "post_id", "left").join(reviews.select("post_id", "status"), "post_id", "left")
    rows = rows.select("post_id", "subreddit", "title", F.coalesce("status", F.when(F.col("gt"), "unreviewed").otherwise("no_consensus")).alias("review_status"))
    rows = rows if status is None else rows.filter(F.col("review_status") == status)
    rows = rows if subreddit is None else rows.filter(F.col("subreddit") == subreddit)
    return rows if title is None else rows.filter(F.ilike("title", F.lit(f"%{title}%")))


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """A page from number 0 on; Spark takes the top (number + 1) * size rows, without a full sort."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def status_counts(posts: DataFrame, ground_truths: DataFrame, reviews: DataFrame) -> DataFrame:
    """total, with_consensus, validated, excluded, unreviewed of each table as a whole; one row."""
    counts = posts.agg(F.count("*").alias("total")).crossJoin(ground_truths.agg(F.count("*").alias("with_consensus")))
    judged = reviews.agg(F.count_if(F.col("status") == "validated").alias("validated"), F.count_if(F.col("status") == "excluded").alias("excluded"))
    open_ = ground_truths.join(reviews.select("post_id"), "post_id", "left_anti").agg(F.count("*").alias("unreviewed"))
    return counts.crossJoin(judged).crossJoin(open_)


def prediction_counts(predictions: DataFrame, ground_truths: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per model: successful predictions on validated posts, those possible, and the rest."""
    ready = ground_truths.select("post_id").join(reviews.filter("status = 'validated'").select("post_id"), "post_id", "left_semi")
    good = predictions.filter("error is null").join(ready, "post_id", "left_semi")
    done = good.groupBy("model_id").agg(F.count("*").alias("predicted")).crossJoin(F.broadcast(ready.agg(F.count("*").alias("available"))))
    return done.withColumn("remaining", F.col("available") - F.col("predicted"))


def consensus_quality(ground_truths: DataFrame) -> DataFrame:
    """n, mean_confidence, upper_median_agreeing: null confidences and counts are 0. The upper median is the value at
    n div 2 of the sorted ones, found from the counts of the few distinct values without sorting the rows."""
    rows = ground_truths.select(F.coalesce("consensus_confidence", F.lit(0.0)).alias("c"), F.coalesce("num_agreeing_comments", F.lit(0)).alias("k"))
    totals = rows.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 4).alias("mean_confidence"))
    upto = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = rows.groupBy("k").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(upto))
    middle = values.crossJoin(F.broadcast(totals)).filter(F.col("upto") > F.floor(F.col("n") / 2)).agg(F.min("k").cast("long").alias("upper_median_agreeing"))
    return totals.crossJoin(middle)


def confidence_histogram(ground_truths: DataFrame) -> DataFrame:
    """bin 0 to 9 of confidences (1.0 falls in 9, null in 0) with their counts, empty bins too."""
    spark = ground_truths.sparkSession
    bins = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    place = F.least(F.lit(9), (F.coalesce("consensus_confidence", F.lit(0.0)) * 10).cast("int"))
    counted = ground_truths.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def batch_stage_counts(batch: DataFrame) -> DataFrame:
    return batch.groupBy("batch_id", "stage_status").agg(F.count("*").alias("n"))


def batch_summary(batch: DataFrame, ground_truths: DataFrame, predictions: DataFrame, judgments: DataFrame, model: str) -> DataFrame:
    """Per batch: posts, consensus, predictions and judgments of a model, prediction errors."""
    mine = predictions.filter((F.col("model_id") == model) & F.col("error").isNull())
    per_post = mine.groupBy("post_id").agg(F.count("*").alias("p"))
    verdicts = judgments.groupBy("prediction_id").agg(F.count("*").alias("j"))
    judged = mine.select(F.col("id").alias("prediction_id"), "post_id").join(verdicts, "prediction_id").groupBy("post_id").agg(F.sum("j").alias("j"))
    rows = batch.join(ground_truths.select("post_id", F.lit(1).alias("g")), "post_id", "left").join(per_post, "post_id", "left").join(judged, "post_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("batch_id").agg(F.count("*").alias("posts"), total("g").alias("consensus"), total("p").alias("predictions"), F.count_if(F.col("stage_status") == "prediction_error").alias("prediction_errors"), total("j").alias("judgments"))


def flag_counts(regressions: DataFrame, feedback: DataFrame) -> DataFrame:
    """kind, value, n: regressions by status and misfires by gate."""
    a = regressions.groupBy(F.lit("regression").alias("kind"), F.col("status").alias("value")).agg(F.count("*").alias("n"))
    return a.unionByName(feedback.groupBy(F.lit("misfire").alias("kind"), F.col("gate").alias("value")).agg(F.count("*").alias("n")))


def snapshot_models(predictions: DataFrame, members: DataFrame) -> DataFrame:
    return predictions.filter("error is null").join(members.select("post_id"), "post_id", "left_semi").select("model_id").distinct()


def call_log_filter(calls: DataFrame, role: str | None = None, post_id: str | None = None, session_id: str | None = None, errors_only: bool = False, newest: int | None = None) -> DataFrame:
    rows = calls
    for column, value in (("role", role), ("post_id", post_id), ("session_id", session_id)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    rows = rows.filter("error is not null") if errors_only else rows
    return rows if newest is None else rows.orderBy(F.col("id").desc()).limit(newest)


def latest_call_per_role(calls: DataFrame, roles: tuple[str, ...] = GATE_ROLES) -> DataFrame:
    """post_id, role, id, verdict, reasoning, error of the newest call of each gate role."""
    newest = calls.filter(F.col("role").isin(*roles)).groupBy("post_id", "role").agg(F.max("id").alias("id"), F.max_by(F.struct("verdict", "reasoning", "error"), "id").alias("x"))
    return newest.select("post_id", "role", "id", "x.*")


def gate_decision_lookup(states: DataFrame, latest: DataFrame, gate: str) -> DataFrame:
    """post_id, gate_decision: the newest call's verdict, or error, or for the consensus gate without a call no_consensus
    in that state; null where nothing is known. states: post_id, state."""
    calls = latest.filter(F.col("role") == GATE_ROLE[gate]).select("post_id", F.lit(True).alias("called"), "verdict", "error")
    rows = states.join(calls, "post_id", "left")
    logged = F.coalesce("verdict", F.when(F.coalesce("error", F.lit("")) != "", "error"))
    inferred = F.when(F.col("state") == "no_consensus", "no_consensus") if gate == "consensus" else F.lit(None).cast("string")
    return rows.select("post_id", F.when(F.col("called"), logged).otherwise(inferred).alias("gate_decision"))


def backfill_state(calls: DataFrame) -> DataFrame:
    """Terminal states from the newest successful call of each (post, role, model, prompt)."""
    verdicts = ("keep", "exclude", "consensus", "no_consensus")
    good = calls.filter(F.col("role").isin("safety_gate", "consensus") & F.col("verdict").isin(*verdicts) & F.col("error").isNull())
    newest = good.groupBy("post_id", "role", "model", "prompt_version").agg(F.max("id").alias("llm_call_id"), F.max_by(F.struct("verdict", "reasoning"), "id").alias("x"))
    safety, verdict = F.col("role") == "safety_gate", F.col("x.verdict")
    status = F.when(safety & (verdict == "keep"), "passed").when(safety & (verdict == "exclude"), "excluded").when(~safety & verdict.isin("consensus", "no_consensus"), verdict)
    rows = newest.select("post_id", F.when(safety, "safety").otherwise("consensus").alias("stage"), "model", "prompt_version", status.alias("status"), F.col("x.reasoning").alias("reasoning"), "llm_call_id")
    return rows.filter("status is not null")


def ingest_stats(post_counts: DataFrame, comment_counts: DataFrame, states: DataFrame) -> DataFrame:
    """name, n: rows that the merges inserted and terminal states by stage, as an ingest run reports them."""
    merged = post_counts.unionByName(comment_counts).filter("merge_action = 'inserted'").select(F.concat(F.lit("new "), F.col("table_name")).alias("name"), "n")
    return merged.unionByName(states.groupBy(F.concat_ws(" ", "stage", "status").alias("name")).agg(F.count("*").alias("n")))


def facets(posts: DataFrame, predictions: DataFrame) -> DataFrame:
    """facet, value: distinct subreddits and models."""
    a = posts.select(F.lit("subreddit").alias("facet"), F.col("subreddit").alias("value")).distinct()
    return a.unionByName(predictions.select(F.lit("model").alias("facet"), F.col("model_id").alias("value")).distinct())


def validated_by_title(posts: DataFrame, reviews: DataFrame, n: int) -> DataFrame:
    """The first n validated posts by title, then id."""
    rows = posts.join(reviews.filter("status = 'validated'").select("post_id"), "post_id", "left_semi")
    return rows.select("post_id", "title").orderBy("title", "post_id").limit(n)


def truncated(text: Column, n: int, empty: str = "") -> Column:
    """One line of at most n characters, cut with an ellipsis."""
    line = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit(empty)), "\n", " "), r"^\s+|\s+$", "")
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)

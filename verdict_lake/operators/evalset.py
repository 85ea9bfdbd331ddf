"""The evaluation set of the consensus step: its items, samples and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .judging import ratio
from .queues import seeded_pick, within, without
from .snapshot import latest_of


def seed_from_flags(regressions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Items from flagged ground truths and consensus misfires; the later source wins on a post."""
    bad = F.col("status").isin("wrong", "partial")
    a = regressions.select(
        "post_id", F.when(bad, "bad_gloss").otherwise("hard_yes_consensus").alias("category"), F.lit(True).alias("expected_has_consensus"),
        F.coalesce(F.nullif("canonical_explanation", F.lit("")), "consensus_at_annotation").alias("expected_explanation"), F.lit("consensus_regression").alias("source"),
        F.coalesce(F.nullif("failure_modes", F.lit("")), "reviewer_notes").alias("notes"), F.lit(0).alias("rank"),
    )
    decision, gate = F.lower(F.coalesce("correct_decision", F.lit(""))), F.lower(F.coalesce("gate_decision", F.lit("")))
    no = F.contains(decision, F.lit("no")) & F.contains(decision, F.lit("consensus"))
    yes = F.contains(decision, F.lit("consensus")) | F.contains(gate, F.lit("no_consensus"))
    b = feedback.filter("gate = 'consensus'").select(
        "post_id", F.when(no, "false_positive_consensus").when(yes, "hard_yes_consensus").otherwise("bad_gloss").alias("category"), (~no).alias("expected_has_consensus"),
        F.lit(None).cast("string").alias("expected_explanation"), F.lit("gate_feedback").alias("source"), "notes", F.lit(1).alias("rank"),
    )
    picked = a.unionByName(b).groupBy("post_id").agg(F.max_by(F.struct("category", "expected_has_consensus", "expected_explanation", "source", "notes"), "rank").alias("x"))
    return picked.select("post_id", "x.*")


def sample_yes_controls(reviews: DataFrame, ground_truths: DataFrame, items: DataFrame, n: int, seed: str) -> DataFrame:
    """n validated, grounded posts that are no items yet."""
    rows = within(ground_truths.select("post_id"), reviews.filter("status = 'validated'"), "post_id")
    return seeded_pick(without(rows, items, "post_id"), n, seed)


def sample_no_controls(states: DataFrame, reviews: DataFrame, ground_truths: DataFrame, items: DataFrame, n: int, seed: str) -> DataFrame:
    """n posts that ended without a consensus, ungrounded, not excluded, that are no items yet."""
    rows = states.filter("stage = 'consensus' and status = 'no_consensus'").select("post_id").distinct()
    rows = without(without(rows, ground_truths, "post_id"), reviews.filter("status = 'excluded'"), "post_id")
    return seeded_pick(without(rows, items, "post_id"), n, seed)


def eval_category_counts(items: DataFrame) -> DataFrame:
    """category (null: all), n of active items."""
    return items.filter("active").rollup("category").agg(F.count("*").alias("n"))


def eval_report(results: DataFrame) -> DataFrame:
    """Per run and category (null: all): total, passed, failed, expected yes and no, false positives, negatives, accuracy."""
    expected, actual = F.col("expected_has_consensus"), F.col("actual_has_consensus")
    counted = results.groupBy("run_id", "category").agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(expected).alias("expected_yes"),
        F.count_if(~expected & actual).alias("false_positive"), F.count_if(expected & ~actual).alias("false_negative"),
    )
    # totals of totals: the second level reads a few rows
    both = counted.groupBy("run_id", "category").agg(*(F.sum(c).alias(c) for c in counted.columns[2:])).unionByName(
        counted.groupBy("run_id").agg(*(F.sum(c).alias(c) for c in counted.columns[2:])).withColumn("category", F.lit(None).cast("string"))
    )
    total, passed = F.col("total"), F.col("passed")
    return both.select("run_id", "category", "total", "passed", (total - passed).alias("failed"), "expected_yes", (total - F.col("expected_yes")).alias("expected_no"), "false_positive", "false_negative", F.round(ratio(passed, total), 6).alias("accuracy"))


def recent_results_per_item(results: DataFrame, n: int = 5) -> DataFrame:
    """The newest n results of each item."""
    return latest_of(results, "post_id", "run_order", n).select("post_id", "position", "run_id", "passed")


def latest_eval_run(results: DataFrame) -> DataFrame:
    return results.agg(F.max_by("run_id", "run_order").alias("run_id"))


def eval_item_filter(items: DataFrame, posts: DataFrame, category: str | None = None, search: str = "", n: int = 3000) -> DataFrame:
    """Active items by category and title or id, in the order of category, newest update and id, n at most."""
    rows = items.filter("active").join(posts.select("post_id", "title"), "post_id")
    rows = rows if category is None else rows.filter(F.col("category") == category)
    rows = rows if not search else rows.filter(F.ilike("title", F.lit(f"%{search}%")) | F.ilike("post_id", F.lit(f"%{search}%")))
    label = F.when(F.col("expected_has_consensus"), "consensus").otherwise("no consensus")
    return rows.select("post_id", "title", "category", label.alias("expected"), "updated_at").orderBy("category", F.col("updated_at").desc(), "post_id").limit(n).drop("updated_at")


def relabel_eval_items(items: DataFrame, actions: DataFrame) -> DataFrame:
    """items after bulk actions (post_id, action, explanation, reviewer_notes, noted_at): confirm, consensus, no_consensus or deactivate.

    Each adds a dated line to the notes; a blank explanation keeps the old one.
    """
    rows = items.join(actions, "post_id", "left")
    action, given = F.col("action"), F.nullif(F.trim(F.coalesce("explanation", F.lit(""))), F.lit(""))
    yes, no = action == "consensus", action == "no_consensus"
    comment = F.trim(F.coalesce("reviewer_notes", F.lit("")))
    line = F.concat("noted_at", F.lit(" eval_review: "), action, F.when(comment != "", F.concat(F.lit(" - "), comment)).otherwise(""))
    notes = F.when(action.isNull(), F.col("notes")).otherwise(F.concat_ws("\n", F.nullif(F.trim(F.coalesce("notes", F.lit(""))), F.lit("")), line))
    explanation = F.when(no, F.lit(None)).when(yes | (action == "confirm"), F.coalesce(given, "expected_explanation")).otherwise(F.col("expected_explanation"))
    return rows.select(
        "post_id",
        F.when(yes, "hard_yes_consensus").when(no, "true_no_consensus").otherwise(F.col("category")).alias("category"),
        F.when(yes, True).when(no, False).otherwise(F.col("expected_has_consensus")).alias("expected_has_consensus"),
        explanation.alias("expected_explanation"),
        notes.alias("notes"),
        F.when(yes | no, True).when(action == "deactivate", False).otherwise(F.col("active")).alias("active"),
    )

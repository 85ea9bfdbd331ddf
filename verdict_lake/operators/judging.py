"""Judgments to votes, agreement rates and leaderboards.

Everything starts from the newest judgment of each (prediction, judge). A judgment without a judge is history only: it
never is the newest of anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Models that summaries no longer show.
RETIRED_MODELS = ("claude-opus-4-7",)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 for an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def latest_per_judge(judgments: DataFrame, *columns: str) -> DataFrame:
    """prediction_id, judge_model, id and the columns (verdict by default) of the newest judgment of each pair.

    max_by combines on the map side, so only one row of each pair and task is shuffled.
    """
    columns = columns or ("verdict",)
    newest = judgments.filter("judge_model is not null").groupBy("prediction_id", "judge_model").agg(F.max("id").alias("id"), F.max_by(F.struct(*columns), "id").alias("x"))
    return newest.select("prediction_id", "judge_model", "id", *(F.col("x")[c].alias(c) for c in columns))


def judgment_history(judgments: DataFrame) -> DataFrame:
    """All judgments with is_latest; unnamed judges show as (unknown) and are never the latest."""
    newest = Window.partitionBy("prediction_id", "judge_model")
    latest = F.col("judge_model").isNotNull() & (F.col("id") == F.max("id").over(newest))
    return judgments.withColumn("is_latest", latest).withColumn("judge_model", F.coalesce("judge_model", F.lit("(unknown)")))


def votes(latest: DataFrame) -> DataFrame:
    """A row a prediction: judges, verdicts (distinct), correct_n, incorrect_n and the majority verdict.

    A verdict needs two votes and more than the other side has.
    """
    counted = latest.groupBy("prediction_id").agg(
        F.count("*").alias("judges"),
        (F.max("verdict") != F.min("verdict")).alias("split"),
        F.count_if(F.col("verdict") == "correct").alias("correct_n"),
        F.count_if(F.col("verdict") == "incorrect").alias("incorrect_n"),
    )
    correct, incorrect = F.col("correct_n"), F.col("incorrect_n")
    verdict = F.when((correct >= 2) & (correct > incorrect), "correct").when((incorrect >= 2) & (incorrect > correct), "incorrect")
    return counted.withColumn("consensus_verdict", verdict)


def voted_predictions(predictions: DataFrame, judgments: DataFrame) -> DataFrame:
    """id, post_id, model_id, error of judged predictions with their votes; the table that the summaries share.

    Judgments are dealt by prediction once, without their texts; newest rows, votes and the join all keep that dealing.
    """
    slim = predictions.select(F.col("id").alias("prediction_id"), "post_id", "model_id", "error")
    dealt = judgments.filter("judge_model is not null").select("id", "prediction_id", "judge_model", "verdict").repartition("prediction_id")
    return votes(latest_per_judge(dealt)).join(slim, "prediction_id")


def judgment_counts(predictions: DataFrame, judgments: DataFrame) -> DataFrame:
    """Per model and judge: judged, correct, incorrect, accuracy over the newest verdicts."""
    slim = predictions.select(F.col("id").alias("prediction_id"), "model_id")
    counted = latest_per_judge(judgments).join(slim, "prediction_id").groupBy("model_id", "judge_model").agg(
        F.count("*").alias("judged"),
        F.count_if(F.col("verdict") == "correct").alias("correct"),
        F.count_if(F.col("verdict") == "incorrect").alias("incorrect"),
    )
    return counted.withColumn("accuracy", F.round(ratio(F.col("correct"), F.col("judged")), 6))


def consensus_counts(voted: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Per model: correct, incorrect, total and accuracy by majority of successful predictions, of the given posts."""
    rows = voted.filter("error is null and consensus_verdict is not null")
    rows = rows if posts is None else rows.join(posts.select("post_id").distinct(), "post_id", "left_semi")
    counted = rows.groupBy("model_id").agg(F.count_if(F.col("consensus_verdict") == "correct").alias("correct"), F.count("*").alias("total"))
    return counted.select("model_id", "correct", (F.col("total") - F.col("correct")).alias("incorrect"), "total", F.round(ratio(F.col("correct"), F.col("total")), 6).alias("accuracy"))


def judge_agreement(voted: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Per model: predictions that several judges judged, those of one verdict, and the rate; failed predictions count too.

    touched (prediction_id) restricts it to a run's predictions and drops models without several judges.
    """
    rows = voted if touched is None else voted.join(touched.select("prediction_id").distinct(), "prediction_id", "left_semi")
    several = F.col("judges") > 1
    counted = rows.groupBy("model_id").agg(F.count_if(several).alias("judged_by_multiple"), F.count_if(several & ~F.col("split")).alias("unanimous_agreements"))
    counted = counted if touched is None else counted.filter("judged_by_multiple > 0")
    return counted.withColumn("agreement_rate", F.round(ratio(F.col("unanimous_agreements"), F.col("judged_by_multiple")), 6))


def active_models(df: DataFrame, retired: tuple[str, ...] = RETIRED_MODELS) -> DataFrame:
    return df.filter(~F.col("model_id").isin(*retired))


def leaderboard(voted: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Active models by majority accuracy with their agreement; rank by accuracy, then model id."""
    counts, several = F.col("error").isNull() & F.col("consensus_verdict").isNotNull(), F.col("judges") > 1
    if posts is not None:
        voted = voted.join(posts.select("post_id", F.lit(True).alias("in_scope")).distinct(), "post_id", "left")
        counts = counts & F.coalesce("in_scope", F.lit(False))
    # majorities and agreement from one pass over the votes
    counted = active_models(voted).groupBy("model_id").agg(
        F.count_if(counts & (F.col("consensus_verdict") == "correct")).alias("correct"),
        F.count_if(counts).alias("total"),
        F.count_if(several).alias("judged_by_multiple"),
        F.count_if(several & ~F.col("split")).alias("unanimous_agreements"),
    )
    board = counted.filter("total > 0").withColumn("accuracy", F.round(ratio(F.col("correct"), F.col("total")), 6))
    # one row a model: the ranking window sorts a handful of rows
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(ratio(F.col("correct"), F.col("total")).desc(), "model_id"))
    agreement = F.round(ratio(F.col("unanimous_agreements"), F.col("judged_by_multiple")), 6)
    return board.select(
        rank.alias("rank"), "model_id", F.lit("consensus").alias("judge_model"), "correct", (F.col("total") - F.col("correct")).alias("incorrect"), "total", "accuracy",
        "judged_by_multiple", "unanimous_agreements", agreement.alias("agreement_rate"),
    )


def leaderboard_rows(board: DataFrame) -> DataFrame:
    """The leaderboard as displayed."""
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    agreed = F.concat(F.col("unanimous_agreements").cast("string"), F.lit("/"), F.col("judged_by_multiple").cast("string"), F.lit(" ("), percent("agreement_rate"), F.lit(")"))
    return board.select("model_id", "correct", "incorrect", "total", percent("accuracy").alias("accuracy_text"), agreed.alias("agreement_text"))


def judge_run_stats(outcomes: DataFrame) -> DataFrame:
    """Per judge of a run (judge_model, verdict or error): correct, incorrect, errors and accuracy in percent."""
    counted = outcomes.groupBy("judge_model").agg(
        F.count_if(F.col("error").isNull() & (F.col("verdict") == "correct")).alias("correct"),
        F.count_if(F.col("error").isNull() & (F.col("verdict") == "incorrect")).alias("incorrect"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    return counted.withColumn("accuracy", F.round(100 * ratio(F.col("correct"), F.col("correct") + F.col("incorrect")), 6))


def prediction_comparison(predictions: DataFrame, judgments: DataFrame) -> DataFrame:
    """Successful predictions with their votes, verdicts by judge and the consensus as text."""
    latest = latest_per_judge(judgments)
    by_judge = latest.groupBy("prediction_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("judge_model", "verdict"))), lambda x: F.concat(x["judge_model"], F.lit("="), x["verdict"])), ";").alias("verdicts"))
    good = predictions.filter("error is null").select(F.col("id").alias("prediction_id"), "post_id", "model_id")
    rows = good.join(votes(latest), "prediction_id", "left").join(by_judge, "prediction_id", "left")
    label = F.when(F.col("judges").isNull(), "No judge evaluations yet").when(F.col("consensus_verdict").isNotNull(), F.concat(F.lit("Consensus: "), F.col("consensus_verdict"))).otherwise("No consensus verdict")
    return rows.select("prediction_id", "post_id", "model_id", F.coalesce("correct_n", F.lit(0)).alias("correct_n"), F.coalesce("incorrect_n", F.lit(0)).alias("incorrect_n"), F.coalesce("verdicts", F.lit("")).alias("verdicts"), label.alias("label"))


def predictions_with_verdict_map(predictions: DataFrame, judgments: DataFrame) -> DataFrame:
    """Successful predictions with a map from judge to its newest verdict and reasoning."""
    latest = latest_per_judge(judgments, "verdict", "judge_reasoning")
    maps = latest.groupBy("prediction_id").agg(F.map_from_entries(F.collect_list(F.struct("judge_model", F.struct("verdict", F.col("judge_reasoning").alias("reasoning"))))).alias("verdicts"))
    return predictions.filter("error is null").select(F.col("id").alias("prediction_id"), "post_id", "model_id").join(maps, "prediction_id", "left")

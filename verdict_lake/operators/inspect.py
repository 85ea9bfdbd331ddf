"""Search and filters over posts: each is a semi or anti join on post_id, so that they combine freely."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .judging import latest_per_judge

CAP = 3000


def like_any(needle: str, *columns: str) -> Column:
    """Whether any column holds the needle, as LIKE does, whatever the case; % and _ in it are wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.ilike(F.col(c).cast("string"), F.lit(f"%{needle}%")), F.lit(False))
    return hit


def full_search(needle: str, searched: Iterable[tuple]) -> DataFrame:
    """post_id of posts with the needle in any of the tables.

    searched: tables with the columns to search, and for tables without post_id another that maps their key to it:
    (table, columns) or (table, columns, key, posts of key). Each table is filtered in its own scan before anything is
    joined, and the ids are united, instead of an OR of EXISTS, which would become nested loops.
    """
    found = None
    for df, columns, *way in searched:
        ids = df.filter(like_any(needle, *columns))
        if way:
            key, posts = way
            ids = posts.select(key, "post_id").join(ids.select(key), key, "left_semi")
        ids = ids.select("post_id")
        found = ids if found is None else found.unionByName(ids)
    return found.distinct()


def of_model(df: DataFrame, model: str | None) -> DataFrame:
    return df if model is None else df.filter(F.col("model_id") == model)


def prediction_coverage(posts: DataFrame, predictions: DataFrame, present: bool = True, model: str | None = None) -> DataFrame:
    """Posts with (or without) a successful prediction, of a model or any."""
    good = of_model(predictions.filter("error is null"), model)
    return posts.join(good.select("post_id"), "post_id", "left_semi" if present else "left_anti")


def evaluation_coverage(posts: DataFrame, predictions: DataFrame, judgments: DataFrame, present: bool = True, model: str | None = None) -> DataFrame:
    """Posts with (or without) a judgment of a successful prediction."""
    good = of_model(predictions.filter("error is null"), model).select(F.col("id").alias("prediction_id"), "post_id")
    judged = good.join(judgments.select("prediction_id"), "prediction_id", "left_semi")
    return posts.join(judged.select("post_id"), "post_id", "left_semi" if present else "left_anti")


def verdict_class(predictions: DataFrame, judgments: DataFrame, model: str | None = None) -> DataFrame:
    """post_id, verdict_class (all_correct, all_incorrect, mixed): a simple majority of newest verdicts settles a
    prediction, so that one vote counts; ties settle nothing."""
    good = of_model(predictions.filter("error is null"), model).select(F.col("id").alias("prediction_id"), "post_id")
    balance = F.sum(F.when(F.col("verdict") == "correct", 1).when(F.col("verdict") == "incorrect", -1).otherwise(0))
    per = latest_per_judge(judgments).groupBy("prediction_id").agg(balance.alias("balance")).filter("balance <> 0").join(good, "prediction_id")
    classes = per.groupBy("post_id").agg(F.bool_or(F.col("balance") > 0).alias("c"), F.bool_or(F.col("balance") < 0).alias("i"))
    return classes.select("post_id", F.when(F.col("c") & F.col("i"), "mixed").when(F.col("c"), "all_correct").otherwise("all_incorrect").alias("verdict_class"))


def tag_filter(posts: DataFrame, tags: DataFrame, meme_tags: DataFrame, mode: str, names: list[str] = ()) -> DataFrame:
    """Posts that are tagged, untagged, or have any / all / none of the names, whatever their ASCII case.

    Names are unique, so no more tags than names are broadcast. Untagged takes no notice of names, and any, all_tags and exclude do nothing without them.
    """
    wanted = sorted({n.lower() for n in names})
    chosen = meme_tags.join(F.broadcast(tags.filter(F.lower("name").isin(*wanted)).select("tag_id")), "tag_id") if wanted else meme_tags
    if mode == "untagged":
        return posts.join(meme_tags.select("post_id"), "post_id", "left_anti")
    if mode == "tagged" or mode == "any" and wanted:
        return posts.join(chosen.select("post_id"), "post_id", "left_semi")
    if mode == "exclude" and wanted:
        return posts.join(chosen.select("post_id"), "post_id", "left_anti")
    if mode == "all_tags" and wanted:
        full = chosen.groupBy("post_id").agg(F.countDistinct("tag_id").alias("n")).filter(F.col("n") == len(wanted))
        return posts.join(full.select("post_id"), "post_id", "left_semi")
    return posts


def inspect_order(rows: DataFrame, needle: str = "", cap: int = CAP) -> DataFrame:
    """The ids to step through: an exact id first, then ids descending, cap at most."""
    exact = F.when(F.lower("post_id") == needle.strip().lower(), 0).otherwise(1)
    return rows.select("post_id").orderBy(exact, F.col("post_id").desc()).limit(cap)


def source_ids(column: str = "source_comment_ids") -> Column:
    """The ids of a JSON array in text; none if it is not one."""
    return F.filter(F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def source_vs_other_comments(sources: DataFrame, comments: DataFrame, others: int = 5) -> DataFrame:
    """post_id, section (source or other), position, comment_id: source comments by score, then the top others."""
    listed = sources.select("post_id", F.explode(source_ids()).alias("comment_id")).distinct()
    slim = comments.select("post_id", "comment_id", "score")
    mine = slim.join(listed, ["post_id", "comment_id"], "left_semi").withColumn("section", F.lit("source"))
    rest = slim.join(sources.select("post_id"), "post_id", "left_semi").join(listed, ["post_id", "comment_id"], "left_anti").withColumn("section", F.lit("other"))
    order = Window.partitionBy("post_id", "section").orderBy(F.col("score").desc(), "comment_id")
    ranked = mine.unionByName(rest).withColumn("position", F.row_number().over(order))
    return ranked.filter((F.col("section") == "source") | (F.col("position") <= others)).select("post_id", "section", "position", "comment_id")


def filter_published(posts: DataFrame, predictions: DataFrame, search: str = "", model: str | None = None, outcome: str | None = None) -> DataFrame:
    """post_id of published posts by text, model and outcome: the set of verdicts must be exactly the outcome's."""
    needle = search.strip().lower()
    line = F.lower(F.concat_ws(" ", "post_id", "title", "subreddit", "ground_truth"))
    rows = posts.filter(F.contains(line, F.lit(needle))).select("post_id") if needle else posts.select("post_id")
    mine = of_model(predictions, model)
    rows = rows if model is None else rows.join(mine.select("post_id"), "post_id", "left_semi")
    if outcome is None:
        return rows
    seen = mine.groupBy("post_id").agg(F.bool_or(F.col("consensus_verdict") == "correct").alias("c"), F.bool_or(F.col("consensus_verdict") == "incorrect").alias("i"))
    c, i = F.coalesce("c", F.lit(False)), F.coalesce("i", F.lit(False))
    wanted = {"all_correct": c & ~i, "all_incorrect": i & ~c, "mixed": c & i}[outcome]
    return rows.join(seen.filter(wanted).select("post_id"), "post_id", "left_semi")


def sort_published(predictions: DataFrame, judgments: DataFrame) -> DataFrame:
    """prediction_id, post_id, position of the prediction by model in its post, newest judges in order, historical count."""
    order = Window.partitionBy("post_id").orderBy("model_id", "prediction_id")
    judged = judgments.groupBy("prediction_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_latest"), F.col("judge_model")))), ",").alias("judges"),
        F.count_if(~F.col("is_latest")).alias("historical"),
    )
    rows = predictions.select("prediction_id", "post_id", "model_id").withColumn("position", F.row_number().over(order))
    return rows.join(judged, "prediction_id", "left").select("prediction_id", "post_id", "position", F.coalesce("judges", F.lit("")).alias("judges"), F.coalesce("historical", F.lit(0)).alias("historical"))

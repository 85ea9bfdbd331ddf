"""Prompts from top comments, and the rule chain over the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import strip

MIN_COMMENT_SCORE, MAX_COMMENTS, MIN_QUALIFYING = 5, 10, 3
MIN_CONFIDENCE, MIN_EXPLANATION, MIN_AVG_SCORE, MIN_AGREEING = 0.6, 100, 5.0, 3
# Phrases of explanations that say nothing.
VAGUE_PHRASES = (
    "absurd humor",
    "random humor",
    "no clear meaning",
    "is from the show",
    "it's relatable",
    "it's just",
    "everyone can relate",
    "pretty self-explanatory",
)


def qualifying_comments(comments: DataFrame, min_score: int = MIN_COMMENT_SCORE, most: int = MAX_COMMENTS) -> DataFrame:
    """post_id, comment_id, author, body, score, rank: the top comments of each post, ties by comment_id.

    Low scores leave before the shuffle, and Spark limits each group on both sides of it.
    """
    order = Window.partitionBy("post_id").orderBy(F.col("score").desc(), "comment_id")
    rows = comments.filter(F.col("score") >= min_score).withColumn("rank", F.row_number().over(order))
    return rows.filter(F.col("rank") <= most).select("post_id", "comment_id", "author", "body", "score", "rank")


def lines_per_post(top: DataFrame, line: Column) -> DataFrame:
    """post_id, n and the lines of its (at most ten) top comments in order."""
    return top.groupBy("post_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def consensus_prompts(posts: DataFrame, top: DataFrame) -> DataFrame:
    """post_id, n, called, prompt: posts with fewer than three top comments get no call, and a null prompt."""
    line = F.concat(F.lit("ID: "), "comment_id", F.lit(" | Score: "), F.col("score").cast("string"), F.lit(" | Author: "), "author", F.lit("\n"), "body", F.lit("\n---"))
    rows = posts.select("post_id", "subreddit").join(lines_per_post(top, line), "post_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    called = F.col("n") >= MIN_QUALIFYING
    prompt = F.concat(F.lit("Subreddit: r/"), "subreddit", F.lit("\n\nComments ("), F.col("n").cast("string"), F.lit(" total):\n"), "lines")
    return rows.select("post_id", "n", called.alias("called"), F.when(called, prompt).alias("prompt"))


def safety_prompts(posts: DataFrame, top: DataFrame) -> DataFrame:
    """post_id, prompt: title and top comments, however few."""
    line = F.concat(F.lit("- ("), F.col("score").cast("string"), F.lit(") "), "body")
    rows = posts.select("post_id", "subreddit", "title").join(lines_per_post(top, line), "post_id", "left")
    prompt = F.concat(F.lit("Subreddit: r/"), "subreddit", F.lit("\nTitle: "), "title", F.lit("\n\nTop comments ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" total):\n"), F.coalesce("lines", F.lit("")))
    return rows.select("post_id", prompt.alias("prompt"))


def judge_prompts(pairs: DataFrame, predictions: DataFrame, ground_truths: DataFrame) -> DataFrame:
    """prediction_id, judge_model, prompt for (prediction, judge) pairs."""
    rows = pairs.join(predictions.select(F.col("id").alias("prediction_id"), "post_id", "prediction"), "prediction_id").join(ground_truths.select("post_id", "explanation"), "post_id")
    prompt = F.concat(F.lit("Ground Truth Explanation:\n"), "explanation", F.lit("\n\nModel's Explanation:\n"), "prediction")
    return rows.select("prediction_id", "judge_model", prompt.alias("prompt"))


def typed(field: str, kinds: tuple[str, ...], to: str, of: str = "v") -> Column:
    """A field of a VARIANT if it has one of the kinds, cast; null otherwise."""
    raw = F.try_variant_get(of, f"$.{field}", "variant")
    kind = F.schema_of_variant(raw)
    allowed = F.lit(False)
    for k in kinds:
        allowed = allowed | F.startswith(kind, F.lit(k))
    return F.when(F.coalesce(allowed, F.lit(False)), F.try_variant_get(of, f"$.{field}", to))


NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def as_number(field: str) -> Column:
    """A number, or a string that is one."""
    return F.coalesce(typed(field, NUMBERS, "double"), strip(typed(field, ("STRING",), "string")).try_cast("double"), typed(field, ("BOOLEAN",), "boolean").cast("double"))


def as_boolean(field: str) -> Column:
    """A boolean, 0 or 1, or a word for one."""
    word = F.lower(typed(field, ("STRING",), "string"))
    number = typed(field, NUMBERS, "double")
    from_word = F.when(word.isin("true", "t", "yes", "y", "on", "1"), True).when(word.isin("false", "f", "no", "n", "off", "0"), False)
    return F.coalesce(typed(field, ("BOOLEAN",), "boolean"), from_word, F.when(number == 1, True).when(number == 0, False))


def present(field: str) -> Column:
    return F.try_variant_get("v", f"$.{field}", "variant").isNotNull()


def is_null(field: str) -> Column:
    """A JSON null, which is not an absent field."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant")) == "VOID", F.lit(False))


def parse_consensus(responses: DataFrame) -> DataFrame:
    """responses (post_id, response) with parsed and the fields of the answer; wrong types make it unparsed."""
    ids = "agreeing_comment_ids"
    kind = F.schema_of_variant(F.try_variant_get("v", f"$.{ids}", "variant"))
    ids_ok = ~present(ids) & ~is_null(ids) | F.coalesce(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    rows = responses.withColumn("v", F.try_parse_json("response"))
    rows = rows.withColumns(
        {
            "has_consensus": as_boolean("has_consensus"),
            "confidence": as_number("confidence"),
            "reasoning": typed("reasoning", ("STRING",), "string"),
            "explanation": typed("selected_explanation", ("STRING",), "string"),
            "ids": F.coalesce(F.try_variant_get("v", f"$.{ids}", "array<string>"), F.array().cast("array<string>")),
            "_ids_ok": ids_ok,
            "_explanation_ok": ~present("selected_explanation") | is_null("selected_explanation") | F.col("v").isNotNull() & typed("selected_explanation", ("STRING",), "string").isNotNull(),
            "_confidence_given": present("confidence"),
            "_object": F.startswith(F.coalesce(F.schema_of_variant("v"), F.lit("")), F.lit("OBJECT")),
        }
    )
    confidence_ok = F.col("confidence").isNotNull() | ~F.col("_confidence_given")
    parsed = F.col("_object") & F.col("has_consensus").isNotNull() & F.col("_ids_ok") & F.col("_explanation_ok") & confidence_ok
    return rows.withColumn("parsed", F.coalesce(parsed, F.lit(False))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).drop("v", "_ids_ok", "_explanation_ok", "_confidence_given", "_object")


def early_stage() -> Column:
    """The first rule that a parsed answer breaks by itself; null if only its comments can still reject it."""
    text = F.coalesce(strip(F.col("explanation")), F.lit(""))
    vague = F.lit(False)
    for phrase in VAGUE_PHRASES:
        vague = vague | F.contains(F.lower(text), F.lit(phrase))
    return (
        F.when(~F.col("parsed"), "parse_error")
        .when(~F.col("has_consensus"), "no_consensus")
        .when(F.col("confidence") < MIN_CONFIDENCE, "low_confidence")
        .when(text == "", "no_explanation")
        .when(F.length(text) < MIN_EXPLANATION, "short_explanation")
        .when(vague, "vague_phrase")
    )


def validate_consensus(responses: DataFrame, comments: DataFrame) -> DataFrame:
    """post_id, stage, accepted, num_agreeing, avg_score: the first rule that an answer breaks, or accepted.

    The average looks the ids up among all of the post's comments, counts repeats and skips unknown ones; the number of
    agreeing comments is that of the list. The average is tested first. Answers that don't parse end at parse_error. A post
    may have several answers; repeats of one give one row. Answers are read once, and only the ids of those that no
    earlier rule rejects meet the comments.
    """
    answers = parse_consensus(responses).withColumn("early", early_stage())
    open_ids = F.when(F.col("early").isNull(), F.col("ids"))
    listed = answers.select("post_id", F.xxhash64("response").alias("answer"), "early", F.size("ids").alias("n"), F.explode_outer(open_ids).alias("comment_id"))
    met = listed.join(comments.select("post_id", "comment_id", "score"), ["post_id", "comment_id"], "left")
    rows = met.groupBy("post_id", "answer", "early", "n").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg"))
    late = F.when(F.col("avg") < MIN_AVG_SCORE, "low_score").when(F.col("n") < MIN_AGREEING, "few_agreeing").otherwise("accepted")
    rows = rows.withColumn("stage", F.coalesce("early", late))
    counted = F.col("stage").isin("few_agreeing", "accepted")
    scored = counted | (F.col("stage") == "low_score")
    return rows.select("post_id", "stage", (F.col("stage") == "accepted").alias("accepted"), F.when(counted, F.col("n")).otherwise(0).alias("num_agreeing"), F.round(F.when(scored, F.col("avg")).otherwise(0.0), 6).alias("avg_score"))


def terminal_consensus(validated: DataFrame) -> DataFrame:
    """Posts that leave the queue without a consensus: answers that parsed and were rejected."""
    return validated.filter("not accepted and stage <> 'parse_error'").select("post_id")


def parse_safety(responses: DataFrame) -> DataFrame:
    """post_id, verdict (keep or exclude), category, error: a malformed answer or one without keep is an error."""
    rows = responses.withColumn("v", F.try_parse_json("response"))
    keep = as_boolean("keep")
    category = F.when(present("category") | is_null("category"), typed("category", ("STRING",), "string")).otherwise("unspecified")
    bad = keep.isNull() | category.isNull()
    return rows.select("post_id", F.when(~bad, F.when(keep, "keep").otherwise("exclude")).alias("verdict"), F.when(~bad, category).alias("category"), bad.alias("error"))

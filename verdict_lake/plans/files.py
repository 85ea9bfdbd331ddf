"""Queries that write, read and stream files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshot as X
from ..session import scratch_folder
from ..sources import published as P
from ..streaming import ingest
from .content import EXPORTED_BOARD, PROMPT, SNAP, _members
from .registry import add, query
from .votes import VOTES


def _tables(t):
    members = _members(t)
    return {
        "memes": X.export_memes(members, t.memes, t.ground_truths),
        "predictions": X.export_predictions(members, t.predictions, t.judgments, t.calls),
        "judgments": X.export_judgments(members, t.predictions, t.judgments),
        "leaderboard": X.export_leaderboard(members, t.predictions, t.judgments),
    }


#: The published tables in SQL.
PUBLISHED = {
    "memes": f"""with {SNAP} select snapshot_id, post_id, title, subreddit, explanation as ground_truth, post_id || '.' || case when local_image_path is null then 'jpg' else lower(regexp_extract(local_image_path, '\\.([A-Za-z0-9]+)$', 1)) end as image
  from m0 join memes using (post_id) join ground_truths using (post_id)""",
    "predictions": f"""with {SNAP}, {VOTES}, {PROMPT} select p.id as prediction_id, p.post_id, p.model_id, p.prediction, prompt_version, coalesce(judges, 0) as judges, coalesce(c, 0) as correct_votes, coalesce(i, 0) as incorrect_votes, cv as consensus_verdict
  from predictions p left join voted on voted.prediction_id = p.id left join pv on pv.post_id = p.post_id and pv.model_id = p.model_id and pv.prediction = p.prediction where error is null and p.post_id in (select post_id from m0)""",
    "judgments": f"""with {SNAP} select j.id as judgment_id, prediction_id, post_id, model_id, coalesce(judge_model, '(unknown)') as judge_model, verdict, judge_prompt_version, judge_model is not null and j.id = max(j.id) over (partition by prediction_id, judge_model) as is_latest
  from judgments j join predictions p on p.id = prediction_id where error is null and post_id in (select post_id from m0)""",
    "leaderboard": EXPORTED_BOARD,
}


def _written(t, table: str, kind: str):
    """The table as written to JSON lines or typed Parquet and read again."""
    path = scratch_folder(t.spark)
    (P.write_export if kind == "json" else P.write_typed_tables)({table: _tables(t)[table]}, path)
    return P.read_published_tables(t.spark, path, kind, (table,))[table]


def _register(name: str, table: str, kind: str) -> None:
    def f(t):
        return _written(t, table, kind)

    f.__name__ = name
    add(PUBLISHED[table], f)


_register("write_export", "predictions", "json")
_register("write_export_memes", "memes", "json")
_register("write_export_judgments", "judgments", "json")
_register("write_export_leaderboard", "leaderboard", "json")
_register("write_typed_tables", "judgments", "parquet")
_register("write_typed_predictions", "predictions", "parquet")
_register("write_typed_leaderboard", "leaderboard", "parquet")
_register("read_published_tables", "memes", "parquet")


@query("select post_id, case when local_image_path is not null and subreddit <> 'sub6' then cast(length('icon of ' || subreddit) + 1 as bigint) end as length from memes")
def image_manifest(t):
    """The length of each post's file: files are saved by subreddit, but for one whose posts name a missing file."""
    root = scratch_folder(t.spark)
    icons = t.memes.filter("subreddit <> 'sub6'").select("subreddit").distinct().withColumn("value", F.concat(F.lit("icon of "), "subreddit"))
    icons.write.partitionBy("subreddit").text(root)
    listed = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    saved = listed.select(F.regexp_extract("path", "subreddit=([^/]+)/", 1).alias("subreddit"), F.regexp_extract("path", "(subreddit=[^/]+/[^/]+)$", 1).alias("at"))
    named = t.memes.join(saved, "subreddit", "left").withColumn("local_image_path", F.when(F.col("local_image_path").isNotNull(), F.coalesce("at", F.lit("gone.jpg"))))
    return P.image_manifest(t.spark, named, root).drop("local_image_path")


@query("""with a as (select post_id, title, case when post_score % 4 <> 0 and (regexp_matches(split_part(lower(image_url), '?', 1), '\\.(jpg|jpeg|png|gif|webp)$') or contains(lower(image_url), 'i.redd.it') or contains(lower(image_url), 'i.imgur.com')) then image_url end as image_url, post_score from memes)
  select post_id, cast(post_score as bigint) as score from a where image_url is not null and post_score >= 10""")
def stream_ingest(t):
    """Posts that a stream over text files appends, of rows that come twice."""
    folder = scratch_folder(t.spark)
    row = """struct(post_id as id, subreddit, title, image_url as url, post_score % 4 = 0 as is_self, post_score as score, 5 as num_comments, cast(unix_timestamp(created_utc) as string) as created_utc)"""
    lines = t.memes.select(F.to_json(F.expr(row)).alias("value"))
    lines.unionByName(lines).repartition(4).write.text(f"{folder}/in")
    ingest.stream_ingest(t.spark, f"{folder}/in", f"{folder}/posts", f"{folder}/state", "36500 days").awaitTermination()
    return t.spark.read.parquet(f"{folder}/posts").select("post_id", "score")


#: How lines of JSON are written that are several times their tables.
SMALL = {"compression": "gzip"}


@query("""with a as (select post_id, case when post_score % 4 <> 0 and (regexp_matches(split_part(lower(image_url), '?', 1), '\\.(jpg|jpeg|png|gif|webp)$') or contains(lower(image_url), 'i.redd.it') or contains(lower(image_url), 'i.imgur.com')) then image_url end as image_url, post_score from memes)
  select distinct comment_id, post_id, cast(score as bigint) as score from comments where author <> 'AutoModerator' and not lower(author) like 'bot%' and body not in ('[deleted]', '[removed]') and distinguished is null
  and post_id in (select post_id from a where image_url is not null and post_score >= 10)""")
def stream_comments(t):
    """Comments that a stream appends: half of them come before any post and wait, the others come with the posts, and twice."""
    folder = scratch_folder(t.spark)
    post = """struct(post_id as id, subreddit, title, image_url as url, post_score % 4 = 0 as is_self, post_score as score, 5 as num_comments, cast(unix_timestamp(created_utc) as string) as created_utc)"""
    said = """struct('t1_' || comment_id as id, 't3_' || post_id as link_id, author, body, score, distinguished, '1700000000' as created_utc)"""
    comments = t.comments.select(F.to_json(F.expr(said)).alias("value"), F.pmod(F.xxhash64("comment_id"), F.lit(2)).alias("half"))
    args = [f"{folder}/{n}" for n in ("posts_in", "in", "posts", "comments", "state")]
    comments.filter("half = 0").select("value").write.options(**SMALL).text(args[1])
    t.spark.createDataFrame([], "value string").write.text(args[0])
    ingest.stream_comments(t.spark, *args).awaitTermination()
    t.memes.select(F.to_json(F.expr(post)).alias("value")).write.mode("append").options(**SMALL).text(args[0])
    twice = comments.filter("half = 1").select(F.explode(F.array("value", "value")).alias("value"))
    twice.write.mode("append").options(**SMALL).text(args[1])
    ingest.stream_ingest(t.spark, args[0], args[2], f"{folder}/posts_state", "36500 days").awaitTermination()
    ingest.stream_comments(t.spark, *args).awaitTermination()
    return t.spark.read.parquet(args[3]).select("comment_id", "post_id", "score")

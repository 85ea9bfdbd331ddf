"""Nested listings to flat posts and comments, and archive rows to posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_image_url

POST = "struct<name:string,subreddit:string,url:string,title:string,permalink:string,score:bigint,num_comments:bigint,created_utc:double>"
POSTS = f"struct<data:struct<after:string,children:array<struct<data:{POST}>>>>"
COMMENT = "struct<name:string,author:string,body:string,distinguished:string,score:bigint,created_utc:double>"
COMMENTS = f"array<struct<data:struct<children:array<struct<kind:string,data:{COMMENT}>>>>>"
ARCHIVE = "struct<id:string,subreddit:string,title:string,url:string,is_self:boolean,permalink:string,score:bigint,num_comments:bigint,created_utc:string,over_18:boolean>"
ARCHIVE_COMMENT = "struct<id:string,link_id:string,author:string,body:string,distinguished:string,score:bigint,created_utc:string>"

MIN_SCORE, MIN_COMMENTS = 10, 3
DELETED = ("[deleted]", "[removed]")


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def number(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def read_posts_listing(raw: DataFrame) -> DataFrame:
    """Posts of listings (value: JSON text): post_id, subreddit, title, url, permalink, score, num_comments, created_at."""
    rows = raw.select(F.from_json("value", POSTS).alias("v")).select(F.explode("v.data.children").alias("c")).select("c.data.*")
    return rows.select(
        F.regexp_replace(text(F.col("name")), "^t3_", "").alias("post_id"),
        text(F.col("subreddit")).alias("subreddit"),
        text(F.col("title")).alias("title"),
        F.col("url"),
        text(F.col("permalink")).alias("permalink"),
        number(F.col("score")).alias("score"),
        number(F.col("num_comments")).alias("num_comments"),
        F.timestamp_seconds(F.col("created_utc").cast("bigint")).alias("created_at"),
    )


def read_comments_listing(raw: DataFrame) -> DataFrame:
    """Comments of listings (post_id, value: a JSON pair of which the second holds them), only of kind t1."""
    rows = raw.select("post_id", F.try_element_at(F.from_json("value", COMMENTS), F.lit(2)).alias("v")).select("post_id", F.explode("v.data.children").alias("c"))
    rows = rows.filter("c.kind = 't1'").select("post_id", "c.data.*")
    return rows.select(
        "post_id",
        F.regexp_replace(text(F.col("name")), "^t1_", "").alias("comment_id"),
        text(F.col("author")).alias("author"),
        text(F.col("body")).alias("body"),
        number(F.col("score")).alias("score"),
        F.col("distinguished"),
    )


def without_kind(c: str, kind: str) -> Column:
    """An id without the kind that may stand before it."""
    return F.when(F.startswith(F.col(c), F.lit(kind)), F.substr(F.col(c), F.lit(len(kind) + 1))).otherwise(F.col(c))


def parsed(raw: DataFrame, kind: str, *keep: str) -> DataFrame:
    """The fields of kind of raw's JSON text (value), with the columns of raw to keep.

    The text is parsed once a row: of an exploded array Spark can't move filters below, where each would parse the text again.
    """
    return raw.select(F.explode(F.array(F.from_json("value", kind))).alias("v"), *keep).select("v.*", *keep)


def created_at(rows: DataFrame) -> DataFrame:
    """rows of an archive with created, in seconds; without an id or a positive creation time they go."""
    created = F.try_to_number(F.col("created_utc"), F.lit("9999999999.999999"))
    created = F.coalesce(F.col("created_utc").try_cast("double"), created.cast("double"))
    return rows.withColumn("created", created).filter("coalesce(id, '') <> '' and created > 0")


def read_archive_comments(raw: DataFrame, *keep: str) -> DataFrame:
    """Comments of archive rows (value: JSON text), with the columns of raw to keep; rows without an id, a post or a positive
    creation time go."""
    rows = created_at(parsed(raw, ARCHIVE_COMMENT, *keep))
    rows = rows.select(
        text(without_kind("link_id", "t3_")).alias("post_id"),
        without_kind("id", "t1_").alias("comment_id"),
        text(F.col("author")).alias("author"),
        text(F.col("body")).alias("body"),
        number(F.col("score")).alias("score"),
        F.col("distinguished"),
        F.col("created").cast("bigint").alias("created_utc"),
        *keep,
    )
    return rows.filter("post_id <> ''")


def read_archive_rows(raw: DataFrame, *keep: str) -> DataFrame:
    """Posts of archive rows (value: JSON text), with the columns of raw to keep; rows without an id or a positive creation
    time go."""
    rows = parsed(raw, ARCHIVE, *keep)
    own = F.coalesce("is_self", F.lit(False))
    rows = created_at(rows)
    return rows.select(
        F.col("id").alias("post_id"),
        text(F.col("subreddit")).alias("subreddit"),
        text(F.col("title")).alias("title"),
        F.when(~own & is_image_url(F.col("url")), F.col("url")).alias("image_url"),
        number(F.col("score")).alias("score"),
        number(F.col("num_comments")).alias("num_comments"),
        F.col("created").cast("bigint").alias("created_utc"),
        F.coalesce("over_18", F.lit(False)).alias("over_18"),
        *keep,
    )


def qualify_posts(posts: DataFrame, url: str = "url", min_score: int = MIN_SCORE, min_comments: int = MIN_COMMENTS) -> DataFrame:
    """Posts with an image link, score and comments enough."""
    return posts.filter(is_image_url(F.col(url)) & (F.col("score") >= min_score) & (F.col("num_comments") >= min_comments))


def date_window(posts: DataFrame, column: str, after: str, before: str) -> DataFrame:
    """Posts from after up to, without, before (UTC dates)."""
    if after >= before:
        raise ValueError("after must be before before")
    return posts.filter((F.col(column) >= F.lit(after).cast("date")) & (F.col(column) < F.lit(before).cast("date")))


def clean_comments(comments: DataFrame) -> DataFrame:
    """Comments by people: no bots, deleted bodies or moderators' marked ones; nulls become defaults."""
    author = text(F.col("author"))
    person = (author != "AutoModerator") & ~F.startswith(F.lower(author), F.lit("bot"))
    rows = comments.filter(person & ~text(F.col("body")).isin(*DELETED) & (text(F.col("distinguished")) != "moderator"))
    return rows.withColumns({"author": author, "body": text(F.col("body")), "score": number(F.col("score"))})

"""Continuous ingest: archive rows to qualified posts and their comments, each inserted once.

Comments come as a stream of their own, beside the stream of posts: a comment that comes before its post waits for it in
files (waiting.py), and the ids of posts wait for comments there. Time is the time of arrival, so that no row is too late. A
comment that has waited in vain is settled by the table of posts: its post may have come long ago.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shuffles_removed
from ..sources.listings import clean_comments, qualify_posts, read_archive_comments, read_archive_rows
from .keyed_sink import KeyedTable
from .waiting import Waiting

#: The time that a partition of a table covers.
SPAN = "month"
#: Bytes of comments' files that a batch takes, as they are on disk; a larger file is a batch of its own.
BATCH_BYTES = 3 << 25
POST_ORDER, COMMENT_ORDER = ("created_utc", "title"), ("created_utc", "body", "post_id")


def since(span: str = SPAN) -> Column:
    """The first day of the span of time in which a row was created."""
    return F.trunc(F.to_date(F.timestamp_seconds("created_utc")), span)


def posts_of(raw: DataFrame, *keep: str) -> DataFrame:
    """Qualified posts of raw archive rows (value: JSON text); the same for batches and streams."""
    return qualify_posts(read_archive_rows(raw, *keep), url="image_url")


def comments_of(raw: DataFrame, *keep: str) -> DataFrame:
    """People's comments of raw archive rows; the same for batches and streams."""
    return clean_comments(read_archive_comments(raw, *keep))


def insert_if_absent(target: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends the posts of a batch that the table at target does not have.

    A batch that runs again finds its rows there and appends none of them.
    """

    def write(batch: DataFrame, _: int) -> None:
        with shuffles_removed(batch.sparkSession):
            KeyedTable(batch.sparkSession, target, "post_id").insert_if_absent(batch, since(), POST_ORDER)

    return write


def insert_comments(target: str, posts_target: str, waiting: str, wait: str, disorder: str) -> Callable[[DataFrame, int], None]:
    """A sink of comments, and of the ids of posts that they wait for."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession

        def known(comments: DataFrame) -> DataFrame:
            return KeyedTable(spark, posts_target, "post_id").among(comments, "post_id").select(*comments.columns)

        def append(comments: DataFrame) -> None:
            KeyedTable(spark, target, "comment_id").insert_if_absent(comments.drop("arrived"), since(), COMMENT_ORDER)

        with shuffles_removed(spark):
            Waiting(spark, waiting, wait, disorder).settle(batch, n, known, append)

    return write


def arriving(spark: SparkSession, source: str, **limits: int) -> DataFrame:
    """value and arrived of the lines of source's text files, a stream: a file's lines arrive when it was written."""
    return spark.readStream.schema("value string").options(**limits).text(source).select("value", F.col("_metadata.file_modification_time").alias("arrived"))


def stream_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, lateness: str = "30 days") -> StreamingQuery:
    """Read new text files of source once, and append their new posts to target.

    Repeats within the watermark leave in the stream's state; older ones meet the table itself.
    """
    raw = spark.readStream.schema("value string").text(source)
    posts = posts_of(raw).withColumn("at", F.timestamp_seconds("created_utc"))
    fresh = posts.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["post_id"]).drop("at")
    return fresh.writeStream.foreachBatch(insert_if_absent(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_comments(
    spark: SparkSession, posts_source: str, source: str, posts_target: str, target: str, checkpoint: str, wait: str = "2 days", disorder: str = "10 minutes"
) -> StreamingQuery:
    """Read new text files of both sources once, and append to target the new comments of qualified posts.

    A comment and its post meet if they arrive within wait of each other, or somewhat later: what waits is dropped by batches. A
    comment that met none by then is appended if posts_target has its post, and else dropped. disorder: by how much files may be
    read out of the order of their times.
    """
    posts = posts_of(arriving(spark, posts_source), "arrived").select(F.lit(True).alias("is_post"), "post_id", "arrived")
    comments = comments_of(arriving(spark, source, maxBytesPerTrigger=BATCH_BYTES), "arrived").withColumn("is_post", F.lit(False))
    rows = comments.unionByName(posts, allowMissingColumns=True)
    sink = insert_comments(target, posts_target, f"{checkpoint}/waiting", wait, disorder)
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

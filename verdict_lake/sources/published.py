"""The published tables: typed writing and reading, and the image manifest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "memes": "snapshot_id string, post_id string, title string, subreddit string, ground_truth string, image string",
    "predictions": "prediction_id bigint, post_id string, model_id string, prediction string, prompt_version string, judges bigint, correct_votes bigint, incorrect_votes bigint, consensus_verdict string",
    "judgments": "judgment_id bigint, prediction_id bigint, post_id string, model_id string, judge_model string, verdict string, judge_prompt_version string, is_latest boolean",
    "leaderboard": "rank bigint, model_id string, judge_model string, correct bigint, incorrect bigint, total bigint, accuracy double, judged_by_multiple bigint, unanimous_agreements bigint, agreement_rate double",
}


def typed(df: DataFrame, table: str) -> DataFrame:
    """df with the columns and types of the published table."""
    pairs = [field.split(" ") for field in SCHEMAS[table].split(", ")]
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in pairs))


def write_export(tables: dict[str, DataFrame], path: str) -> None:
    """JSON lines a table, nulls written as such."""
    for name, df in tables.items():
        typed(df, name).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def write_typed_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet a table; posts by snapshot."""
    for name, df in tables.items():
        writer = typed(df, name).write.mode("overwrite")
        (writer.partitionBy("snapshot_id") if name == "memes" else writer).parquet(f"{path}/{name}")


def read_published_tables(spark: SparkSession, path: str, kind: str = "json", names: tuple[str, ...] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """The four tables, or those named, with their schemas, from JSON lines or Parquet."""
    reader = {name: spark.read.schema(schema) for name, schema in SCHEMAS.items() if name in names}
    return {name: (r.json if kind == "json" else r.parquet)(f"{path}/{name}") for name, r in reader.items()}


def image_manifest(spark: SparkSession, memes: DataFrame, root: str) -> DataFrame:
    """memes (post_id, local_image_path) with the length of the file at that path under root; null where there is none."""
    # both sides are named by what follows the root's own path, whatever its scheme
    under = re.sub(r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "", root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.select(F.substring_index("path", under, -1).alias("local_image_path"), "length")
    return memes.select("post_id", "local_image_path").join(named, "local_image_path", "left").select("post_id", "local_image_path", "length")

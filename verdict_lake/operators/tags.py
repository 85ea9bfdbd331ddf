"""Tags: cleaning, summaries and changes. Names are equal whatever their ASCII case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import delete_keys


def clean_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"\s+", " ")


def clean_tag_names(names: DataFrame) -> DataFrame:
    """name, position of the first of each name (name, position), trimmed, white space collapsed, empty ones dropped."""
    rows = names.select(clean_name(F.col("name")).alias("name"), "position").filter("name <> ''")
    first = rows.groupBy(F.lower("name").alias("k")).agg(F.min(F.struct("position", "name")).alias("x"))
    return first.select("x.name", "x.position")


def tag_summaries(tags: DataFrame, meme_tags: DataFrame) -> DataFrame:
    """tag_id, name, posts: unused tags have 0."""
    used = meme_tags.groupBy("tag_id").agg(F.count("*").alias("posts"))
    return tags.join(used, "tag_id", "left").select("tag_id", "name", F.coalesce("posts", F.lit(0)).alias("posts"))


def tags_per_post(tags: DataFrame, meme_tags: DataFrame) -> DataFrame:
    """post_id, tags: names with notes in the order of the lower-cased names, as one line."""
    rows = meme_tags.join(tags.select("tag_id", "name"), "tag_id")
    listed = F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name", F.coalesce("notes", F.lit("")).alias("notes"))))
    line = F.array_join(F.transform(listed, lambda x: F.concat(x["name"], F.lit(":"), x["notes"])), "|")
    return rows.groupBy("post_id").agg(line.alias("tags"))


def tag_by_name(tags: DataFrame, name: str) -> DataFrame:
    return tags.filter(F.lower("name") == F.lower(clean_name(F.lit(name))))


def remove_tag(tags: DataFrame, meme_tags: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the tags of gone (tag_id): their links go with them."""
    return delete_keys(tags, gone, ["tag_id"]), delete_keys(meme_tags, gone, ["tag_id"])


def rename_tags(tags: DataFrame, renames: DataFrame) -> DataFrame:
    """tag_id, name, description, outcome (kept, renamed, conflict, empty) after renames (tag_id, new_name).

    A new name that another tag has keeps the old one; links are by id and so stay.
    """
    new = renames.select("tag_id", clean_name(F.col("new_name")).alias("new_name"))
    rows = tags.join(new, "tag_id", "left")
    taken = tags.select(F.lower("name").alias("k"), F.col("tag_id").alias("owner"))
    rows = rows.join(taken, F.lower("new_name") == F.col("k"), "left")
    conflict = F.col("owner").isNotNull() & (F.col("owner") != F.col("tag_id"))
    outcome = F.when(F.col("new_name").isNull(), "kept").when(F.col("new_name") == "", "empty").when(conflict, "conflict").otherwise("renamed")
    return rows.withColumn("outcome", outcome).select("tag_id", F.when(F.col("outcome") == "renamed", F.col("new_name")).otherwise(F.col("name")).alias("name"), "description", "outcome")

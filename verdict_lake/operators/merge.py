"""Keyed merges: a new version of a table from its old one and updates, by policy.

The updates become one row a key by an aggregate, which combines on the map side, so that a key with many updates is no
skew, and meet the old version in one full outer join on the key. Updates carry an order column; the last one wins where
several have the same key. A null key meets nothing: such rows of the target stay, such updates are inserted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("insert_if_absent", "replace", "replace_only_failures", "replace_keep_created", "coalesce_update")


def newest(updates: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key: the last by order."""
    rest = [c for c in updates.columns if c not in keys]
    picked = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x"))
    return picked.select(*keys, "x.*")


def first_of(updates: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def merge(target: DataFrame, updates: DataFrame, keys: Sequence[str], policy: str, order: str = "seq", failed: Column | None = None, created: str = "created_at", coalesced: Sequence[str] = ()) -> DataFrame:
    """The columns of target plus merge_action: kept, inserted, or updated.

    updates has target's columns and order. insert_if_absent leaves existing rows and takes the first of new ones;
    replace takes the last; replace_only_failures replaces a row only where failed holds for it; replace_keep_created
    also keeps the column created; coalesce_update keeps the old value of the coalesced columns where the new is null.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    columns = target.columns
    rest = [c for c in columns if c not in keys]
    last = (first_of if policy == "insert_if_absent" else newest)(updates.select(*columns, order), keys, order).drop(order)
    both = target.select(*keys, F.struct(*rest).alias("old")).join(last.select(*keys, F.struct(*rest).alias("new")), list(keys), "full_outer")
    old, new = F.col("old"), F.col("new")
    has_old, has_new = old.isNotNull(), new.isNotNull()
    if policy == "insert_if_absent":
        use_new = has_new & ~has_old
    elif policy == "replace_only_failures":
        lost = F.lit(False) if failed is None else failed
        use_new = has_new & (~has_old | F.coalesce(lost, F.lit(False)))
    else:
        use_new = has_new
    action = F.when(~use_new, "kept").when(has_old, "updated").otherwise("inserted")

    def value(c: str) -> Column:
        chosen = F.when(use_new, new[c]).otherwise(old[c])
        if policy == "replace_keep_created" and c == created:
            return F.coalesce(old[c], chosen)
        if policy == "coalesce_update" and c in coalesced:
            return F.coalesce(chosen, old[c])
        return chosen

    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in columns], action.alias("merge_action"))


def delete_keys(target: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target without the keys of gone; the same call on a dependent table is a cascade."""
    return target.join(gone.select(*keys), list(keys), "left_anti")


def merge_counts(merged: DataFrame, table: str) -> DataFrame:
    """table, merge_action, n: what a merge did, as run statistics."""
    return merged.groupBy(F.lit(table).alias("table_name"), "merge_action").agg(F.count("*").alias("n"))

"""Merges into a stored table against merges of whole tables, and the files that they leave alone."""

import pytest

from verdict_lake.operators import merge as M
from verdict_lake.operators.keyed_table import KeyedTable

SCHEMA = "id long, part string, v string, error string, created_at string"
UPDATE = f"{SCHEMA}, seq long"


def sorted_rows(df):
    return sorted(map(str, df.collect()))


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def rows(n):
    return [(k, "ab"[k % 2], f"old{k}", "timeout" if k % 3 else None, "c0") for k in range(n)] + [(None, "a", "lost", None, "c0"), (7, None, "lost too", None, "c0")]


CHANGES = [(3, "b", "new", None, "u1", 1), (3, "b", "newer", None, "u2", 2), (4, "a", None, None, "u1", 1), (90, "a", "added", None, "u1", 1), (6, "a", "old6", None, "c0", 5)]


@pytest.mark.parametrize("policy, how", [("insert_if_absent", {}), ("replace", {}), ("replace_only_failures", {"failed": "error"}), ("replace_keep_created", {}), ("coalesce_update", {"coalesced": ["v"]})])
def test_a_stored_merge_equals_the_whole_one_and_runs_twice(spark, frame, tmp_path, policy, how):
    from pyspark.sql import functions as F

    if "failed" in how:
        how = {"failed": F.col("old.error").isNotNull()}
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id", "part"], buckets=16)
    table.merge(frame(UPDATE, *((*r, 0) for r in rows(30))), "replace")
    updates = frame(UPDATE, *CHANGES)
    want = M.merge(frame(SCHEMA, *rows(30)), updates, ["id", "part"], policy, **how).drop("merge_action")
    before = files(tmp_path / "t")
    table.merge(updates, policy, **how)
    after = files(tmp_path / "t")
    assert sorted_rows(table.read()) == sorted_rows(want)
    # at most the buckets of five keys have other files; the rest keep theirs
    folders = {f.split("/")[0] for f in before.items() ^ after.items() for f in [f[0]]}
    assert 0 < len(folders) <= 4 and len(before.keys() & after.keys()) >= len(before) - 4
    table.merge(updates, policy, **how)
    assert files(tmp_path / "t") == after


def test_deleting_keys_and_tables_without_rows(spark, frame, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id", "part"], buckets=8)
    assert table.read().count() == 0 and table.merge(frame(UPDATE), "replace").count() == 0
    table.delete(frame("id long, part string", (1, "a")))
    counts = table.merge(frame(UPDATE, *((*r, 0) for r in rows(12))), "replace")
    assert {r.merge_action: r.n for r in counts.collect()} == {"inserted": 14}
    before = files(tmp_path / "t")
    table.delete(frame("id int, part string", (5, "a"), (77, "a"), (None, "a"), (7, None)))
    assert files(tmp_path / "t") == before
    # integers of another type find their bucket, and a bucket that loses all rows goes
    table.delete(frame("id int, part string", *((k, "ab"[k % 2]) for k in range(11))))
    assert sorted_rows(table.read()) == sorted_rows(frame(SCHEMA, *rows(12)[11:]))

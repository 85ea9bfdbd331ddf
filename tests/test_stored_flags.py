"""Queues on stored flags: no large table is shuffled, and null keys meet nothing."""

import re
import uuid

import pytest

from verdict_lake.operators.stored_flags import StoredFlags


@pytest.fixture
def stored(spark, frame):
    flags = StoredFlags(spark, f"flags_{uuid.uuid4().hex}", buckets=6)
    posts = frame("post_id string, subreddit string, title string", *((f"p{k}", "s", f"t{k}") for k in range(8)), (None, "s", "t"))
    truths = frame("post_id string", *((f"p{k}",) for k in (1, 2, 3)), ("gone",), (None,))
    reviews = frame("post_id string, status string, reason string", ("p2", "validated", None), ("p3", "excluded", "x"), ("p4", "excluded", "auto: y"), ("gone", "validated", None), ("p5", None, None), (None, "validated", None))
    calls = frame("role string, post_id string", ("consensus", "p6"), ("consensus", "p6"), ("judge", "p7"))
    predictions = frame("id long, post_id string, model_id string, error string", (1, "p2", "a", None), (2, "p2", "b", "timeout"), (3, "gone", "b", None), (4, None, "a", None), (5, "p3", "a", None))
    judgments = frame("prediction_id long, judge_model string", (1, "x"), (1, "x"), (3, None), (3, "y"), (None, "x"))
    flags.store(posts, truths, reviews, calls, predictions, judgments)
    yield flags
    flags.drop()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_results(frame, stored):
    states = frame("stage string, model string, prompt_version string, post_id string", ("safety", "m", "v", "p0"), ("safety", "m", "old", "p6"), ("consensus", "m", "v", "p5"), ("safety", "m", "v", None))
    assert rows(stored.pending_gate()) == [("p0",), ("p6",), ("p7",)]
    assert rows(stored.pending_gate(states, "m", "v")) == [("p6",), ("p7",)]
    assert rows(stored.pending_consensus(states, "m", "v")) == [("p0",), ("p6",), ("p7",)]
    assert rows(stored.pending_predictions(["a", "b"])) == [("gone", "a"), ("p2", "b")]
    assert rows(stored.pending_judgments(["x", "y"])) == [(1, "y"), (3, "x")]
    assert dict(rows(stored.states())) == {"p0": "pending", "p1": "unreviewed", "p2": "validated", "p3": "human_excluded", "p4": "quality_excluded", "p5": "pending", "p6": "no_consensus", "p7": "pending"}
    assert tuple(stored.status_counts().first()) == (8, 4, 2, 2, 1)


def test_no_large_table_is_shuffled(spark, frame, stored):
    states = frame("stage string, model string, prompt_version string, post_id string", ("safety", "m", "v", "p0"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for queue in (stored.pending_gate(), stored.pending_predictions(["a", "b"]), stored.pending_judgments(["x", "y"]), stored.states(), stored.listing("unreviewed")):
            assert "Exchange" not in queue._jdf.queryExecution().executedPlan().toString()
        for queue in (stored.pending_gate(states, "m", "v"), stored.pending_consensus(states, "m", "v")):
            plan = queue._jdf.queryExecution().executedPlan().toString()
            # the few states are dealt to the buckets; the flags stay where they are
            assert len(re.findall(r"Exchange hashpartitioning\(post_id", plan)) == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

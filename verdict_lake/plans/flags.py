"""Queries on stored flags: the same results as the queues and listings that join each time, by the same SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.queues import few
from ..operators.status import page
from ..operators.stored_flags import StoredFlags
from . import posts, work  # noqa: F401  their SQL is needed
from .registry import ORACLES, QUERIES
from .views import Tables


def add(like: str, f: Callable[[Tables, StoredFlags], DataFrame]) -> None:
    """Register f of the tables and their stored flags as stored_ and the name of the query whose SQL it shares."""

    def run(spark, sf_dir):
        t = Tables(spark, sf_dir)
        stored = StoredFlags(spark, f"flags_{uuid.uuid4().hex}", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
        stored.store(t.memes, t.ground_truths, t.reviews, t.calls, t.predictions, t.judgments)
        return f(t, stored)

    QUERIES[f"stored_{like}"], ORACLES[f"stored_{like}"] = run, ORACLES[like]


add("pending_gate", lambda t, s: s.pending_gate())
add("pending_gate_by_state", lambda t, s: s.pending_gate(t.states, "model_0", "prompt_1"))
add("pending_consensus", lambda t, s: s.pending_consensus(t.states, "model_1", "prompt_0"))
add("pending_predictions", lambda t, s: s.pending_predictions(few(t.predictions, "model_id")))
add("pending_judgments", lambda t, s: s.pending_judgments(few(t.judgments, "judge_model")))
add("classify_state", lambda t, s: s.states())
add("review_status_listing", lambda t, s: page(s.listing("unreviewed", "sub3", "urgent"), [F.col("post_id")], 20, 1))
add("status_counts", lambda t, s: s.status_counts())

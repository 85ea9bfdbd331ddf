"""Prefix doubling finds the strings that the library finds."""

import random

import doubling_attempt
from pyspark import cloudpickle

from verdict_lake.llm import suffix_dedup

# workers do not find modules of tests
cloudpickle.register_pickle_by_value(doubling_attempt)


def test_doubling_marks_the_same_bytes(frame):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefé") for _ in range(draw.randrange(3, 9)))
    passage = " ".join(word() for _ in range(120))
    texts = [" ".join(word() for _ in range(draw.randrange(30, 90))) + draw.choice(("", passage, passage[:450], passage[100:])) + word() for _ in range(14)] + [None, "", "x" * 900]
    df = frame("doc_id long, text string", *enumerate(texts)).repartition(2)
    *_, (length, live) = doubling_attempt.doubling(df)
    removed = {}
    for r in live.collect():
        removed.setdefault(r.doc_id, set()).update(range(r["at"], r["at"] + length))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_report(df).collect()}
    assert got == {k: len(removed.get(k, ())) for k in range(len(texts))} and sum(got.values()) > 2000

"""Scores of the rule ensemble, recomputed in plain Python from the rules."""

import math

import regex
from pyspark.sql import functions as F

from verdict_lake.llm import quality_model

DATA = "/root/testdata/sf0.001"


def plain_statistics(text):
    text = text or ""
    w = [x for x in regex.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, w))
    share = lambda a, b: a / b if b else 0.0
    n = lambda pattern: len(regex.findall(pattern, text))
    return {
        "words": math.log1p(len(w)),
        "word_length": share(chars, len(w)),
        "distinct": share(len(set(w)), len(w)),
        "symbols": share(n(r"[#*$%&|<>]"), len(w)),
        "capitals": share(n(r"\p{Lu}"), chars),
        "exclamations": share(text.count("!"), len(w)),
        "digits": share(n("[0-9]"), chars),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
        "line_words": share(len(w), len(lines)),
        "marks": share(n("[.,;:?]"), len(w)),
    }


def plain_score(intercept, rules, text):
    s = plain_statistics(text)
    held = [r for r in rules if all((s[quality_model.FEATURES[f]] > limit) == above for f, above, limit in r.terms)]
    return 1 / (1 + math.exp(-(intercept + sum(r.weight for r in held))))


def test_scores_follow_from_the_rules(spark, frame):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 150_000 + "End!\n" * 3000), (10**6 + 3, "É! 日本 語\x0b7\r\n\r\n7"), (10**6 + 4, "x")]
    texts = docs.select("doc_id", "text").unionByName(frame("doc_id long, text string", *odd))
    intercept, rules = quality_model.fit_rules(quality_model.labelled_sample(texts, labels))
    assert len(rules) > 3
    got = {r.doc_id: r for r in quality_model.quality_report(texts, labels).collect()}
    for r in texts.collect():
        want = plain_score(intercept, rules, r.text)
        assert abs(got[r.doc_id].score - want) < 1e-6 and got[r.doc_id].predicted == (round(want, 6) >= 0.3)
    # and the statistics, of which rules use some alone
    for r in texts.select("text", quality_model.statistics(F.col("text")).alias("s")).collect():
        assert all(abs(r.s[k] - v) < 1e-9 for k, v in plain_statistics(r.text).items())

"""Rows that share a doc_id, with equal texts and with texts whose 32-bit hashes are equal."""

from collections import Counter

from pyspark.sql import functions as F

from verdict_lake.llm import substring_dedup, suffix_dedup, windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(frame, rows):
    return frame(DOCS, *((i, t, "en", "s", 0) for i, t in rows))


def colliding(spark, k):
    """Two texts of 60 words, most of them their own, with one 32-bit hash."""
    line = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda j: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x"), j.cast("string"))))
    found = spark.range(k).select("id", line.alias("text")).withColumn("h", F.hash("text"))
    twice = found.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").orderBy("h").first()
    return [r.text for r in found.filter(F.col("id").isin(twice.a, twice.b)).orderBy("id").collect()]


def test_texts_of_one_32_bit_hash_stay_apart(spark, frame):
    a, b = colliding(spark, 300_000)
    df = table(frame, [(1, a), (2, a), (2, b)])
    got = {(r.doc_id, r.kept.decode()) for r in substring_dedup.without_passages(df).collect()}
    assert got == {(1, a), (2, ""), (2, b)}
    got = Counter((r.doc_id, r.kept.decode()) for r in suffix_dedup.without_repeats(table(frame, [(None, a), (None, b), (3, a)])).collect())
    assert got == Counter({(None, ""): 1, (None, b): 1, (3, ""): 1})


def test_marks_do_not_grow_with_repeated_rows(frame):
    body = " ".join(f"w{k}" for k in range(150))
    df = table(frame, [(None, body)] * 40 + [(5, body)] * 30 + [(6, "short")] * 5)
    texts = windows.keyed(df)
    first = windows.once(texts, windows.repeats_of(texts))
    assert first.count() == 3
    for finder, length in ((suffix_dedup.finder(), 400), (substring_dedup.finder(), 50)):
        assert finder.marks(first).count() < 40
    cut = Counter((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_report(df).collect())
    assert cut == Counter({(None, len(body)): 40, (5, len(body)): 30, (6, 0): 5})
    cut = Counter((r.doc_id, r.n_removed) for r in substring_dedup.substring_report(df).collect())
    assert cut == Counter({(None, 0): 40, (5, 150): 30, (6, 0): 5})

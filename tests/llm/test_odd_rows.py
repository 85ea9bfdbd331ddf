"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, operator by operator and stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verdict_lake.llm import chat, decontam, mixing, pii, quality_model, quality_rules, simhash, substring_dedup, suffix_dedup, tokenfile

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 7919}" for k in range(60_000))
PROSE = "the small dog went home because the rain had come and nobody wanted to stay outside any longer than they had to"
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG + " end"), (6, PROSE), (6, PROSE), (7, PROSE), (None, PROSE + " too"), (None, None), (None, "a b"), (None, "a b"), (8, "x"), (9, "\U0001f600 " * 70)]
CLASHING = ("rest", "matches", "size", "rate", "copies", "words", "lines", "label", "n_words", "_id", "_w", "_source", "_salt", "body", "node", "root", "of", "salt", "copy", "own_salt", "new", "a.b", "w0", "id", "first", "_n")


@pytest.fixture(scope="module")
def odd(frame):
    return frame(DOCS, *((i, t, None, None if k % 3 else "s", None) for k, (i, t) in enumerate(ROWS))).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder of labels and a benchmark with odd rows."""
    root = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 10)] + [(None, 1, 0), (4, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "zzz yyy"), (3, "q r s t u v"), (3, "q r s t u v")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def clashing(df):
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(CLASHING)))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, odd, folder, name, stage):
    docs = clashing(odd)
    out = stage(spark, docs, folder)
    got = out.collect()
    if name == "tokens":
        assert len(got) == len(ROWS) and sum(r.n_tokens == 1 for r in got) == 4
    else:
        assert out.columns == docs.columns
        assert all(r[n] == k for r in got for k, n in enumerate(CLASHING))
    if name == "near_dedup":
        assert sorted(str(r.doc_id) for r in got) == ["1", "4", "6", "8", "9", "None"]
    if name == "decontaminate":
        assert len(got) == len(ROWS)
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_reports_take_odd_rows(odd):
    docs = clashing(odd)
    for report in (tokenfile.token_report(docs, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")), suffix_dedup.suffix_report(docs), substring_dedup.substring_report(docs), pii.pii_report(docs), quality_rules.rule_report(docs), simhash.simhash_report(docs), mixing.mix_report(docs)):
        assert report.count() == len(ROWS)
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.suffix_report(docs).collect()}
    assert removed[(4, len(LONG))] == len(LONG) and removed[(8, 1)] == 0 and removed[(1, 0)] == 0
    cut = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.substring_report(docs).collect()}
    assert cut[(5, 60_001)] == 60_000 and cut[(4, 60_000)] == 0


def test_very_long_texts_are_judged_whole(frame):
    long = " ".join(f"w{k}" for k in range(200_000))
    item = " ".join(f"w{k}" for k in range(199_950, 199_980))
    df = frame(DOCS, (1, long, "en", "s", 0), (2, long + " Mr. John Smith", "en", "s", 0))
    benchmark = frame("item_id long, text string", (5, item))
    assert [r.doc_id for r in decontam.decontam_report(df, benchmark).orderBy("doc_id").collect()] == [1, 2]
    assert {r.doc_id: r.n_entities for r in pii.pii_report(df).collect()} == {1: 0, 2: 2}
    assert simhash.near_dedup(df).count() == 1
    assert {r.n_words for r in quality_rules.rule_report(df).collect()} == {200_000, 200_003}


def test_classifier_and_rules_keep_columns_of_any_name(frame, odd):
    labels = frame("doc_id long, quality int, toxic int", *((k, k % 2, 0) for k in range(1, 10)))
    docs = clashing(odd)
    out = quality_model.with_quality(docs, labels)
    assert out.columns == [*docs.columns, "score", "predicted"]
    assert all(r[n] == k for r in out.collect() for k, n in enumerate(CLASHING))
    stats = quality_rules.base_statistics(docs)
    assert set(stats.columns) == {*docs.columns, *quality_rules.STATISTICS}
    assert all(r[n] == k for r in stats.collect() for k, n in enumerate(CLASHING) if n not in quality_rules.STATISTICS)


def test_mixing_draws_rows_without_an_id_by_their_texts(frame, monkeypatch):
    texts = [f"text number {k} of many" for k in range(400)]
    df = frame(DOCS, *((None, t, "en", "a" if k % 4 else "b", 0) for k, t in enumerate(texts)))
    out = mixing.with_copies(clashing(df))
    assert all(r["rest"] == 0 and r["own_salt"] == CLASHING.index("own_salt") for r in out.select("rest", "own_salt").collect())
    taken = {r.source: (r.taken, r.target) for r in out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect()}
    assert all(abs(taken[s][0] - taken[s][1]) < 0.15 * taken[s][1] for s in "ab")
    same = sorted(map(str, out.select("text", "copies").collect()))
    monkeypatch.setattr(mixing, "SENT_SOURCES", 0)
    assert sorted(map(str, mixing.with_copies(df).select("text", "copies").collect())) == same


def test_reply_trees_with_repeated_and_missing_nodes(frame):
    schema = "tree long, node long, parent long, score double, role string, text string, more long"
    rows = [(1, 1, None, 1.0, "user", "hi", 0), (1, 2, 1, 5.0, "assistant", "a [", 0), (1, 2, 1, 2.0, "assistant", "b", 0), (1, None, 1, 9.0, "user", "lost", 0), (None, 1, None, 1.0, "user", "lost", 0), (2, 1, None, None, None, None, 0)]
    out = {r.conv_id: r for r in chat.format_trees(frame(schema, *rows)).collect()}
    assert set(out) == {1, 2}
    spans = [(m.start, m.end) for m in out[1].loss_mask]
    assert [out[1].formatted[a:b] for a, b in spans] == ["b"]
    assert out[2].formatted == f"{chat.START}{chat.HEAD}{chat.END}" and out[2].loss_mask == []
    assert chat.format_trees(frame(schema)).count() == 0


def test_loss_mask_of_very_many_turns(frame):
    rows = [(1, k, "assistant" if k % 2 else "user", f"<t{k}>") for k in range(3000)]
    turns = frame("conv_id long, turn long, role string, text string", *rows).select("conv_id", F.lit(0).alias("path"), F.col("turn").alias("position"), "role", "text")
    out = chat.formatted(turns).first()
    said = [out.formatted[m.start : m.end] for m in out.loss_mask]
    assert said == [f"<\\t{k}>" for k in range(1, 3000, 2)]

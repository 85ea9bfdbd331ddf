"""Hand-written cases of the benchmark operators."""

import json

import pytest
from pyspark.sql import functions as F

from verdict_lake.functions import hashes as H
from verdict_lake.functions import models as MO
from verdict_lake.functions import urls as U
from verdict_lake.operators import audit as A
from verdict_lake.operators import consensus as C
from verdict_lake.operators import duplicates as D
from verdict_lake.operators import evalset as E
from verdict_lake.operators import inspect as I
from verdict_lake.operators import judging as J
from verdict_lake.operators import merge as M
from verdict_lake.operators import numbering as N
from verdict_lake.operators import queues as Q
from verdict_lake.operators import responses as R
from verdict_lake.operators import snapshot as X
from verdict_lake.operators import status as S
from verdict_lake.sources import listings as L
from verdict_lake.sources import published as P

PREDICTION = "id long, post_id string, model_id string, prediction string, error string"
JUDGMENT = "id long, prediction_id long, judge_model string, verdict string, judge_reasoning string, judge_prompt_version string"


def judged(frame, *groups):
    """Predictions 1, 2, ... of model m, with (judge, verdict) lists."""
    predictions = frame(PREDICTION, *((k, f"p{k}", "m", "x", None) for k in range(1, len(groups) + 1)))
    rows, n = [], 0
    for k, group in enumerate(groups, 1):
        for judge, verdict in group:
            n += 1
            rows.append((n, k, judge, {"c": "correct", "i": "incorrect"}[verdict], "why", "v1"))
    return predictions, frame(JUDGMENT, *rows)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_majority_and_agreement(frame):
    p, j = judged(frame, [("a", "c"), ("b", "c"), ("d", "i")], [("a", "c"), ("b", "i"), ("d", "i")], [("a", "c"), ("b", "i")])
    voted = J.voted_predictions(p, j)
    assert rows(J.consensus_counts(voted)) == [("m", 1, 1, 2, 0.5)]
    p, j = judged(frame, [("a", "c"), ("b", "c")], [("a", "c"), ("b", "i")])
    assert rows(J.judge_agreement(J.voted_predictions(p, j))) == [("m", 2, 1, 0.5)]


def test_solo_judge_and_rejudged(frame):
    p, j = judged(frame, [("a", "c")])
    assert rows(J.judge_agreement(J.voted_predictions(p, j))) == [("m", 0, 0, 0.0)]
    p, j = judged(frame, [("a", "i"), ("a", "c")])
    assert rows(J.judgment_counts(p, j)) == [("m", "a", 1, 1, 0, 1.0)]


def test_superseded_vote_leaves_no_verdict(frame):
    p, j = judged(frame, [("a", "c"), ("b", "c"), ("b", "i")])
    assert J.leaderboard(J.voted_predictions(p, j)).count() == 0
    history = J.judgment_history(j).filter("judge_model = 'b'").orderBy("id").select("is_latest")
    assert [r[0] for r in history.collect()] == [False, True]


def test_unnamed_judges_never_count(frame):
    p, j = judged(frame, [(None, "c"), ("a", "c")])
    assert J.latest_per_judge(j).count() == 1
    assert rows(J.judgment_history(j).select("judge_model", "is_latest")) == [("(unknown)", False), ("a", True)]


def test_quality_statistics(frame):
    g = frame("post_id string, consensus_confidence double, num_agreeing_comments int", ("a", 0.95, 5), ("b", 0.85, 3), ("c", 0.75, 7))
    assert rows(S.consensus_quality(g)) == [(3, 0.85, 5)]
    bins = dict(rows(S.confidence_histogram(g)))
    assert [bins[k] for k in range(10)] == [0, 0, 0, 0, 0, 0, 0, 1, 1, 1]
    one = frame("post_id string, consensus_confidence double, num_agreeing_comments int", ("a", 1.0, None))
    assert dict(rows(S.confidence_histogram(one)))[9] == 1


def test_hamming_and_widths(spark):
    assert spark.range(1).select(H.hamming(F.lit("0" * 16), F.lit("000000000000000f"))).first()[0] == 4
    with pytest.raises(Exception, match="unequal"):
        spark.range(1).select(H.hamming(F.lit("00"), F.lit("0000"))).collect()


def test_raster_hashes(spark):
    bright = list(range(72, 0, -1))
    row = spark.createDataFrame([(bright, [0] * 32 + [9] * 32)], "a array<int>, b array<int>").select(H.dhash(F.col("a")), H.ahash(F.col("b"))).first()
    assert tuple(row) == ("f" * 16, "0" * 8 + "f" * 8)


PRINT = "post_id string, exact_hash string, dhash string, ahash string, width int, height int"


def test_duplicates_match_reviewed_posts_only(frame):
    reviewed = frame(PRINT, ("r", "h1", "0" * 16, "0" * 16, 100, 100))
    pending = frame(PRINT, ("same", "h1", "f" * 16, "f" * 16, 9, 1), ("near", "h2", "000000000000000f", "f" * 16, 100, 100), ("wide", "h3", "00000000000000ff", "0000000000000003", 100, 100), ("far", "h4", "00000000000001ff", "0" * 16, 100, 100), ("tall", "h5", "0" * 16, "0" * 16, 50, 100))
    best = D.best_duplicate(D.candidate_pairs(pending, reviewed))
    assert {r.pending_id: r.exact for r in best.collect()} == {"same": True, "near": False, "wide": False}
    assert D.candidate_pairs(pending, frame(PRINT)).count() == 0


def test_bands_find_all_that_brute_force_finds(spark, frame):
    import random

    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(40)]

    def flipped(x, n):
        for b in draw.sample(range(64), n):
            x ^= 1 << b
        return x

    hexa = lambda x: f"{x:016x}"
    reviewed = [(f"r{k}", f"r{k}", hexa(x), hexa(x >> 1), 10, 10) for k, x in enumerate(base)]
    pending = [(f"q{k}", f"q{k}", hexa(flipped(base[k % 40], draw.randint(0, 9))), hexa(flipped(base[k % 40] >> 1, draw.randint(0, 3)) & (2**64 - 1)), 10, 10) for k in range(300)]
    near = lambda p, r: (d := (int(p[2], 16) ^ int(r[2], 16)).bit_count()) <= 4 or d <= 8 and (int(p[3], 16) ^ int(r[3], 16)).bit_count() <= 2
    expected = sorted((p[0], r[0]) for p in pending for r in reviewed if near(p, r))
    assert rows(D.candidate_pairs(frame(PRINT, *pending), frame(PRINT, *reviewed)).select("pending_id", "reviewed_id")) == expected


def test_pixels(frame):
    pairs = frame("pending_id string, reviewed_id string, exact boolean, dh int, ah int", ("q", "r", False, 1, 1), ("q", "s", False, 1, 1), ("q", "t", False, 0, 0))
    rasters = frame("post_id string, raster binary", ("q", bytearray([9] * 12)), ("r", bytearray([10] * 12)), ("s", bytearray([90] * 12)))
    assert rows(D.pixel_differences(pairs, rasters).select("reviewed_id", "diff")) == [("r", 1.0), ("s", 81.0)]


def test_pixels_decide_for_each_class_of_equal_images(frame):
    zero = "0" * 16
    reviewed = frame(PRINT, ("r1", "f1", zero, zero, 9, 9), ("r2", "f2", zero, zero, 9, 9), ("r3", "f3", zero, "f" * 16, 9, 9))
    pending = frame(PRINT, *((f"q{k}", f"p{k}", zero, zero, 9, 9) for k in range(1, 5)), ("q5", "f2", "f" * 16, zero, 9, 9), ("q6", "p6", zero, zero, 9, 9))
    raster = lambda x: bytearray([x] * 12)
    # the first reviewed image differs in its pixels, the second is the match; q4 is far from both, q6 has no raster
    rasters = frame("post_id string, raster binary", ("r1", raster(200)), ("r2", raster(10)), ("r3", raster(13)), ("q1", raster(10)), ("q2", raster(10)), ("q3", raster(14)), ("q4", raster(100)), ("q5", raster(0)))
    best = D.near_duplicates(pending, reviewed, rasters)
    assert {r.pending_id: (r.reviewed_id, r.exact, r.dh, r.ah) for r in best.collect()} == {"q1": ("r2", False, 0, 0), "q2": ("r2", False, 0, 0), "q3": ("r2", False, 0, 0), "q5": ("r2", True, 0, 0)}
    assert rows(D.exclusions(best).select("post_id", "reason"))[0] == ("q1", "duplicate_image:r2")


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from verdict_lake.session import scratch_folder

    conf = SimpleNamespace(get=lambda key, default: default, set=lambda key, value: None)
    with pytest.raises(RuntimeError):
        scratch_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert scratch_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).count("/") >= 2


def test_manifest_finds_files_by_their_path_under_the_root(spark, frame, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "p1.jpg").write_bytes(b"12345")
    posts = frame("post_id string, local_image_path string", ("p1", "a/p1.jpg"), ("p2", "a/p2.jpg"), ("p3", None), ("p4", "../a/p1.jpg"))
    expected = [("p1", 5), ("p2", None), ("p3", None), ("p4", None)]
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        assert rows(P.image_manifest(spark, posts, root).select("post_id", "length")) == expected


def test_search_goes_by_keys_of_other_tables(frame):
    judgments = frame("prediction_id long, why string", (1, "a needle"), (2, "none"))
    predictions = frame("prediction_id long, post_id string", (1, "p1"), (2, "p2"))
    posts = frame("post_id string, title string", ("p3", "NEEDLE%"))
    found = I.full_search("needle", ((posts, ("title",)), (judgments, ("why",), "prediction_id", predictions)))
    assert rows(found) == [("p1",), ("p3",)]


def test_null_keys_meet_nothing(frame):
    schema = "k string, v string, error string, created_at string"
    old, new = frame(schema, (None, "1", None, "t0")), frame(schema + ", seq int", (None, "2", None, "t1", 1))
    merged = M.merge(old, new, ["k"], "replace").collect()
    assert sorted((r.v, r.merge_action) for r in merged) == [("1", "kept"), ("2", "inserted")]


@pytest.mark.parametrize("url, expected", [("https://i.redd.it/a", True), ("https://x.com/a.PNG?x=1", True), ("https://i.imgur.com/a", True), ("http://x/y.webp", True), ("https://x.com/page", False), (None, False)])
def test_image_urls(spark, url, expected):
    assert spark.createDataFrame([(url,)], "u string").select(U.is_image_url(F.col("u"))).first()[0] is expected


def test_archive_rows(spark):
    raw = [{"id": "a", "url": "https://i.redd.it/a.png", "created_utc": 1700000000.5, "score": 20, "num_comments": 4}, {"id": "", "created_utc": 5}, {"id": "b", "created_utc": 0}, {"id": "c", "url": "https://i.redd.it/c.png", "is_self": True, "created_utc": "1700000001"}, {"id": "d", "created_utc": "soon"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in raw], "value string")
    assert rows(L.read_archive_rows(df).select("post_id", "image_url", "created_utc")) == [("a", "https://i.redd.it/a.png", 1700000000), ("c", None, 1700000001)]
    with pytest.raises(ValueError):
        L.date_window(df, "value", "2024-01-02", "2024-01-02")


def test_error_kinds(spark):
    df = spark.createDataFrame([("insufficient_quota", None), (None, 401), (None, 429), ("x", 400), (None, None)], "code string, status int")
    assert [r[0] for r in df.select(MO.error_kind(F.col("code"), F.col("status"))).collect()] == ["fatal", "fatal", "retryable", "other", None]


LONG = "x" * 120


@pytest.mark.parametrize(
    "answer, stage",
    [
        ({"has_consensus": False}, "no_consensus"),
        ({"has_consensus": True, "confidence": 0.5}, "low_confidence"),
        ({"has_consensus": "true", "confidence": "0.9", "selected_explanation": " "}, "no_explanation"),
        ({"has_consensus": 1, "confidence": 0.9, "selected_explanation": "short"}, "short_explanation"),
        ({"has_consensus": True, "confidence": 0.9, "selected_explanation": LONG + " It's JUST it"}, "vague_phrase"),
        ({"has_consensus": True, "confidence": 0.9, "selected_explanation": LONG, "agreeing_comment_ids": ["low", "low", "low"]}, "low_score"),
        ({"has_consensus": True, "confidence": 0.9, "selected_explanation": LONG, "agreeing_comment_ids": ["hi", "gone"]}, "few_agreeing"),
        ({"has_consensus": True, "confidence": 0.9, "selected_explanation": LONG, "agreeing_comment_ids": ["hi", "hi", "gone"]}, "accepted"),
        ({"has_consensus": True, "confidence": 0.9, "agreeing_comment_ids": [1]}, "parse_error"),
        ({"has_consensus": True, "confidence": None}, "parse_error"),
        ({"has_consensus": True, "confidence": 0.9, "agreeing_comment_ids": None}, "parse_error"),
        ({"confidence": 0.9}, "parse_error"),
        ([], "parse_error"),
    ],
)
def test_consensus_chain(frame, answer, stage):
    comments = frame("post_id string, comment_id string, score int", ("p", "hi", 9), ("p", "low", 1))
    out = C.validate_consensus(frame("post_id string, response string", ("p", json.dumps(answer))), comments).first()
    assert out.stage == stage
    assert out.accepted == (stage == "accepted")


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"reasoning": "because", "verdict": "CORRECT"}', ("correct", "because", None)),
        ('```json\n{"reasoning": "because", "verdict": "incorrect"}\n```', ("incorrect", "because", None)),
        ('Well: {"reasonation": "typo here", "verdict": "correct"}.', ("correct", "typo here", None)),
        ('{"reasoning": "because", " ": "correct"}', ("correct", "because", None)),
        ('{"reasoning": "....", "verdict": "correct"}', (None, None, "reasoning")),
        ('{"reasoning": 5, "verdict": "correct"}', (None, None, "parse")),
        ('{"reasoning": "because", "verdict": "both"}', (None, None, "verdict")),
        ("", (None, None, "parse")),
        (None, (None, None, "parse")),
        ('  ```\n{"reasoning": " because\\n so ", "verdict": " Correct "}\n ``` ', ("correct", "because\n so", None)),
        ('{"reasoning": "because", "verdict": "correct"} and more', (None, None, "parse")),
        ('so {"reasoning": "because"} or {"verdict": "correct"}', (None, None, "parse")),
        ('[{"reasoning": "because", "verdict": "correct"}]', ("correct", "because", None)),
        ('[1, 2]', (None, None, "parse")),
        ('{"reasoning": "because", "": "maybe", " ": "Incorrect", "  ": "correct"}', ("incorrect", "because", None)),
        ('{"reasoning": null, "reasonation": "because", "verdict": "correct"}', (None, None, "parse")),
        ('{"reasonation": 7, "verdict": "correct"}', (None, None, "reasoning")),
        ('{"reasoning": "because", "verdict": null, "": "correct"}', (None, None, "parse")),
        ('{"reasoning": "because", "verdict": ["correct"]}', (None, None, "parse")),
        ('{"reasoning": "because", "verdict": "incorrect", "verdict": "correct"}', ("correct", "because", None)),
        ('{"reasoning": "потому", "verdict": "correct", "more": {"a": [1]}}', ("correct", "потому", None)),
        ("{'reasoning': 'because', 'verdict': 'correct'}", (None, None, "parse")),
    ],
)
def test_verdict_parsing(frame, text, expected):
    out = R.parse_verdicts(frame("id long, response string", (1, text))).first()
    assert (out.verdict, out.reasoning, out.error) == expected


def test_merge_policies(frame):
    schema = "k string, v string, error string, created_at string"
    old = frame(schema, ("a", "1", None, "t0"), ("b", "2", "bad", "t0"))
    new = frame(schema + ", seq int", ("a", "9", None, "t1", 1), ("b", "8", None, "t1", 1), ("b", "7", None, "t2", 2), ("c", None, None, "t1", 1))
    get = lambda policy, **how: {r.k: (r.v, r.created_at, r.merge_action) for r in M.merge(old, new, ["k"], policy, **how).collect()}
    assert get("insert_if_absent") == {"a": ("1", "t0", "kept"), "b": ("2", "t0", "kept"), "c": (None, "t1", "inserted")}
    assert get("replace") == {"a": ("9", "t1", "updated"), "b": ("7", "t2", "updated"), "c": (None, "t1", "inserted")}
    assert get("replace_only_failures", failed=F.col("old.error").isNotNull()) == {"a": ("1", "t0", "kept"), "b": ("7", "t2", "updated"), "c": (None, "t1", "inserted")}
    assert get("replace_keep_created")["b"] == ("7", "t0", "updated")
    with pytest.raises(ValueError):
        M.merge(old, new, ["k"], "other")


def test_queues_ignore_nulls_on_the_right(frame):
    posts = frame("post_id string", ("a",), ("b",))
    none = frame("post_id string, status string", (None, "excluded"))
    assert Q.pending_gate(posts, none, none).count() == 2


def test_seeded_pick_is_stable(frame):
    df = frame("post_id string", *((f"p{k}",) for k in range(50)))
    assert rows(Q.seeded_pick(df, 5, "s")) == rows(Q.seeded_pick(df.repartition(7), 5, "s"))


def test_version_is_independent_of_order_and_the_same_streamed(frame):
    pairs = [(f"p{k}", f"text {k}") for k in range(40)]
    a, b = (frame("post_id string, explanation string", *x) for x in (pairs, pairs[::-1]))
    version = X.dataset_version(a).first()[0]
    assert len(version) == 16
    assert version == X.dataset_version(b).first()[0] == X.dataset_version(a.repartition(5)).first()[0]
    empty = frame("post_id string, explanation string")
    assert X.create_snapshot(empty, frame("dataset_version string")).count() == 0
    assert X.create_snapshot(a, frame("dataset_version string", (version,))).count() == 0


def test_numbers_follow_the_order_whatever_the_partitions(frame):
    df = frame("post_id string", *((f"p{k:03}",) for k in range(200))).repartition(9)
    for parts in (1, 3, 8):
        assert rows(N.numbered(df, "post_id", parts=parts)) == [(f"p{k:03}", k + 1) for k in range(200)]


def test_forbidden_keys_at_any_depth(frame):
    lines = frame("value string", ('{"a": [{"b": {"author": 1}}]}',), ('{"title": "author"}',), ('{"prompt" : 1}',), ("null",))
    assert rows(A.audit_export_keys(lines)) == [("author", 1), ("prompt", 1)]


def test_audits_count_bad_rows(frame):
    sources = frame("post_id string, source_comment_ids string", ("a", '["c1"]'), ("b", "[1]"), ("c", '["c1"]'), ("d", "x"))
    comments = frame("post_id string, comment_id string", ("a", "c1"))
    assert rows(A.audit_source_ids(sources, comments)) == [("b", "not an array of strings"), ("c", "unknown comment"), ("d", "not an array of strings")]


def test_eval_report_levels(frame):
    results = frame("run_id string, post_id string, category string, expected_has_consensus boolean, actual_has_consensus boolean, passed boolean", ("r", "a", "x", True, False, False), ("r", "b", "x", True, True, True), ("r", "c", "y", False, True, False))
    totals = E.eval_report(results).filter("category is null").first()
    assert (totals.total, totals.passed, totals.false_positive, totals.false_negative, totals.accuracy) == (3, 1, 1, 1, 0.333333)


def test_published_round_trip(spark, frame, tmp_path):
    board = frame("rank int, model_id string, judge_model string, correct long, incorrect long, total long, accuracy double, judged_by_multiple long, unanimous_agreements long, agreement_rate double", (1, "m", "consensus", 1, 0, 1, 1.0, 0, 0, 0.0))
    memes = frame("snapshot_id string, post_id string, title string, subreddit string, ground_truth string, image string", ("s", "p", None, "r", "g", "p.jpg"))
    tables = {"leaderboard": board, "memes": memes}
    P.write_export(tables, str(tmp_path / "json"))
    text = "".join(p.read_text() for p in (tmp_path / "json" / "memes").glob("part-*"))
    assert '"title":null' in text
    P.write_typed_tables(tables, str(tmp_path / "parquet"))
    back = P.read_published_tables(spark, str(tmp_path / "parquet"), "parquet", ("memes",))["memes"]
    assert rows(back.select("post_id", "snapshot_id")) == [("p", "s")]


def test_image_manifest(spark, frame, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.jpg").write_bytes(b"12345")
    memes = frame("post_id string, local_image_path string", ("a", "data/a.jpg"), ("b", "data/b.jpg"), ("c", "../data/a.jpg"), ("d", None))
    assert {r.post_id: r.length for r in P.image_manifest(spark, memes, str(tmp_path)).collect()} == {"a": 5, "b": None, "c": None, "d": None}


def test_stream_equals_batch(spark, tmp_path):
    from verdict_lake.streaming import ingest

    raw = [json.dumps({"id": f"p{k % 30}", "url": "https://i.redd.it/x.png", "created_utc": 1700000000 + k % 30, "score": 5 + k % 30, "num_comments": 3}) for k in range(90)]
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(raw[n * 40 : n * 40 + 50]))
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    ingest.stream_ingest(spark, *args).awaitTermination()
    (tmp_path / "in" / "2.txt").write_text("\n".join(raw))
    ingest.stream_ingest(spark, *args).awaitTermination()
    batch = ingest.posts_of(spark.read.text(args[0])).select("post_id").distinct()
    assert rows(spark.read.parquet(args[1]).select("post_id")) == rows(batch)


def test_few_values_or_an_error(frame):
    df = frame("m string", ("b",), ("a",), (None,), ("b",))
    assert Q.few(df, "m") == ["a", "b"]
    with pytest.raises(ValueError, match="more than 1"):
        Q.few(df, "m", most=1)


def test_tag_changes(frame):
    from verdict_lake.operators import tags as G

    tags = frame("tag_id long, name string, description string", (1, "Alpha", None), (2, "beta", None))
    links = frame("post_id string, tag_id long, notes string", ("p", 1, None), ("q", 2, "n"))
    renames = frame("tag_id long, new_name string", (1, " BETA "), (2, "Beta"))
    assert rows(G.rename_tags(tags, renames).select("tag_id", "name", "outcome")) == [(1, "Alpha", "conflict"), (2, "Beta", "renamed")]
    left, joined = G.remove_tag(tags, links, tags.filter("tag_id = 1"))
    assert rows(left.select("tag_id")) == [(2,)] and rows(joined.select("post_id")) == [("q",)]
    assert rows(G.clean_tag_names(frame("name string, position int", ("  a   b ", 1), ("A B", 2), ("  ", 3)))) == [("a b", 1)]

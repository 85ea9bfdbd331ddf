"""Streams of posts and comments against batches, and the files that a batch reads."""

import json
import os

from verdict_lake.streaming import ingest
from verdict_lake.streaming.keyed_sink import KeyedTable

HOUR, START = 3600, 1_700_000_000


def lines(folder, name, arrived, rows):
    """A text file of JSON lines that counts as written at a time."""
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("\n".join(map(json.dumps, rows)))
    os.utime(path, (START + arrived, START + arrived))


def post(k, **more):
    return {"id": f"p{k}", "url": "https://i.redd.it/x.png", "created_utc": START + 86_400 * (k % 5) + k, "score": 20, "num_comments": 3, **more}


def comment(k, of, **more):
    return {"id": f"c{k}", "link_id": f"t3_p{of}", "author": f"u{k}", "body": f"about {k}", "score": k, "created_utc": START + 86_400 * (k % 3) + k, **more}


def ids(spark, path, key):
    return sorted(r[0] for r in spark.read.parquet(str(path)).select(key).collect())


def test_comments_wait_for_posts_and_late_ones_are_settled(spark, tmp_path):
    posts, comments = tmp_path / "posts", tmp_path / "comments"
    posts.mkdir()
    lines(comments, "0", 0, [comment(k, k % 8) for k in range(24)] + [comment(3, 3), comment(90, 77), comment(91, 1, author="AutoModerator"), comment(92, 1, body="[deleted]"), comment(93, 9)])

    def run():
        ingest.stream_ingest(spark, str(posts), str(tmp_path / "p"), str(tmp_path / "p_state"), "3650 days").awaitTermination()
        args = [str(tmp_path / n) for n in ("posts", "comments", "p", "c", "c_state")]
        ingest.stream_comments(spark, *args, wait="1 day").awaitTermination()

    run()  # comments alone: all wait
    assert not (tmp_path / "c").exists()
    lines(posts, "1", HOUR, [post(k) for k in range(8)] + [post(2), post(9, score=1)])
    run()
    first = sorted(f"c{k}" for k in range(24))
    assert ids(spark, tmp_path / "c", "comment_id") == first
    # days later: the posts have left the state; one comment has a known post, one has none, one is there already
    lines(comments, "2", 240 * HOUR, [comment(50, 4), comment(51, 88), comment(5, 5)])
    lines(posts, "2", 240 * HOUR, [post(20), post(3)])
    run()
    lines(comments, "3", 480 * HOUR, [comment(60, 20)])
    lines(posts, "3", 480 * HOUR, [post(30)])
    run()
    # the comment on post 20 came too late for the state, and waits there until more arrives
    lines(comments, "4", 720 * HOUR, [])
    lines(posts, "4", 720 * HOUR, [post(31)])
    lines(comments, "5", 721 * HOUR, [comment(70, 31)])
    run()
    batch = ingest.comments_of(spark.read.text(str(comments)))
    known = ingest.posts_of(spark.read.text(str(posts))).select("post_id").distinct()
    want = sorted({r.comment_id for r in batch.join(known, "post_id", "left_semi").collect()})
    assert ids(spark, tmp_path / "p", "post_id") == sorted(r.post_id for r in known.collect())
    assert ids(spark, tmp_path / "c", "comment_id") == want == sorted([*first, "c50", "c60", "c70"])


def test_files_that_a_batch_reads_stay_as_many(spark, frame, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "post_id")
    schema = "post_id string, title string, created_utc long"
    rows = lambda d, n: frame(schema, *((f"p{d}.{k}", "t", START + 7 * 86_400 * d + k) for k in range(n)))
    read = []
    for d in range(12):
        # a week's new rows, and a repeat of the week before
        batch = rows(d, 20).unionByName(rows(max(d - 1, 0), 3))
        found = table.known(batch)
        read.append(len(found.inputFiles()) if found is not None else 0)
        table.insert_if_absent(batch, ingest.since("week"), ingest.POST_ORDER)
    assert len(ids(spark, table.path, "post_id")) == 12 * 20 == len(set(ids(spark, table.path, "post_id")))
    assert read[0] == 0 and max(read[2:]) <= 2, read
    # a key under another week is found too, null keys are one key, and a full filter costs files alone
    table.insert_if_absent(frame(schema, ("p3.1", "other", START + 86_400 * 40), (None, "a", START), (None, "b", START), ("new", "t", START)), ingest.since("week"), ingest.POST_ORDER)
    assert sorted(map(str, {r.post_id for r in spark.read.parquet(table.path).filter("title <> 't' or post_id = 'new'").collect()})) == ["None", "new"]


def test_a_batch_that_broke_off_runs_again(spark, frame, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), "post_id")
    schema = "post_id string, title string, created_utc long"
    batch = frame(schema, *((f"p{k}", "t", START) for k in range(10)))
    table._add_bits(batch.withColumn("since", ingest.since()))  # bits alone: broke off before the rows
    for _ in range(2):
        table.insert_if_absent(batch, ingest.since("week"), ingest.POST_ORDER)
    assert ids(spark, table.path, "post_id") == sorted(f"p{k}" for k in range(10))
    assert len(table._versions()) <= 2


def test_text_is_parsed_once_a_row(spark, frame):
    raw = frame("value string", (json.dumps(comment(1, 1)),), (json.dumps(comment(2, 1, author="BotX")),), ("no json",), (None,))
    rows = ingest.comments_of(raw)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [r.comment_id for r in rows.collect()] == ["c1"]


def test_waiting_comments_are_files_and_batches_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "BATCH_BYTES", 1)
    posts, state = tmp_path / "posts", tmp_path / "c_state"
    posts.mkdir()
    for k in range(3):
        lines(tmp_path / "comments", str(k), k, [comment(k, 1), comment(10 + k, 2)])
    args = [str(tmp_path / n) for n in ("posts", "comments", "p", "c", "c_state")]
    ingest.stream_comments(spark, *args).awaitTermination()
    assert sorted(p.name for p in (state / "waiting" / "comments").iterdir()) == ["batch=0", "batch=1", "batch=2"]
    assert not (state / "state").exists()  # no state of a join
    lines(posts, "1", HOUR, [post(1)])
    lines(tmp_path / "comments", "3", HOUR, [comment(3, 1), comment(0, 1)])
    ingest.stream_comments(spark, *args).awaitTermination()
    assert ids(spark, tmp_path / "c", "comment_id") == ["c0", "c1", "c2", "c3"]
    # long after, what waits is settled by the table of posts, and its files go
    ingest.stream_ingest(spark, str(posts), args[2], str(tmp_path / "p_state"), "3650 days").awaitTermination()
    lines(posts, "2", 240 * HOUR, [post(3)])
    lines(tmp_path / "comments", "4", 240 * HOUR, [comment(4, 1)])
    ingest.stream_comments(spark, *args).awaitTermination()
    assert [p.name for p in (state / "waiting" / "comments").iterdir()] == ["batch=4"]
    assert ids(spark, tmp_path / "c", "comment_id") == ["c0", "c1", "c2", "c3", "c4"]

"""Text is removed only where both hashes agree."""

from pyspark.sql import functions as F

from verdict_lake.llm import rolling, substring_dedup, suffix_dedup, windows


def piece(doc, content, length):
    return {"key": 1, "doc": doc, "body": doc, "at": 0, "low": 0, "high": len(content) - length, "owner": doc, "n": 2, "content": content}


def test_windows_of_one_first_hash_stay_apart(monkeypatch):
    finder = suffix_dedup.finder(8)
    group = [piece(1, b"abcdefghijkl", 8), piece(2, b"xxabcdefghyy", 8), piece(3, b"nothingshared", 8)]
    expected = [(1, 1, 0, 0), (2, 2, 2, 2)]
    assert finder.marks_in(group) == expected
    whole = windows.window_hashes
    monkeypatch.setattr(windows, "window_hashes", lambda *a: (whole(*a)[0] * 0, whole(*a)[1]))
    assert finder.marks_in(group) == expected
    monkeypatch.setattr(windows, "window_hashes", lambda *a: (whole(*a)[0], whole(*a)[1] * 0))
    assert finder.marks_in(group) == expected


def test_runs_of_one_first_hash_stay_apart(frame):
    schema = "doc long, body long, at long, low long, high long, name long, run long, more long, owner long"
    rows = frame(schema, (1, 1, 5, 0, 9, 7, 70, 1, 11), (2, 2, 5, 0, 9, 7, 70, 2, 12), (3, 3, 5, 0, 9, 7, 70, 2, 13), (4, 4, 5, 0, 9, 8, 80, 1, 14))
    whole, rest = suffix_dedup.finder().narrowed(rows)
    assert sorted(r.doc for r in whole.collect()) == [2, 3]
    # both kinds of run go on, as their windows may still share parts
    assert sorted(r.doc for r in rest.collect()) == [1, 2]


def test_both_hashes_differ_in_base_and_values():
    units = substring_dedup.word_units(b"one two three two")
    first, second = (u.tolist() for u in units)
    assert first[1] == first[3] and second[1] == second[3] and len(set(first + second)) == 6
    number, counts = rolling.same_as(*(u for u in units))
    assert counts[number].tolist() == [1, 2, 1, 2]


def test_touching_runs_are_listed_as_one(frame):
    texts = windows.keyed(frame("doc_id long, text string", (1, "a" * 5000), (2, None)))
    body = texts.filter("doc = 1").first().body
    marks = frame("low long", *((k,) for k in range(0, 4900, 3))).select(F.lit(1).cast("long").alias("doc"), F.lit(body).alias("body"), "low", (F.col("low") + 1).alias("high"))
    far = frame("doc long, body long, low long, high long", (1, body, 4990, 4990), (1, body, 4990, 4990))
    out = {r.doc: (r.lows, r.highs) for r in windows.with_marks(texts, marks.unionByName(far), 20).collect()}
    assert out == {1: ([0, 4990], [4900, 4990]), 2: (None, None)}

"""Searches by the text index against scans."""

import random

import pytest

from verdict_lake.operators import text_index
from verdict_lake.operators.inspect import like_any
from verdict_lake.operators.text_index import ROW, TextIndex, literal_parts

NEEDLES = ("cat", "CAT", "at", "", "%", "_", "c_t", "dog%cat", "100\\%", "a\\_b", "straße", "ΟΔΟΣ", "日本語", "no such", "cat house", "line\ntwo", "xx%yy%zz", "İst", "house cat dog")


def table(draw, n):
    words = ["cat", "Cat", "dog", "house", "100%", "a_b", "axb", "Straße", "οδος", "ΟΔΟΣΑ", "日本語", "line\ntwo", "xx", "yy", "zz", "İstanbul", "x" * 40]
    rows = []
    for k in range(n):
        text = None if k % 17 == 0 else draw.choice((" ", "")).join(draw.choice(words) for _ in range(draw.randrange(6)))
        rows.append((draw.choice("st"), str(k), f"p{k % (n // 3)}", text))
    return rows


def scanned(df, needle):
    return sorted({r.post_id for r in df.filter(like_any(needle, "text")).filter("post_id is not null").collect()})


def found(index, needle):
    return sorted(r.post_id for r in index.search(needle).collect())


def test_searches_equal_scans_through_refreshes(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "PARTS", 3)
    draw = random.Random(2)
    index = TextIndex(spark, str(tmp_path / "i"))
    rows = table(draw, 60)
    for step in range(3):
        df = frame(ROW, *rows)
        index.refresh(df)
        for needle in NEEDLES if step == 2 else NEEDLES[:4]:
            assert found(index, needle) == scanned(df, needle), (step, needle)
        # texts change, rows go, rows come, a row moves to another post and one comes back
        other = table(draw, 60)
        rows = [(s, k, f"m{k}" if int(k) == 5 else p, other[int(k)][3] if int(k) % 4 == step else t) for s, k, p, t in rows if int(k) % 9 != step]
        rows += [("s", str(100 + step), "p1", f"cat {step}"), ("n", str(step), None, "cat"), ("s", "7", "p7", "cat again")][: 2 + (step == 1 and not any(r[:2] == ("s", "7") for r in rows))]
    before = index.texts().count()
    index.refresh(df)
    assert index.texts().count() == before  # nothing changed, nothing written


def test_a_search_reads_the_parts_of_its_posts_alone(spark, frame, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    index.refresh(frame(ROW, *(("s", str(k), f"p{k}", f"text of number {k}" + (" needle in hay" if k == 77 else "")) for k in range(400))))
    every = len(index.texts().inputFiles())
    assert found(index, "NEEDLE in") == ["p77"]
    assert len(index.read_for("NEEDLE in").inputFiles()) < every / 8


def test_rounds_equal_scans_and_the_trigrams_stay_few(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "ROUND_ROWS", 10)
    monkeypatch.setattr(text_index, "BLOCKS", 8)
    index = TextIndex(spark, str(tmp_path / "i"))
    rows = [("s", str(k), f"p{k}", f"text {k}") for k in range(300)]
    for _ in range(2):
        index.refresh(frame(ROW, *rows))
    assert len(index._versions()) == text_index.ROUNDS and index.texts().count() == 300
    rows[7] = ("s", "7", "p7", "other")
    index.refresh(frame(ROW, *rows))
    assert found(index, "text 7") == sorted(f"p{k}" for k in range(300) if str(k).startswith("7") and k != 7)
    assert found(index, "OTHER") == ["p7"]
    # by block, not by post: 300 posts hold " te", and a block holds it once
    assert index.grams().groupBy("gram", "block").count().filter("count > 2").count() == 0
    assert index.grams().count() < 300 * 3


def test_a_version_that_broke_off_is_written_again(spark, frame, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    df = frame(ROW, ("s", "1", "p1", "a cat"), ("s", "2", "p2", "a dog"))
    index.refresh(df)
    (tmp_path / "i" / "grams" / "version=0" / "_SUCCESS").unlink()
    assert index.texts().count() == 0 and found(index, "cat") == []
    index.refresh(df)
    assert index.texts().count() == 2 and found(index, "cat") == ["p1"]


@pytest.mark.parametrize("needle, parts", [("a%b_c", ["a", "b", "c"]), ("\\%a\\\\", ["%a\\"]), ("%%", []), ("ab", ["ab"])])
def test_literal_parts(needle, parts):
    assert literal_parts(needle) == parts

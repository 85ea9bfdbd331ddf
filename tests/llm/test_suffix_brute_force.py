"""Suffix dedup against hashes of every byte position, and which of its columns tells planted passages."""

import random

import numpy as np
import suffix_brute_force as brute

from verdict_lake.llm import suffix_dedup


def test_removals_tell_planted_passages_and_lengths_do_not(frame):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghé") for _ in range(draw.randrange(7, 12)))
    passage = " ".join(word() for _ in range(60))
    texts, planted = [None, ""], [False, False]
    for k in range(40):
        body = [word() for _ in range(draw.choice((60, 200, 400)))]
        planted.append(k % 2 == 0)
        texts.append(" ".join(body[:20] + [passage] * planted[-1] + body[20 + 60 * planted[-1] :]))
    got = suffix_dedup.suffix_report(frame("doc_id long, text string", *enumerate(texts))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == list(brute.after(texts))
    column = lambda c: np.array([r[c] for r in got])
    planted = np.array(planted)
    assert len(passage.encode()) > 400 and ((brute.passages(texts) > 0) == planted).all()
    assert brute.reading(column("n_removed"), planted) == (1, 1)
    # n_bytes is the input's length whatever is removed, so no result of the contract tells passages by it
    assert column("n_bytes").tolist() == [len((t or "").encode()) for t in texts] and min(brute.reading(column("n_bytes"), planted)) < 0.8


def test_brute_force_itself():
    draw = random.Random(7)
    texts = ["".join(draw.choice("ab") for _ in range(draw.randrange(40))) for _ in range(30)] + [None, "", "a" * 30]
    for length in (1, 7, 13):
        data = [(t or "").encode() for t in texts]
        starts = [t[k : k + length] for t in data for k in range(len(t) - length + 1)]
        gone = [{j for k in range(len(t) - length + 1) if starts.count(t[k : k + length]) > 1 for j in range(k, k + length)} for t in data]
        assert [r[:2] for r in brute.after(texts, length)] == [(len(t), len(g)) for t, g in zip(data, gone)]
    lines = ["a b c d e", "x b c d y", "b c q", "c d e f c d e"]
    assert brute.passages(lines, 3).tolist() == [7, 5, 0, 5] and brute.passages(lines, 4).tolist() == [0] * 4

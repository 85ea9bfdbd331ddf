"""Whitening, exact top-k search and collocations against plain versions, with odd rows."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from verdict_lake.llm import collocations, exact_topk, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def integers(rows):
    """(vec_id, x) of the rows that take part."""
    good = [(i, e) for i, e, _ in rows if e and all(c is not None and isfinite(c) for c in e)]
    return [(i, [floor(256 * float(np.float32(c))) for c in e]) for i, e in good]


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(4)
    base = draw.normal(size=(3, 6)).astype(np.float32)
    rows = [(k, [float(c) for c in base[k % 3] + draw.normal(scale=0.3, size=6).astype(np.float32)], k) for k in range(240)]
    rows += [(k + 240, rows[k % 7][1], 0) for k in range(60)]  # copies
    rows += [(400, [100.0, -3e4, 0.0, -0.0, 1e-9, -1e-9], 0), (None, rows[3][1], 0), (402, rows[4][1], 0), (402, rows[4][1], 0), (402, rows[5][1], 1)]
    odd = [(500, None, 0), (501, [], 0), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (503, [float("nan")] * 6, 0), (504, [float("inf")] + [0.0] * 5, 0)]
    return rows, odd


def test_whitening_against_exact_fractions(frame, vectors):
    rows, odd = vectors
    got = whitening.whitening_report(frame(VECTORS, *rows, *odd, (600, [1.0, 2.0], 0))).collect()
    used = integers(rows)
    fit = sorted({tuple(x) for _, x in used})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(6)] for i in range(6)])
    values, basis = np.linalg.eigh(cov)
    assert len(got) == 4 * len(used) and {r.n for r in got} == {n}
    deviations = Counter((i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in used for _ in range(4))
    assert Counter((r.vec_id, r.deviation) for r in got) == deviations
    for k in range(4):
        e, v = values[5 - k], basis[:, 5 - k]
        mine = {}
        for i, x in used:
            mine.setdefault(i, []).append(float((np.array(x) - np.array(sums) / n) @ v / np.sqrt(e)))
        found = {}
        for r in got:
            if r.component == k + 1:
                found.setdefault(r.vec_id, []).append(r.whitened)
                assert abs(r.explained - e / np.trace(cov)) < 1e-9
        sign = np.sign(found[0][0] * mine[0][0])
        assert all(np.allclose(sorted(found[i]), sorted(sign * x for x in mine[i]), atol=1e-7) for i in mine)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_keeps_columns_and_defines_empty_and_flat_tables(frame, vectors):
    schema = "vec_id long, embedding array<float>, x string, rest int, whitened int, n int"
    out, model, _ = whitening.with_whitened(frame(schema, *((i, e, "x", 7, 1, 2) for i, e, _ in vectors[0][:30])))
    assert out.columns == ["vec_id", "embedding", "x", "rest", "n", "whitened", "deviation"] and out.count() == 30
    assert all((r.x, r.rest, r.n, len(r.whitened)) == ("x", 7, 2, 6) for r in out.collect()) and model.n == 30
    assert whitening.whitening_report(frame(VECTORS)).count() == 0
    assert whitening.whitening_report(frame(VECTORS, *vectors[1])).count() == 0
    flat = whitening.whitening_report(frame(VECTORS, (1, [2.0, 1.0], 0), (2, [2.0, 1.0], 0))).collect()
    assert len(flat) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat} == {(1, 0, None, None, None)}


def test_bit_planes_give_exact_products():
    draw = np.random.default_rng(1)
    for low, high, rows in ((-3, 4, 70), (-(1 << 40), 1 << 40, 65), (-(1 << 62), 1 << 62, 130)):
        x = draw.integers(low, high, size=(rows, 5))
        y = x.astype(object)
        sums, products = whitening.scatter(x)
        assert (sums == y.sum(axis=0)).all() and (products == y.T @ y).all()


def plain_top(rows, k=5):
    used = integers(rows)
    queries = {}
    for i, x in used:
        if i is not None and i % 50 == 0:
            queries[i] = min(queries.get(i, x), x)
    candidates = sorted({(i, tuple(x)) for i, x in used if i is not None})
    want = set()
    for q, x in queries.items():
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in candidates if i != q)[:k]
        want |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    return want


@pytest.mark.parametrize("strip, block, pivots", [(4096, 32_000_000, 64), (7, 600, 3)])
def test_top_k_against_all_pairs(frame, vectors, monkeypatch, strip, block, pivots):
    for name, value in (("STRIP", strip), ("BLOCK_BYTES", block), ("PIVOTS", pivots), ("PICKED_FROM", 40)):
        monkeypatch.setattr(exact_topk, name, value)
    rows, odd = vectors
    got = exact_topk.topk_report(frame(VECTORS, *rows, *odd).repartition(3)).collect()
    assert len(got) == 5 * 7 and {tuple(r) for r in got} == plain_top(rows)


def test_top_k_of_few_and_no_rows(frame):
    few = [(0, [1.0], 0), (50, [-1.0], 0), (7, [1.0], 0)]
    assert {tuple(r) for r in exact_topk.topk_report(frame(VECTORS, *few)).collect()} == plain_top(few)
    assert exact_topk.topk_report(frame(VECTORS, (0, [1.0, 2.0], 0))).count() == 0
    assert exact_topk.topk_report(frame(VECTORS)).count() == 0


def plain_collocations(docs, top, least):
    f, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                for at in range(len(w) - size + 1):
                    f[lang, tuple(w[at : at + size])] = f.get((lang, tuple(w[at : at + size])), 0) + 1
    out = set()
    for lang in n:
        mine = {p: a for (of, p), a in f.items() if of == lang and len(p) > 1 and a >= least}
        rows = []
        for p, a in mine.items():
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in mine.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            s, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out |= {(lang, rank + 1, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}
    return out


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(8)
    words = [f"w{k}" for k in range(25)] + ["Ärger", "ärger", "A", "a#", "日本", "x\x0by", "\x00"]
    docs = []
    for k in range(90):
        said = [words[min(int(draw.expovariate(0.12)), len(words) - 1)] for _ in range(120)]
        for at in range(0, 110, 10):
            said[at : at + 3] = draw.choice((["New", "York", "city"], ["of", "the", "w1"], ["new", "york", "W2"]))
        text = "".join(w + draw.choice((" ", " ", "  ", " ", "\t", ". ", ",", "\n")) for w in said)
        docs.append((text, draw.choice(("en", "en", "en", "fr", None))))
    return [*docs, (None, "en"), ("", None), ("only once", "de"), *docs[:3]]


@pytest.mark.parametrize("top, run, bits", [(2000, 4_000_000, 23), (6, 500, 23), (3, 3000, 7)])
def test_collocations_against_plain_counts(frame, prose, monkeypatch, top, run, bits):
    # few phrases asked for: thresholds, several rounds, and bitmaps in which prefixes collide
    for name, value in (("RUN", run), ("BITS", bits), ("AHEAD", 1), ("GROWTH", 2), ("ROWS", 50)):
        monkeypatch.setattr(collocations, name, value)
    df = frame("text string, lang string, a int, phrase int", *((t, lang, 1, 2) for t, lang in prose)).repartition(3)
    got = collocations.collocations(df, top=top, least=4).collect()
    assert len(got) > 2 and {tuple(r) for r in got} == plain_collocations(prose, top, 4)
    if top == 6:
        assert collocations.collocations(df.limit(0)).count() == 0
        assert collocations.collocations(frame("text string, lang string", (None, None), ("one two", "en"))).count() == 0


def test_scores_beyond_64_bits(frame):
    big = 9_000_000_000_000_001
    row = frame("a long, l long, r long", (big, big + 3, big + 5)).select(collocations.score("a", "l", "r").alias("s")).first()
    assert row.s == 1000000 * big * big // ((big + 3) * (big + 5))

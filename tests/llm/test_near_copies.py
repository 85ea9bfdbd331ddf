"""Near-dedup by similarity against all pairs of texts."""

import random

import numpy as np

from verdict_lake.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def planted(seed=5):
    """Texts of several lengths, near copies of them with some words changed or added, copies, short texts and nulls."""
    draw = random.Random(seed)
    texts = [None, "", " ", "one", "One", "one two three", "one two three four five six"]
    for n in (30, 60, 120, 300):
        for _ in range(6):
            body = [f"w{draw.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(body))
            for changes in (1, 1, n // 60, n // 30, n // 15):
                copy = list(body)
                for _ in range(changes):
                    copy[draw.randrange(n)] = f"x{draw.randrange(5000)}"
                texts.append(" ".join(copy + ["more"] * draw.randrange(2)))
    return texts


def brute_kept(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return [k for k in range(len(texts)) if up[k] == k]


def docs_of(frame, texts):
    return frame(DOCS, *((i, t, "en", "s", 0) for i, t in enumerate(texts))).repartition(3)


def test_near_dedup_equals_all_pairs(frame):
    texts = planted()
    df = docs_of(frame, texts)
    kept = brute_kept(texts)
    assert len(kept) < len(texts) * 0.6
    out = simhash.near_dedup(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == kept
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_large_groups_of_near_copies_and_tiny_chunks(frame, monkeypatch):
    draw = random.Random(3)
    body, other = ([f"w{draw.randrange(900)}" for _ in range(80)] for _ in range(2))
    texts = []
    for base, copies in ((body, 150), (other, 20)):
        for _ in range(copies):
            copy = list(base)
            copy[draw.randrange(80)] = f"x{draw.randrange(9000)}"
            texts.append(" ".join(copy))
    # a chain: neighbours are similar, its ends are not
    chain = [f"c{k}" for k in range(100)]
    texts += [" ".join([*chain[k * 6 :], *(f"d{j}" for j in range(k * 6))]) for k in range(8)]
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "BLOCK", 200)
    df = docs_of(frame, texts)
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == brute_kept(texts)


def test_what_stars_leave_is_compared_in_full(frame, monkeypatch):
    # proposals without any bound on the bits: one dense chunk, of which stars test only a part
    texts = planted(7)
    monkeypatch.setattr(simhash, "RADII", (64, 256))
    monkeypatch.setattr(simhash, "SMALL_RADII", (64, 256))
    assert sorted(r.doc_id for r in simhash.near_dedup(docs_of(frame, texts)).collect()) == brute_kept(texts)


#: Shingles that a pair of texts shares, and those of the first and of the second alone: the hardest pairs at 0.8.
SHARES = ((4, 0, 1), (8, 0, 2), (8, 1, 1), (12, 0, 3), (12, 1, 2), (20, 2, 3), (36, 4, 5), (68, 12, 5), (92, 8, 15), (180, 20, 25))


def pairs_by_size(pairs, seed=9):
    """Rows of two texts each, of words of their own, whose sets of 5-word shingles have the similarity 0.8."""
    draw = random.Random(seed)
    for size, (shared, first, second) in enumerate(SHARES):
        for k in range(pairs):
            word = lambda side, n: [f"{side}{size}.{k}.{j}.{draw.randrange(1000)}" for j in range(n)]
            body = word("w", shared + 4)
            # words at an end make as many new shingles, and words before the start too
            yield size, " ".join(word("a", first) + body), " ".join(body + word("b", second))


def test_recall_at_the_threshold_for_every_size(frame):
    pairs = 200
    rows = list(pairs_by_size(pairs))
    texts = [t for _, a, b in rows for t in (a, b)]
    for _, a, b in rows[::pairs]:
        assert len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) == 0.8
    kept = [r.doc_id for r in simhash.near_dedup(docs_of(frame, texts)).select("doc_id").collect()]
    left = [0] * len(SHARES)
    for k in kept:
        left[rows[k // 2][0]] += k % 2
    assert max(left) <= pairs * 0.01, dict(zip(SHARES, left))


def test_near_against_plain_bit_counts():
    draw = np.random.default_rng(2)
    words = [draw.integers(0, 1 << 62, 300).astype(np.uint64) & np.uint64(0xFFFF) for _ in range(2)]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if int(words[0][i] ^ words[0][j]).bit_count() <= 3 and sum(int(w[i] ^ w[j]).bit_count() for w in words) <= 8}
    i, j = simhash.near(words, words, 3, 8, True)
    assert want and set(zip(i.tolist(), j.tolist())) == want


def test_many_texts_near_to_each_other_but_not_enough(frame):
    # each pair shares some 0.7 of its shingles: proposed by the fingerprints, and no star's link holds
    draw = random.Random(11)
    body = [f"w{draw.randrange(9000)}" for _ in range(120)]
    texts = []
    for k in range(90):
        copy = list(body)
        for at in draw.sample(range(5, 115, 7), 2):
            copy[at] = f"x{k}.{at}"
        texts.append(" ".join(copy))
    texts += [t + " end" for t in texts[:10]]
    assert sorted(r.doc_id for r in simhash.near_dedup(docs_of(frame, texts)).collect()) == brute_kept(texts)


def test_similar_against_sets_in_blocks_of_columns(monkeypatch):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([draw.choice(base, draw.integers(60, 80), replace=False), draw.integers(0, 1 << 60, draw.integers(0, 6)).astype(np.uint64)])) for _ in range(40)]
    sets.append(np.zeros(0, np.uint64))
    want = {(i, j) for i, a in enumerate(sets[:20]) for j, b in enumerate(sets[20:]) if len(a) and len(np.intersect1d(a, b)) >= 0.75 * len(np.union1d(a, b))}
    for cells in (1 << 24, 500):
        monkeypatch.setattr(simhash, "CELLS", cells)
        i, j = simhash.similar(sets[:20], sets[20:], 0.75)
        assert want and set(zip(i.tolist(), j.tolist())) == want
    assert simhash.similar([], sets, 0.5)[0].tolist() == []

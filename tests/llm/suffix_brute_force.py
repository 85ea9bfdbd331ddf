"""Suffix dedup by 64-bit hashes of every byte position, on one machine and without the library's code, and passages of 51 words.

python tests/llm/suffix_brute_force.py documents.parquet output prints how many rows of a stored output of op3_suffix_dedup differ, and
how its columns tell documents that hold 51 words in a row that another document holds too. It holds all texts in memory.
"""

import hashlib
import os
import sys
from concurrent.futures import ThreadPoolExecutor

import numpy as np

U = np.uint64
LENGTH, PASSAGE, STEP, BUCKETS = 400, 51, 1 << 22, 64
DRAWN = np.random.default_rng(20261129)
BYTES = DRAWN.integers(1, 1 << 64, 256, dtype=U)
ODD = [U(int(x) | 1) for x in DRAWN.integers(1, 1 << 63, 4, dtype=U)]


def mixed(a):
    a = (a ^ (a >> U(31))) * ODD[0]
    return a ^ (a >> U(29))


def hashes(values, length):
    """Of all neighbours of length values: widths double, and those that make up the length are joined."""
    n, out, at, width, sums = len(values) - length + 1, np.zeros(len(values) - length + 1, U), 0, 1, values
    while width <= length:
        if length & width:
            out = mixed(out * ODD[1] + sums[at : at + n] * ODD[2])
            at += width
        if 2 * width <= length:
            sums = mixed(sums[:-width] * ODD[1] + sums[width:] * ODD[3] + U(width))
        width *= 2
    return out


def repeated(values, sizes, length, elsewhere):
    """Which positions start a window that stays in its document and starts twice; elsewhere: in two documents."""
    ends = np.cumsum(sizes)
    inside = np.zeros(len(values), bool)
    for start, end in zip((ends - sizes).tolist(), ends.tolist()):
        inside[start : max(start, end - length + 1)] = True
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes) if elsewhere else None
    names, found = np.zeros(len(values), U), np.zeros(len(values), bool)

    def name(low):
        part = values[low : low + STEP + length - 1]
        if len(part) >= length:
            names[low : low + len(part) - length + 1] = hashes(part if part.dtype == U else BYTES[part], length)

    def settle(bucket):
        at = np.concatenate([low + np.flatnonzero(inside[low : low + STEP] & (names[low : low + STEP] % U(BUCKETS) == U(bucket))) for low in range(0, len(values), STEP)])
        if elsewhere and len(at):
            at = at[np.argsort(names[at], kind="stable")]
            first = np.flatnonzero(np.diff(names[at], prepend=~names[at[:1]]))
            last = np.append(first[1:], len(at)) - 1
            found[at[np.repeat(owner[at[first]] != owner[at[last]], last - first + 1)]] = True
        elif len(at):
            these = np.sort(names[at])
            twice = np.unique(these[1:][these[1:] == these[:-1]])
            if len(twice):
                place = np.minimum(np.searchsorted(twice, names[at]), len(twice) - 1)
                found[at[twice[place] == names[at]]] = True

    with ThreadPoolExecutor(5) as pool:
        list(pool.map(name, range(0, len(values), STEP)))
        list(pool.map(settle, range(BUCKETS if len(values) else 0)))
    return found


def after(texts, length=LENGTH):
    """n_bytes, n_removed, n_spans and kept_sha256 of each text."""
    texts = [(t or "").encode() for t in texts]
    data, sizes = np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts], dtype=np.int64)
    found, at = repeated(data, sizes, length, False), 0
    for text in texts:
        starts = np.flatnonzero(found[at : at + len(text)])
        edges = np.bincount(starts, minlength=len(text) + 1) - np.bincount(starts + length, minlength=len(text) + 1)
        gone = np.cumsum(edges[:-1]) > 0
        kept = data[at : at + len(text)][~gone].tobytes()
        yield len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()
        at += len(text)


def passages(texts, length=PASSAGE):
    """The most bytes of consecutive windows of length words that another text holds too, for each text; 0: none."""
    split = [(t or "").encode().split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    found = repeated(np.fromiter((hash(w) for ws in split for w in ws), np.int64, int(sizes.sum())).view(U), sizes, length, True)
    out, at = [], 0
    for words in split:
        edges = np.flatnonzero(np.diff(found[at : at + len(words)].astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        ends = np.cumsum([0, *(len(w) + 1 for w in words)])  # one space after each word
        out.append(max((int(ends[high + length - 1] - ends[low]) - 1 for low, high in edges.tolist()), default=0))
        at += len(words)
    return np.array(out, dtype=np.int64)


def reading(column, planted):
    """The shares of planted documents above the median of the others, and of the others that are not."""
    middle = np.median(column[~planted])
    return float((column[planted] > middle).mean()), float((column[~planted] <= middle).mean())


def main(source, output):
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    docs = pq.read_table(source, columns=["doc_id", "text"]).sort_by("doc_id")
    got = ds.dataset(output, format="parquet").to_table().sort_by("doc_id")
    names, texts = ["n_bytes", "n_removed", "n_spans", "kept_sha256"], docs["text"].to_pylist()
    assert docs["doc_id"].to_pylist() == got["doc_id"].to_pylist() and len(set(got["doc_id"].to_pylist())) == len(got), "one row a doc_id is asked for"
    rows = list(zip(*(got[c].to_pylist() for c in names)))
    print(f"{len(rows)} documents, {sum(r[1] > 0 for r in rows)} with removals, {sum(a != b for a, b in zip(rows, after(texts)))} differ from the brute force", flush=True)
    longest = passages(texts)
    planted, removed = longest > 0, got["n_removed"].to_numpy()
    for c in names[:2]:
        print(f"{c} above its median of the others: caught {reading(got[c].to_numpy(), planted)[0]:.4f}, left alone {reading(got[c].to_numpy(), planted)[1]:.4f}")
    missed = planted & (removed == 0)
    print(f"{planted.sum()} hold {PASSAGE} words of another; of those {missed.sum()} lose nothing, {(missed & (longest < LENGTH)).sum()} of them repeat under {LENGTH} bytes; {(~planted & (removed > 0)).sum()} others lose bytes")


if __name__ == "__main__":
    if os.environ.get("PYTHONHASHSEED") != "0":  # hashes of words that a rerun has too
        os.execve(sys.executable, [sys.executable, *sys.argv], os.environ | {"PYTHONHASHSEED": "0"})
    main(*sys.argv[1:])

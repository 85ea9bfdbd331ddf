"""Substring dedup by seed and extend: documents meet on winnowed anchors, and around each anchor the windows of words
that others have too are found.

A plain join on anchors would give all pairs of a group, and a passage in a third of all documents makes such a group. So
the documents of an anchor are grouped instead of paired: first by the anchor, then by half a window's words to its right
or left, then by the windows that hold it, up to the farthest on both sides. Equal surroundings are one row on the way.
A match is not a row of two documents but a run of windows of one; runs that touch are joined, so that what is removed
are the maximal repeats over the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rolling import BYTE_VALUES, MORE_VALUES, Pair, U, Units
from .store import python_ready
from .windows import NO_ID, Finder, covered, keyed, once, repeats_of, unsqueeze, with_marks

LENGTH, GRAM = 50, 8
#: Words hashed at once.
STEP = 1 << 16


def word_units(text: bytes) -> Units:
    """Both hashes of each word."""
    words = text.split()
    parts = []
    for at in range(0, len(words), STEP):
        some = words[at : at + STEP]
        ends = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)))
        starts = np.concatenate([[0], ends[:-1]])
        data = np.frombuffer(b"".join(some), dtype=np.uint8)
        parts.append(Pair((BYTE_VALUES[data], MORE_VALUES[data])).hashes(starts, ends))
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, dtype=U), np.zeros(0, dtype=U))


def finder(length: int = LENGTH) -> Finder:
    return Finder(length, min(length, GRAM), True, word_units, lambda text, a, b: b" ".join(text.split()[a:b]))


def kept_words(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, packed, lows, highs in zip(*(batch.column(c).to_pylist() for c in ("doc", "packed", "lows", "highs"))):
                words = unsqueeze(packed).split()
                n, removed = len(words), 0
                if lows:
                    mask = covered(lows, [h + length for h in highs], n)
                    removed = int(mask.sum())
                    words = [w for w, gone in zip(words, mask.tolist()) if not gone]
                kept = b" ".join(words)
                rows.append((None if doc == NO_ID else doc, n, removed, hashlib.sha256(kept).hexdigest(), kept))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return run


def without_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words (UTF-8, joined by a space) of each row of docs.

    A word goes if it is in a window of length words whose words also start in a document of a smaller doc_id; windows
    are judged on the input. Null texts have no words; a null doc_id is smaller than all; repeated rows have one doc_id
    and so don't remove each other. Texts of any length are searched whole.
    """
    python_ready(docs.sparkSession)
    texts = keyed(docs)
    marked = with_marks(texts, finder(length).marks(once(texts, repeats_of(texts))), length)
    return marked.mapInArrow(kept_words(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


def substring_report(docs: DataFrame) -> DataFrame:
    return without_passages(docs).drop("kept")

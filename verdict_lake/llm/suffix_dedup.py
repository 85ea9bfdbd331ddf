"""Every byte string of the threshold's length that starts twice, found by seed and extend over winnowed positions.

The method dealt for this operator, prefix doubling, was exchanged for that of substring dedup: both run windows.Finder. There
are no suffix ranks, no sorted pairs of ranks and no rounds of doubling. Each window of the threshold's length marks one
position by its smallest gram hash, the same in equal windows; positions are grouped by that hash, then by the hash of
the half window next to it, and what is left is compared window by window. Doubling over all positions stands in
tests/llm/doubling_attempt.py, which prints what it shuffles; it gives the same bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import BYTE_VALUES, MORE_VALUES, Units
from .store import python_ready, small_or_not
from .windows import NO_ID, Finder, covered, keyed, once, repeats_of, unsqueeze, with_marks

LENGTH = 400


def byte_units(text: bytes) -> Units:
    data = np.frombuffer(text, dtype=np.uint8)
    return BYTE_VALUES[data], MORE_VALUES[data]


def finder(length: int = LENGTH) -> Finder:
    return Finder(length, max(1, length // 8), False, byte_units, lambda text, a, b: text[a:b])


def kept_bytes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, packed, lows, highs in zip(*(batch.column(c).to_pylist() for c in ("doc", "packed", "lows", "highs"))):
                text = unsqueeze(packed)
                removed, spans, kept = 0, 0, text
                if lows:
                    mask = covered(lows, [h + length for h in highs], len(text))
                    removed = int(mask.sum())
                    spans = int((np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1).sum())
                    kept = np.frombuffer(text, dtype=np.uint8)[~mask].tobytes()
                rows.append((None if doc == NO_ID else doc, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of each row of docs (doc_id, text).

    A byte goes if it is in a string of length bytes that starts anywhere else too, in this document or another;
    overlaps count and strings are judged on the input. Null texts are empty; texts under the length keep all; a row
    that repeats another is another place. Texts of any length are searched whole. Kept bytes need not be whole characters.
    """
    python_ready(docs.sparkSession)
    texts = keyed(docs)
    repeats = repeats_of(texts)
    marks = finder(length).marks(once(texts, repeats))
    if not repeats.isEmpty():
        # every string of a repeated row starts in the other rows too; a text shorter than the length has none
        ends = F.octet_length("text") - length
        whole = texts.join(small_or_not(repeats.select("doc", "body")), ["doc", "body"], "left_semi").filter(ends >= 0)
        marks = marks.unionByName(whole.select("doc", "body", F.lit(0).cast("long").alias("low"), ends.cast("long").alias("high")))
    marked = with_marks(texts, marks, length)
    return marked.mapInArrow(kept_bytes(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).drop("kept")

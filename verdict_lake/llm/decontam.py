"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

The test items are partitioned by size into classes of doubling shingle counts. An item with q shingles is found if a
document holds at least need = ceil(t q) of them; then of any q - need + 1 of its shingles the document holds one. So an
item's signature is its smallest MinHash values, as many as its class's largest size asks for, and a document is a
candidate if any of its own shingle hashes is in a signature. A MinHash of a whole long document would not do: against
an item of 30 shingles a document of 20,000 words has a Jaccard similarity near 0.001. A document has no part in the
classes whose smallest items need more shingles than it has. Candidates are verified on the shingles' own bytes. The
search finds every pair.

Items of SENT_BYTES at most go to the tasks, and documents are not shuffled. More items are a table: signatures and those
shingle hashes of documents that may be in one are joined, and only candidates' texts are shuffled for the verification.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rolling import BYTE_VALUES, Sums, U
from .store import packed, python_ready, stored, unpacked

WIDTH, THRESHOLD = 5, 0.8
PUNCTUATION = string.punctuation.encode()
#: The most bytes of test items that are sent to the tasks.
SENT_BYTES = 16_000_000
#: Shingle hashes of documents are joined only if their first so many bits are those of a signature's.
SLOT_BITS = 24
#: Items that are verified against a document at once.
TOGETHER = 64
#: Shingles hashed at once.
STEP = 1 << 15
HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType())]))


def normal(text: str | None) -> bytes:
    """Lower-cased words without ASCII punctuation, joined by single spaces; words of punctuation alone vanish."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).split())


def cuts(line: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The line's bytes and its words' starts and ends."""
    data = np.frombuffer(line, dtype=np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], gaps + 1]) if len(data) else np.zeros(0, np.int64)
    ends = np.concatenate([gaps, [len(data)]]) if len(data) else np.zeros(0, np.int64)
    return data, starts.astype(np.int64), ends.astype(np.int64)


def shingle_hashes(line: bytes, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, starts and ends of the line's shingles, a stretch at a time."""
    data, starts, ends = cuts(line)
    n = len(starts) - width + 1
    for at in range(0, max(0, n), STEP):
        s, e = starts[at : min(at + STEP, n)], ends[at + width - 1 : min(at + STEP, n) + width - 1]
        part = Sums(BYTE_VALUES[data[s[0] : e[-1]]])
        yield part.hashes(s - s[0], e - s[0]), s, e


def size_class(n: int) -> int:
    """1 for one shingle, 2 for two or three, 3 for four to seven, and so on."""
    return n.bit_length()


def needed(n: int, threshold: float) -> int:
    """How many of n shingles a document must hold."""
    return max(1, math.ceil(threshold * n - 1e-9))


def item_shingles(line: bytes, width: int) -> tuple[int, dict[bytes, int]]:
    """Words of a shingle (fewer in a short item) and the hash of each distinct shingle of a normalized item."""
    own = min(width, line.count(b" ") + 1)
    return own, {line[a:b]: int(h) for hs, ss, es in shingle_hashes(line, own) for h, a, b in zip(hs, ss.tolist(), es.tolist())}


def signature_size(n: int, threshold: float) -> int:
    """So many of the hashes of an item of n shingles that every document that holds enough of it has one of them."""
    largest = (1 << size_class(n)) - 1
    return largest - needed(largest, threshold) + 1


def signature(hashes: list[int], threshold: float) -> list[int]:
    """The smallest hashes, one of which is in every document that holds enough of the item."""
    return sorted(hashes)[: signature_size(len(hashes), threshold)]


class Items:
    """Test items with their signatures, by shingle width (short items are one shingle of all their words) and size class."""

    def __init__(self, rows: list[tuple[int, str]], width: int, threshold: float):
        self.threshold = threshold
        self.shingles: list[tuple[int, frozenset[bytes]]] = []
        owners: dict[int, dict[int, dict[int, list[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        for item_id, text in rows:
            line = normal(text)
            if not line:
                continue
            own, found = item_shingles(line, width)
            for h in signature(list(found.values()), threshold):
                owners[own][size_class(len(found))][h].append(len(self.shingles))
            self.shingles.append((item_id, frozenset(found)))
        #: Of each width the classes from small to large: shingles that the smallest item of the class needs, its signature
        #: hashes in order and their items, and whether a hash with those first 20 bits is in this class or a smaller one.
        self.classes: dict[int, list[tuple[int, np.ndarray, list[list[int]], np.ndarray]]] = {}
        for w, by_class in owners.items():
            maybe, out = np.zeros(1 << 20, dtype=bool), []
            for c, items in sorted(by_class.items()):
                hashes = np.array(sorted(items), dtype=U)
                maybe = maybe.copy()
                maybe[(hashes >> U(44)).astype(np.int64)] = True
                out.append((needed(1 << (c - 1), threshold), hashes, [items[h] for h in sorted(items)], maybe))
            self.classes[w] = out

    def candidates(self, line: bytes, width: int) -> set[int]:
        """Items with a signature hash among those of the line's shingles."""
        n = line.count(b" ") + 2 - width
        held = [c for c in self.classes[width] if c[0] <= n]
        out: set[int] = set()
        for h, _, _ in shingle_hashes(line, width) if held else ():
            h = h[held[-1][3][(h >> U(44)).astype(np.int64)]]
            for _, hashes, owners, _ in held:
                at = np.searchsorted(hashes, h)
                at = at[(at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == h)]
                for k in np.unique(at).tolist():
                    out.update(owners[k])
        return out

    def found_in(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, shared shingles, the item's shingles) of every item that the text holds."""
        line, out = normal(text), []
        for width in self.classes:
            candidates = self.candidates(line, width)
            if candidates:
                own = shingles_of(line, width)
                for k in sorted(candidates):
                    item_id, shingles = self.shingles[k]
                    shared = len(shingles & own)
                    if shared >= needed(len(shingles), self.threshold):
                        out.append((item_id, shared, len(shingles)))
        return sorted(out, key=lambda x: (x[0] is None, x))


def shingles_of(line: bytes, width: int) -> set[bytes]:
    _, starts, ends = cuts(line)
    return {line[a:b] for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())}


def hash_rows(width: int, threshold: float):
    """item, width, need, size (of its signature), hash of all distinct shingles of each item (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                line = normal(text)
                if line:
                    own, found = item_shingles(line, width)
                    need, size = needed(len(found), threshold), signature_size(len(found), threshold)
                    rows += [(item, own, need, size, h) for h in found.values()]
            items, widths, needs, sizes, hashes = zip(*rows) if rows else ((), (), (), (), ())
            columns = [pa.array(items, pa.binary()), pa.array(widths, pa.int32()), pa.array(needs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(hashes, dtype=U).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "width", "need", "size", "hash"])

    return run


def rare_signatures(item_texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """item, width, need, hash: for each item (item, text) the hashes that the fewest items have, the smallest of equals.

    Any as many of an item's hashes would do. A phrase that very many items share is in hardly a signature, so that the
    documents that hold it meet few items by it.
    """
    every = stored(item_texts.mapInArrow(hash_rows(width, threshold), "item binary, width int, need long, size int, hash long"))
    shared = every.groupBy("width", "hash").agg(F.count("*").alias("items")).filter("items > 1")
    order = Window.partitionBy("item").orderBy(F.coalesce("items", F.lit(1)), "hash")
    ranked = every.join(shared, ["width", "hash"], "left").withColumn("rank", F.row_number().over(order))
    return ranked.filter("rank <= size").select("item", "width", "need", "hash")


def possible_hashes(widths: list[int], slots):
    """doc, width, n, hash of the shingles of texts (doc, text) whose slot is taken; n: how many shingles the text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = slots.value
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                line = normal(text.as_py())
                for width in widths:
                    n = line.count(b" ") + 2 - width if line else 0
                    parts = [h[taken[(h >> U(64 - SLOT_BITS)).astype(np.int64)]] for h, _, _ in shingle_hashes(line, width)]
                    hashes = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=U)
                    for column, value in zip(columns, (doc, width, n)):
                        column += [value] * len(hashes)
                    columns[3].append(hashes)
            hashes = np.concatenate([np.zeros(0, dtype=U), *columns[3]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(hashes)], ["doc", "width", "n", "hash"])

    return run


def contained(width: int, threshold: float):
    """doc, item, n_shared, n_item of rows (doc, text, items: of (item, text)) whose texts hold the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, items in zip(*(batch.column(c) for c in ("doc", "text", "items"))):
                line, own = normal(text.as_py()), {}
                for x in items.as_py():
                    w, found = item_shingles(normal(x["text"]), width)
                    own[w] = own[w] if w in own else shingles_of(line, w)
                    shared = len(found.keys() & own[w])
                    if shared >= needed(len(found), threshold):
                        rows.append((doc.as_py(), x["item"], shared, len(found)))
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc", "item", "n_shared", "n_item"])

    return run


def named(text: str = "text"):
    """128 bits that name a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def pairs_by_join(docs: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc, item, n_shared, n_item of all texts of docs and items (named by named()), of any number of both."""
    spark = docs.sparkSession
    item_texts = stored(items.select(named().alias("item"), "text").dropDuplicates(["item"]))
    signatures = stored(rare_signatures(item_texts, width, threshold))
    slot = F.shiftrightunsigned("hash", 64 - SLOT_BITS)
    # a row for each 64 slots, 2^18 at most whatever the number of items
    words = signatures.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - SLOT_BITS}) & 63 as int))")).alias("bits")).collect()
    bits = np.zeros(1 << (SLOT_BITS - 6), dtype=np.int64)
    for r in words:
        bits[r.word] = r.bits
    slots = spark.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool))
    widths = [r.width for r in signatures.select("width").distinct().collect()]  # width at most
    texts = docs.select(named().alias("doc"), "text")
    hashes = texts.mapInArrow(possible_hashes(widths, slots), "doc binary, width int, n long, hash long")
    candidates = stored(hashes.join(signatures, ["width", "hash"]).filter("need <= n").select("doc", "item").distinct())
    # a document's candidates are dealt to lists of some TOGETHER items
    many = candidates.groupBy("doc").agg(F.count("*").alias("n"))
    dealt = candidates.join(many, "doc").withColumn("part", F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / TOGETHER)))
    listed = dealt.join(item_texts, "item").groupBy("doc", "part").agg(F.collect_list(F.struct("item", "text")).alias("items"))
    once = texts.join(many.select("doc"), "doc", "left_semi").dropDuplicates(["doc"])
    return stored(once.join(listed, "doc").select("doc", "text", "items").mapInArrow(contained(width, threshold), "doc binary, item binary, n_shared long, n_item long"))


def bytes_of(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0


def with_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """docs with matches: array of (item_id, n_shared, n_item) of the test items that the text contains, by id (null last).

    Containment is the share of an item's distinct shingles of width words that occur in the document. Items of fewer
    words are one shingle of all their words; items without words match nothing; null texts are empty, texts of any length are
    searched whole; repeated items
    are reported each, and so are repeated rows of docs. A column of docs named matches is replaced; others stay.
    """
    python_ready(docs.sparkSession)
    docs = docs.drop("matches")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = packed(docs, "text")
    if bytes_of(items) <= SENT_BYTES:
        sent = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in items.collect()], width, threshold))
        found = F.pandas_udf(lambda texts: pd.Series([sent.value.found_in(t) for t in texts]), HITS)
        out = rows.withColumn("matches", found("text"))
    else:
        pairs = pairs_by_join(docs, items, width, threshold).join(items.select(named().alias("item"), "item_id"), "item")
        hit = F.struct(F.col("item_id").isNull().alias("last"), "item_id", "n_shared", "n_item")
        listed = pairs.groupBy("doc").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
        joined = rows.withColumn("doc", named()).join(listed, "doc", "left")
        matches = F.transform("hits", lambda x: F.struct(x["item_id"].alias("item_id"), x["n_shared"].alias("n_shared"), x["n_item"].alias("n_item")))
        out = joined.withColumn("matches", F.coalesce(matches, F.array().cast(HITS)))
    return unpacked(out, docs, "text", more=("matches",))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs, with all their columns, without the documents that contain a test item."""
    kept = with_matches(packed(docs, "text"), benchmark, **how).filter(F.size("matches") == 0)
    return unpacked(kept, docs, "text")


def decontam_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: a row for each document and test item in it."""
    hits = with_matches(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("matches").alias("m"))
    return hits.select("doc_id", "m.item_id", "m.n_shared", "m.n_item", (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))


ORACLE = r"""
with d as (select doc_id as id, 'd' as side, coalesce(text, '') as text from documents
  union all select item_id, 'i', coalesce(text, '') from benchmark),
w as (select side, id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
k as (select distinct least(5, len(w)) as k from w where side = 'i' and len(w) > 0),
g as (select distinct side, id, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select side, id, w, k.k, unnest(range(1, len(w) - k.k + 2)) as i from w, k where len(w) >= k.k and (side = 'd' or k.k = least(5, len(w))))),
n as (select id, count(*) as n from g where side = 'i' group by id)
select d.id as doc_id, i.id as item_id, count(*) as n_shared, any_value(n.n) as n_item, count(*) / any_value(n.n) as containment
from g d join g i on d.side = 'd' and i.side = 'i' and d.k = i.k and d.g = i.g join n on n.id = i.id
group by d.id, i.id having count(*) >= 0.8 * any_value(n.n)
"""

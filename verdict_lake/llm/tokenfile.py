"""Token-id output in shards that are compressed by Re-Pair grammars.

The documents are dealt by ranges of doc_id, so that shards follow each other in its order, and encoded. In a shard,
frequent pairs of ids are replaced by new symbols, round by round; its row of the output (a Parquet file a task) holds
the rules, each symbol's expansion length and the remaining symbols. Pairs never reach across the end of a document, so
a document is a run of symbols, and the expansion lengths give its place without decoding what stands before it.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .store import python_ready, small_or_not, stored

END_ID = 2
#: Characters in a shard, at which it is closed after the document at hand.
SHARD_CHARS = 4_000_000
#: Rounds of replacement, pairs replaced in one, and how often a pair must occur in its shard.
ROUNDS, PAIRS, LEAST = 6, 4096, 16
#: Words whose ids a Python worker remembers from one task to the next, and the longest of them in code points.
REMEMBERED, LONGEST = 300_000, 64
#: The parts of a tokenizer under which the words between white space have ids of their own.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Marks after a Latin letter or digit that end a word are pieces of their own; none begins a special token.
MARKS = r"([a-z0-9\x{DF}-\x{F6}\x{F8}-\x{FF}])([.,;:!?#*$%&]+)([ \t\n\x0b\x0c\r]|$)"
#: Words that are one piece each.
LETTERS = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff\u0410-\u044f]+")
#: One-piece words that are encoded as one text.
TOGETHER = 512
SLOTS = 1 << 20
SHARD = "part int, seq int, n_docs long, n_ids long, first_symbol long, doc_ids binary, id_counts binary, symbol_counts binary, rules binary, lengths binary, symbols binary"


def by_words(tokenizer: Tokenizer) -> bool:
    """Whether a text's ids are those of its words, one after another: normalizing, splitting and merging never look
    across white space, and the last id of each piece bears the mark of an end."""
    spec = json.loads(tokenizer.to_str())
    normalizers = (spec["normalizer"] or {}).get("normalizers", [])
    splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    spaces = [n for n in normalizers if n["type"] == "Replace"]
    return (
        tuple(n["type"] for n in normalizers) == NORMALIZERS
        and all(n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in spaces)
        and [p.get("type") for p in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": PIECES}
        and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
        and (splits[1]["add_prefix_space"], splits[1]["use_regex"]) == (False, False)
        and (spec["model"]["type"], spec["model"]["end_of_word_suffix"], spec["model"]["dropout"]) == ("BPE", WORD_END, None)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )


class Encoder:
    """Encodes texts with a tokenizer. Where words have ids of their own (see by_words), a shard's texts are split by
    Arrow and each distinct word is looked up or encoded once; texts in Latin-1, where lower-casing commutes with
    normalizing, are split without case and without the marks at the words' ends. Under any other tokenizer the library
    encodes whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_words = by_words(self.tokenizer)
        self.closes = np.zeros(self.vocabulary, dtype=bool)
        self.closes[[k for w, k in self.tokenizer.get_vocab().items() if w.endswith(WORD_END)]] = True

    def coded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_new(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words. Those of letters alone go in groups, cut where pieces end."""
        out: dict[str, bytes] = {}
        single = [w for w in words if LETTERS.fullmatch(w)]
        groups = [single[k : k + TOGETHER] for k in range(0, len(single), TOGETHER)]
        for group, ids in zip(groups, self.coded([" ".join(g) for g in groups])):
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) == len(group):
                data = ids.tobytes()
                out.update(zip(group, map(data.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, (ids.tobytes() for ids in self.coded(rest))))
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        known = self.known
        fresh = self.of_new([w for w in words if w not in known])
        out = [fresh[w] if w in fresh else known[w] for w in words]
        if len(known) + len(fresh) > REMEMBERED:
            self.known = {w: x for w, x in zip(words, out) if len(w) <= LONGEST}
        else:
            known.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST)
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one after another, and how many each has."""
        if not self.by_words:
            coded = [np.append(ids, np.uint32(end_id)) for ids in self.coded(texts.to_pylist())]
            return np.concatenate(coded).astype("<u4"), np.array([len(c) for c in coded], dtype="<i8")
        as_is = pc.or_(pc.match_substring_regex(texts, r"[^\x00-\x{FF}]"), pc.match_substring(texts, "<|"))
        cut = pc.replace_substring_regex(pc.utf8_lower(texts), MARKS, r"\1 \2\3")
        split = pc.ascii_split_whitespace(pc.if_else(as_is, texts, cut))
        words = split.flatten().dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), " ")
        pieces = [*self.of_words(distinct[0].as_py().split(" ") if len(words.dictionary) else []), np.array([end_id], dtype="<u4").tobytes()]
        # the end id is a word more at the end of each text
        n_words = np.asarray(split.value_lengths(), dtype=np.int64)
        which = np.insert(np.asarray(words.indices), np.cumsum(n_words), len(pieces) - 1)
        sizes = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces)) // 4
        n, place = sizes[which], (np.cumsum(sizes, dtype=np.int32) - sizes)[which]
        upto = np.cumsum(n)
        ids = np.frombuffer(b"".join(pieces), dtype="<u4")[np.repeat(place - (upto - n).astype(np.int32), n) + np.arange(upto[-1], dtype=np.int32)]
        return ids, np.diff(upto[np.cumsum(n_words + 1) - 1], prepend=0).astype("<i8")


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a Python worker, so that later tasks find the words of earlier ones."""
    return Encoder(path)


def repair(ids: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Symbols, whether each ends a document, and the rules (pairs of symbols) of each round, numbered from first on.

    A round counts all pairs within documents, takes the most frequent ones (PAIRS at most, each LEAST times or more)
    and replaces them from left to right; where two chosen pairs overlap, the left one goes. Counts are kept in hashed
    slots; of pairs that share a slot only the first is a candidate in that round.
    """
    rules: list[np.ndarray] = []
    symbols, ends = ids.astype(np.uint32), ends.copy()
    for _ in range(ROUNDS):
        if len(symbols) < 2:
            break
        left, right = symbols[:-1], symbols[1:]
        slot = ((left * np.uint32(0x9E3779B1) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(12)).astype(np.int64)
        slot[ends[:-1]] = SLOTS
        often = np.bincount(slot, minlength=SLOTS + 1) >= LEAST
        often[SLOTS] = False
        at = np.flatnonzero(often[slot])
        slot = slot[at]
        first_at = np.zeros(SLOTS, dtype=np.int64)
        first_at[slot[::-1]] = at[::-1]
        same = first_at[slot]
        same = (left[same] == left[at]) & (right[same] == right[at])
        at, slot = at[same], slot[same]
        counts = np.bincount(slot, minlength=SLOTS)
        chosen = np.flatnonzero(counts >= LEAST)
        if not len(chosen):
            break
        chosen = np.sort(chosen[np.argsort(-counts[chosen], kind="stable")[:PAIRS]])
        number = np.full(SLOTS, -1, dtype=np.int64)
        number[chosen] = np.arange(len(chosen))
        which = number[slot]
        at, which = at[which >= 0], which[which >= 0]
        # in a run of overlapping pairs every second one goes
        fresh = np.concatenate([[True], np.diff(at) != 1])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        taken = (np.arange(len(at)) - begin) % 2 == 0
        at, which = at[taken], which[taken]
        table = np.stack([left[first_at[chosen]], right[first_at[chosen]]], axis=1).astype("<u4")
        symbols[at] = (first + which).astype(np.uint32)
        ends[at] = ends[at + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols, ends = symbols[keep], ends[keep]
        rules.append(table)
        first += len(chosen)
        if len(at) < len(symbols) // 100:
            break
    return symbols.astype("<u4"), ends, rules


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule's symbol stands for."""
    out = np.ones(len(rules), dtype=np.int64)
    done = 0
    while done < len(rules):
        # rules of a round only use symbols of earlier rounds
        upto = done + int(np.argmax(np.append((rules[done:] >= first + done).any(axis=1), True)))
        for_side = [np.where(rules[done:upto, k] >= first, out[np.maximum(rules[done:upto, k].astype(np.int64) - first, 0)], 1) for k in (0, 1)]
        out[done:upto] = for_side[0] + for_side[1]
        done = upto
    return out


def expanded(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for: all symbols that are rules are replaced at once until none is left."""
    symbols = symbols.astype(np.int64)
    while len(at := np.flatnonzero(symbols >= first)):
        left, right = rules[symbols[at] - first].T
        symbols[at] = left
        symbols = np.insert(symbols, at + 1, right)
    return symbols.astype("<u4")


def packed(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array).tobytes(), 1)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=kind)


def shard_row(part: int, seq: int, doc_ids: list, all_ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> dict:
    ends = np.zeros(len(all_ids), dtype=bool)
    ends[np.cumsum(counts) - 1] = True
    symbols, last, rules = repair(all_ids, ends, vocabulary)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), dtype="<u4")
    present = np.array([x is not None for x in doc_ids])
    ids = np.array([0 if x is None else x for x in doc_ids], dtype="<i8")
    return {
        "part": part,
        "seq": seq,
        "n_docs": len(doc_ids),
        "n_ids": int(counts.sum()),
        "first_symbol": vocabulary,
        "doc_ids": packed(np.concatenate([ids, present.astype("<i8")])),
        "id_counts": packed(counts),
        "symbol_counts": packed(np.diff(np.concatenate([[0], np.flatnonzero(last) + 1])).astype("<i8")),
        "rules": packed(table),
        "lengths": packed(expansion_lengths(table.astype(np.int64), vocabulary).astype("<i8")),
        "symbols": symbols.tobytes(),
    }


def encoded_shards(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        chars = 0

        def shard() -> pa.RecordBatch:
            ids, texts = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text"))
            row = shard_row(part, seq, ids.to_pylist(), *coder.encode(texts, end_id), coder.vocabulary)
            types = {"part": pa.int32(), "seq": pa.int32()} | {k: pa.int64() for k in ("n_docs", "n_ids", "first_symbol")}
            return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.binary())) for k, v in row.items()], list(row))

        for batch in batches:
            upto = np.cumsum(np.asarray(pc.utf8_length(batch.column("text")), dtype=np.int64))
            begin = done = 0
            while chars + (int(upto[-1]) if len(upto) else 0) - done >= SHARD_CHARS:
                end = int(np.searchsorted(upto, done + SHARD_CHARS - chars)) + 1
                held.append(batch.slice(begin, end - begin))
                yield shard()
                held, seq, chars = [], seq + 1, 0
                begin, done = end, int(upto[end - 1])
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
                chars += int(upto[-1]) - done
        if held:
            yield shard()
        pa.default_memory_pool().release_unused()

    return run


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """The written shards of docs in ascending doc_id (null first), a row each, read again from their files.

    tokenizer: path of a tokenizers file, the same on every executor. A null text is empty; every document gets the end
    id; repeated rows are documents of their own; an empty table gives no shard.
    """
    python_ready(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tasks = max(slim.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # many texts under one id, or under none, are dealt by their hashes
    order = ("doc_id", "spread")
    dealt = slim.withColumn("spread", F.xxhash64("text")).repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("spread")
    return stored(dealt.mapInArrow(encoded_shards(tokenizer, end_id), SHARD))


def rules_of(row: dict) -> np.ndarray:
    return unpacked(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)


def documents_of(row: dict) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and symbols' ids of each document of a shard."""
    ids, present = unpacked(row["doc_ids"], "<i8").reshape(2, -1)
    all_ids = expanded(np.frombuffer(row["symbols"], dtype="<u4"), rules_of(row), row["first_symbol"])
    upto = np.cumsum(unpacked(row["id_counts"], "<i8"))
    for k, there, a, b in zip(ids.tolist(), present.tolist(), [0, *upto[:-1].tolist()], upto.tolist()):
        yield (k if there else None), all_ids[a:b]


def document_at(row: dict, k: int) -> np.ndarray:
    """Random access: the ids of the k-th document of a shard, expanding its own symbols alone."""
    upto = np.cumsum(unpacked(row["symbol_counts"], "<i8"))
    symbols = np.frombuffer(row["symbols"], dtype="<u4")
    return expanded(symbols[(upto[k - 1] if k else 0) : upto[k]], rules_of(row), row["first_symbol"])


def id_at(row: dict, position: int) -> int:
    """Random access: the id at a position of a shard, found by expansion lengths and one way down the rules."""
    rules = rules_of(row)
    lengths, first = unpacked(row["lengths"], "<i8"), row["first_symbol"]
    symbols = np.frombuffer(row["symbols"], dtype="<u4").astype(np.int64)
    size = np.where(symbols >= first, lengths[np.maximum(symbols - first, 0)] if len(lengths) else 1, 1)
    upto = np.cumsum(size)
    k = int(np.searchsorted(upto, position, side="right"))
    symbol, position = int(symbols[k]), position - int(upto[k] - size[k])
    while symbol >= first:
        left, right = rules[symbol - first].tolist()
        of_left = int(lengths[left - first]) if left >= first else 1
        symbol, position = (left, position) if position < of_left else (right, position - of_left)
    return symbol


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            rows = [(i, len(x), zlib.crc32(x)) for i, x in documents_of(row)]
            n = np.array([r[1] for r in rows], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array(row["shard_start"] + np.cumsum(n) - n, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def token_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written files."""
    shards = write_shards(docs, tokenizer)
    # the sums of the parts, a row a task, are summed up in one task; the shards of a part among themselves
    parts = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counts = shards.select("part", "seq", "n_ids")
    totals = counts.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    totals = totals.select("part", F.coalesce(F.sum("n_ids").over(parts), F.lit(0)).alias("part_start"))
    start = F.col("part_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    starts = stored(counts.join(totals, "part").select("part", "seq", start.alias("shard_start")))
    placed = shards.join(small_or_not(starts), ["part", "seq"])
    return placed.mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")

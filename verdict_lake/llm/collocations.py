"""Phrase collocation mining by best-first branch-and-bound growth.

Phrases grow by a word a level, and only from prefixes that are frequent enough. A phrase's score is the least over its cuts of
a * a / (l * r). Of a prefix (w1, w2) found f times, any longer phrase is found f times at most and its rest at least as
often as itself, so its score is at most f / f(w1): the prefix's bound, which is never below the prefix's own score. Prefixes
are expanded from the highest bound down to a threshold of their language; what scores at least that is then known in full,
and once as many phrases survive there as are asked for, the language is settled, ties included. Others go on with a
lower threshold.

A level is counted in tasks, over runs of texts, by numpy; Spark adds up the counts. Which prefixes are expanded reaches the
tasks as a bitmap of fixed size: a prefix that shares a bit with another is counted too, in full, and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rolling import BASE, U, scattered
from .store import python_ready, stored

LEAST, TOP, SCALE = 10, 2000, 1_000_000
#: A phrase goes if one that holds it has this share of its occurrences, in hundredths.
ABSORBED = 50
#: ASCII letters to lower case; what ends a piece to a full stop, which no word holds; tabs to spaces.
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLDED = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + b"." * len(ENDS) + b" ")
#: Words that a task counts together, and rows that it returns at once.
RUN, ROWS = 2_000_000, 100_000
#: Bits of a bitmap, as a power of two.
BITS = 23
#: A language's first threshold leaves this many times the asked phrases above it, the next ones GROWTH times as many.
AHEAD, GROWTH = 3, 4
#: Languages whose thresholds may be broadcast.
SENT_LANGS = 100_000


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return scattered(first * U(BASE) + second)


def bits_of(phrase_words: int):
    """place, bits: the bitmap's word of each phrase (lang, phrase) of one or two words, and its bit there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
            hashes = np.array([[word_hash(lang, w) for w in phrase.encode().split(b" ")] for lang, phrase in rows], dtype=U).reshape(-1, phrase_words)
            at = (hashes[:, 0] if phrase_words == 1 else pair_hash(hashes[:, 0], hashes[:, 1])) >> U(64 - BITS)
            yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).view(np.int64)), pa.array((U(1) << (at & U(63))).view(np.int64))], ["place", "bits"])

    return run


def bitmap(phrases: DataFrame, phrase_words: int) -> np.ndarray:
    """2^BITS bits as 64-bit words, whatever the number of phrases."""
    found = phrases.select("lang", "phrase").mapInArrow(bits_of(phrase_words), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=U)
    out[found["place"].to_numpy()] = found["bits"].to_numpy().view(U)
    return out


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> U(64 - (64 * len(bits)).bit_length() + 1)
    return (bits[at >> U(6)] >> (at & U(63))) & U(1) == 1


class Run:
    """Texts as numbers of their words; 0 ends a piece. Words of two languages have different numbers."""

    def __init__(self):
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.words: list[bytes] = [b"."]
        self.langs: list[str] = [""]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        found = text.encode("utf-8", "surrogatepass").translate(FOLDED).replace(b".", b" . ").split()
        known = self.numbers.setdefault(lang, {b".": 0})
        for w in found:
            if w not in known:
                known[w] = len(self.words)
                self.words.append(w)
                self.langs.append(lang)
        self.parts.append(np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found)))
        self.parts.append(np.zeros(1, dtype=np.int64))
        self.size += len(found) + 1

    def hashes(self) -> np.ndarray:
        return np.array([word_hash(lang, w) for lang, w in zip(self.langs, self.words)], dtype=U)

    def counts(self, level: int, frequent, new, old) -> tuple[np.ndarray, np.ndarray]:
        """Distinct phrases of level words as rows of numbers, and how often each is there."""
        ids = np.concatenate(self.parts)
        if level == 1:
            n = np.bincount(ids, minlength=len(self.words))
            n[0] = 0
            return np.flatnonzero(n)[:, None], n[n > 0]
        hashes = self.hashes()
        good = holds(frequent, hashes)
        good[0] = False
        fine = good[ids]
        both = fine[:-1] & fine[1:]
        if level == 2:
            at = np.flatnonzero(both)
            codes, n = np.unique(ids[at] * len(self.words) + ids[at + 1], return_counts=True)
            return np.stack(np.divmod(codes, len(self.words)), axis=1), n
        pairs = np.flatnonzero(both)
        hashed = pair_hash(hashes[ids[pairs]], hashes[ids[pairs + 1]])
        wanted = np.zeros(len(ids), dtype=bool)
        for way, (grown, tested) in ((True, new), (False, old)):
            if grown is None:
                continue
            prefix, suffix = (np.zeros(len(ids) + 1, dtype=bool) for _ in range(2))
            prefix[pairs] = holds(grown, hashed)
            suffix[pairs] = holds(tested, hashed)
            hit = prefix[:-1] | suffix[1:]
            wanted = hit if way else wanted & ~hit
        at = np.flatnonzero(wanted[:-2] & both[:-1] & both[1:])
        firsts, which = np.unique(ids[at] * len(self.words) + ids[at + 1], return_inverse=True)
        codes, n = np.unique(which * len(self.words) + ids[at + 2], return_counts=True)
        pair, last = np.divmod(codes, len(self.words))
        return np.stack([*np.divmod(firsts[pair], len(self.words)), last], axis=1), n


def counted_in_runs(level: int, sent):
    """lang, phrase, n of the phrases of level words in a task; at level 1 also each language's words under an empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value if sent is not None else (None, (None, None), (None, None))
        held = Run()

        def rows() -> Iterator[pa.RecordBatch]:
            numbers, n = held.counts(level, *filters)
            if level == 1:
                langs = np.array(held.langs, dtype=object)[numbers[:, 0]] if len(n) else np.zeros(0, object)
                names, which = np.unique(langs.astype(str), return_inverse=True)
                totals = np.bincount(which, weights=n, minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array([""] * len(names), pa.string()), pa.array(totals)], ["lang", "phrase", "n"])
            for at in range(0, len(n), ROWS):
                some = numbers[at : at + ROWS].tolist()
                phrases = [b" ".join([held.words[k] for k in row]).decode("utf-8", "surrogatepass") for row in some]
                yield pa.RecordBatch.from_arrays([pa.array([held.langs[row[0]] for row in some], pa.string()), pa.array(phrases, pa.string()), pa.array(n[at : at + ROWS])], ["lang", "phrase", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                held.add(lang.as_py(), text.as_py())
                if held.size >= RUN:
                    yield from rows()
                    held = Run()
        if held.size:
            yield from rows()

    return run


def counted(texts: DataFrame, level: int, sent=None) -> DataFrame:
    found = texts.mapInArrow(counted_in_runs(level, sent), "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def score(a: str, l: str, r: str):  # noqa: E741
    """floor(SCALE * a * a / (l * r)) by decimals of 38 digits."""
    big = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"cast(cast(cast({SCALE} as decimal(38,0)) * {big(a)} * {big(a)} as decimal(38,0)) div cast({big(l)} * {big(r)} as decimal(38,0)) as bigint)")


def scored_pairs(pairs: DataFrame, single: DataFrame) -> DataFrame:
    """Two-word candidates with l, r, score and bound, the most that a phrase with this prefix can score."""
    words = F.split("phrase", " ")
    cut = pairs.select("lang", "phrase", "a", words[0].alias("first"), words[1].alias("second"))
    f = lambda word, n: single.select("lang", F.col("phrase").alias(word), F.col("a").alias(n))
    full = cut.join(f("first", "l"), ["lang", "first"]).join(f("second", "r"), ["lang", "second"])
    return full.select("lang", "phrase", "a", "l", "r", score("a", "l", "r").alias("score"), F.expr(f"a * {SCALE} div l").alias("bound"))


def scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Three-word candidates (lang, phrase, a) with l, r and score of their lowest cut, the first of equals."""
    words = F.split("phrase", " ")
    cut = triples.select("lang", "phrase", "a", F.concat_ws(" ", words[0], words[1]).alias("head"), F.concat_ws(" ", words[1], words[2]).alias("tail"))
    head = pairs.select("lang", F.col("phrase").alias("head"), F.col("l").alias("l1"), F.col("a").alias("l2"))
    tail = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    full = cut.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).withColumns({"s1": score("a", "l1", "r1"), "s2": score("a", "l2", "r2")})
    of = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    return full.select("lang", "phrase", "a", of("l1", "l2").alias("l"), of("r1", "r2").alias("r"), F.least("s1", "s2").alias("score"))


def thresholds(pairs: DataFrame, ahead: int) -> DataFrame:
    """lang, least: a score that about ahead pairs of the language reach, 0 where it has fewer.

    Scores are counted in some two hundred classes of their logarithms.
    """
    step = F.floor(8 * F.log2(F.col("score") + 1))
    classes = pairs.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    above = Window.partitionBy("lang").orderBy(F.desc("step"))
    reached = classes.withColumn("above", F.sum("n").over(above)).filter(F.col("above") >= ahead).groupBy("lang").agg(F.max("least").alias("least"))
    return pairs.select("lang").distinct().join(reached, "lang", "left").select("lang", F.coalesce("least", F.lit(0)).alias("least"))


def sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= SENT_LANGS else small


def survivors(pairs: DataFrame, triples: DataFrame, least: DataFrame) -> DataFrame:
    """Candidates that score at least their language's threshold and are in no longer one with ABSORBED hundredths of their count."""
    words = F.split("phrase", " ")
    parts = F.array(F.concat_ws(" ", words[0], words[1]), F.concat_ws(" ", words[1], words[2]))
    holder = triples.select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    names = ["lang", "phrase", "a", "l", "r", "score"]
    high = lambda df: df.join(least, "lang").filter(F.col("score") >= F.col("least")).select(*names)
    kept = high(pairs).join(holder, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < ABSORBED * F.col("a")))
    return kept.select(*names).unionByName(high(triples))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first top phrases of two or three words, found at least least times.

    docs: lang, text; other columns are not read. A null lang is "und", a null text is empty; whole texts count; repeated rows
    count each. A language without candidates, and an empty table, give no rows. Ties go to the larger a, then to the smaller
    phrase by its bytes.
    """
    spark = docs.sparkSession
    python_ready(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    send = spark.sparkContext.broadcast
    single = stored(counted(texts, 1).filter((F.col("a") >= least) | (F.col("phrase") == "")))
    totals = single.filter("phrase = ''").select("lang", F.col("a").alias("n"))
    single = single.filter("phrase <> ''")
    frequent = bitmap(single, 1)
    none = (None, None)
    pairs = stored(scored_pairs(counted(texts, 2, send((frequent, none, none))).filter(F.col("a") >= least), single))
    open_pairs, triples, old, ahead, found = pairs, None, none, AHEAD * top, None
    while not open_pairs.isEmpty():
        limits = sent(stored(thresholds(open_pairs, ahead)))
        grown = open_pairs.join(limits, "lang").filter(F.col("bound") >= F.col("least"))
        new = (bitmap(grown, 2), bitmap(grown.filter(F.col("score") >= F.col("least")), 2))
        more = stored(scored_triples(counted(texts, 3, send((frequent, new, old))).filter(F.col("a") >= least), pairs))
        triples = more if triples is None else triples.unionByName(more)
        kept = stored(survivors(open_pairs, triples, limits))
        enough = kept.groupBy("lang").agg(F.count("*").alias("kept"))
        settled = stored(limits.join(enough, "lang", "left").filter((F.coalesce("kept", F.lit(0)) >= top) | (F.col("least") == 0)).select("lang"))
        done = kept.join(sent(settled), "lang", "left_semi")
        found = done if found is None else found.unionByName(done)
        open_pairs = stored(open_pairs.join(sent(settled), "lang", "left_anti"))
        # what either bitmap of an earlier round let through is counted already
        old = new if old[0] is None else tuple(a | b for a, b in zip(old, new))
        ahead *= GROWTH
    if found is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(sent(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""with texts as (
  select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
  select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from texts
), numbered as (
  select lang, row_number() over () as piece_id, [w for w in regexp_split_to_array(piece, '[\\x20\\x09]+') if w <> ''] as w from pieces
), worded as (
  select lang, piece_id, unnest(w) as w1, unnest(range(len(w))) as place from numbered
), runs as (
  select lang, w1, lead(w1, 1) over follow as w2, lead(w1, 2) over follow as w3 from worded window follow as (partition by piece_id order by place)
), grams as (
  select lang, 1 as len, w1 as phrase, null as head, null as tail from runs
  union all select lang, 2, w1 || ' ' || w2, w1, w2 from runs where w2 is not null
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, w1 || ' ' || w2, w2 || ' ' || w3 from runs where w3 is not null
), f as (
  select lang, len, phrase, any_value(head) as head, any_value(tail) as tail, count(*) as a from grams group by lang, len, phrase
), totals as (
  select lang, cast(sum(a) as bigint) as n from f where len = 1 group by lang
), often as (
  select * from f where a >= {LEAST}
), halves as (
  select lang, phrase, len, a, 1 as k, split_part(phrase, ' ', 1) as left_part, tail as right_part from often where len > 1
  union all select lang, phrase, len, a, 2, head, split_part(phrase, ' ', 3) from often where len = 3
), cuts as (
  select c.*, l.a as l, r.a as r, cast({SCALE}::hugeint * c.a * c.a // (l.a::hugeint * r.a) as bigint) as score
  from halves c join often l on l.lang = c.lang and l.phrase = c.left_part join often r on r.lang = c.lang and r.phrase = c.right_part
), best as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), holders as (
  select lang, part, max(a) as longer from (
    select lang, a, head as part from often where len = 3 union all select lang, a, tail from often where len = 3
  ) group by lang, part
), kept as (
  select b.* from best b left join holders h on b.lang = h.lang and b.phrase = h.part and b.len = 2
  where h.longer is null or 100 * h.longer < {ABSORBED} * b.a
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= {TOP}"""

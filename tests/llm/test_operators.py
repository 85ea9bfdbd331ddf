"""The training-data operators against brute force on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdict_lake.llm import chat, decontam, graph, mixing, pii, quality_model, quality_rules, simhash, substring_dedup, suffix_dedup, tokenfile, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return WORD.findall(text or "")


def odd_texts(seed=3, n=60):
    """Texts of a small vocabulary with copies, shared passages, odd spaces, an empty one and a null."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)] + ["é", "Ünï", "日本", "a.b", "#", "The"]
    passage = " ".join(draw.choice(vocabulary) for _ in range(70))
    texts = [None, "", " \t\n", "one", "one two", passage, passage + "\x1cend"]
    for k in range(n):
        body = [draw.choice(vocabulary) for _ in range(draw.randint(1, 150))]
        if k % 4 == 0:
            body.insert(draw.randint(0, len(body)), passage)
        texts.append(draw.choice([" ", "  ", "\n", "\t "]).join(body))
    return texts + texts[7:12] + [texts[9] + " more"]


def table(frame, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return frame(DOCS, *((i, t, "en", f"s{k % 3}" if k % 7 else None, 0) for k, (i, t) in enumerate(zip(ids, texts))))


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(frame, texts):
    return table(frame, texts).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1


@pytest.mark.parametrize("sent", [1 << 30, -1])
def test_decontamination_equals_brute_force(frame, docs, texts, sent, monkeypatch):
    monkeypatch.setattr(decontam, "SENT_BYTES", sent)
    monkeypatch.setattr(decontam, "TOGETHER", 3)
    draw = random.Random(1)
    items = [None, "", "...", "one two", "w1 w2"] + [" ".join(w) for w in (words(t)[5 : 5 + draw.randint(5, 40)] for t in texts[7:30]) if w]
    items += [i.upper() + "!!" for i in items[6:9]] + [items[7]]
    benchmark = frame("item_id long, text string, extra int", *((k, t, 1) for k, t in enumerate(items)))
    expected = []
    for k, item in enumerate(items):
        iw = decontam.normal(item).split()
        if not iw:
            continue
        width = min(5, len(iw))
        own = {tuple(iw[j : j + width]) for j in range(len(iw) - width + 1)}
        for d, t in enumerate(texts):
            tw = decontam.normal(t).split()
            shared = len(own & {tuple(tw[j : j + width]) for j in range(len(tw) - width + 1)})
            if shared >= 0.8 * len(own):
                expected.append((d, k, shared, len(own)))
    got = decontam.decontam_report(docs, benchmark).select("doc_id", "item_id", "n_shared", "n_item")
    assert rows(got) == sorted(expected, key=str)
    assert len({e[0] for e in expected}) > 5
    kept = {r.doc_id for r in decontam.decontaminated(docs, benchmark).collect()}
    assert kept == set(range(len(texts))) - {e[0] for e in expected}
    named = docs.withColumnsRenamed({"lang": "rest", "source": "doc", "n_chars": "matches"})
    out = decontam.with_matches(named, benchmark)
    assert out.columns == ["doc_id", "text", "rest", "doc", "matches"]
    assert rows(out.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")) == sorted(expected, key=str)


def test_classes_that_need_more_than_a_document_has_are_skipped(monkeypatch):
    body = [f"t{k}" for k in range(200)]
    items = decontam.Items([(1, " ".join(body[:10])), (2, " ".join(body[:150]))], 5, 0.8)
    assert [c[0] for c in items.classes[5]] == [4, 103]
    looked = []
    monkeypatch.setattr(decontam.np, "searchsorted", lambda hashes, h, find=np.searchsorted: looked.append(len(hashes)) or find(hashes, h))
    assert items.found_in(" ".join(body[:60])) == [(1, 6, 6)]
    assert looked == [len(items.classes[5][0][1])]
    assert items.found_in(" ".join(body[:3])) == [] and len(looked) == 1
    assert [m[0] for m in items.found_in(" ".join(body))] == [1, 2]


def test_decontamination_by_join_and_without_rows(frame, docs, monkeypatch):
    benchmark = frame("item_id long, text string", *((k, f"w{k} w{k + 1}") for k in range(9)))
    whole = rows(decontam.decontam_report(docs, benchmark))
    monkeypatch.setattr(decontam, "SENT_BYTES", 60)
    assert rows(decontam.decontam_report(docs, benchmark)) == whole
    assert decontam.decontam_report(docs, benchmark.limit(0)).count() == 0
    assert decontam.decontam_report(docs.limit(0), benchmark).count() == 0


def test_a_phrase_of_all_items_and_documents_is_in_no_signature(frame, monkeypatch):
    draw = random.Random(6)
    phrase = "as an example of this"
    own = [" ".join(f"u{k}.{draw.randrange(10**6)}" for _ in range(20)) for k in range(30)]
    items = [(k, f"{phrase} {body}") for k, body in enumerate(own)]
    texts = [(k, f"{phrase} {draw.randrange(99)} " + (own[k] if k % 4 == 0 else f"other words {k} here")) for k in range(30)]
    item_texts = frame("item_id long, text string", *items).select(decontam.named().alias("item"), "text")
    found = decontam.rare_signatures(item_texts, 5, 0.8)
    most = found.groupBy("hash").count().agg(F.max("count")).first()[0]
    sizes = {r["count"] for r in found.groupBy("item").count().collect()}
    assert most == 1 and sizes == {decontam.signature_size(21, 0.8)}
    benchmark, df = frame("item_id long, text string", *items), frame("doc_id long, text string", *texts)
    want = rows(decontam.decontam_report(df, benchmark))
    monkeypatch.setattr(decontam, "SENT_BYTES", -1)
    assert rows(decontam.decontam_report(df, benchmark)) == want and len(want) == 8


def test_items_in_stretches(monkeypatch):
    monkeypatch.setattr(decontam, "STEP", 7)
    body = [f"t{k}" for k in range(100)]
    items = decontam.Items([(1, " ".join(body[20:60]))], 5, 0.8)
    assert items.found_in(" ".join(body)) == [(1, 36, 36)]
    assert items.found_in(" ".join(body[:50])) == []


# 2


def test_token_files_equal_the_library(frame, texts):
    extra = ["<|endoftext|>x<|startoftext|>", "H\u0331 T\u0308, I\u0307! ẖ, É.. It's!? it'S,. 12,5! x<|EndOfText|>. Σ, ΣΑΣ! İ,", "Ǻb\u00a0c\u2003d\x85e", "ΑΣ ΣΑΣ don't", "x" * 5000, "a\x1cb"]
    every = texts + extra
    got = tokenfile.token_report(table(frame, every).repartition(3), TOKENIZER).orderBy("doc_id").collect()
    library, start = Tokenizer.from_file(TOKENIZER), 0
    assert [r.doc_id for r in got] == list(range(len(every)))
    for r, text in zip(got, every):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, library = tokenfile.Encoder(path), Tokenizer.from_file(path)
    assert tokenfile.by_words(Tokenizer.from_file(TOKENIZER)) and not coder.by_words
    texts = ["One  two\n\nthree", "", "  x"]
    ids, counts = coder.encode(pa.array(texts), 9)
    assert ids.tolist() == [k for t in texts for k in (*library.encode(t, add_special_tokens=False).ids, 9)]
    assert counts.tolist() == [len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts]


def test_small_shards_and_forgotten_words(frame, monkeypatch):
    coder, texts = tokenfile.Encoder(TOKENIZER), ["a bc, d", "Bc d. " + "y" * 100, "", "zz a"]
    monkeypatch.setattr(tokenfile, "REMEMBERED", 3)
    first, again = coder.encode(pa.array(texts), 2), coder.encode(pa.array(texts), 2)
    assert [x.tolist() for x in first] == [x.tolist() for x in again]
    assert all(len(w) <= tokenfile.LONGEST for w in coder.known)
    monkeypatch.setattr(tokenfile, "SHARD_CHARS", 10)
    monkeypatch.setattr(tokenfile.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": ["abcdefghijkl", "", "x"]}), pa.RecordBatch.from_pydict({"doc_id": pa.array([4], pa.int64()), "text": ["y" * 25]}), pa.RecordBatch.from_pydict({"doc_id": pa.array([5], pa.int64()), "text": ["z"]})]
    shards = [b.to_pylist()[0] for b in tokenfile.encoded_shards(TOKENIZER, 2)(iter(batches))]
    assert [[k for k, _ in tokenfile.documents_of(s)] for s in shards] == [[1], [2, 3, 4], [5]]


def test_token_files_with_null_and_repeated_ids(frame):
    df = frame(DOCS, (None, "one two", "en", "s", 0), (5, None, "en", "s", 0), (5, "x", None, None, None), (5, "x", None, None, None))
    got = tokenfile.token_report(df, TOKENIZER).collect()
    assert sorted(r.start for r in got)[0] == 0
    assert sum(r.n_tokens for r in got) == 3 + 1 + 2 + 2
    assert tokenfile.token_report(df.limit(0), TOKENIZER).count() == 0


def test_repair_is_lossless_and_random_access():
    draw = np.random.default_rng(4)
    coded = [np.concatenate([draw.choice(30, draw.integers(0, 400)), np.tile([3, 4, 5, 6], 40), [2]]).astype("<u4").tobytes() for _ in range(60)]
    ids = np.frombuffer(b"".join(coded), dtype="<u4")
    row = tokenfile.shard_row(0, 0, [*range(59), None], ids, np.array([len(c) // 4 for c in coded], dtype="<i8"), 100)
    assert len(row["symbols"]) < ids.nbytes / 2
    back = list(tokenfile.documents_of(row))
    assert [k for k, _ in back] == [*range(59), None]
    assert [x.tobytes() for _, x in back] == coded
    assert tokenfile.document_at(row, 17).tobytes() == coded[17]
    assert tokenfile.document_at(row, 0).tobytes() == coded[0]
    for position in (0, 1, 777, len(ids) - 1):
        assert tokenfile.id_at(row, position) == ids[position]


def test_repair_of_runs_and_nothing():
    ids = np.full(1000, 7, dtype="<u4")
    symbols, _, rules = tokenfile.repair(ids, np.zeros(1000, dtype=bool), 100)
    table = np.concatenate(rules)
    assert tokenfile.expanded(symbols, table.astype(np.int64), 100).tobytes() == ids.tobytes()
    assert len(symbols) < 100
    assert len(tokenfile.repair(ids[:1], np.zeros(1, dtype=bool), 100)[0]) == 1


# 3 and 4


def brute_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for d, b in enumerate(data):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length, group", [(40, 256), (40, 1), (13, 256), (400, 256)])
def test_suffix_dedup_equals_brute_force(frame, docs, texts, length, group, monkeypatch):
    monkeypatch.setattr(windows, "GROUP", group)
    got = suffix_dedup.without_repeats(docs, length).drop("kept")
    assert rows(got) == sorted(brute_bytes(texts, length), key=str)


def test_suffix_dedup_within_a_document_and_repeated_rows(frame):
    draw = random.Random(2)
    body = "".join(draw.choice("abcdef ") for _ in range(500))
    every = [body + "|" + body, body[:450] + "é" * 300, None, "a" * 1000, ""]
    assert rows(suffix_dedup.suffix_report(table(frame, every))) == sorted(brute_bytes(every, 400), key=str)
    twice = frame(DOCS, (None, body, "", "", 0), (None, body, "", "", 0), (4, "short", "", "", 0))
    got = rows(suffix_dedup.suffix_report(twice))
    assert [r[:4] for r in got if r[0] is None] == [(None, 500, 500, 1)] * 2


def brute_words(texts, ids, length):
    first = {}
    for i, t in zip(ids, texts):
        w = words(t)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in zip(ids, texts):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("length, group", [(50, 256), (50, 1), (9, 256), (3, 2)])
def test_substring_dedup_equals_brute_force(frame, texts, length, group, monkeypatch):
    monkeypatch.setattr(windows, "GROUP", group)
    ids = [k // 2 for k in range(len(texts))]
    random.Random(9).shuffle(ids)
    got = substring_dedup.without_passages(table(frame, texts, ids).repartition(3), length).drop("kept")
    assert rows(got) == sorted(brute_words(texts, ids, length), key=str)


def test_windows_in_stretches(frame, docs, texts, monkeypatch):
    monkeypatch.setattr(windows, "STRETCH", 64)
    found = [x for x in windows.anchors(suffix_dedup.byte_units(b"abcdefghij" * 60), 40, 5)]
    starts = sorted(s for f in found for lo, hi in zip(f[1].tolist(), f[2].tolist()) for s in range(lo, hi + 1))
    assert starts == list(range(600 - 39))


def test_deduplicators_take_empty_tables(docs):
    assert suffix_dedup.suffix_report(docs.limit(0)).count() == 0
    assert substring_dedup.substring_report(docs.limit(0)).count() == 0


# 5

PERSONAL = 'Mr. John Smith wrote to anna.b@mail7.example.com, JOHN; call +1 (017) 555-7713 or +1-017-555-7713, 97.51.17.173 4785380592391139. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" password=hunter22 г-н Иван Петров, Mrs Maria Smith'


def test_surrogates_keep_types_formats_and_coreference(frame):
    df = frame("doc_id long, text string, n_entities int", (1, PERSONAL, 0), (2, "Anna.B@mail7.example.com and Frau Smith", 0), (3, None, 0), (4, "nothing here 12", 0), (1, PERSONAL, 0))
    out = {r.doc_id: r for r in pii.with_surrogates(df).collect()}
    new = out[1].text
    for value in ("Smith", "anna.b@", "555-7713", "97.51.17.173", "4785380592391139", "04dbebab", "hunter22", "Петров", "Иван"):
        assert value not in new
    found = {k: c for _, _, k, c in pii.entities(new)}
    assert pii.luhn(found["card"]) == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} or \+1-\d{3}-\d{3}-\d{4}", new)
    assert re.sub(r"\D", "", re.search(r"\+1 \(.{13}", new).group()) == re.sub(r"\D", "", re.search(r"\+1-.{12}", new).group())
    mail = re.search(r"[\w.]+@[\w.]+", new).group()
    assert re.search(r"[\w.]+@[\w.]+", out[2].text).group() == mail.lower()
    assert re.search(r"Frau (\w+)", out[2].text).group(1) == re.search(r"Mrs \w+ (\w+)", new).group(1) == re.search(r"Mr\. \w+ (\w+)", new).group(1)
    assert re.search(r"Mr\. (\w+)", new).group(1) in pii.GIVEN[("latin", "m")] and re.search(r"Mrs (\w+)", new).group(1) in pii.GIVEN[("latin", "f")]
    assert re.search(r"г-н (\w+) [А-Я]", new)
    assert (out[3].text, out[3].n_entities) == (None, 0) and (out[4].text, out[4].n_entities) == ("nothing here 12", 0)


def test_surrogates_are_distinct_after_collisions(frame, monkeypatch):
    names = [g for (s, g_), pool in pii.GIVEN.items() if s == "latin" and g_ == "f" for g in pool]
    found = frame("kind string, canon string", *(("given:f:latin", n.casefold()) for n in names), *(("ip", f"10.0.0.{k}") for k in range(50)))
    attempts = pii.attempts_needed(found).collect()
    new = [(r.kind.split(":")[0], pii.surrogate(r.kind, r.canon, r.attempt)) for r in attempts]
    assert len(attempts) == len(names) + 50 == len(set(new))
    assert not {n for _, n in new} & {r.canon for r in attempts}
    df = frame("doc_id long, text string", *((k, f"Mrs {n} Baker") for k, n in enumerate(names)))
    sent = rows(pii.with_surrogates(df))
    monkeypatch.setattr(pii, "SENT_ROWS", -1)
    assert rows(pii.with_surrogates(df)) == sent
    assert len({r[1] for r in sent}) == len(names)


def test_surrogates_of_empty_table(docs):
    assert pii.pii_report(docs.limit(0)).count() == 0


# 6


def test_quality_model_learns_without_held_out_rows(spark, frame):
    good = ["the quick brown fox jumps over the lazy dog and runs. " * (k % 5 + 2) for k in range(150)]
    bad = ["BUY### NOW$$$ *** %%% && ||| " * (k % 5 + 2) for k in range(60)]
    df = table(frame, good + bad + [None, ""])
    labels = frame("doc_id long, quality int, toxic int", *((k, int(k < 150), 0) for k in range(210)), (None, 1, 0), (3, None, 0))
    out = {r.doc_id: r for r in quality_model.quality_report(df, labels).collect()}
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in out)
    assert all(out[k].predicted == int(k < 150) for k in range(210))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(quality_model.quality_report(df, wrong)) == rows(quality_model.quality_report(df, labels))
    assert {r.doc_id for r in quality_model.quality_kept(df, labels).collect()} >= set(range(150))


def test_quality_model_with_one_label_or_none(frame, docs):
    labels = frame("doc_id long, quality int, toxic int", *((k, 1, 0) for k in range(20)))
    assert {r.predicted for r in quality_model.quality_report(docs, labels).collect()} == {1}
    assert quality_model.quality_report(docs, labels.limit(0)).count() == docs.count()
    assert quality_model.quality_report(docs.limit(0), labels).count() == 0


# 7


def brute_rules(text):
    t = text or ""
    w, lines = words(t), [x for x in t.split("\n") if words(x)]
    windows_ = defaultdict(list)
    for k in range(len(w) - 2):
        windows_[tuple(w[k : k + 3])].append(k)
    covered = {k + j for at in windows_.values() if len(at) > 1 for k in at for j in range(3)}
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_rule_statistics_equal_brute_force(frame, docs, texts):
    extra = ["a b c a b c", "x x x x", "l one\nl one\n \nl two\nl one", "# # <|>", "a b c d e f a b c", "日本 " * 60]
    every = texts + extra
    got = quality_rules.rule_report(table(frame, every).repartition(3)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(every[r.doc_id]), r
        assert not (r.base_failed and r.kept)
    assert quality_rules.rule_report(docs.limit(0)).count() == 0


def test_cascade_order_does_not_change_the_verdict(frame, docs):
    stats = quality_rules.base_statistics(docs)
    rules = {"short": F.col("n_words") < 20, "null": F.lit(None).cast("boolean"), "symbols": F.col("n_symbols") > 3}
    expected = rows(stats.select("doc_id", ~(rules["short"] | rules["symbols"])))
    for order in (list(rules), list(rules)[::-1]):
        assert rows(stats.select("doc_id", quality_rules.cascade(docs, {k: rules[k] for k in order}))) == expected


def test_cascade_puts_the_better_rule_first(spark):
    sample = spark.range(2000).selectExpr("id", "repeat('ab', 200) as text").cache()
    rules = {"never": F.rlike("text", F.lit("(a|b)*c")), "always": F.col("id") >= 0}
    sample.agg(F.count_if(rules["never"])).collect()
    assert quality_rules.cascade_order(sample, rules) == ["always", "never"]


# 8


def brute_simhash(text):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("chunk", [1024, 2])
def test_simhash_equals_brute_force(frame, texts, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    every = texts + [" ".join([f"q{k}" for k in range(300)][: 300 - j]) for j in range(12)]
    ids = [100 - k for k in range(len(every))]
    prints = {i: brute_simhash(t) for i, t in zip(ids, every)}
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = rows(simhash.simhash_report(table(frame, every, ids).repartition(3)))
    assert got == sorted(((i, f"{prints[i]:016x}", root(i)) for i in ids), key=str)
    assert len({root(i) for i in ids}) < len(ids) - 5


def test_near_dedup_keeps_one_row_of_each_group(frame):
    df = frame(DOCS, (7, "a b c d", "en", "s", 1), (3, "A B c d", "en", "s", 1), (3, "A B c d", "en", "s", 1), (9, None, "en", "s", 1), (None, "", "en", "s", 1), (None, "z z z z y", "en", "s", 1))
    out = simhash.near_dedup(df)
    assert out.columns == df.columns
    assert rows(out.select("doc_id", "text")) == rows(frame("doc_id long, text string", (3, "A B c d"), (9, None), (None, "z z z z y")))
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_nothing(frame):
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(500, 500 + k) for k in range(1, 80)]
    got = dict(rows(graph.components(frame("a long, b long", *chain, *star, (5, 4), (900, 900)))))
    assert all(got[k] == 0 for k in range(61)) and all(got[500 + k] == 500 for k in range(80)) and 900 not in got
    assert graph.components(frame("a long, b long")).count() == 0


# 9


def brute_targets(sizes):
    """Sources' sizes in order to their targets, by dealing and dealing again what is above."""
    total, targets, free = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    weight = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    left = total
    while free and left > 1e-9:
        whole = sum(weight[k] for k in free)
        over = {k for k in free if left * weight[k] / whole >= 2 * sizes[k] - 1e-9}
        if not over:
            for k in free:
                targets[k] = left * weight[k] / whole
            break
        for k in over:
            targets[k] = 2.0 * sizes[k]
            left -= targets[k]
        free -= over
    return targets


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_dealing(frame, seed):
    draw = random.Random(seed)
    names = sorted(f"s{k:02}" for k in range(draw.randint(1, 12)))
    sizes = [draw.choice([0, 1, draw.randint(1, 1000)]) for _ in names] + [5]
    got = mixing.source_targets(frame("source string, size long", *zip(names, sizes), (None, 5))).orderBy(F.col("source").asc_nulls_last()).collect()
    expected = brute_targets(sizes)
    assert [r.source for r in got] == [*names, None]
    assert all(abs(r.target - e) < 1e-6 for r, e in zip(got, expected))


def test_mix_comes_near_its_targets_and_reruns_agree(frame):
    draw = random.Random(8)
    df = table(frame, [" ".join("w" for _ in range(draw.randint(1, 40))) for _ in range(3000)] + [None, ""])
    report = mixing.mix_report(df)
    assert rows(report) == rows(mixing.mix_report(df.repartition(5)))
    per = defaultdict(lambda: [0, 0.0])
    for r in report.join(df.select("doc_id", "source"), "doc_id").collect():
        assert 0 <= r.taken <= 2 * r.size
        per[r.source][0] += r.taken
        per[r.source][1] = r.target
    assert all(abs(taken - target) < 0.1 * target for taken, target in per.values())
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in mixing.with_copies(df).collect())
    assert mixing.mix(df.limit(0)).count() == 0


# 10


def test_chat_escapes_round_trip(spark):
    texts = [r"a\b", r"<|im_end|>", "[INST]", r"\\<\[", "<<SYS>>", "", "<", "plain", "</s>\\"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in out)
    assert not any(x in r.e for r in out for x in ("<|", "[INST", "<<SYS", "</s", "<s>"))


TREE = "tree long, node long, parent long, role string, text string, score double"


def test_best_paths_of_reply_trees(frame):
    tree = frame(TREE, (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", "c", 9.0), (1, 5, 3, "user", "d", None), (1, 6, 99, "user", "lost", 50.0), (1, 7, 8, "user", "loop", 99.0), (1, 8, 7, "user", "loop", 99.0), (2, 1, None, "user", "only", None))
    out = {(r.conv_id, r.path): r for r in chat.format_trees(tree, keep=2).collect()}
    assert {k: (r.path_rank, r.path_score) for k, r in out.items()} == {(1, 4): (1, 10.0), (1, 5): (2, 5.0), (2, 1): (1, 0.0)}
    assert out[(1, 4)].formatted == "<|im_start|>user<|im_sep|>q<|im_end|><|im_start|>assistant<|im_sep|>a<|im_end|><|im_start|>user<|im_sep|>c<|im_end|>"
    assert [out[(1, 5)].formatted[m.start : m.end] for m in out[(1, 5)].loss_mask] == ["b"]
    assert chat.format_trees(tree.limit(0)).count() == 0


def test_long_chains(frame):
    n = 300
    chain = frame(TREE, *((1, k, k - 1 if k else None, "assistant" if k % 2 else "user", f"t{k}", 1.0) for k in range(n)))
    out = chat.format_trees(chain).collect()
    assert len(out) == 1 and out[0].path_score == n and out[0].formatted.count("<|im_start|>") == n


def test_chat_report_equals_brute_force(frame):
    turns = [(1, 0, "user", "hi [x] \\ é"), (1, 1, "assistant", "<|im_end|>ok"), (1, 1, "assistant", None), (2, 5, None, "x"), (2, 5, None, "x"), (2, 9, "assistant", ""), (None, 1, "assistant", "n")]
    groups = defaultdict(list)
    for c, t, r, x in turns + [(-1, 0, "user", chat.TRICKY), (-1, 1, "assistant", chat.TRICKY)]:
        groups[c].append((t, r or "", x or ""))
    expected = []
    for c, g in groups.items():
        g = sorted(g)
        loss = "".join(x for _, r, x in g if r == "assistant")
        expected.append((c, len(g), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in g).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = chat.chat_report(frame("conv_id long, turn long, role string, text string, path int", *((*t, 1) for t in turns)))
    assert rows(got.drop("formatted_chars")) == sorted(expected, key=str)

"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule's cost and selectivity are estimated on a sample; the rules are then tried in the order of rejections per
cost, and a document leaves at the first rule that rejects it. The order decides the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, packed, stored, unpacked
from .words import SPACE, text_of, words

#: Rows on which costs and selectivities are estimated; they set the order of the rules alone.
SAMPLE_ROWS = 2000
#: Seconds under which costs are not told apart.
LEAST_COST = 1e-3

SYMBOLS = "[#*$%&|<>]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(w: Column) -> Column:
    """Words of the array w in three-word windows found twice or more, the first included.

    Windows are compared by 64-bit hashes, whose sorting puts equal ones side by side; without a repeat nothing is
    sorted. Starts of repeated windows in order then cover three words each, or up to the next start.
    """

    def covered(starts: Column) -> Column:
        def upto(s: Column, i: Column) -> Column:
            return F.when(i + 1 < F.size(starts), F.least(F.lit(3), F.get(starts, i + 1) - s)).otherwise(3)

        return F.aggregate(F.transform(starts, upto), F.lit(0), lambda a, x: a + x)

    def of_sorted(s: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            return (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])

        return let(F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["i"])), covered)

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, of_sorted))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, 0).otherwise(let(hashes, of_hashes)).cast("long")


#: What base_statistics counts.
STATISTICS = ("n_words", "word_chars", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols")


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with the STATISTICS (long), counted over whole texts; a null text is empty, repeated rows count alike. Columns
    that already have these names are replaced; others stay, whatever their names."""
    text = text_of("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    symbols = F.regexp_count(text, F.lit(SYMBOLS)).cast("long")
    counted = packed(docs, "text").withColumns({"words": let(words(text), of_words), "lines": let(lines, of_lines), "n_symbols": symbols})
    return unpacked(counted.select("text", "rest", "words.*", "lines.*", "n_symbols"), docs, "text", more=STATISTICS)


def standard_rules() -> dict[str, Column]:
    """Rejecting conditions over the text and its base statistics; none fires on running prose of any of the languages."""
    text, n = text_of("text"), F.col("n_words")
    return {
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "repeated_lines": 5 * F.col("n_dup_lines") > 2 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "shouting": 2 * F.regexp_count(text, F.lit(r"\p{Lu}")) > F.regexp_count(text, F.lit(r"\p{L}")),
        "exclamations": 2 * F.regexp_count(text, F.lit("!")) > n,
        "no_letters": 2 * F.regexp_count(text, F.lit(r"\p{L}")) < F.length(F.regexp_replace(text, SPACE, "")),
    }


def cascade_order(sample: DataFrame, rules: dict[str, Column]) -> list[str]:
    """The rules by rejections per second on the sample, the best first; those that reject nothing by their cost alone.

    The first pass over the sample only warms it up. A rule's cost is the shorter of two passes, less that of a pass without
    any rule, so that a job's own latency is no cost.
    """

    def seconds(rule: Column) -> tuple[float, int]:
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(rule)).first()[0]
        return time.perf_counter() - began, rejected

    rows = max(1, sample.count())
    latency = min(seconds(F.lit(False))[0] for _ in range(2))
    value = {}
    for name, rule in rules.items():
        cost, rejected = min(seconds(rule) for _ in range(2))
        value[name] = ((rejected + 0.5) / rows) / max(LEAST_COST, cost - latency)
    return sorted(rules, key=lambda name: (-value[name], name))


def cascade(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> Column:
    """Whether a row with base statistics passes all rules: one CASE, whose branches are tried in the cheapest order.

    docs (with text) is what the sample is drawn from, about sample_rows rows; only those get statistics for it. A rule
    that is null for a row doesn't reject it. An empty table gets the rules in some order.
    """
    rules = standard_rules() if rules is None else rules
    sample = stored(base_statistics(docs.sample(min(1.0, sample_rows / max(1, docs.count())), seed=7)))
    order = cascade_order(sample, rules)
    drop(sample)
    verdict = F.when(rules[order[0]], False)
    for name in order[1:]:
        verdict = verdict.when(rules[name], False)
    return verdict.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; a row for each row."""
    docs = docs.select("doc_id", "text")
    stats = base_statistics(docs)
    kept = ~base_failed() & cascade(docs)
    return stats.withColumns({"base_failed": base_failed(), "kept": kept}).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
p as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from w),
t as (select doc_id, i, word || ' ' || lead(word, 1) over x || ' ' || lead(word, 2) over x as g from p window x as (partition by doc_id order by i)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from t where g is not null) where n > 1),
c as (select doc_id, count(distinct i + k) as n from r, (select unnest([0, 1, 2]) as k) group by doc_id),
s as (select w.doc_id, text, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(l)::bigint as n_lines,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
  len(regexp_extract_all(text, '\p{L}')) as letters, len(regexp_extract_all(text, '\p{Lu}')) as uppers,
  len(regexp_extract_all(text, '!')) as marks, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as solid
  from w left join c using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > 3 * n_words or 5 * n_dup_lines > 2 * n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words
       or 2 * uppers > letters or 2 * marks > n_words or 2 * letters < solid) as kept from b
"""

"""Mixing sources to target weights with DataFrame functions only.

One pass sums the words of each source; the few sources' targets are found by water-filling; each document is then
repeated floor(rate) times, plus one Bernoulli copy of probability rate - floor(rate) decided by an MD5 of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import packed, stored, unpacked
from .words import n_words, text_of

WEIGHTS = (5.0, 2.0, 1.0)
#: Sources whose rows may be broadcast, and ways in which a source's row is repeated where there are more.
SENT_SOURCES, SALTS = 100_000, 64


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: (source, size), a row a document. Returns source, source_size, target, rate; a row a source (null is one).

    The sources by code point, null last, get the weights in turn. share times all words are dealt by weight; a source
    stops at most times its own words and its excess goes to the others by weight, until none is above. With the
    sources in order of the level most * size / weight at which they fill, the filled ones come first, so the common
    level follows from running sums. No words: targets and rates are 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_level = Window.partitionBy(F.lit(0)).orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    through = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    levels = (
        per.withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("even", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        # the first source that the even level would not fill fixes it for all after it
        .withColumn("open", F.first(F.when(F.col("even") <= F.col("level"), F.col("even")), ignorenulls=True).over(through))
    )
    target = F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("open")))
    return levels.select(
        "source",
        "source_size",
        target.cast("double").alias("target"),
        F.least(F.lit(most), F.coalesce(F.try_divide(target, "source_size"), F.lit(0.0))).alias("rate"),
    )


def with_copies(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """docs with size, source_size, target and copies (int): how often the mix takes the document.

    Null texts have size 0, texts of any length count whole, a null source is a source of its own. The draw depends on the doc_id alone, so reruns agree and
    rows that repeat an id draw alike; without an id it depends on the text. Columns that already have these names are
    replaced; others stay, whatever their names.
    """
    used = ("doc_id", "text", "source")
    sized = packed(docs, *used).withColumn("size", n_words(text_of("text")))
    targets = stored(source_targets(sized.select("source", "size"), **how))
    rows = targets.withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    if targets.count() <= SENT_SOURCES:
        joined = sized.join(F.broadcast(rows), same)
    else:
        salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")
        joined = sized.withColumn("own_salt", salt).join(salted, same & (F.col("own_salt") == F.col("salt")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(text_of("text"))))
    digits = F.substring(F.md5(F.concat(name, F.lit(":" + seed))), 1, 13)
    draw = F.conv(digits, 16, 10).cast("double") / float(1 << 52)
    whole = F.floor("rate")
    copies = (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return unpacked(joined.withColumn("copies", copies), docs, *used, more=("size", "source_size", "target", "copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document of docs as many times as it is taken, with all columns of docs; what with_copies says
    of odd rows holds. Documents without words are taken as often as their source's others."""
    used = ("doc_id", "text", "source")
    taken = with_copies(packed(docs, *used), **how).filter("copies > 0")
    return unpacked(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs, *used)


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of it)."""
    return with_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = """
with d as (select doc_id, coalesce(cast(doc_id as varchar), 'text ' || md5(coalesce(text, ''))) as name, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as k from d group by source),
w as (select *, [5.0, 2.0, 1.0][(k - 1) % 3 + 1]::double as weight, 2.0 * source_size as cap, 1.5 * sum(source_size) over () as total from s),
l as (select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as even from w),
o as (select *, first_value(case when even <= cap / weight then even end ignore nulls) over (order by cap / weight, source nulls last
      rows between unbounded preceding and unbounded following) as lev from l),
t as (select source, source_size, cast(case when lev is null then cap else least(cap, weight * lev) end as double) as target from o),
r as (select doc_id, size, source_size, target, least(2.0, case when source_size = 0 then 0 else target / source_size end) as rate,
      ('0x' || substr(md5(name || ':mix'), 1, 13))::bigint / 4503599627370496.0 as draw
      from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end) as bigint) as taken from r
"""

"""A quality classifier as a sparse rule ensemble.

Shallow trees over text statistics are grown on a bounded labelled sample; every path from a root to a node becomes a
conjunctive rule; a lasso logistic regression keeps few of the rules; and these are compiled into one Spark column
expression that scores any table of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let
from .store import packed, stored, unpacked
from .words import text_of, words

#: The most labelled rows that the model is fitted on, chosen by a hash of their ids.
TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO, THRESHOLD = 12, 3, 0.001, 0.3
FEATURES = ("words", "word_length", "distinct", "symbols", "capitals", "exclamations", "digits", "repeated_lines", "line_words", "marks")


def statistics(text: Column) -> Column:
    """A struct of the FEATURES (double), shares of words or letters where that makes sense; 0 for an empty text."""
    text = text_of(text)

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(n.alias("n"), F.size(F.array_distinct(w)).alias("distinct"), F.length(F.array_join(w, "")).alias("chars"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(
        F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l")),
        lambda s: F.struct(
            F.log1p(s["w"]["n"].cast("double")).alias("words"),
            share(s["w"]["chars"], s["w"]["n"]).alias("word_length"),
            share(s["w"]["distinct"], s["w"]["n"]).alias("distinct"),
            share(count(r"[#*$%&|<>]"), s["w"]["n"]).alias("symbols"),
            share(count(r"\p{Lu}"), s["w"]["chars"]).alias("capitals"),
            share(count("!"), s["w"]["n"]).alias("exclamations"),
            share(count(r"[0-9]"), s["w"]["chars"]).alias("digits"),
            share(s["l"]["n"] - s["l"]["distinct"], s["l"]["n"]).alias("repeated_lines"),
            share(s["w"]["n"], s["l"]["n"]).alias("line_words"),
            share(count(r"[.,;:?]"), s["w"]["n"]).alias("marks"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is above, threshold) and its weight in the score."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def column(self, of: Column) -> Column:
        out = F.lit(True)
        for feature, above, limit in self.terms:
            value = of[FEATURES[feature]]
            out = out & ((value > limit) if above else (value <= limit))
        return out


def tree_paths(node, terms: tuple = ()) -> Iterator[tuple]:
    """The conditions on the way to every node below this one; repeated conditions on a side keep the sharper one."""
    if terms:
        yield terms
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        feature, limit = split.featureIndex(), split.threshold()
        for above, child in ((False, node.leftChild()), (True, node.rightChild())):
            rest = tuple(t for t in terms if t[:2] != (feature, above))
            yield from tree_paths(child, tuple(sorted((*rest, (feature, above, limit)))))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """label and features s of at most rows labelled documents whose crc32 of the id as text is not a multiple of 5."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("label")).filter("label in (0, 1) and _id is not null")
    known = known.filter(F.crc32(F.col("_id").cast("string")) % 5 != 0)
    picked = known.orderBy(F.md5(F.col("_id").cast("string")), "label").limit(rows)  # the bound that lets it be broadcast
    texts = docs.select(F.col("doc_id").alias("_doc"), "text")
    return stored(texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("label", statistics(F.col("text")).alias("s")))


def fit_rules(sample: DataFrame) -> tuple[float, list[Rule]]:
    """Intercept and weighted rules. A sample with one label or none gives no rules and that label's constant score."""
    counts = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return (0.0 if not counts else 4.0 if 1.0 in counts else -4.0), []
    flat = sample.select("label", *(F.col("s")[f].alias(f) for f in FEATURES))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(flat).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, seed=7).fit(data)
    rules = [Rule(t) for t in sorted({p for tree in forest.trees for p in tree_paths(tree._call_java("rootNode"))})]
    if not rules:
        return 0.0, []
    named = sample.select("label", *(r.column(F.col("s")).cast("double").alias(f"r{k}") for k, r in enumerate(rules)))
    inputs = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features")
    fitted = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, maxIter=60).fit(stored(inputs.transform(named).select("label", "features")))
    return float(fitted.intercept), [Rule(r.terms, float(w)) for r, w in zip(rules, fitted.coefficients) if abs(w) > 1e-6]


def score_column(intercept: float, rules: list[Rule], text: Column) -> Column:
    """The ensemble compiled into an expression: the logistic of the weights of the rules that hold."""

    def total(s: Column) -> Column:
        return sum((F.when(r.column(s), F.lit(r.weight)).otherwise(0.0) for r in rules), F.lit(intercept))

    return F.round(1 / (1 + F.exp(-let(statistics(text), total))), 6)


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.3). Null texts are empty and scored so, texts of any length
    whole. The labels, lang, source and doc_id are never inputs of a score; a document's repeated labels count each, and
    repeated rows get equal scores. Columns named score or predicted are replaced; others stay, whatever their names."""
    intercept, rules = fit_rules(labelled_sample(docs, labels))
    scored = docs.drop("score", "predicted").withColumn("score", score_column(intercept, rules, F.col("text")))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def quality_kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier does not reject, with all their columns; what with_quality says of odd rows holds. Without
    labels of both kinds all documents have one score: kept, but where all labels are 0."""
    scored = with_quality(packed(docs, "doc_id", "text"), labels)
    return unpacked(scored.filter("predicted = 1"), docs, "doc_id", "text")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return with_quality(docs.select("doc_id", "text"), labels).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")

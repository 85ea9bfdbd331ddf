"""Chat formatting of reply trees: iterative self-joins find the best root-to-leaf paths, each formatted as a conversation.

Paths are followed by doubling: after round k every message knows its ancestor 2^k replies up and the sum of the scores
on the way, so a tree of depth d takes log2(d) self-joins, and a chain of thousands of turns no more than a dozen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, stored

START, HEAD, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Every character that can begin a control string of a known chat template, and the escape mark itself.
MARKED = r"([\\<\[])"


def escape(text: Column) -> Column:
    """A backslash after each backslash, '<' and '[': no control string (<s>, [INST], <<SYS>>, <|im_end|>) can remain."""
    return F.regexp_replace(text, MARKED, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, MARKED + r"\\", "$1")


def ranked_leaves(messages: DataFrame, keep: int = 1) -> DataFrame:
    """tree, leaf, path_rank, path_score of the keep best branches of each tree.

    messages: tree, node, parent (null at a root), score; nodes are unique in a tree. A path's score is the sum over
    its messages (null: 0); ties go to the smaller leaf. Messages whose ancestors do not end at a root (a missing
    parent, a cycle) lie on no path.
    """
    link = stored(messages.select("tree", "node", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).alias("sum")))
    nodes = link.count()
    hops = 1
    # messages of a cycle or under a cycle never reach a root: after as many hops as there are nodes they are left out
    while hops <= nodes and not link.filter("up is not null").isEmpty():
        above = link.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum"))
        # a parent that is missing leaves the link open for ever: its messages are dropped here
        nxt = link.filter("up is not null").join(above, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"))
        last, link = link, stored(link.filter("up is null").select("tree", "node", "up", "sum").unionByName(nxt))
        drop(last)
        hops *= 2
    ended = link.filter("up is null")
    parents = messages.filter("parent is not null").select("tree", F.col("parent").alias("node"))
    leaves = ended.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("sum").desc(), F.col("node"))
    ranked = leaves.withColumn("path_rank", F.row_number().over(best)).filter(F.col("path_rank") <= keep)
    return ranked.select("tree", F.col("node").alias("leaf"), "path_rank", F.col("sum").alias("path_score"))


def path_nodes(messages: DataFrame, leaves: DataFrame) -> DataFrame:
    """tree, leaf, node, height (0 at the leaf) of every message on the chosen paths, by doubling from the leaf upwards."""
    jump = stored(messages.filter("parent is not null").select("tree", "node", F.col("parent").alias("up")))
    found = stored(leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("height")))
    hops = 1
    while True:
        more = stored(found.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("height") + hops).alias("height")))
        # the leaves' ways end at roots, so this ends, even where other messages form a cycle
        if more.isEmpty():
            break
        last, found = found, stored(found.unionByName(more))
        drop(last)
        drop(more)
        above = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"))
        last, jump = jump, stored(jump.join(above, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up")))
        drop(last)
        hops *= 2
    return found


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, path (leaf), formatted text and the loss mask: [start, end) code points of each assistant text.

    turns: conv_id, path, position, role, text; null roles and texts are empty. The template is
    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|> a turn, roles and texts escaped.
    """
    role, text = (escape(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    # a turn is cut into what comes before the text, the text and the end mark, so that lengths give the mask
    parts = turns.select("conv_id", "path", "position", F.coalesce("role", F.lit("")).alias("raw_role"), F.concat(F.lit(START), role, F.lit(HEAD)).alias("lead"), text.alias("body"))
    # where a turn begins is the sum of what stands before it
    before = Window.partitionBy("conv_id", "path").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("lead") + F.length("body") + len(END)
    placed = parts.withColumn("start", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)) + F.length("lead"))
    rows = placed.groupBy("conv_id", "path").agg(F.array_sort(F.collect_list(F.struct("position", "raw_role", "lead", "body", "start"))).alias("t"))
    spoken = F.transform(F.filter("t", lambda x: x["raw_role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["body"])).alias("end")))
    joined = F.array_join(F.transform("t", lambda x: F.concat(x["lead"], x["body"], F.lit(END))), "")
    return rows.select("conv_id", "path", joined.alias("formatted"), spoken.alias("loss_mask"))


def unique_messages(messages: DataFrame) -> DataFrame:
    """messages with one row for each node of a tree: of several the first by parent, score, role and text."""
    repeated = messages.groupBy("tree", "node").agg(F.count("*").alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return messages
    rest = ("parent", "score", "role", "text")
    return messages.groupBy("tree", "node").agg(F.min(F.struct(*rest)).alias("x")).select("tree", "node", *(f"x.{c}" for c in rest))


def format_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """The keep best paths of each reply tree as conversations: conv_id, path, formatted, loss_mask, path_rank, path_score.

    messages: tree, node, parent, score, role, text. Empty tables give none; other columns are not used. Rows without a
    tree or a node are on no path; of several rows of one node the first by parent, score, role and text counts. Texts
    may be empty, null (as empty) or of any length; a conversation is one row of the output.
    """
    messages = unique_messages(messages.select("tree", "node", "parent", "score", "role", "text").filter("tree is not null and node is not null"))
    slim = stored(messages.select("tree", "node", "parent", F.col("score").cast("double").alias("score")))
    leaves = stored(ranked_leaves(slim, keep))
    path = path_nodes(slim, leaves)
    turns = path.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    out = formatted(turns.select(F.col("tree").alias("conv_id"), F.col("leaf").alias("path"), (-F.col("height")).alias("position"), "role", "text"))
    return out.join(leaves.select(F.col("tree").alias("conv_id"), F.col("leaf").alias("path"), "path_rank", "path_score"), ["conv_id", "path"])


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a reply tree in which each turn answers the one before; ties in turn go by role, then text.

    A message scores its number of code points. A null conv_id is a conversation of its own, under -2^63.
    """
    tree = F.coalesce(F.col("conv_id"), F.lit(-(2**63)))
    rows = conversations.select(tree.alias("tree"), "turn", "role", "text")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.withColumn("node", node).withColumn("parent", parent).withColumn("score", F.length("text").cast("double"))


def read_back(chats: DataFrame) -> DataFrame:
    """The digest of formatted conversations, parsed from their text and mask alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>"), lambda x: x != "")
    turns = F.transform(pieces, lambda x: F.split(F.substring(x, len(START) + 1, 1 << 30), r"<\|im_sep\|>"))
    said = F.transform(turns, lambda x: F.concat(unescape(x[0]), F.lit("\n"), unescape(x[1]), F.lit("\n")))
    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int"))))
    parsed = chats.withColumn("loss", F.array_join(loss, ""))
    return parsed.select(
        F.when(F.col("conv_id") != -(2**63), F.col("conv_id")).alias("conv_id"),
        F.size(pieces).cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that looks like another template's control strings, as the query adds it.
TRICKY = "</s>[INST] ok [/INST]"


def chat_report(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    trick = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(trick)
    messages = stored(linear_messages(rows))
    return read_back(stored(format_trees(messages)))


ORACLE = r"""
with c as (select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, text as t0, role as r0 from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, r0 nulls first, t0 nulls first)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, r0 nulls first, t0 nulls first) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(regexp_replace(role, '[\\<\[]', '..', 'g')) + length(regexp_replace(text, '[\\<\[]', '..', 'g')) + 32) as bigint) as formatted_chars
from e group by conv_id
"""

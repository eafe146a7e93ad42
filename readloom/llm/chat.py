"""Chat formatting of reply trees: branches as conversations, with the spans that bear loss.

Nodes (tree, node, parent, role, text, score) form trees. Each leaf's ancestors are found by self-joins that double
their reach (path rows only, log2(depth) joins); branches are ranked by their mean score and the chosen ones formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import materialize

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
MAX_DOUBLINGS = 40


def escape(text: Column) -> Column:
    r"""One more backslash between ``<`` and ``|``, behind those already there: no control string is left."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    r"""Roles stand on one line: besides, ``\`` becomes ``\b`` and a line feed ``\n``, so each backslash has its letter."""
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def paths(nodes: DataFrame) -> DataFrame:
    """Rows (tree, leaf, node, up): the ancestors of each leaf and their distance from it, the leaf itself at 0.

    A node whose parent is null or absent is a root. Leaves that lead into a cycle have no root and give no path.
    """
    keys = nodes.select("tree", "node", "parent")
    known = keys.select("tree", F.col("node").alias("parent"))
    hop = materialize(keys.join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("to")))
    leaf = keys.join(hop.select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti")
    path = leaf.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    reach = 1
    for _ in range(MAX_DOUBLINGS):
        path = materialize(path.unionByName(path.join(hop, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up"))))
        again = hop.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        hop = materialize(hop.join(again, ["tree", "to"]).select("tree", "node", F.col("next").alias("to")))
        reach *= 2
        if hop.isEmpty():
            return path
        if reach > 2 * keys.count():
            break
    looped = hop.select("tree", F.col("node").alias("leaf")).distinct()
    return path.join(looped, ["tree", "leaf"], "left_anti")


def format_branches(nodes: DataFrame, branches: int | None = 1, loss_roles: tuple = ("assistant",)) -> DataFrame:
    """One row a chosen branch: tree, leaf, rank, formatted, n_turns and spans (array of (start, length) that bear loss).

    ``nodes``: tree and node (not null, unique together), parent, role, text, score. Null texts and roles are empty;
    null scores count as 0. Branches rank by mean score, ties to the smaller leaf; ``branches=None`` keeps all.
    """
    held = nodes.select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    path = paths(held)
    if branches is not None:
        scored = path.join(held.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))).filter(F.col("rank") <= branches)
        path = path.join(ranked.select("tree", "leaf", "rank"), ["tree", "leaf"])
    else:
        path = path.withColumn("rank", F.lit(1))
    body = path.join(held.select("tree", "node", "role", "text"), ["tree", "node"])
    body = body.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("said", escape(F.col("text"))).withColumn("seg", F.concat("head", "said", F.lit(END + "\n")))
    before = W.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, -1)
    body = body.withColumn("at", F.coalesce(F.sum(F.length("seg")).over(before), F.lit(0)) + F.length("head"))
    loss = F.coalesce(F.col("role").isin(*loss_roles), F.lit(False))
    turn = F.struct((-F.col("up")).alias("o"), F.col("seg").alias("seg"), loss.alias("loss"), F.col("at").cast("long").alias("start"), F.length("said").cast("long").alias("length"))
    out = body.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return out.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda x: x["seg"]), "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"), spans.alias("spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    segs = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x, i: i > 0)

    def turn(seg: Column) -> Column:
        role = F.substring_index(seg, "\n", 1)
        text = F.substring(seg, F.length(role) + 2, F.length(seg) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(segs, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as chains: each turn answers the one before it.

    Ties in ``turn`` go by role and text, nulls first; a null conv_id is one conversation of its own.
    """
    d = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "conv_id", "turn", "role", "text")
    d = d.withColumn("node", F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    return d.select("tree", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))

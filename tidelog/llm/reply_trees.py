"""Chat formatting over reply trees (operator 7).

Messages form trees by parent ids.  Root-to-leaf paths are enumerated by
iterative self-joins that double the length of a jump each time, so a path of n
messages takes log2(n) joins.  Branches (leaves) are ranked by the mean score of
their path; each chosen path is formatted as one conversation.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside texts and
roles, a backslash is put into each ``<|`` (one more where there are some), and in
roles line ends and backslashes are written ``\\n`` and ``\\\\``; this is undone on reading.  The loss
mask holds the spans of assistant texts as code points of the formatted string.

Defined results: null texts and roles are empty; a missing parent makes a root; messages on a
cycle have no root and are in no path; rows that repeat a tree and node id count
once each as turns of a conversation table (``conversation_nodes`` numbers them by
turn, role and text); a null turn comes last; a null tree id is a tree of its own; an
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_table

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as trees of one path: ``tree, node, parent, score, role, text``."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    nodes = rows.select(tree.alias("tree"), "turn", role.alias("role"), text.alias("text")).withColumn("node", F.row_number().over(order).cast("long"))
    return nodes.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``nodes(tree, node, parent, score)`` -> ``(tree, leaf, rank, node, depth)`` for the nodes of the
    ``branches`` best paths of each tree; ``depth`` counts from the leaf."""
    ids = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = ids.select("tree", F.col("node").alias("parent")).distinct().withColumn("_there", F.lit(True))
    state = kept_table(ids.join(there, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("_there"), F.col("parent")).alias("jump"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")))
    most = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels = [state]
    while 2 ** (len(levels) - 1) <= most and not state.filter("jump is not null").isEmpty():
        on = state.select("tree", F.col("node").alias("jump"), F.col("jump").alias("_j"), F.col("steps").alias("_s"), F.col("total").alias("_t"))
        further = state.filter("jump is not null").join(on, ["tree", "jump"]).select(
            "tree", "node", F.col("_j").alias("jump"), (F.col("steps") + F.col("_s")).alias("steps"), (F.col("total") + F.col("_t")).alias("total"))
        state = kept_table(state.filter("jump is null").unionByName(further))
        levels.append(state)
    parents = levels[0].filter("jump is not null").select("tree", F.col("jump").alias("node"))
    leaves = state.filter("jump is null").join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy((F.col("total") / F.col("steps")).desc(), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    path = kept_table(ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("depth")))
    for k in reversed(range(len(levels) - 1)):
        up = levels[k].filter("jump is not null").select("tree", "node", "jump")
        more = path.join(up, ["tree", "node"]).select("tree", "leaf", "rank", F.col("jump").alias("node"), (F.col("depth") + 2 ** k).alias("depth"))
        path = kept_table(path.unionByName(more))
    return path


def formatted(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, rank, conversation, mask``: each chosen path as one string with the spans that bear loss."""
    turns = chosen_paths(nodes, branches).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    grouped = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("depth")).alias("at"), F.col("role").alias("role"),
        F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body")))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")

    def step(acc: Column, t: Column) -> Column:
        start = acc["pos"] + F.length(t["head"])
        end = start + F.length(t["body"])
        mask = F.when(t["role"] == ASSISTANT, F.concat(acc["mask"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["mask"])
        return F.struct((end + len(END)).alias("pos"), mask.alias("mask"))

    first = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<start:long,end:long>>").alias("mask"))
    return grouped.select("tree", "leaf", "rank", whole.alias("conversation"), F.aggregate("turns", first, step, lambda a: a["mask"]).alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """``turns(role, text)`` and ``loss_text`` read from ``conversation`` and ``mask`` alone."""
    parts = F.split("conversation", r"<\|im_end\|>\n", -1)
    turn = lambda p: F.struct(
        _unescape_role(F.substring_index(p.substr(F.lit(len(START) + 1), F.length(p)), "\n", 1)).alias("role"),
        unescape(p.substr(F.instr(p, "\n") + 1, F.length(p))).alias("text"))
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)
    loss = F.transform("mask", lambda m: unescape(F.col("conversation").substr((m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return chats.withColumn("turns", turns).withColumn("loss_text", F.array_join(loss, ""))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Digests of every formatted conversation, read back: ``conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars``."""
    nodes = kept_table(conversation_nodes(conversations))
    back = read_back(formatted(nodes))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").try_cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("conversation").cast("long").alias("formatted_chars"))

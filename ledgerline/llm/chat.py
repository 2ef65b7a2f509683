"""Chat formatting of reply trees.

Messages name the message they answer. Iterative self-joins enumerate the paths from every leaf to its root: a table of jumps
doubles its reach each round (answers' answers), and each round the paths found so far are continued by the jump, so the rounds
are the logarithm of the deepest tree and the rows written are those of the paths. Branches are ranked by the sum of their
messages' scores, and each chosen path becomes one conversation. Texts join only the chosen paths.

The template writes a turn as ``<|im_start|>role``, a line feed, the text and ``<|im_end|>`` with a line feed. Control strings of this and
other chat templates inside texts and roles are escaped, so they never reach a tokenizer as such, and come back on reading.
The loss mask holds the byte spans (start, length) of the texts of one role. Everything is a DataFrame operation.

Edge cases: null texts and roles are empty. A message whose parent is null, absent or itself is a root; messages whose ancestors
run in a circle have no root and are on no path. Messages repeated under one id are one, the smallest by parent, score, role and
text. Ties of scores go to the smaller leaf; null scores count as zero. A null conversation id is a conversation of its own.
Conversations without parents (``chain``) are taken in the order of turn, role and text, repeated rows included. An empty table
gives an empty result. Other columns are ignored. A conversation is one output row, so its chosen path has to fit into one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerline.llm.durable import stored

#: The marks of the template, and control strings of other templates that are escaped as well.
START, END = "<|im_start|>", "<|im_end|>"
OTHERS = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>"]
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """Without control strings: a backslash becomes ``\\b``, the first sign of a control string ``\\l`` (<) or ``\\s`` ([)."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for sign, mark in (("<", "l"), ("[", "s")):
        rest = "|".join(re.escape(c[1:]) for c in [START, END, *OTHERS] if c[0] == sign)
        text = F.regexp_replace(text, f"{re.escape(sign)}(?={rest})", rf"\\{mark}")
    return text


def plain(text: Column) -> Column:
    """What ``escaped`` was given."""
    for mark, sign in (("l", "<"), ("s", "["), ("n", "\n"), ("b", "\\")):
        text = F.replace(text, F.lit(f"\\{mark}"), F.lit(sign))
    return text


def chain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of conversations without branches: each turn answers the one before it."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    at = F.row_number().over(W.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    placed = rows.select("conv", at.alias("node"), "role", "text")
    return placed.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def _same(a: DataFrame, b: DataFrame, **pairs: str) -> Column:
    match = a["conv"].eqNullSafe(b["conv"])
    for left, right in pairs.items():
        match = match & (a[left] == b[right])
    return match


def reply_paths(messages: DataFrame) -> DataFrame:
    """``conv``, ``leaf``, ``node``, ``up``: every message of every root-to-leaf path, ``up`` steps above its leaf.

    ``messages`` has ``conv``, ``node`` and ``parent``, one row for each message.
    """
    nodes = messages.select("conv", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"))
    known = messages.select("conv", "node").alias("k")
    found = nodes.alias("m").join(known, F.col("m.conv").eqNullSafe(F.col("k.conv")) & (F.col("m.parent") == F.col("k.node")), "left")
    jumps = stored(found.select("m.conv", "m.node", F.col("k.node").alias("to")))
    answered = jumps.where("to is not null").select("conv", F.col("to").alias("node")).distinct()
    ends = jumps.join(answered, _same(jumps, answered, node="node"), "left_anti")
    paths = stored(ends.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    # No tree is deeper than the messages of its conversation: what can still jump beyond that runs in a circle.
    deepest = jumps.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    jumps, reach = jumps.where("to is not null"), 1
    while reach < 2 * deepest and not jumps.isEmpty():
        p, j, onward = paths.alias("p"), jumps.alias("j"), jumps.alias("o")
        further = p.join(j, F.col("p.conv").eqNullSafe(F.col("j.conv")) & (F.col("p.node") == F.col("j.node"))).select(
            "p.conv", "p.leaf", F.col("j.to").alias("node"), (F.col("p.up") + reach).alias("up"))
        paths = stored(paths.unionAll(further))
        jumps = stored(j.join(onward, F.col("j.conv").eqNullSafe(F.col("o.conv")) & (F.col("j.to") == F.col("o.node"))).select(
            "j.conv", "j.node", F.col("o.to").alias("to")))
        reach *= 2
    circles = jumps.select("conv", F.col("node").alias("leaf"))
    return paths.join(circles, _same(paths, circles, leaf="leaf"), "left_anti")


def conversations(messages: DataFrame, best: int = 1, learned: str = LEARNED) -> DataFrame:
    """``conv``, ``branch`` (rank from 1), ``leaf``, ``score``, ``formatted`` and ``loss`` (byte spans) of the ``best`` branches of every conversation.

    ``messages`` has ``conv``, ``node``, ``parent``, ``score``, ``role`` and ``text``.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    once = stored(messages.where("node is not null").select("conv", "node", F.struct("parent", score.alias("score"), text("role").alias("role"), text("text").alias("text")).alias("m"))
                  .groupBy("conv", "node").agg(F.min("m").alias("m")).select("conv", "node", "m.*"))
    paths = stored(reply_paths(once.select("conv", "node", "parent")))
    p, m = paths.alias("p"), once.select("conv", "node", "score").alias("m")
    here = F.col("p.conv").eqNullSafe(F.col("m.conv")) & (F.col("p.node") == F.col("m.node"))
    branches = p.join(m, here).groupBy("p.conv", "p.leaf").agg(F.sum("m.score").alias("score"))
    place = F.row_number().over(W.partitionBy("conv").orderBy(F.desc("score"), "leaf"))
    chosen = branches.withColumn("branch", place).where(F.col("branch") <= best).alias("b")
    wanted = p.join(chosen, F.col("p.conv").eqNullSafe(F.col("b.conv")) & (F.col("p.leaf") == F.col("b.leaf"))).select("p.*", "b.branch", "b.score").alias("p")

    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))
    # Each text is escaped once, before it moves.
    turns = once.select("conv", "node", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"),
                        (F.col("role") == learned).alias("learned")).alias("m")
    parts = wanted.join(turns, here).select("p.conv", "p.branch", "p.leaf", "p.score", (-F.col("p.up")).alias("at"), "m.head", "m.body", "m.learned")
    whole = F.octet_length("head") + F.octet_length("body") + len(END) + 1
    before = F.sum(whole).over(W.partitionBy("conv", "branch").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    spans = F.struct((F.coalesce(before, F.lit(0)) + F.octet_length("head")).cast("long").alias("start"), F.octet_length("body").cast("long").alias("length"))
    made = parts.withColumn("span", F.when(F.col("learned"), spans)).groupBy("conv", "branch").agg(
        F.first("leaf").alias("leaf"), F.first("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END + "\n")).alias("turn"), "span"))).alias("turns"))
    return made.select("conv", "branch", "leaf", "score", F.array_join(F.col("turns")["turn"], "").alias("formatted"),
                       F.filter(F.col("turns")["span"], lambda s: s.isNotNull()).alias("loss"))


def turns_of(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, re.escape(END) + "\n", -1), lambda p: p != "")
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(pieces, lambda p: F.struct(
        plain(F.substr(head(p), F.lit(len(START) + 1))).alias("role"),
        plain(F.substr(p, F.length(head(p)) + 2)).alias("text")))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    raw = formatted.cast("binary")
    # Byte spans, so each is cut out in the time of its own length.
    return F.array_join(F.transform(loss, lambda s: plain(F.substr(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))), "")

"""Chat formatting over reply trees.

Messages name their parent. Pointer doubling self-joins give each message its
1st, 2nd, 4th ... ancestor, in as many rounds as the logarithm of the deepest
branch; walking these from the longest jump down to the first enumerates every
root-to-leaf path as narrow (leaf, message, distance) rows of numbers. Branches are ranked
by their messages' mean score within the tree, and each chosen path becomes one
conversation. Texts join only at the end.

The template is ChatML-like. A control string inside a text cannot be mistaken
for a mark: ``<`` followed by backslashes and ``|`` gets one backslash more, and
loses it again on reading.

Defined results: null text or role is empty; null score is 0; a null tree id is
a tree like any other; a parent that is not there makes a root; messages without
an id, and those on or below a cycle of parents, are on no root-to-leaf path; of
several rows with one id the first by parent, role, text and score counts.
Branches of equal score rank by leaf id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwash.llm.blocks import numbered
from ledgerwash.llm.scratch import dropped, written

START, END = "<|im_start|>", "<|im_end|>\n"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    for char, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def unescape_text(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


def _jumps(links: DataFrame) -> tuple[list[DataFrame], bool]:
    """Tables of (node, up): the ancestor 1, 2, 4 ... links up; and whether some chain
    never ends."""
    tables = [written(links, "jump")]
    longest = tables[0].count()
    while not tables[-1].isEmpty():
        if 1 << len(tables) - 1 > longest:
            return tables, True
        a, b = tables[-1].alias("a"), tables[-1].alias("b")
        twice = a.join(b, F.col("a.up") == F.col("b.node")).select("a.node", "b.up")
        tables.append(written(twice, "jump"))
    dropped(links.sparkSession, tables.pop())
    return tables, False


def paths(messages: DataFrame) -> DataFrame:
    """(leaf, node, dist) for every message on every root-to-leaf path; dist counts
    from the leaf. Of ``messages`` (node, tree, msg, parent), ``node`` is a unique
    number and (tree, msg) is unique. Each step of the walk is written and replaces
    the one before: a branch is a row at first, and is dealt out anew as it grows."""
    spark = messages.sparkSession
    parents = messages.select("tree", F.col("msg").alias("parent"), F.col("node").alias("up"))
    links = messages.where("parent IS NOT NULL").join(parents, ["tree", "parent"]).select("node", "up")
    jumps, endless = _jumps(links)
    leaves = messages.select("node")
    if jumps:
        leaves = leaves.join(jumps[0].select(F.col("up").alias("node")), "node", "left_anti")
    if endless:
        leaves = leaves.join(jumps[-1], "node", "left_anti")
    walk = written(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")), "walk")
    for k in range(len(jumps) - 1 - endless, -1, -1):
        here = F.struct("node", "dist")
        there = F.struct(F.col("up").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))
        both = walk.repartition("leaf", "node").join(jumps[k], "node", "left")
        step = both.select("leaf", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x"))
        then = written(step.select("leaf", "x.node", "x.dist"), "walk")
        dropped(spark, walk)
        walk = then
    for jump in jumps:
        dropped(spark, jump)
    return walk


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """One row per chosen branch: tree_id, leaf_id, rank, score, n_turns, formatted,
    and ``loss``, the spans (code points of ``formatted``) of the assistant's texts.
    Columns read: tree_id, message_id, parent_id, role, text, score. ``best``: how
    many branches of a tree to keep, all if None."""
    # A struct around the tree id makes null equal to null in joins.
    rows = messages.where("message_id IS NOT NULL").select(
        F.struct(F.col("tree_id").alias("id")).alias("tree"), F.col("message_id").alias("msg"),
        F.col("parent_id").alias("parent"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    # Written once, with a number that stands for tree and message from here on; the texts are read once.
    rows = written(rows.withColumn("node", F.monotonically_increasing_id()), "messages")
    if not rows.groupBy("tree", "msg").count().where("count > 1").isEmpty():
        first = Window.partitionBy("tree", "msg").orderBy("parent", "role", "text", "score")
        rows = written(rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n"), "messages")
    walk = paths(rows.select("node", "tree", "msg", "parent"))
    scored = walk.join(rows.select("node", "score"), "node").groupBy("leaf").agg(
        F.avg("score").alias("score"), F.max("dist").alias("depth"))
    named = scored.join(rows.select(F.col("node").alias("leaf"), "tree", F.col("msg").alias("leaf_id")), "leaf")
    # Ranks by one sort over all trees, as one tree may have a third of all branches.
    order = numbered(named.withColumn("less", -F.col("score")), "tree", "less", "leaf_id", name="ranked")
    firsts = order.groupBy("tree").agg(F.min("place").alias("first"))
    ranked = order.join(firsts, "tree").withColumn("rank", (F.col("place") - F.col("first") + 1).cast("int"))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    ranked = written(ranked.select("leaf", "leaf_id", "tree", "rank", "score", "depth"), "ranked")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = (walk.join(ranked.select("leaf", "depth"), "leaf").join(rows.select("node", "role", "text"), "node")
             .select("leaf", (F.col("depth") - F.col("dist")).alias("pos"), (F.col("role") == "assistant").alias("own"),
                     F.length(head).alias("head"), F.concat(head, escape_text(F.col("text")), F.lit(END)).alias("shown")))
    so_far = F.sum(F.length("shown")).over(Window.partitionBy("leaf").orderBy("pos"))
    turns = turns.withColumn("end", so_far - len(END))
    begin = F.col("end") + len(END) - F.length("shown") + F.col("head")
    turn = F.struct("pos", "shown", F.when(F.col("own"), F.struct(
        begin.cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("loss"))
    whole = turns.select("leaf", turn.alias("turn")).groupBy("leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    text = whole.select("leaf", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.shown"), "").alias("formatted"),
                        F.filter(F.col("turns.loss"), lambda x: x.isNotNull()).alias("loss"))
    return text.join(ranked, "leaf").select(
        F.col("tree.id").alias("tree_id"), "leaf_id", "rank", "score", "n_turns", "formatted", "loss")


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees of one branch: each row
    replies to the one before; rows of equal turn go by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").withColumn(
        "pos", F.row_number().over(order).cast("long")).select(
        F.col("conv_id").alias("tree_id"), F.col("pos").alias("message_id"),
        F.when(F.col("pos") > 1, F.col("pos") - 1).alias("parent_id"), "role", "text", F.lit(None).cast("double").alias("score"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.removesuffix(END).partition("\n")
        turns.append((unescape_role(role), unescape_text(text)))
    return turns


_DIGEST = T.StructType([T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType())])


@F.arrow_udf(_DIGEST)
def read_back(formatted: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Digests of the turns and of the text under the loss mask, from the output."""
    names = [f.name for f in _DIGEST]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string()]
    for texts, masks in formatted:
        rows = []
        for text, mask in zip(texts.to_pylist(), masks.to_pylist(), strict=True):
            turns = parse(text)
            loss = "".join(unescape_text(text[s["start"]:s["end"]]) for s in mask)
            rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                         len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        columns = zip(*rows) if rows else ([] for _ in names)
        yield pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def report(conversations: DataFrame) -> DataFrame:
    done = format_trees(chains(conversations))
    return done.select("tree_id", "formatted", read_back(F.col("formatted"), F.col("loss")).alias("d")).select(
        F.col("tree_id").alias("conv_id"), "d.*", F.length("formatted").cast("long").alias("formatted_chars"))

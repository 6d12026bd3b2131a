"""Reply trees to conversations.

``paths`` finds the root-to-leaf path of every leaf by iterative self-joins with
pointer jumping: each round joins the paths found so far and the jump table with the
jump table, so a tree of depth d takes about log2(d) rounds and never holds more rows
than its paths and one jump a node and round. ``ranked`` orders the branches of a tree by score; ``formatted`` writes
each chosen path as one conversation, with the places of the text to learn from.

Template: ``<s>``, then every turn as ``[INST]text[/INST]`` (user), ``[ASST]text[/ASST]``
(assistant) or ``[ROLE name]text[/ROLE]``, then ``</s>``. Texts and names are escaped:
backslash, ``<``, ``[`` and ``]`` become a backslash and one letter, so no control string
can occur inside them and ``unescaped`` gives back every text. The loss mask holds
start and end (code points) of each assistant text within the output.

Null texts and roles are empty. Turns of one number stand in order of role, then text,
and each counts, repeated rows too; a null turn number comes first. A null conv_id is a
conversation of its own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popspark.llm.common import stored

LETTERS = {"\\": "b", "<": "l", "[": "o", "]": "c"}
BACK = {v: k for k, v in LETTERS.items()}


def escaped(text: Column) -> Column:
    for sign, letter in LETTERS.items():
        text = F.replace(text, F.lit(sign), F.lit("\\" + letter))
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\([bloc])", lambda m: BACK[m[1]], text)


def paths(nodes: DataFrame) -> DataFrame:
    """leaf, node, depth (root 0) for every leaf of the trees in ``nodes`` (node, parent; both unique long ids).

    A null or unknown parent makes a root. Nodes whose ancestors run in a circle belong to no
    tree and are left out: jumps as long as the number of nodes end for all others.
    """
    known = nodes.select(F.col("node").alias("parent"))
    jumps = stored(nodes.join(known, "parent", "left_semi").select("node", F.col("parent").alias("up")), "jumps")
    inner = jumps.select(F.col("up").alias("node")).distinct()
    levels, most = [], nodes.count()
    while 1 << len(levels) < most and not jumps.isEmpty():
        levels.append(jumps)
        far = jumps.select("node", F.col("up").alias("mid")).join(jumps.select(F.col("node").alias("mid"), "up"), "mid").select("node", "up")
        jumps = stored(far, "jumps")
    leaves = nodes.join(inner, "node", "left_anti").join(jumps.select("node"), "node", "left_anti")
    found = stored(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above")), "paths")
    for k, level in enumerate(levels):
        step = found.join(level, "node").select("leaf", F.col("up").alias("node"), (F.col("above") + F.lit(1 << k).cast("long")).alias("above"))
        found = stored(found.unionByName(step), "paths")
    total = found.groupBy("leaf").agg(F.max("above").alias("most"))
    return found.join(total, "leaf").select("leaf", "node", (F.col("most") - F.col("above")).alias("depth"))


def ranked(found: DataFrame, scores: DataFrame, tree: DataFrame) -> DataFrame:
    """tree, leaf, score, rank: branches by mean score of their nodes (null scores count 0), best first, ties by leaf.

    ``scores`` has node, score; ``tree`` has node, tree.
    """
    by_leaf = found.join(scores, "node", "left").groupBy("leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    placed = by_leaf.join(tree.select(F.col("node").alias("leaf"), "tree"), "leaf")
    return placed.select("tree", "leaf", "score", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")).alias("rank"))


def formatted(turns: DataFrame, key: list[str]) -> DataFrame:
    """``key`` columns, n_turns, text, mask (array of start, end) from turns with depth, role, text.

    The turns of one conversation meet in one row, as its text does.
    """
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    opened = F.when(role == "user", "[INST]").when(role == "assistant", "[ASST]").otherwise(F.concat(F.lit("[ROLE "), escaped(role), F.lit("]")))
    closed = F.when(role == "user", "[/INST]").when(role == "assistant", "[/ASST]").otherwise("[/ROLE]")
    rows = turns.select(*key, "depth", opened.alias("o"), text.alias("t"), closed.alias("c"), (role == "assistant").alias("learn"))
    before = Window.partitionBy(*key).orderBy("depth", "o", "t", "c").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(3) + F.coalesce(F.sum(F.length("o") + F.length("t") + F.length("c")).over(before), F.lit(0)) + F.length("o")
    part = F.struct("depth", "o", "t", "c", start.cast("int").alias("start"), "learn")
    per = rows.select(*key, part.alias("part")).groupBy(*key).agg(F.array_sort(F.collect_list("part")).alias("ps"))
    per = per.select(*key, "ps", F.expr("concat('<s>', array_join(transform(ps, p -> concat(p.o, p.t, p.c)), ''), '</s>')").alias("text"))
    mask = F.expr("transform(filter(ps, p -> p.learn), p -> named_struct('start', p.start, 'end', p.start + length(p.t)))")
    return per.select(*key, F.size("ps").cast("long").alias("n_turns"), "text", mask.alias("mask"))


TURN = re.compile(r"\[(INST|ASST|ROLE)([^\]]*)\]([^\[]*)\[/\1\]")


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; raises if anything else is in it."""
    if not (text.startswith("<s>") and text.endswith("</s>")):
        raise ValueError("no conversation")
    turns, at = [], 3
    while at < len(text) - 4:
        m = TURN.match(text, at, len(text) - 4)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append(({"INST": "user", "ASST": "assistant"}.get(m[1]) or unescaped(m[2][1:]), unescaped(m[3])))
        at = m.end()
    return turns


def read_back(conversations: DataFrame, key: str) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, taken from the formatted text and its mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, mask in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = parsed(text)
                loss = "".join(unescaped(text[m["start"] : m["end"]]) for m in mask)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = conversations.schema[key].dataType.simpleString()
    return conversations.select(key, "text", "mask").mapInArrow(run, f"{key} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def as_trees(turns: DataFrame) -> DataFrame:
    """node, parent, conv_id, role, text: each turn replies to the one before it.

    Node ids are given once and written, as later rounds must agree on them; the
    chain of a conversation is one window, the unit that its output row has too.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(rows.withColumn("node", F.monotonically_increasing_id()), "turns")
    before = F.lag("node").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text", "node"))
    return rows.select("node", before.alias("parent"), "conv_id", "role", "text")


def conversations(turns: DataFrame, best: int = 1) -> DataFrame:
    """conv_id, n_turns, text, mask: the ``best`` branches of every conversation, ranked by the share of long replies.

    A conversation without side branches has one path, all its turns.
    """
    nodes = stored(as_trees(turns), "nodes")
    found = stored(paths(nodes.select("node", "parent")), "found")
    scores = nodes.select("node", F.least(F.length("text") / 1000.0, F.lit(1.0)).alias("score"))
    chosen = ranked(found, scores, nodes.select("node", F.col("conv_id").alias("tree"))).where(F.col("rank") <= best)
    turns_of = found.join(chosen.select("leaf", "rank"), "leaf").join(nodes.select("node", "conv_id", "role", "text"), "node")
    return formatted(turns_of, ["conv_id", "leaf"]).drop("leaf")


def with_control_text(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The table and conversation -1, whose texts look like another template's control strings."""
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(own)

"""Trees as edge tables: reading Newick, ancestors, most recent common ancestors, monophyly, support of splits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\[[^\]]*\])|('(?:[^']|'')*')|([(),;])|:\s*([-+0-9.eE]+)|([^\s(),:;\[\]']+))")


def parse_newick(text: str) -> list[tuple[int, int | None, str | None, float | None, float | None]]:
    """(node, parent, label, length, support) of one tree, root first; numeric labels of inner nodes are supports."""
    nodes: list[list] = [[None, None, None, None]]
    at, inner = 0, set()
    for m in TOKEN.finditer(text):
        comment, quoted, sign, length, bare = m.groups()
        if sign == "(":
            inner.add(at)
            nodes.append([at, None, None, None])
            at = len(nodes) - 1
        elif sign == ",":
            nodes.append([nodes[at][0], None, None, None])
            at = len(nodes) - 1
        elif sign == ")":
            at = nodes[at][0]
        elif sign == ";":
            break
        elif length is not None:
            nodes[at][2] = float(length)
        elif quoted or bare:
            label = quoted[1:-1].replace("''", "'") if quoted else bare
            if at in inner and re.fullmatch(r"[0-9.]+", label):
                support = float(label)
                nodes[at][3] = support / 100 if support > 1 else support
            else:
                nodes[at][1] = label
    return [(i, p, label, length, support) for i, (p, label, length, support) in enumerate(nodes)]


def edges(trees: DataFrame) -> DataFrame:
    """tree, node, parent, label, length, support of Newick texts (``tree``, ``newick``); a null text has no nodes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(t, *n) for t, text in zip(part["tree"], part["newick"]) if text for n in parse_newick(text)]
            yield pd.DataFrame(rows, columns=["tree", "node", "parent", "label", "length", "support"]).astype({"parent": "Int64"})

    kind = trees.schema["tree"].dataType.simpleString()
    return trees.select("tree", "newick").mapInPandas(run, f"tree {kind}, node int, parent int, label string, length double, support double")


def ancestors(edge_table: DataFrame, most_depth: int = 10_000) -> DataFrame:
    """tree, node, ancestor, steps: every node with itself and all nodes above it."""
    edge_table.createOrReplaceTempView("popspark_edges")
    return edge_table.sparkSession.sql(
        f"""WITH RECURSIVE up(tree, node, ancestor, steps) MAX RECURSION LEVEL {most_depth} AS (
        SELECT tree, node, node, 0 FROM popspark_edges
        UNION ALL SELECT u.tree, u.node, e.parent, u.steps + 1 FROM up AS u JOIN popspark_edges AS e ON e.tree = u.tree AND e.node = u.ancestor WHERE e.parent IS NOT NULL)
        SELECT * FROM up"""
    )


def tip_counts(edge_table: DataFrame) -> DataFrame:
    """tree, node, tips, depth."""
    up = ancestors(edge_table)
    inner = edge_table.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    tips = edge_table.select("tree", "node").join(inner, ["tree", "node"], "left_anti")
    below = up.join(tips, ["tree", "node"]).groupBy("tree", F.col("ancestor").alias("node")).agg(F.count("*").alias("tips"))
    depth = up.groupBy("tree", "node").agg(F.max("steps").alias("depth"))
    return below.join(depth, ["tree", "node"])


def common_ancestors(edge_table: DataFrame, groups: DataFrame) -> DataFrame:
    """tree, grp, node, monophyletic: the deepest node above all labels of each group (``grp``, ``label``)."""
    up = ancestors(edge_table)
    members = edge_table.join(groups, "label").select("tree", "grp", "node")
    size = members.groupBy("tree", "grp").agg(F.count("*").alias("n"))
    shared = members.join(up, ["tree", "node"]).groupBy("tree", "grp", F.col("ancestor").alias("node")).agg(F.count("*").alias("k"))
    counted = shared.join(size, ["tree", "grp"]).where("k = n").join(tip_counts(edge_table), ["tree", "node"])
    best = counted.groupBy("tree", "grp").agg(F.max(F.struct("depth", "node", (F.col("tips") == F.col("n")).alias("mono"))).alias("m"))
    return best.select("tree", "grp", "m.node", F.col("m.mono").alias("monophyletic"))


def split_support(replicates: DataFrame) -> DataFrame:
    """split, support: share of the trees of ``edges`` that hold each split, written as the sorted labels of the side without the first label."""
    up = ancestors(replicates)
    tips = replicates.where("label IS NOT NULL").select("tree", "node", "label")
    first = tips.agg(F.min("label").alias("first"))
    n = tips.groupBy("tree").agg(F.collect_set("label").alias("all"))
    sides = tips.join(up, ["tree", "node"]).groupBy("tree", "ancestor").agg(F.collect_set("label").alias("side")).join(n, "tree").crossJoin(F.broadcast(first))
    split = F.array_sort(F.when(F.array_contains("side", F.col("first")), F.array_except("all", "side")).otherwise(F.col("side")))
    named = sides.select("tree", split.alias("s"), F.size("all").alias("n")).where((F.size("s") > 1) & (F.size("s") < F.col("n") - 1)).select("tree", F.array_join("s", ",").alias("split")).distinct()
    total = replicates.select("tree").distinct().agg(F.count("*").alias("total"))
    return named.groupBy("split").agg(F.count("*").alias("k")).crossJoin(F.broadcast(total)).select("split", (F.col("k") / F.col("total")).alias("support"))

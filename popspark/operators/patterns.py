"""Alignments as site patterns: columns that agree in every sequence are one, with a weight.

Distances and replicates over sites then work on patterns. A bootstrap replicate draws as many sites as
there are with replacement, so it only changes the weights: how many draws a chunk of patterns gets is
binomial, halving the chunks down to one, and inside its chunk they are multinomial. Partial
sums of chunks add up.

Pairs of sequences are compared block by block as matrices: a row per sequence, patterns as columns, one
product for the places where both have a base, one for equal bases, one for equal classes (purines).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popspark.operators.permutation import CHUNKS, GROUPS, rng
from popspark.plans.compose import query, step
from popspark.plans.working import kept

#: Patterns of a chunk (about), sequences of a block (about).
PATTERNS, BLOCK = 1024, 512
BASES = "ACGT"

#: A pattern's key adds up what sequence and base say, in any order; so no task gathers a column. Bases other than the four are one.
step("known_bases", "SELECT ind, pop, site, CASE WHEN base IN ('A', 'C', 'G', 'T') THEN base ELSE '-' END AS base FROM sites")
step("column_keys", "SELECT site, $pattern(ind ; base)$ AS pattern, count(DISTINCT base) AS kinds, count(CASE WHEN base = '-' THEN 1 END) AS gaps, count(*) AS rows_here FROM known_bases GROUP BY site")
step("patterns", "SELECT min(site) AS site, count(*) AS weight, max(kinds) AS kinds, max(gaps) AS gaps FROM column_keys GROUP BY pattern, rows_here")
query("site_patterns", "SELECT site, weight, kinds, gaps FROM patterns")


def weights(w: np.ndarray, sizes: np.ndarray, chunk: int, replicates: int, total: int, *key) -> np.ndarray:
    """replicates x patterns of ``chunk``: weights when ``total`` sites are drawn; ``sizes`` are the sites of each chunk."""
    n = np.full(replicates, total, np.int64)
    low, high = 0, len(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        all_, left = sizes[low:high].sum(), sizes[low:mid].sum()
        draw = rng("half", *key, low, high).binomial(n, left / all_ if all_ else 0.0)
        if chunk < mid:
            n, high = draw, mid
        else:
            n, low = n - draw, mid
    return rng("sites", *key, chunk).multinomial(n, w / w.sum())


def bootstrap_dxy(sites: DataFrame, patterns: DataFrame, replicates: int = 1000) -> DataFrame:
    """p1, p2, dxy, dxy_low, dxy_high, da, da_low, da_high: 95 % intervals by drawing sites, where all sequences have a base.

    ``patterns``: site (of one column), weight, gaps.
    """
    spark = sites.sparkSession
    whole = kept(patterns.where("gaps = 0").select("site", "weight"))
    size = whole.agg(F.count("*").alias("n"), F.sum("weight").alias("sites")).first()
    chunks = max(1, min(CHUNKS, size.n // PATTERNS))
    pops = [x["pop"] for x in sites.select("pop").distinct().orderBy("pop").collect()]
    kind = sites.schema["pop"].dataType.simpleString()
    schema = f"p1 {kind}, p2 {kind}, dxy double, dxy_low double, dxy_high double, da double, da_low double, da_high double"
    if not size.n:
        return spark.createDataFrame([], schema)
    numbers = spark.createDataFrame(list(enumerate(pops)), f"p int, pop {kind}")
    held = whole.withColumn("chunk", F.pmod(F.xxhash64("site"), F.lit(chunks)).cast("int"))
    sizes = np.zeros(chunks, np.int64)
    for x in held.groupBy("chunk").agg(F.sum("weight").alias("w")).collect():
        sizes[x["chunk"]] = x["w"]
    parts = max(1, min(replicates, GROUPS // chunks))
    counts = sites.join(held, "site").join(numbers, "pop").groupBy("chunk", "site", "weight", "p", "base").agg(F.count("*").alias("n"))
    units = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    width, total = len(pops), int(size.sites)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        chunk, part = (k.as_py() for k in key)
        names, place = np.unique(rows["site"].to_numpy(), return_inverse=True)
        w = np.zeros(len(names), np.int64)
        w[place] = rows["weight"].to_numpy()
        f = np.zeros((len(names), width, 4))
        base = np.array([BASES.index(b) for b in rows["base"].to_pylist()])
        f[place, rows["p"].to_numpy(), base] = rows["n"].to_numpy()
        n = f.sum(axis=2)
        both = n[:, :, None] * n[:, None, :]
        pairs = both - np.eye(width) * n[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(pairs > 0, (both - f @ f.transpose(0, 2, 1)) / pairs, np.nan).reshape(len(names), -1)
        mine = np.arange(part, replicates, parts)
        sums = weights(w, sizes, chunk, len(mine), total, "dxy", part) @ d
        b = [*([0] if part == 0 else []), *(int(x) + 1 for x in mine)]
        sums = np.vstack([w[None] @ d, sums]) if part == 0 else sums
        return pa.table({"b": pa.array(b, pa.int32()), "sums": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    made = units.repartition(GROUPS, "chunk", "part").groupBy("chunk", "part").applyInArrow(run, "b int, sums array<double>")
    d = made.select("b", F.posexplode("sums").alias("k", "v")).groupBy("b", "k").agg((F.sum("v") / total).alias("d"))
    d = kept(d.select("b", (F.col("k") / width).cast("int").alias("x"), (F.col("k") % width).alias("y"), "d"))
    own = d.where("x = y").select("b", "x", F.col("d").alias("own"))
    across = d.where("x < y").join(own, ["b", "x"]).join(own.toDF("b", "y", "other"), ["b", "y"])
    # A population of one sequence has no distances within; da needs them.
    value = across.select("b", "x", "y", "d", F.when(~F.isnan("own") & ~F.isnan("other"), F.greatest(F.lit(0.0), F.col("d") - (F.col("own") + F.col("other")) / 2)).alias("da"))

    def of(c: str, name: str) -> list:
        drawn = F.when(F.col("b") > 0, F.col(c))
        return [F.max(F.when(F.col("b") == 0, F.col(c))).alias(name), F.percentile(drawn, 0.025).alias(f"{name}_low"), F.percentile(drawn, 0.975).alias(f"{name}_high")]

    out = value.groupBy("x", "y").agg(*of("d", "dxy"), *of("da", "da"))
    return out.join(numbers.toDF("x", "p1"), "x").join(numbers.toDF("y", "p2"), "y").select("p1", "p2", "dxy", "dxy_low", "dxy_high", "da", "da_low", "da_high")


def sequence_distances(sites: DataFrame, patterns: DataFrame, every: int = 1) -> DataFrame:
    """i, j, compared, p, k2p of pairs of sequences, sites left out pair by pair; i is a sequence whose id ``every`` divides, j any other (of two such, j > i).

    p is null and k2p 0 where no site can be compared; k2p is 3 where its formula has no value.
    """
    listed = kept(patterns.select("site", "weight", (F.col("gaps") == 0).alias("clean"), "kinds"))
    # Columns of one base that all have add to every comparison.
    plain = listed.where("clean AND kinds = 1").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).first().n
    used = listed.where("NOT (clean AND kinds = 1)").select("site", "weight").withColumn("k", F.row_number().over(Window.orderBy("site")) - 1)
    code = F.when(F.col("base").isin(*BASES), F.array_position(F.array(*map(F.lit, BASES)), F.col("base"))).otherwise(0).cast("int")
    own = sites.join(used, "site", "left").groupBy("ind").agg(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", code.alias("c"), "weight"))).alias("own"))
    inds = kept(own)
    wanted = F.pmod("ind", F.lit(every)) == 0
    # Those asked are few, so they have blocks of their own, and every other block is read once for each of these.
    tall, wide = (max(1, -(-x.count() // BLOCK)) for x in (inds.where(wanted), inds))
    block = lambda n: F.pmod(F.xxhash64("ind"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = inds.where(wanted).select("ind", "own", block(tall).alias("x"), each(wide).alias("y"))
    others = inds.select("ind", "own", block(wide).alias("y"), each(tall).alias("x"))
    kind = sites.schema["ind"].dataType.simpleString()

    def coded(rows: pa.Table) -> tuple[np.ndarray, ...]:
        own = rows["own"].combine_chunks()
        flat = own.flatten()
        return pc.list_parent_indices(own).to_numpy(), *(flat.field(f).to_numpy() for f in ("k", "c", "weight"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        sides = [coded(t) for t in (a, b)]
        width = 1 + max(int(k.max(initial=-1)) for _, k, _, _ in sides)
        w = np.zeros(width)
        x, y = (np.zeros((t.num_rows, width), np.int8) for t in (a, b))
        for m, (row, k, c, weight) in zip((x, y), sides, strict=True):
            m[row, k], w[k] = c, weight
        i, j = (np.array(t["ind"].to_pylist()) for t in (a, b))
        compared = plain + ((x > 0) * w) @ (y > 0).T
        same = plain + sum(((x == c) * w) @ (y == c).T for c in (1, 2, 3, 4))
        like = plain + sum((np.isin(x, c) * w) @ np.isin(y, c).T for c in ((1, 3), (2, 4)))
        r, c = np.nonzero((i[:, None] < j[None]) | ((j % every != 0)[None] & (i[:, None] != j[None])))
        n, s, l = compared[r, c], same[r, c], like[r, c]
        with np.errstate(divide="ignore", invalid="ignore"):
            p, q = (l - s) / n, (n - l) / n
            u, v = 1 - 2 * p - q, 1 - 2 * q
            k2p = np.where((u > 0) & (v > 0), -0.5 * np.log(u) - 0.25 * np.log(v), 3.0)
        none = n == 0
        return pa.table({"i": i[r], "j": j[c], "compared": n.astype(np.int64), "p": pa.array(p + q, mask=none), "k2p": np.where(none, 0.0, k2p) + 0.0})

    met = asked.groupBy("x", "y").cogroup(others.toDF("ind", "own", "of_y", "of_x").groupBy("of_x", "of_y"))
    empty = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("compared", pa.int64()), ("p", pa.float64()), ("k2p", pa.float64())]).empty_table()
    return met.applyInArrow(lambda a, b: run(a, b) if a.num_rows and b.num_rows else empty, f"i {kind}, j {kind}, compared bigint, p double, k2p double")

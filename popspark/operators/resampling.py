"""Mantel, bootstrap and EM operators; ``permutation`` has the tests that shuffle individuals and gene copies.

A group (population and locus, or one matrix) is one task's work; replicates of large
tests are dealt to tasks in numbered chunks. Random numbers are seeded by the group's or
the chunk's own key, so results don't depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popspark.operators import permutation
from popspark.operators.permutation import permuted_theta, rng  # noqa: F401


def hwe_exact(geno: DataFrame, replicates: int = 1000) -> DataFrame:
    """``permutation.hwe_exact`` of individuals' genotypes, which are counted first."""
    a, b = F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b")
    return permutation.hwe_exact(geno.groupBy("pop", "locus", a, b).agg(F.count("*").alias("n")), replicates)


def null_alleles_em(genotypes: DataFrame) -> DataFrame:
    """pop, locus, r: frequency of a null allele by EM; apparent homozygotes may hide one.

    ``genotypes`` has pop, locus, a <= b, n. Cells with under two alleles or five individuals have none.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        pop, locus, n = part["pop"].iloc[0], part["locus"].iloc[0], int(part["n"].sum())
        codes, names = pd.factorize(pd.concat([part["a"], part["b"]]), sort=True)
        k, c = len(names), part["n"].to_numpy(float)
        if k < 2 or n < 5:
            return pd.DataFrame({"pop": [pop], "locus": [locus], "r": [np.nan]})
        a, b = codes[: len(part)], codes[len(part) :]
        p = np.bincount(np.concatenate([a, b]), weights=np.concatenate([c, c]), minlength=k) / (2 * n)
        hom, het = a == b, a != b
        ho, he = c[het].sum() / n, 1 - (p**2).sum()
        r = min(0.5, max(0.01, (he - ho) / (1 + he)))
        p = p * (1 - r)
        fixed = np.bincount(np.concatenate([a[het], b[het]]), weights=np.concatenate([c[het], c[het]]), minlength=k)
        same = np.bincount(a[hom], weights=c[hom], minlength=k)
        for _ in range(5000):
            part_null = np.where(p > 0, 2 * r / np.maximum(p + 2 * r, 1e-300), 0)
            new_p = (fixed + same * (2 - part_null)) / (2 * n)
            new_r = (same * part_null).sum() / (2 * n)
            done = abs(new_r - r) < 1e-10
            p, r = new_p, new_r
            if done:
                break
        return pd.DataFrame({"pop": [pop], "locus": [locus], "r": [float(r)]})

    kinds = {c: genotypes.schema[c].dataType.simpleString() for c in ("pop", "locus")}
    return genotypes.groupBy("pop", "locus").applyInPandas(run, f"pop {kinds['pop']}, locus {kinds['locus']}, r double")


def replicate_chunks(df: DataFrame, replicates: int, per_chunk: int) -> DataFrame:
    """(chunk, first, count) rows; the data they work on are small summaries, broadcast by the caller."""
    spark = df.sparkSession
    n = -(-replicates // per_chunk)
    return spark.range(0, n, 1, n).select(F.col("id").cast("int").alias("chunk"), (F.col("id") * per_chunk).alias("first"), F.least(F.lit(per_chunk), F.lit(replicates) - F.col("id") * per_chunk).cast("int").alias("count"))


def mantel(pairs: DataFrame, replicates: int = 999, per_chunk: int = 100, most_labels: int = 2000) -> DataFrame:
    """r, p, n: Mantel test of the distances ``x`` and ``y`` of pairs (p1, p2); labels of y are shuffled.

    A matrix needs all its labels at once, so it is sent to the tasks; over ``most_labels`` labels it is refused.
    """
    labels = sorted({v for row in pairs.select("p1", "p2").limit(most_labels * most_labels).collect() for v in row})
    if len(labels) > most_labels:
        raise ValueError(f"over {most_labels} labels")
    place = {v: i for i, v in enumerate(labels)}
    x = np.full((len(labels), len(labels)), np.nan)
    y = x.copy()
    for row in pairs.select("p1", "p2", "x", "y").collect():
        i, j = place[row["p1"]], place[row["p2"]]
        x[i, j] = x[j, i] = np.nan if row["x"] is None else row["x"]
        y[i, j] = y[j, i] = np.nan if row["y"] is None else row["y"]
    upper = np.triu_indices(len(labels), 1)

    def r_of(order: np.ndarray) -> float:
        u, v = x[upper], y[np.ix_(order, order)][upper]
        ok = np.isfinite(u) & np.isfinite(v)
        return float(np.corrcoef(u[ok], v[ok])[0, 1]) if ok.sum() > 2 else np.nan

    seen = r_of(np.arange(len(labels)))

    def run(parts):
        for part in parts:
            out = []
            for chunk, count in zip(part["chunk"], part["count"]):
                g = rng("mantel", int(chunk))
                out.append(sum(r_of(g.permutation(len(labels))) >= seen - 1e-12 for _ in range(int(count))))
            yield pd.DataFrame({"ge": out})

    counted = replicate_chunks(pairs, replicates, per_chunk).mapInPandas(run, "ge bigint")
    return counted.agg(F.lit(seen).alias("r"), ((F.sum("ge") + 1) / (replicates + 1)).alias("p"), F.lit(len(labels)).cast("long").alias("n"))


def bootstrap_loci(parts: DataFrame, numerator: str, denominator: str, replicates: int = 1000) -> DataFrame:
    """low, high: 95 % interval of sum(numerator) / sum(denominator) when loci are drawn with replacement.

    Each replicate draws as many loci as there are, by a hash of replicate and draw.
    """
    loci = numbered(parts.select("locus", F.col(numerator).alias("u"), F.col(denominator).alias("v")), [], F.xxhash64("locus"), "locus").select("k", "u", "v")
    n = loci.count()
    draws = parts.sparkSession.range(replicates).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    drawn = draws.select("b", (F.pmod(F.xxhash64("b", "i", F.lit(7)), F.lit(n)) + 1).alias("k"))
    value = drawn.join(loci, "k").groupBy("b").agg((F.sum("u") / F.sum("v")).alias("t"))
    return value.agg(F.percentile("t", 0.025).alias("low"), F.percentile("t", 0.975).alias("high"))


def numbered(rows: DataFrame, keys: list[str], h: Column, tie: str = "ind") -> DataFrame:
    """``rows`` with k, numbers from 1 within ``keys`` by the hash ``h`` and ``tie``: row numbers within ranges of the hash, after the counts of the ranges before."""
    rows = rows.withColumn("_h", h).withColumn("_part", F.shiftright(F.col("_h"), 56))
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy(*keys, "_part").count().select(*keys, "_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h", tie))
    return rows.join(ranges, [*keys, "_part"]).withColumn("k", F.col("_before") + place).drop("_h", "_part", "_before")

"""Index of association and correlations of loci, exactly as their SQL defines them, without pairs of individuals.

What a pair of individuals adds depends on their classes at a locus alone (their genotypes there, or none).
So sums over pairs follow from how often classes of two loci meet in one individual: with N these counts and
F, G what pairs of classes add at either locus, the sum of products over pairs is half of sum(N * (F N G)) less what
individuals would add with themselves. A task holds the classes of two loci of one population.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.operators.permutation import GROUPS
from popspark.plans.working import kept


def _met(classes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that pairs of classes make, sums of their distances and of the squares; a genotype is (low, high), null equals nothing."""

    def apart(x: dict, y: dict) -> int:
        u, v = (x["low"], x["high"]), (y["low"], y["high"])
        if u[0] is None or v[0] is None:
            return 2
        return 0 if u == v else 1 if set(u) & set(v) else 2

    r, s, q = np.zeros((3, len(classes), len(classes)))
    for a, x in enumerate(classes):
        for b, y in enumerate(classes[: a + 1]):
            d = [apart(g, h) for g in x for h in y]
            for to, v in ((r, len(d)), (s, sum(d)), (q, sum(k * k for k in d))):
                to[a, b] = to[b, a] = v
    return r, s, q


def _alone(n: np.ndarray, f: np.ndarray) -> float:
    """Sum over pairs of individuals at one locus."""
    return float(n @ f @ n - n @ np.diag(f)) / 2


def _locus(classes: list, n: np.ndarray, people: int) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """Numbers of the classes, no data last, and what pairs add; None where no pair has data. Pairs without data take the mean."""
    n = np.append(n, people - n.sum()).astype(float)
    made = [np.pad(v, (0, 1)) for v in _met(classes)]
    rows = _alone(n, made[0])
    if rows == 0:
        return n, None
    mean = _alone(n, made[1]) / rows
    for v, fill in zip(made, (1, mean, mean * mean), strict=True):
        v[-1, :] = v[:, -1] = fill
    return n, made


def _sums(rows: pa.Table) -> dict:
    """Sums over pairs of individuals for two loci (or one with itself)."""
    items, people = rows.to_pylist(), rows["people"][0].as_py()
    sides = []
    for c, other in (("x", "y"), ("y", "x")):
        of = {}
        for k in items:
            if k[other] is None and k[c] is not None:
                of[repr(k[c])] = (k[c], k["n"])
        sides.append((list(of), *_locus([v[0] for v in of.values()], np.array([v[1] for v in of.values()], float), people)))
    (left, n1, f), (right, n2, g) = sides
    out = {"n": 0.0, "x": None, "y": None, "xx": None, "yy": None, "xy": None}
    if f is None or g is None:
        return out
    if items[0]["l1"] == items[0]["l2"]:
        # One locus: its rows, their sum and sum of squares, and the squares of the sums by pair.
        return out | {"n": _alone(n1, f[0]), "x": _alone(n1, f[1]), "xx": _alone(n1, f[2]), "xy": _alone(n1, f[1] ** 2)}
    at, to = ({k: i for i, k in enumerate(v)} for v in (left, right))
    m = np.zeros((len(left) + 1, len(right) + 1))
    for k in items:
        if k["x"] is not None and k["y"] is not None:
            m[at[repr(k["x"])], to[repr(k["y"])]] = k["n"]
    m[:-1, -1] = n1[:-1] - m[:-1].sum(axis=1)
    m[-1] = n2 - m[:-1].sum(axis=0)

    def over(u: np.ndarray, v: np.ndarray) -> float:
        return float((m * (u @ m @ v)).sum() - np.diag(u) @ m @ np.diag(v)) / 2

    return {"n": over(f[0], g[0]), "x": over(f[1], g[0]), "y": over(f[0], g[1]), "xx": over(f[2], g[0]), "yy": over(f[0], g[2]), "xy": over(f[1], g[1])}


def sums(geno: DataFrame) -> DataFrame:
    """pop, l1, l2 (l1 <= l2), people, n (rows), x, y, xx, yy, xy: sums over the pairs of a population of the distances at two loci."""
    geno = geno.where("pop IS NOT NULL AND ind IS NOT NULL")
    people = geno.groupBy("pop").agg(F.countDistinct("ind").alias("people")).where("people > 1")
    genotype = F.struct(F.least("a1", "a2").alias("low"), F.greatest("a1", "a2").alias("high"))
    own = kept(geno.where("locus IS NOT NULL").groupBy("pop", "ind", "locus").agg(F.array_sort(F.collect_list(genotype)).alias("class")))
    packed = own.groupBy("pop", "ind").agg(F.array_sort(F.collect_list(F.struct("locus", "class"))).alias("own"))
    first = packed.select("pop", "own", F.explode("own").alias("a"))
    met = first.select("pop", "a", F.explode(F.filter("own", lambda b: b["locus"] > F.col("a.locus"))).alias("b"))
    both = met.groupBy("pop", F.col("a.locus").alias("l1"), F.col("b.locus").alias("l2"), F.col("a.class").alias("x"), F.col("b.class").alias("y")).agg(F.count("*").alias("n"))
    each = kept(own.groupBy("pop", "locus", "class").agg(F.count("*").alias("n")))
    loci = each.select("pop", "locus").distinct()
    l1, l2 = loci.toDF("pop", "l1"), loci.toDF("pop", "l2")
    pairs = kept(l1.join(l2, "pop").where("l1 <= l2"))
    none = F.lit(None).cast(own.schema["class"].dataType)
    left = pairs.join(each.toDF("pop", "l1", "x", "n"), ["pop", "l1"]).select("pop", "l1", "l2", "x", none.alias("y"), "n")
    right = pairs.join(each.toDF("pop", "l2", "y", "n"), ["pop", "l2"]).select("pop", "l1", "l2", none.alias("x"), "y", "n")
    rows = both.unionByName(left).unionByName(right).join(people, "pop")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("pop", "l1", "l2")}
    names = ["n", "x", "y", "xx", "yy", "xy"]

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        got = _sums(group)
        fixed = {c: pa.array([k.as_py()], k.type) for c, k in zip(("pop", "l1", "l2"), key, strict=True)}
        return pa.table(fixed | {"people": pa.array([group["people"][0].as_py()], pa.int64())} | {c: pa.array([got[c]], pa.float64()) for c in names})

    fields = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), "people bigint", *(f"{c} double" for c in names)])
    return rows.repartition(GROUPS, "pop", "l1", "l2").groupBy("pop", "l1", "l2").applyInArrow(run, fields)


def _rounded(c):
    return F.round(c, 6) + F.lit(0.0)


def pairwise_rd(geno: DataFrame) -> DataFrame:
    """pop, l1, l2, rd: the correlation of two loci's distances over the pairs of a population."""
    n, x, y, xx, yy, xy = (F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy"))
    u, v = xx - x * x / n, yy - y * y / n
    # What rounding leaves of a spread of none.
    spread = F.when((u > 1e-12 * xx) & (v > 1e-12 * yy), F.sqrt(u * v))
    return sums(geno).where("l1 < l2").select("pop", "l1", "l2", F.when(n > 0, _rounded((xy - x * y / n) / spread)).alias("rd"))


def index_of_association(geno: DataFrame) -> DataFrame:
    """pop, ia, rd: the spread of pairs' distances over all loci against those of the loci."""
    made = kept(sums(geno))
    n, x, xx = F.col("n"), F.col("x"), F.col("xx")
    var = F.when(n > 1, F.greatest(F.lit(0.0), xx - x * x / n) / (n - 1))
    by_locus = made.where("l1 = l2").withColumn("v", var)
    root = F.sum(F.sqrt("v"))
    loci = by_locus.groupBy("pop", "people").agg(F.sum("v").alias("ve"), ((root * root - F.sum("v")) / 2).alias("cross_v"), F.sum("x").alias("x"), F.sum("xy").alias("own"))
    cross = made.where("l1 < l2").groupBy("pop").agg(F.sum("xy").alias("cross"))
    m = F.col("people") * (F.col("people") - 1) / 2
    vd = F.when(m > 1, (F.col("own") + 2 * F.coalesce("cross", F.lit(0.0)) - x * x / m) / (m - 1))
    all_ = loci.join(cross, "pop", "left").withColumn("vd", vd)
    ia = F.col("vd") / F.nullif("ve", F.lit(0.0)) - 1
    rd = (F.col("vd") - F.col("ve")) / F.nullif(2 * F.col("cross_v"), F.lit(0.0))
    return all_.select("pop", _rounded(ia).alias("ia"), _rounded(rd).alias("rd"))

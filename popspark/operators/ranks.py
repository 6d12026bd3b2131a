"""Rank tests and intervals over ordered values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popspark.functions.special import normal_p

#: Differences up to which the signed-rank distribution is counted out, and at least.
EXACT, LEAST = 20, 4
#: Ranges that the values of one group are ranked in.
RANGES = 256


def signed_rank(diffs: DataFrame) -> DataFrame:
    """key, n, w, p_excess, p_deficit, p_two of Wilcoxon's signed-rank test; ``diffs``: key, v.

    Zeros and nulls don't count, ties share a rank. Up to ``EXACT`` differences the number of sign patterns of every rank
    sum is counted in a table that a fold over the ranks carries; beyond, the normal approximation holds.
    Under ``LEAST`` differences the p values are null.
    """
    size = Window.partitionBy("key", F.abs("v"))
    # Twice the rank, so that shared ranks are whole.
    twice = 2 * F.rank().over(Window.partitionBy("key").orderBy(F.abs("v"))) + F.count("*").over(size) - 1
    ranked = diffs.where("v <> 0 AND NOT isnan(v)").select("key", "v", twice.cast("int").alias("r"))
    sums = ranked.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.when(F.col("v") > 0, F.col("r")).otherwise(0)).alias("w2"))
    few = ranked.join(sums.where(F.col("n") <= EXACT).select("key"), "key", "left_semi").groupBy("key").agg(F.collect_list("r").alias("ranks"))
    table = "aggregate(ranks, transform(sequence(0, n * (n + 1)), k -> IF(k = 0, 1L, 0L)), (acc, r) -> transform(acc, (c, k) -> c + IF(k >= r, get(acc, CAST(k - r AS INT)), 0L)))"
    both = sums.join(few, "key", "left").withColumn("d", F.when(F.col("ranks").isNotNull(), F.expr(table)))
    up = F.expr("aggregate(slice(d, CAST(w2 AS INT) + 1, size(d)), 0L, (s, c) -> s + c)") / F.pow(F.lit(2.0), "n")
    down = F.expr("aggregate(slice(d, 1, CAST(w2 AS INT) + 1), 0L, (s, c) -> s + c)") / F.pow(F.lit(2.0), "n")
    z = (F.col("w2") / 2 - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0)
    exact, enough = F.col("d").isNotNull(), F.col("n") >= LEAST
    tail = lambda x: normal_p(x)
    p = both.select("key", "n", (F.col("w2") / 2).alias("w"), F.when(exact, up).alias("_up"), F.when(exact, down).alias("_down"), tail(z).alias("_high"), tail(-z).alias("_low"), enough.alias("_enough"))
    excess, deficit = F.coalesce("_up", "_high"), F.coalesce("_down", "_low")
    return p.select("key", "n", "w", F.when(F.col("_enough"), excess).alias("p_excess"), F.when(F.col("_enough"), deficit).alias("p_deficit"), F.when(F.col("_enough"), F.least(F.lit(1.0), 2 * F.least(excess, deficit))).alias("p_two"))


def hpd(draws: DataFrame, mass: float = 0.95) -> DataFrame:
    """key, n, low, high: the shortest interval that holds ``mass`` of a key's values; the lowest of equally short ones. ``draws``: key, v.

    Values are ranked in ranges between approximate quantiles, counted on from range to range, so no task sorts a whole key.
    """
    told = draws.where("v IS NOT NULL AND NOT isnan(v)")
    cuts = told.groupBy("key").agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)]).alias("cuts"), F.count("*").alias("n"))
    held = told.join(cuts, "key").select("key", "n", "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))
    sizes = held.groupBy("key", "part").agg(F.count("*").alias("own"))
    before = sizes.select("key", "part", (F.sum("own").over(Window.partitionBy("key").orderBy("part")) - F.col("own")).alias("before"))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("v"))
    ranked = held.join(before, ["key", "part"]).select("key", "n", "v", (F.col("before") + place).alias("rank"))
    width = F.greatest(F.lit(1), F.floor(F.lit(mass) * F.col("n")))
    ends = ranked.select("key", "rank", F.col("v").alias("high"))
    spans = ranked.select("key", "n", F.col("v").alias("low"), (F.col("rank") + width - 1).alias("rank")).join(ends, ["key", "rank"])
    best = spans.groupBy("key", "n").agg(F.min(F.struct((F.col("high") - F.col("low")).alias("width"), "low", "high")).alias("s"))
    return best.select("key", "n", "s.low", "s.high")

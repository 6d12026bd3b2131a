"""Choice of the number of clusters from replicate runs, and k-means on scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evanno(runs: DataFrame) -> DataFrame:
    """k, mean, sd, l1, l2, delta_k from runs (k, lnp): second difference of the means over the sample sd."""
    per = runs.groupBy("k").agg(F.avg("lnp").alias("mean"), F.stddev_samp("lnp").alias("sd"))
    w = Window.orderBy("k")
    l1 = F.when(F.lag("k").over(w) == F.col("k") - 1, F.col("mean") - F.lag("mean").over(w))
    l2 = F.when((F.lag("k").over(w) == F.col("k") - 1) & (F.lead("k").over(w) == F.col("k") + 1), F.abs(F.lead("mean").over(w) - 2 * F.col("mean") + F.lag("mean").over(w)))
    return per.select("k", "mean", "sd", l1.alias("l1"), l2.alias("l2"), (l2 / F.when(F.col("sd") > 0, F.col("sd"))).alias("delta_k"))


def puechmaille(q: DataFrame, threshold: float = 0.5) -> DataFrame:
    """k, med_med_k, med_mean_k, max_med_k, max_mean_k: clusters that reach ``threshold`` in some population (k, run, pop, cluster, q)."""
    per_pop = q.groupBy("k", "run", "pop", "cluster").agg(F.avg("q").alias("mean"), F.percentile("q", 0.5).alias("med"))
    per_run = per_pop.groupBy("k", "run").agg(
        F.count_distinct(F.when(F.col("mean") >= threshold, F.col("cluster"))).alias("by_mean"),
        F.count_distinct(F.when(F.col("med") >= threshold, F.col("cluster"))).alias("by_med"),
    )
    return per_run.groupBy("k").agg(F.percentile("by_med", 0.5).alias("med_med_k"), F.percentile("by_mean", 0.5).alias("med_mean_k"), F.max("by_med").alias("max_med_k"), F.max("by_mean").alias("max_mean_k"))


def units_of(ages: DataFrame, units: DataFrame) -> DataFrame:
    """The rows of ``ages`` (id, age) with the finest unit (name, rank, upper, lower; larger rank is finer) that holds the age.

    Units are cut at whole numbers, so an age meets only units of its own block.
    """
    blocks = units.withColumn("block", F.explode(F.sequence(F.floor("upper"), F.floor("lower"))))
    met = ages.withColumn("block", F.floor("age")).join(blocks, "block", "left").where(F.col("name").isNull() | ((F.col("age") >= F.col("upper")) & (F.col("age") < F.col("lower"))))
    best = met.groupBy("id", "age").agg(F.max(F.struct("rank", "name")).alias("m"))
    return ages.join(best.select("id", F.col("m.name").alias("unit")).dropDuplicates(["id"]), "id", "left").select("id", "age", "unit")

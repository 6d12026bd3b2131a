"""p values of the homogeneity tests of all loci, their corrections and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popspark.functions.special import chi2_p


def _r(x: Column) -> Column:
    return F.round(x, 6) + 0.0


def tests(homogeneity: DataFrame) -> DataFrame:
    """locus, chi2, df, p; a locus without degrees of freedom (one allele or population) has no test."""
    return homogeneity.where("df > 0").select("locus", "chi2", "df", chi2_p(F.col("chi2"), F.col("df").cast("double")).alias("p"))


def genic_differentiation(homogeneity: DataFrame) -> DataFrame:
    return tests(homogeneity).select("locus", _r(F.col("chi2")).alias("chi2"), "df", _r(F.col("p")).alias("p"))


def adjusted_p(homogeneity: DataFrame) -> DataFrame:
    """locus, p, bonferroni, holm, bh, bys (Benjamini-Yekutieli) over all loci with a test."""
    up, down = Window.orderBy("p", "locus"), Window.orderBy(F.desc("p"), F.desc("locus"))
    p, m, k, one = F.col("p"), F.col("m"), F.col("k"), F.lit(1.0)
    ranked = tests(homogeneity).select("locus", "p", F.row_number().over(up).alias("k"), F.count("*").over(Window.partitionBy()).cast("double").alias("m"))
    ranked = ranked.withColumn("cm", F.sum(1.0 / k).over(Window.partitionBy()))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    return ranked.select(
        "locus",
        _r(p).alias("p"),
        _r(F.least(one, p * m)).alias("bonferroni"),
        _r(F.max(F.least(one, p * (m - k + 1))).over(up.rowsBetween(*so_far))).alias("holm"),
        _r(F.min(F.least(one, p * m / k)).over(down.rowsBetween(*so_far))).alias("bh"),
        _r(F.min(F.least(one, p * m * F.col("cm") / k)).over(down.rowsBetween(*so_far))).alias("bys"),
    )


def fisher_combined(homogeneity: DataFrame) -> DataFrame:
    return tests(homogeneity).agg(_r(-2 * F.sum(F.log(F.greatest("p", F.lit(1e-300))))).alias("chi2"), (2 * F.count("*")).alias("df"))

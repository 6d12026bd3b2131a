"""All Hardy-Weinberg tests of a data set as one family: corrected p values, summaries by population and locus, suspected null alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.functions.special import chi2_p
from popspark.operators.permutation import holm
from popspark.plans.working import kept

#: Level of a significant test, share of populations and mean frequency that make a locus suspect.
ALPHA, SHARE, FREQUENCY = 0.05, 0.5, 0.05


def hwe_family(exact: DataFrame, fis: DataFrame, nulls: DataFrame, kinds: DataFrame) -> DataFrame:
    """pop, locus, n, k, fis, p, p_holm, null_frequency of every cell; Holm's correction runs over the whole family.

    ``exact``: pop, locus, n, p; ``fis``: pop, locus, f; ``nulls``: pop, locus, r; ``kinds``: pop, locus, k.
    """
    cells = exact.select("pop", "locus", "n", "p").join(kinds, ["pop", "locus"], "left").join(fis.select("pop", "locus", F.col("f").alias("fis")), ["pop", "locus"], "left")
    cells = cells.join(nulls.select("pop", "locus", F.when(~F.isnan("r"), F.col("r")).alias("null_frequency")), ["pop", "locus"], "left")
    return kept(holm(kept(cells), "p").select("pop", "locus", "n", "k", "fis", "p", "p_holm", "null_frequency"))


def _fisher() -> Column:
    """Fisher's combination of the group's p values."""
    told = F.col("p") > 0
    return chi2_p(-2 * F.sum(F.when(told, F.log("p"))), 2.0 * F.count_if(told))


def _counts() -> list[Column]:
    low = F.col("p_holm") < ALPHA
    return [F.count_if(low).alias("n_significant"), F.count_if(low & (F.col("fis") > 0)).alias("n_deficit"), F.count_if(low & (F.col("fis") < 0)).alias("n_excess"), F.count("p").alias("n_tested"), F.avg("fis").alias("mean_fis"), F.avg("null_frequency").alias("mean_null")]


def by_population(family: DataFrame) -> DataFrame:
    """pop, cells with significant deficit or excess, their tests, mean F_IS and null frequency, Fisher's p."""
    return family.groupBy("pop").agg(*_counts(), _fisher().alias("fisher_p"))


def by_locus(family: DataFrame) -> DataFrame:
    """The same by locus, with the most alleles, the highest null frequency, and whether null alleles are suspected: a significant deficit in half of the populations and a mean frequency above ``FREQUENCY``."""
    found = family.groupBy("locus").agg(F.max("k").alias("k"), *_counts(), F.max("null_frequency").alias("max_null"), F.count("*").alias("_cells"), _fisher().alias("fisher_p"))
    suspect = (F.col("n_deficit") >= F.greatest(F.lit(1), F.ceil(SHARE * F.col("_cells")))) & (F.coalesce("mean_null", F.lit(0.0)) > FREQUENCY)
    return found.withColumn("suspect_null", suspect).drop("_cells")


def without_loci(geno: DataFrame, loci: DataFrame) -> DataFrame:
    """Genotypes of all loci but those of ``loci`` (locus)."""
    return geno.join(loci.select("locus").distinct(), "locus", "left_anti").select(*geno.columns)

"""Queries that aren't one SQL statement: resampling, ordination and trees over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.dataset import Dataset, from_tables, relation
from popspark.functions.special import chi2_p
from popspark.operators import association, family, haplotypes, matrices, multiple, neutrality, patterns, permutation, ranks, resampling, spatial, tables
from popspark.plans.compose import r, statement
from popspark.plans.working import kept


def hwe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.hwe_exact(relation(spark, sf_dir, "geno"), 1000)


def hwe_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir, "hwe_chi_square").withColumn("p", F.round(chi2_p(F.col("chi2"), F.col("df").cast("double")), 6))


def genic_differentiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.genic_differentiation(relation(spark, sf_dir, "homogeneity"))


def adjusted_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.adjusted_p(relation(spark, sf_dir, "homogeneity"))


def fisher_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.fisher_combined(relation(spark, sf_dir, "homogeneity"))


def null_alleles_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.null_alleles_em(from_tables(spark, sf_dir, "genotype_table"))


def permuted_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.permuted_theta(relation(spark, sf_dir, "geno"), 999)


def amova_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.amova_tests(relation(spark, sf_dir, "geno"), 999)


def pairwise_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.pairwise_tests(relation(spark, sf_dir, "geno"), 199)


def multilocus_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.multilocus_ld(relation(spark, sf_dir, "geno"), 999)


def pairwise_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.pairwise_ld(relation(spark, sf_dir, "geno"), 199)


def theta_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = from_tables(spark, sf_dir, "theta_by_locus").select("locus", "a", (F.col("a") + F.col("b") + F.col("c")).alias("total"))
    return resampling.bootstrap_loci(parts, "a", "total", 1000)


def mantel_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = from_tables(spark, sf_dir, "pairwise_theta"), from_tables(spark, sf_dir, "population_km")
    return resampling.mantel(x.join(y, ["p1", "p2"]).select("p1", "p2", F.col("theta").alias("x"), F.col("km").alias("y")), 999)


def fu_fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neutrality.fu_fs(from_tables(spark, sf_dir, "fu_fs_parts"))


def _nei(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir, "population_distances").select(F.lit("nei72").alias("tree"), "p1", "p2", F.greatest("nei72", F.lit(0.0)).alias("d"))


def pcoa_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.pcoa(_nei(spark, sf_dir))


def neighbour_joining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.neighbour_joining(_nei(spark, sf_dir))


def upgma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.upgma(_nei(spark, sf_dir))


def _rounded(df: DataFrame, *exact: str) -> DataFrame:
    return df.select(*(c if c in exact else (F.round(c, 6) + 0.0).alias(c) for c in df.columns))


def dxy_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.bootstrap_dxy(relation(spark, sf_dir, "sites"), relation(spark, sf_dir, "patterns"), 1000)


def sequence_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences whose id 100 divides, against all."""
    return _rounded(patterns.sequence_distances(relation(spark, sf_dir, "sites"), relation(spark, sf_dir, "patterns"), 100), "i", "j", "compared")


def _family(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = relation(spark, sf_dir, "cell_stats").select("pop", "locus", F.col("na").alias("k"))
    return family.hwe_family(hwe_exact(spark, sf_dir), from_tables(spark, sf_dir, "fis_nei_chesser"), null_alleles_em(spark, sf_dir), kinds)


def hwe_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir)


def hwe_by_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family.by_population(_family(spark, sf_dir))


def hwe_by_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family.by_locus(_family(spark, sf_dir))


def theta_without_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multilocus theta without the loci that are suspected of null alleles."""
    suspect = family.by_locus(_family(spark, sf_dir)).where("suspect_null")
    return Dataset(spark, geno=family.without_loci(relation(spark, sf_dir, "geno"), suspect)).result("theta_multilocus")


def hwe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = kept(hwe_exact(spark, sf_dir))
    kinds = relation(spark, sf_dir, "cell_stats").select("pop", "locus", F.col("na").alias("k"))
    tests = family.hwe_family(exact, from_tables(spark, sf_dir, "fis_nei_chesser"), null_alleles_em(spark, sf_dir), kinds)
    return tables.hwe_table(tests, exact, relation(spark, sf_dir, "cell_stats"))


def differentiation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.differentiation_table(pairwise_tests(spark, sf_dir), from_tables(spark, sf_dir, "pairwise_gst"), from_tables(spark, sf_dir, "pairwise_theta"))


def data_as_analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.data_as_analysed(relation(spark, sf_dir, "geno"), relation(spark, sf_dir, "places"))


def nei_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.distance_matrix(from_tables(spark, sf_dir, "population_distances"), "nei72").withColumnRenamed("name", "pop")


def correlogram_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.correlogram(spatial.genotype_scores(relation(spark, sf_dir, "geno")), relation(spark, sf_dir, "places"), 999)[0]


def kinship_slope_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.correlogram(spatial.genotype_scores(relation(spark, sf_dir, "geno")), relation(spark, sf_dir, "places"), 499)[1]


def heterozygosity_signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether expected exceeds observed heterozygosity over the loci of a population."""
    cells = relation(spark, sf_dir, "cell_stats").select(F.col("pop").alias("key"), F.round(F.col("he") - F.col("ho"), 9).alias("v"))
    return _rounded(ranks.signed_rank(cells), "key", "n").withColumnRenamed("key", "pop")


def trait_hpd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest intervals of 95 % of each trait's values."""
    return ranks.hpd(relation(spark, sf_dir, "traits").select(F.col("trait").alias("key"), "v")).withColumnRenamed("key", "trait")


def _wide(column: str, names: range, value: str, made: str) -> str:
    return ", ".join(f'min(CASE WHEN {column} = {x} THEN {v} END) AS "{n}"' for x in names for v, n in ((v.strip(), made.format(x, k)) for k, v in enumerate(value.split(","), 1)))


#: DuckDB SQL written apart from the Spark code; the tables have seven loci and 25 populations.
SQL = {
    "data_as_analysed": statement(
        f"""SELECT g.*, p.latitude, p.longitude FROM (SELECT ind AS individual, min(pop) AS population, min(region) AS region, {_wide("locus", range(1, 8), "a1, a2", "{0}_{1}")} FROM geno GROUP BY ind) AS g
        LEFT JOIN (SELECT ind, max(lat) AS latitude, max(lon) AS longitude FROM places GROUP BY ind) AS p ON p.ind = g.individual""",
        "duckdb",
    ),
    "nei_distance_matrix": statement(
        f"""SELECT x AS pop, {_wide("y", range(25), "d", "{0}")} FROM (SELECT p1 AS x, p2 AS y, round(nei72, 6) + 0e0 AS d FROM pop_distances UNION ALL SELECT p2, p1, round(nei72, 6) + 0e0 FROM pop_distances
        UNION ALL SELECT pop, pop, 0e0 FROM (SELECT DISTINCT pop FROM cells) AS c) AS m GROUP BY x""",
        "duckdb",
    ),
    "haplotype_em": haplotypes.duck_sql(),
    "sequence_distances": statement(
        f"""SELECT i, j, n AS compared, {r("(ti + tv) / nullif(n * 1e0, 0)")} AS p, {r("CASE WHEN n = 0 THEN 0e0 WHEN 1 - (2 * ti + tv) / n > 0 AND 1 - 2 * tv / n > 0 THEN -0.5e0 * ln(1 - (2 * ti + tv) / n) - 0.25e0 * ln(1 - 2 * tv / n) ELSE 3e0 END")} AS k2p
        FROM (SELECT x.ind AS i, y.ind AS j, count(CASE WHEN x.base IN ('A', 'C', 'G', 'T') AND y.base IN ('A', 'C', 'G', 'T') THEN 1 END) AS n,
        count(CASE WHEN concat(x.base, y.base) IN ('AG', 'GA', 'CT', 'TC') THEN 1 END) AS ti, count(CASE WHEN concat(x.base, y.base) IN ('AC', 'CA', 'AT', 'TA', 'GC', 'CG', 'GT', 'TG') THEN 1 END) AS tv
        FROM sites AS x JOIN sites AS y ON x.site = y.site AND x.ind % 100 = 0 AND (x.ind < y.ind OR y.ind % 100 <> 0) AND x.ind <> y.ind GROUP BY x.ind, y.ind) AS t""",
        "duckdb",
    ),
    "heterozygosity_signed_rank": statement(
        f"""SELECT pop, n, {r("w / 2")} AS w, {r("avg(CASE WHEN x >= w THEN 1e0 ELSE 0e0 END)")} AS p_excess, {r("avg(CASE WHEN x <= w THEN 1e0 ELSE 0e0 END)")} AS p_deficit,
        {r("least(1e0, 2 * least(avg(CASE WHEN x >= w THEN 1e0 ELSE 0e0 END), avg(CASE WHEN x <= w THEN 1e0 ELSE 0e0 END)))")} AS p_two
        FROM (SELECT pop, n, w, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN ranks[i] ELSE 0 END)) AS x
        FROM (SELECT *, unnest(range(0, CAST(power(2, n) AS BIGINT))) AS mask FROM signed) AS m) AS s GROUP BY pop, n, w""",
        "duckdb",
        {
            "differing": "SELECT pop, round(he - ho, 9) AS v FROM cell_stats WHERE round(he - ho, 9) <> 0",
            "signed": "SELECT pop, count(*) AS n, list(k) AS ranks, sum(CASE WHEN v > 0 THEN k ELSE 0 END) * 1e0 AS w FROM (SELECT pop, v, 2 * rank() OVER (PARTITION BY pop ORDER BY abs(v)) + count(*) OVER (PARTITION BY pop, abs(v)) - 1 AS k FROM differing) AS x GROUP BY pop HAVING count(*) BETWEEN 4 AND 20",
        },
    ),
    "trait_hpd": statement(
        """SELECT trait, n, low, high FROM (SELECT x.trait, x.n, x.v AS low, y.v AS high, row_number() OVER (PARTITION BY x.trait ORDER BY y.v - x.v, x.v) AS first
        FROM spread AS x JOIN spread AS y ON x.trait = y.trait AND y.k = x.k + greatest(1, CAST(floor(0.95e0 * x.n) AS BIGINT)) - 1) AS s WHERE first = 1""",
        "duckdb",
        {"spread": "SELECT trait, v, row_number() OVER (PARTITION BY trait ORDER BY v) AS k, count(*) OVER (PARTITION BY trait) AS n FROM traits"},
    ),
}

OTHER = {f.__name__: f for f in (hwe_exact, hwe_p_values, genic_differentiation, adjusted_p, fisher_combined, null_alleles_em, permuted_theta, amova_tests, pairwise_tests, multilocus_ld, pairwise_ld, dxy_bootstrap, sequence_distances, hwe_family, hwe_by_population, hwe_by_locus, theta_without_nulls, hwe_table, differentiation_table, data_as_analysed, nei_distance_matrix, correlogram_envelope, kinship_slope_test, heterozygosity_signed_rank, trait_hpd, theta_bootstrap, mantel_distance, fu_fs, pcoa_populations, neighbour_joining, upgma)}

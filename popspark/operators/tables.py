"""Result tables: a row per population, locus or pair with every measure that a report gives of it, and wide sheets.

Column names are told apart without case in Spark, so the inbreeding of individuals in the total is ``fit``, not F.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.plans.compose import QUERIES, query, r, step

#: Loci of a population that vary, its alleles over all loci, those of no other population, and its individuals.
step("pop_private", "SELECT pop, count(*) AS n FROM (SELECT pop, count(*) OVER (PARTITION BY locus, allele) AS k FROM allele_counts) AS x WHERE k = 1 GROUP BY pop")
step("pop_sizes", "SELECT pop, count(DISTINCT ind) AS n FROM geno GROUP BY pop")
step("pooled_cells", "SELECT a.locus, count(*) AS na, sum(CASE WHEN a.n >= 0.05e0 * t.n THEN 1 ELSE 0 END) AS na5, sum(power(a.n / (t.n * 1e0), 2)) AS s2, sum(power(a.n / (t.n * 1e0), 4)) AS s4, -sum(a.n / (t.n * 1e0) * ln(a.n / (t.n * 1e0))) AS i, max(t.n) / 2e0 AS n, max(t.ho) AS ho, max(a.n / (t.n * 1e0)) AS top FROM alleles AS a JOIN (SELECT locus, sum(n) AS n, sum(n_het) / (sum(n) * 1e0) AS ho FROM allele_counts GROUP BY locus) AS t ON t.locus = a.locus GROUP BY a.locus")
_MEANS = ("na", "na5", "ne", "i", "ho", "he", "uhe", "f", "pic", "ar")


def _summary(cells: str) -> str:
    """Means over loci with their standard errors; a locus without the measure takes no part in its mean."""
    means = ", ".join(f"{r(f'avg({c} * 1e0)')} AS {c}, {r(f'stddev_samp({c} * 1e0) / sqrt(count({c}) * 1e0)')} AS {c}_se" for c in _MEANS)
    return f"""SELECT population, {means}, CAST(sum(CASE WHEN top < 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_poly, {r("sum(CASE WHEN top < 1 THEN 1e0 ELSE 0e0 END) / count(*)")} AS p_poly, CAST(sum(na) AS BIGINT) AS total_alleles FROM ({cells}) AS c GROUP BY population"""


_DERIVED = "1 / s2 AS ne, i, ho, 1 - s2 AS he, CASE WHEN n > 1 THEN 2e0 * n / (2e0 * n - 1) * (1 - s2) ELSE 1 - s2 END AS uhe, CASE WHEN s2 < 1 THEN (1 - s2 - ho) / (1 - s2) END AS f, 1 - s2 - (s2 * s2 - s4) AS pic"
step("summary_pops", _summary(f"SELECT CAST(q.pop AS VARCHAR(99)) AS population, q.na, q.na5, {_DERIVED}, q.top, a.ar FROM cell_stats AS q JOIN richness AS a ON a.pop = q.pop AND a.locus = q.locus"))
step("summary_pooled", _summary(f"SELECT 'Pooled' AS population, na, na5, {_DERIVED}, top, CAST(NULL AS DOUBLE) AS ar FROM pooled_cells"))
query(
    "summary_table",
    """SELECT s.*, n.n, coalesce(v.n, 0) AS private_alleles FROM summary_pops AS s JOIN pop_sizes AS n ON CAST(n.pop AS VARCHAR(99)) = s.population LEFT JOIN pop_private AS v ON CAST(v.pop AS VARCHAR(99)) = s.population
    UNION ALL SELECT s.*, (SELECT count(DISTINCT ind) FROM geno) AS n, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM pop_private) AS private_alleles FROM summary_pooled AS s""",
)

_NEI = f"""{r("hs")} AS hs, {r("ht")} AS ht, {r("(ht - hs) / nullif(ht, 0)")} AS gst, {r("(ht - hs) / nullif(ht, 0) / nullif((r - 1) * (1 - hs) / (r - 1 + hs), 0)")} AS gprime_st, {r("r / (r - 1) * (ht - hs) / nullif(1 - hs, 0)")} AS jost_d"""
_WC = f"""{r("a / nullif(a + b + c, 0)")} AS theta, {r("b / nullif(b + c, 0)")} AS f, {r("(a + b) / nullif(a + b + c, 0)")} AS fit"""
step("wc_total", "SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c FROM wc_locus")
step("nei_total", "SELECT avg(hs) AS hs, avg(ht) AS ht, min(CASE WHEN first = 1 THEN r END) AS r FROM (SELECT *, row_number() OVER (ORDER BY locus) AS first FROM nei_locus) AS x")
query(
    "fstatistics_table",
    f"""SELECT CAST(n.locus AS VARCHAR(99)) AS locus, {_NEI}, {_WC} FROM nei_locus AS n LEFT JOIN wc_locus AS w ON w.locus = n.locus WHERE r >= 2
    UNION ALL SELECT 'Multilocus' AS locus, {_NEI}, {_WC} FROM nei_total CROSS JOIN wc_total""",
)


def _drift(r2: str, s: str) -> str:
    """What sampling leaves of the mean squared correlation."""
    return f"({r2} - CASE WHEN {s} >= 30 THEN 1 / {s} + 3.19e0 / ({s} * {s}) ELSE 0.0018e0 + 0.907e0 / {s} + 4.44e0 / ({s} * {s}) END)"


def _size(x: str, s: str) -> str:
    return f"CASE WHEN {x} > 0 THEN CASE WHEN {s} >= 30 THEN (1e0 / 3 + sqrt(greatest(0e0, 1e0 / 9 - 2.76e0 * {x}))) / (2 * {x}) ELSE (0.308e0 + sqrt(greatest(0e0, 0.094864e0 - 2.08e0 * {x}))) / (2 * {x}) END END"


#: Limits of the size by linkage: each locus in turn is left out with all its pairs, by taking its sums off the population's.
step("ld_sides", "SELECT pop, l1 AS locus, w, w * r2 AS wr, w / s AS ws FROM ld_locus_pairs UNION ALL SELECT pop, l2, w, w * r2, w / s FROM ld_locus_pairs")
step("ld_loci", "SELECT pop, locus, sum(w) AS w, sum(wr) AS wr, sum(ws) AS ws FROM ld_sides GROUP BY pop, locus")
step("ld_totals", "SELECT pop, sum(w) AS w, sum(w * r2) AS wr, sum(w / s) AS ws FROM ld_locus_pairs GROUP BY pop HAVING count(*) >= 3")
step("ld_left", "SELECT t.pop, (t.wr - x.wr) / (t.w - x.w) AS r2, (t.w - x.w) / (t.ws - x.ws) AS s FROM ld_totals AS t JOIN ld_loci AS x ON x.pop = t.pop WHERE t.w - x.w > 0.5e0")
step("ld_spread", f"SELECT q.pop, sqrt((m - 1e0) / m * v) AS se FROM (SELECT pop, count(*) * var_pop({_drift('r2', 's')}) AS v FROM ld_left GROUP BY pop HAVING count(*) > 2) AS q JOIN (SELECT pop, count(*) * 1e0 AS m FROM ld_loci GROUP BY pop) AS n ON n.pop = q.pop")
step("ld_sizes", f"SELECT q.pop, n_pairs, r2, s, {_drift('r2', 's')} AS x, se FROM ld_pop AS q LEFT JOIN ld_spread AS v ON v.pop = q.pop")
#: Sizes without end are null.
query(
    "effective_size_table",
    f"""SELECT n.pop, n.n, n_pairs AS locus_pairs, {r("r2")} AS mean_r2, {r("r2 - x")} AS expected_r2, {r(_size("x", "s"))} AS ne_ld, {r(_size("(x + 1.96e0 * se)", "s"))} AS ne_ld_lower, {r(_size("(x - 1.96e0 * se)", "s"))} AS ne_ld_upper,
    h.d AS het_excess_d, h.ne AS ne_het, h.ne_low AS ne_het_lower, h.ne_high AS ne_het_upper
    FROM pop_sizes AS n LEFT JOIN ld_sizes AS q ON q.pop = n.pop LEFT JOIN ({QUERIES["ne_heterozygote_excess"]}) AS h ON h.pop = n.pop WHERE q.pop IS NOT NULL OR h.pop IS NOT NULL""",
)


def _selfing(f: str) -> str:
    return f"CASE WHEN {f} > 0 THEN 2 * {f} / (1 + {f}) WHEN {f} <= 0 THEN 0e0 END"


query(
    "selfing_table",
    f"""SELECT m.pop, n.n, k.loci, m.f AS f_is, i.f_low, i.f_high, {r(_selfing("m.f"))} AS selfing_rate, {r(_selfing("i.f_low"))} AS selfing_low, {r(_selfing("i.f_high"))} AS selfing_high
    FROM ({QUERIES["fis_multilocus"]}) AS m JOIN pop_sizes AS n ON n.pop = m.pop JOIN (SELECT pop, count(*) AS loci FROM fis_cells GROUP BY pop) AS k ON k.pop = m.pop LEFT JOIN ({QUERIES["fis_intervals"]}) AS i ON i.pop = m.pop""",
)


def _names(rows: DataFrame, column: str) -> list:
    """The distinct values that become columns; a sheet's width bounds them."""
    return [x[0] for x in rows.select(column).where(f"{column} IS NOT NULL").distinct().orderBy(column).collect()]


def data_as_analysed(geno: DataFrame, places: DataFrame, loci: Sequence | None = None) -> DataFrame:
    """individual, population, region, latitude, longitude, and two columns <locus>_1, <locus>_2 a locus: one row per individual, null where unscored."""
    at = lambda locus, allele: F.min(F.when(F.col("locus") == F.lit(locus), F.col(allele)))
    wide = [at(x, a).alias(f"{x}_{k}") for x in (_names(geno, "locus") if loci is None else loci) for k, a in ((1, "a1"), (2, "a2"))]
    rows = geno.groupBy(F.col("ind").alias("individual")).agg(F.min("pop").alias("population"), F.min("region").alias("region"), *wide)
    where = places.groupBy(F.col("ind").alias("individual")).agg(F.max("lat").alias("latitude"), F.max("lon").alias("longitude"))
    head = ("individual", "population", "region")
    return rows.join(where, "individual", "left").select(*head, "latitude", "longitude", *[F.col(f"`{c}`") for c in rows.columns if c not in head])


def distance_matrix(pairs: DataFrame, value: str, names: Sequence | None = None) -> DataFrame:
    """name and a column per name: the square of distances of p1, p2 and ``value``, 0 on the diagonal, null where there is none."""
    ends = pairs.select(F.col("p1").alias("name"), F.col("p2").alias("other"), F.col(value).alias("d"))
    ends = ends.unionByName(pairs.select(F.col("p2").alias("name"), F.col("p1").alias("other"), F.col(value).alias("d")))
    ends = ends.unionByName(ends.select("name", F.col("name").alias("other"), F.lit(0.0).alias("d")).distinct())
    cell = lambda x: F.min(F.when(F.col("other") == F.lit(x), F.col("d"))).alias(str(x))
    return ends.groupBy("name").agg(*[cell(x) for x in (_names(ends, "name") if names is None else names)])


def _five(name: str) -> Column:
    return (F.round(name, 5) + 0.0).alias(name)


def hwe_table(family: DataFrame, exact: DataFrame, cells: DataFrame) -> DataFrame:
    """pop, locus, n, alleles, ho, fis, p_exact, p_adjusted (Holm, over all cells), p_deficit, null_em of each tested cell.

    ``family``: as ``family.hwe_family`` gives; ``exact``: pop, locus, p_deficit of the same test; ``cells``: pop, locus, ho.
    """
    rows = family.join(exact.select("pop", "locus", "p_deficit"), ["pop", "locus"], "left").join(cells.select("pop", "locus", "ho"), ["pop", "locus"], "left")
    named = rows.select("pop", "locus", "n", F.col("k").alias("alleles"), "ho", "fis", F.col("p").alias("p_exact"), F.col("p_holm").alias("p_adjusted"), "p_deficit", F.col("null_frequency").alias("null_em"))
    return named.select("pop", "locus", "n", "alleles", *[_five(c) for c in named.columns[4:]])


def differentiation_table(tests: DataFrame, nei: DataFrame, theta: DataFrame) -> DataFrame:
    """p1, p2, theta, p_theta_holm, phi, p_phi_holm, gst, gprime_st, jost_d, nm of each pair of populations."""
    more = nei.select("p1", "p2", "gst", F.col("gst_hedrick").alias("gprime_st"), "jost_d").join(theta.select("p1", "p2", "nm"), ["p1", "p2"], "full")
    rows = more.join(tests.select("p1", "p2", "theta", "p_theta_holm", "phi", "p_phi_holm"), ["p1", "p2"], "left")
    return rows.select("p1", "p2", *[_five(c) for c in ("theta", "p_theta_holm", "phi", "p_phi_holm", "gst", "gprime_st", "jost_d", "nm")])

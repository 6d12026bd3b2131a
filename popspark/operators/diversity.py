"""Diversity within populations: allele counts, heterozygosity, richness, private alleles, phenotypic diversity."""

from popspark.plans.compose import query, r, series, step

step("copies", "SELECT ind, pop, region, locus, a1 AS allele, CASE WHEN a1 <> a2 THEN 1 ELSE 0 END AS het FROM geno UNION ALL SELECT ind, pop, region, locus, a2, CASE WHEN a1 <> a2 THEN 1 ELSE 0 END FROM geno")
step("allele_counts", "SELECT pop, locus, allele, count(*) AS n, CAST(sum(het) AS BIGINT) AS n_het FROM copies GROUP BY pop, locus, allele")
#: Allele counts hold all that the cells need: gene copies halve to individuals, and each heterozygote bears two alleles.
step("cells", "SELECT pop, locus, CAST(sum(n) / 2 AS BIGINT) AS n, sum(n_het) / (sum(n) * 1e0) AS ho FROM allele_counts GROUP BY pop, locus")
step("freqs", "SELECT a.pop, a.locus, a.allele, a.n, a.n_het, c.n AS inds, c.ho, a.n / (2e0 * c.n) AS p FROM allele_counts AS a JOIN cells AS c ON a.pop = c.pop AND a.locus = c.locus")
step("alleles", "SELECT locus, allele, CAST(sum(n) AS BIGINT) AS n FROM allele_counts GROUP BY locus, allele")
step(
    "grid",
    """SELECT c.pop, c.locus, l.allele, c.n AS inds, c.ho, coalesce(a.n, 0) AS n, coalesce(a.n_het, 0) AS n_het, coalesce(a.n, 0) / (2e0 * c.n) AS p
    FROM cells AS c JOIN alleles AS l ON c.locus = l.locus LEFT JOIN allele_counts AS a ON a.pop = c.pop AND a.locus = l.locus AND a.allele = l.allele""",
)
step(
    "cell_stats",
    """SELECT pop, locus, max(inds) AS n, count(*) AS na, sum(CASE WHEN p >= 0.05e0 THEN 1 ELSE 0 END) AS na5, 1 / sum(p * p) AS ne, -sum(p * ln(p)) AS i,
    1 - sum(p * p) AS he, max(ho) AS ho, sum(p * p) AS s2, sum(p * p * p * p) AS s4, max(p) AS top FROM freqs GROUP BY pop, locus""",
)
step("cell_full", "SELECT *, CASE WHEN n > 1 THEN 2e0 * n / (2e0 * n - 1) * he ELSE he END AS uhe, CASE WHEN he > 0 THEN (he - ho) / he END AS f, 1 - s2 - (s2 * s2 - s4) AS pic FROM cell_stats")

query("allele_counts", "SELECT pop, locus, allele, n, n_het FROM allele_counts")
query(
    "allele_frequencies",
    f"""SELECT g.pop, g.locus, g.allele, {r("g.p")} AS p, {r("g.pooled")} AS pooled, g.n_pops, CASE WHEN g.n_pops = 1 THEN g.only END AS private_to FROM (SELECT pop, locus, allele, p,
    sum(n) OVER w / (sum(2e0 * inds) OVER w) AS pooled, count(CASE WHEN n > 0 THEN 1 END) OVER w AS n_pops, min(CASE WHEN n > 0 THEN pop END) OVER w AS only
    FROM grid WINDOW w AS (PARTITION BY locus, allele)) AS g""",
)
query(
    "diversity_cells",
    f"""SELECT pop, locus, n, na, CAST(na5 AS BIGINT) AS na_f5, {r("ne")} AS ne, {r("i")} AS i, {r("he")} AS he, {r("ho")} AS ho, {r("uhe")} AS uhe, {r("f")} AS f, {r("pic")} AS pic FROM cell_full""",
)
query(
    "diversity_summary",
    f"""SELECT pop, {r("avg(n * 1e0)")} AS mean_n, {r("avg(na * 1e0)")} AS na, {r("stddev_samp(na * 1e0) / sqrt(count(*) * 1e0)")} AS na_se, {r("avg(ne)")} AS ne, {r("avg(i)")} AS i,
    {r("avg(ho)")} AS ho, {r("stddev_samp(ho) / sqrt(count(*) * 1e0)")} AS ho_se, {r("avg(he)")} AS he, {r("stddev_samp(he) / sqrt(count(*) * 1e0)")} AS he_se, {r("avg(uhe)")} AS uhe, {r("avg(f)")} AS f,
    {r("avg(pic)")} AS pic, {r("100e0 * sum(CASE WHEN top < 1 THEN 1 ELSE 0 END) / count(*)")} AS p_poly FROM cell_full GROUP BY pop""",
)
query(
    "polymorphic_loci",
    """SELECT pop, count(CASE WHEN top < 1 THEN 1 END) AS strict, count(CASE WHEN top <= 0.99e0 THEN 1 END) AS p99, count(CASE WHEN top <= 0.95e0 THEN 1 END) AS p95, count(*) AS loci FROM cell_stats GROUP BY pop""",
)
query(
    "pooled_diversity",
    f"""SELECT locus, count(*) AS na, {r("1 / sum(p * p)")} AS ne, {r("-sum(p * ln(p))")} AS i, {r("1 - sum(p * p)")} AS he, {r("max(ho)")} AS ho, {r("2e0 * max(inds) / (2e0 * max(inds) - 1) * (1 - sum(p * p))")} AS uhe
    FROM (SELECT a.locus, a.allele, a.n / (t.n * 1e0) AS p, t.n / 2 AS inds, t.ho FROM alleles AS a JOIN (SELECT locus, sum(n) AS n, sum(n_het) / (sum(n) * 1e0) AS ho FROM allele_counts GROUP BY locus) AS t ON a.locus = t.locus) AS x GROUP BY locus""",
)
query("private_alleles", f"""SELECT locus, allele, pop, {r("p")} AS p FROM (SELECT *, count(*) OVER (PARTITION BY locus, allele) AS k FROM freqs) AS x WHERE k = 1""")
query(
    "locally_common_alleles",
    """SELECT locus, allele, n_common, n_common <= greatest(1, floor(n_pops / 4e0 + 0.5e0)) AS quarter, n_common <= greatest(1, floor(n_pops / 2e0 + 0.5e0)) AS half
    FROM (SELECT locus, allele, count(CASE WHEN p >= 0.05e0 THEN 1 END) AS n_common, max(t.n_pops) AS n_pops FROM freqs CROSS JOIN (SELECT count(DISTINCT pop) AS n_pops FROM cells) AS t GROUP BY locus, allele) AS x
    WHERE n_pops >= 4 AND n_common > 0""",
)
step("least_copies", "SELECT CAST(min(2 * n) AS INT) AS g FROM cells")
#: Chance that a sample of g copies misses an allele, as a product of g factors within the row.
_MISSED = "CASE WHEN 2 * inds - n >= g THEN exp($folded(ln(greatest(2e0 * inds - n - j, 0.5e0) / (2e0 * inds - j)) ; g)$) ELSE 0e0 END"
step("richness", f"SELECT pop, locus, sum(1 - {_MISSED}) AS ar FROM freqs CROSS JOIN least_copies GROUP BY pop, locus")
query("rarefied_richness", f"""SELECT pop, locus, {r("ar")} AS ar FROM richness""")
step("curve_sizes", f"SELECT g FROM (SELECT 2 + step * greatest(1, CAST(floor(most / 40e0 + 0.5e0) AS INT)) AS g, most FROM (SELECT most, {series('0', '100')} AS step FROM (SELECT CAST(least(min(2 * n), 200) AS INT) AS most FROM cells) AS m) AS s) AS z WHERE g <= most")
query("rarefaction_curve", f"""SELECT pop, g, {r("avg(ar)")} AS ar FROM (SELECT pop, locus, g, sum(1 - {_MISSED}) AS ar FROM freqs CROSS JOIN curve_sizes GROUP BY pop, locus, g) AS z GROUP BY pop, g""")
step("band_cells", "SELECT pop, band, count(*) AS n, avg(x * 1e0) AS f, avg(1e0 - x) AS absent FROM bands GROUP BY pop, band")
step("null_q", "SELECT pop, band, n, f, absent, CASE WHEN absent = 0 THEN 0e0 ELSE least(1e0, sqrt(absent) * (1 + (1 - absent) / (8e0 * n * absent))) END AS q FROM band_cells")
query(
    "dominant_diversity",
    f"""SELECT pop, band, n, {r("f")} AS frequency, {r("sqrt(absent)")} AS q_sqrt, {r("q")} AS q, {r("2 * q * (1 - q)")} AS he, {r("CASE WHEN n > 1 THEN 2e0 * n / (2e0 * n - 1) ELSE 1e0 END * 2 * q * (1 - q)")} AS uhe,
    {r("1 / (1 - 2 * q * (1 - q))")} AS ne, {r("-(CASE WHEN q > 0 THEN q * ln(q) ELSE 0e0 END) - CASE WHEN q < 1 THEN (1 - q) * ln(1 - q) ELSE 0e0 END")} AS i, greatest(f, 1 - f) < 1 AS polymorphic FROM null_q""",
)
#: Posterior mean of q on 401 points under P(absent) = q^2 + F q (1 - q), with F = 0 and a flat prior.
query(
    "dominant_bayes",
    f"""SELECT pop, band, {r("sum(q * exp(l - top)) / sum(exp(l - top))")} AS q FROM (SELECT pop, band, q, l, max(l) OVER (PARTITION BY pop, band) AS top FROM (
    SELECT pop, band, j / 400e0 AS q, k0 * ln(greatest(j * j / 160000e0, 1e-12)) + (n - k0) * ln(greatest(1 - j * j / 160000e0, 1e-12)) AS l
    FROM (SELECT pop, band, n, absent * n AS k0, {series("0", "400")} AS j FROM band_cells) AS x) AS y) AS z GROUP BY pop, band""",
)
step("hap_counts", "SELECT pop, locus, allele, count(*) AS n FROM hap GROUP BY pop, locus, allele")
step("hap_freqs", "SELECT pop, locus, allele, n, sum(n) OVER (PARTITION BY pop, locus) AS total FROM hap_counts")
query(
    "haplotype_diversity",
    f"""SELECT pop, locus, CAST(max(total) AS BIGINT) AS n, count(*) AS na, {r("CASE WHEN max(total) > 1 THEN max(total) / (max(total) - 1e0) * (1 - sum((n / (total * 1e0)) * (n / (total * 1e0)))) ELSE 0e0 END")} AS h FROM hap_freqs GROUP BY pop, locus""",
)
step("trait_scale", "SELECT trait, avg(v) AS m, CASE WHEN stddev_samp(v) > 0 THEN stddev_samp(v) ELSE 1e0 END AS s FROM traits GROUP BY trait")
step("trait_classes", "SELECT pop, trait, least(9, greatest(0, floor((v - (m - 2.5e0 * s)) / (0.5e0 * s)))) AS class, count(*) AS n FROM (SELECT t.pop, t.trait, t.v, q.m, q.s FROM traits AS t JOIN trait_scale AS q ON t.trait = q.trait) AS x GROUP BY pop, trait, least(9, greatest(0, floor((v - (m - 2.5e0 * s)) / (0.5e0 * s))))")
query(
    "phenotypic_diversity",
    f"""SELECT pop, trait, {r("-sum(p * ln(p))")} AS h, {r("-sum(p * ln(p)) / ln(10e0)")} AS h_relative, count(*) AS classes FROM (SELECT pop, trait, n / (sum(n) OVER (PARTITION BY pop, trait) * 1e0) AS p FROM trait_classes) AS x GROUP BY pop, trait""",
)
query("trait_summary", f"""SELECT pop, trait, count(v) AS n, {r("avg(v)")} AS mean, {r("stddev_samp(v)")} AS sd, {r("100 * stddev_samp(v) / avg(v)")} AS cv, {r("min(v)")} AS low, {r("max(v)")} AS high FROM traits GROUP BY pop, trait""")

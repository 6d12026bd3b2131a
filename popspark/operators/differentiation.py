"""Hardy-Weinberg, F-statistics, AMOVA and multiple testing."""

from popspark.plans.compose import query, r, series, step

query("genotype_table", "SELECT pop, locus, least(a1, a2) AS a, greatest(a1, a2) AS b, count(*) AS n FROM geno GROUP BY pop, locus, least(a1, a2), greatest(a1, a2)")
step("genotypes", "SELECT pop, locus, least(a1, a2) AS a, greatest(a1, a2) AS b, count(*) AS n FROM geno GROUP BY pop, locus, least(a1, a2), greatest(a1, a2)")
step("expected", "SELECT x.pop, x.locus, x.allele AS a, y.allele AS b, CASE WHEN x.allele = y.allele THEN x.p * x.p ELSE 2 * x.p * y.p END * x.inds AS e FROM freqs AS x JOIN freqs AS y ON x.pop = y.pop AND x.locus = y.locus AND x.allele <= y.allele")
query(
    "hwe_chi_square",
    f"""SELECT e.pop, e.locus, {r("sum((coalesce(g.n, 0) - e.e) * (coalesce(g.n, 0) - e.e) / e.e)")} AS chi2, CAST(max(c.na * (c.na - 1) / 2) AS BIGINT) AS df, min(e.e) < 5 AS low_expected
    FROM expected AS e LEFT JOIN genotypes AS g ON g.pop = e.pop AND g.locus = e.locus AND g.a = e.a AND g.b = e.b JOIN cell_stats AS c ON c.pop = e.pop AND c.locus = e.locus
    WHERE c.na >= 2 AND c.n >= 2 GROUP BY e.pop, e.locus""",
)
step("fis_parts", "SELECT pop, locus, max(inds) AS n, count(*) AS k, sum(inds / (inds - 1e0) * (p * (1 - p) - (2e0 * inds - 1) / (4e0 * inds) * (n_het / (inds * 1e0)))) AS b, sum(n_het / (inds * 2e0)) AS c FROM freqs WHERE inds >= 2 GROUP BY pop, locus")
query("fis_by_cell", f"""SELECT pop, locus, {r("b")} AS b, {r("c")} AS c, {r("CASE WHEN b + c <> 0 THEN 1 - c / (b + c) END")} AS f FROM fis_parts""")
query(
    "fis_multilocus",
    f"""SELECT pop, {r("max(f)")} AS f, {r("CASE WHEN count(*) > 2 THEN sqrt((count(*) - 1e0) / count(*) * sum((loo - m) * (loo - m))) END")} AS se, {r("CASE WHEN max(f) > 0 THEN 2 * max(f) / (1 + max(f)) ELSE 0e0 END")} AS selfing
    FROM (SELECT pop, f, loo, avg(loo) OVER (PARTITION BY pop) AS m FROM (SELECT pop, 1 - (sum(c) OVER w) / (sum(b + c) OVER w) AS f, 1 - ((sum(c) OVER w) - c) / ((sum(b + c) OVER w) - b - c) AS loo
    FROM fis_parts WHERE k >= 2 AND b + c <> 0 WINDOW w AS (PARTITION BY pop)) AS x) AS y GROUP BY pop""",
)
query("fis_nei_chesser", f"""SELECT pop, locus, {r("ho")} AS ho, {r("hs")} AS hs, {r("CASE WHEN hs > 0 THEN 1 - ho / hs END")} AS f FROM (SELECT pop, locus, ho, n / (n - 1e0) * (he - ho / (2e0 * n)) AS hs FROM cell_stats WHERE n >= 2) AS x""")
query("null_alleles", f"""SELECT pop, locus, {r("CASE WHEN he + ho > 0 THEN (he - ho) / (he + ho) END")} AS chakraborty, {r("(he - ho) / (1 + he)")} AS brookfield FROM cell_stats WHERE na >= 2 AND n >= 5""")

#: Weir and Cockerham: cells with n >= 2, the allele grid filled with zeros.
step("wc_grid", "SELECT locus, pop, allele, inds * 1e0 AS n, p, n_het / (inds * 1e0) AS h FROM grid WHERE inds >= 2")
step("wc_pops", "SELECT locus, count(*) * 1e0 AS r, avg(n * 1e0) AS nb, sum(n * 1e0 * n) AS n2 FROM cells WHERE n >= 2 GROUP BY locus")
step("wc_means", "SELECT g.locus, g.allele, max(w.r) AS r, max(w.nb) AS nb, max((w.r * w.nb - w.n2 / (w.r * w.nb)) / (w.r - 1)) AS nc, sum(g.n * g.p) / max(w.r * w.nb) AS pb, sum(g.n * g.h) / max(w.r * w.nb) AS hb FROM wc_grid AS g JOIN wc_pops AS w ON g.locus = w.locus WHERE w.r >= 2 GROUP BY g.locus, g.allele")
step("wc_var", "SELECT m.locus, m.allele, m.r, m.nb, m.nc, m.pb, m.hb, sum(g.n * (g.p - m.pb) * (g.p - m.pb)) / ((m.r - 1) * m.nb) AS s2 FROM wc_means AS m JOIN wc_grid AS g ON g.locus = m.locus AND g.allele = m.allele GROUP BY m.locus, m.allele, m.r, m.nb, m.nc, m.pb, m.hb")
step(
    "wc_locus",
    """SELECT locus, sum(nb / nc * (s2 - (pb * (1 - pb) - (r - 1) / r * s2 - hb / 4) / (nb - 1))) AS a,
    sum(nb / (nb - 1) * (pb * (1 - pb) - (r - 1) / r * s2 - (2 * nb - 1) / (4 * nb) * hb)) AS b, sum(hb / 2) AS c FROM wc_var GROUP BY locus""",
)
query("theta_by_locus", f"""SELECT locus, {r("a")} AS a, {r("b")} AS b, {r("c")} AS c, {r("a / nullif(a + b + c, 0)")} AS theta, {r("b / nullif(b + c, 0)")} AS f, {r("(a + b) / nullif(a + b + c, 0)")} AS fit FROM wc_locus""")
query(
    "theta_multilocus",
    f"""SELECT {r("theta")} AS theta, {r("f")} AS f, {r("fit")} AS fit, {r("CASE WHEN theta > 0 THEN (1 - theta) / (4 * theta) END")} AS nm,
    CASE WHEN theta < 0.05e0 THEN 'little' WHEN theta < 0.15e0 THEN 'moderate' WHEN theta < 0.25e0 THEN 'great' ELSE 'very great' END AS wright_class
    FROM (SELECT sum(a) / sum(a + b + c) AS theta, sum(b) / sum(b + c) AS f, sum(a + b) / sum(a + b + c) AS fit FROM wc_locus) AS x""",
)
query(
    "theta_jackknife",
    f"""SELECT {r("sqrt((count(*) - 1e0) / count(*) * sum((theta - m_theta) * (theta - m_theta)))")} AS theta_se, {r("sqrt((count(*) - 1e0) / count(*) * sum((f - m_f) * (f - m_f)))")} AS f_se
    FROM (SELECT theta, f, avg(theta) OVER () AS m_theta, avg(f) OVER () AS m_f FROM (SELECT (sum(a) OVER () - a) / (sum(a + b + c) OVER () - a - b - c) AS theta, (sum(b) OVER () - b) / (sum(b + c) OVER () - b - c) AS f FROM wc_locus) AS x) AS y""",
)
step("nei_pops", "SELECT locus, count(*) * 1e0 AS r, count(*) / sum(1e0 / n) AS nh, avg(ho) AS ho, avg(s2) AS s2 FROM cell_stats GROUP BY locus")
step("nei_mean", "SELECT locus, sum(pb * pb) AS t2 FROM (SELECT locus, allele, avg(p) AS pb FROM grid GROUP BY locus, allele) AS x GROUP BY locus")
step("nei_locus", "SELECT locus, r, ho, hs, 1 - t2 + hs / (nh * r) - ho / (2 * nh * r) AS ht FROM (SELECT p.locus, p.r, p.nh, p.ho, nh / (nh - 1) * (1 - s2 - ho / (2 * nh)) AS hs, m.t2 FROM nei_pops AS p JOIN nei_mean AS m ON p.locus = m.locus WHERE p.nh > 1) AS x")
query(
    "nei_by_locus",
    f"""SELECT locus, {r("ho")} AS ho, {r("hs")} AS hs, {r("ht")} AS ht, {r("ht - hs")} AS dst, {r("(ht - hs) / nullif(ht, 0)")} AS gst,
    {r("(ht - hs) / nullif(ht, 0) / nullif((r - 1) * (1 - hs) / (r - 1 + hs), 0)")} AS gst_hedrick, {r("r / (r - 1) * (ht - hs) / nullif(1 - hs, 0)")} AS jost_d FROM nei_locus WHERE r >= 2""",
)
query(
    "nei_multilocus",
    f"""SELECT {r("ho")} AS ho, {r("hs")} AS hs, {r("ht")} AS ht, {r("(ht - hs) / ht")} AS gst, {r("(ht - hs) / ht / ((r - 1) * (1 - hs) / (r - 1 + hs))")} AS gst_hedrick, {r("r / (r - 1) * (ht - hs) / (1 - hs)")} AS jost_d, {r("d_mean")} AS d_mean
    FROM (SELECT avg(ho) AS ho, avg(hs) AS hs, avg(ht) AS ht, min(CASE WHEN first = 1 THEN r END) AS r, avg(r / (r - 1) * (ht - hs) / nullif(1 - hs, 0)) AS d_mean FROM (SELECT *, row_number() OVER (ORDER BY locus) AS first FROM nei_locus) AS x) AS y""",
)

#: AMOVA by locus: (G^2 - sum C^2) / (2 G) for all copies, regions, populations and individuals.
step("ss_total", "SELECT locus, sum(n) * 1e0 AS g, (sum(n) * 1e0 - sum(n * 1e0 * n) / sum(n)) / 2 AS ss FROM alleles GROUP BY locus")
step("ss_pop", "SELECT locus, count(*) * 1e0 AS np, sum(ss) AS ss, sum(n * 1e0 * n) AS n2 FROM (SELECT locus, pop, sum(n) / 2e0 AS n, (sum(n) * 1e0 - sum(n * 1e0 * n) / sum(n)) / 2 AS ss FROM allele_counts GROUP BY locus, pop) AS x GROUP BY locus")
step("ss_ind", "SELECT locus, sum(n_het) / 4e0 AS ss FROM allele_counts GROUP BY locus")
step(
    "amova_locus",
    """SELECT t.locus, t.g / 2 AS n, p.np, t.ss AS ss_total, t.ss - p.ss AS ss_ap, p.ss - i.ss AS ss_ai, i.ss AS ss_wi, (t.g / 2 - p.n2 / (t.g / 2)) / (p.np - 1) AS n0
    FROM ss_total AS t JOIN ss_pop AS p ON t.locus = p.locus JOIN ss_ind AS i ON t.locus = i.locus WHERE p.np >= 2 AND t.g > 2""",
)
step("amova_sigma", "SELECT *, ss_wi / n AS sd, (CASE WHEN n > np THEN ss_ai / (n - np) ELSE 0e0 END - ss_wi / n) / 2 AS sc FROM amova_locus")
step("amova_flat_sum", "SELECT sum(ss_total) AS ss_total, sum(ss_ap) AS ss_ap, sum(ss_ai) AS ss_ai, sum(ss_wi) AS ss_wi, sum((ss_ap / (np - 1) - sd - 2 * sc) / (2 * n0)) AS sb, sum(sc) AS sc, sum(sd) AS sd FROM amova_sigma")
query(
    "amova",
    f"""SELECT {r("ss_total")} AS ss_total, {r("ss_ap")} AS ss_pops, {r("ss_ai")} AS ss_individuals, {r("ss_wi")} AS ss_within, {r("sb")} AS sigma_pops, {r("sc")} AS sigma_individuals, {r("sd")} AS sigma_within,
    {r("sb / (sb + sc + sd)")} AS phi_st, {r("sc / (sc + sd)")} AS phi_is, {r("(sb + sc) / (sb + sc + sd)")} AS phi_it, {r("100 * sb / (sb + sc + sd)")} AS percent_pops FROM amova_flat_sum""",
)
step("region_of", "SELECT pop, min(region) AS region FROM geno GROUP BY pop")
step("ss_region", "SELECT locus, count(*) * 1e0 AS ng, sum(ss) AS ss, sum(n * 1e0 * n) AS n2 FROM (SELECT locus, region, sum(n) / 2e0 AS n, (sum(n) * 1e0 - sum(n * 1e0 * n) / sum(n)) / 2 AS ss FROM (SELECT a.locus, q.region, a.allele, sum(a.n) AS n FROM allele_counts AS a JOIN region_of AS q ON a.pop = q.pop GROUP BY a.locus, q.region, a.allele) AS x GROUP BY locus, region) AS y GROUP BY locus")
step("pop_weights", "SELECT locus, sum(n2 / n) AS w FROM (SELECT c.locus, q.region, sum(c.n * 1e0 * c.n) AS n2, sum(c.n) * 1e0 AS n FROM cells AS c JOIN region_of AS q ON c.pop = q.pop GROUP BY c.locus, q.region) AS x GROUP BY locus")
step(
    "hier_parts",
    """SELECT s.locus, s.n, s.np, q.ng, s.ss_total, s.ss_total - q.ss AS ss_ag, q.ss - (s.ss_total - s.ss_ap) AS ss_ap, s.sc, s.sd, (s.n - w.w) / (s.np - q.ng) AS n1,
    (w.w - p.n2 / s.n) / (q.ng - 1) AS n2, (s.n - q.n2 / s.n) / (q.ng - 1) AS n3 FROM amova_sigma AS s JOIN ss_region AS q ON s.locus = q.locus JOIN pop_weights AS w ON s.locus = w.locus JOIN ss_pop AS p ON s.locus = p.locus
    WHERE q.ng >= 2 AND s.np > q.ng""",
)
step("hier_sigma", "SELECT *, (ss_ap / (np - ng) - sd - 2 * sc) / (2 * n1) AS sb FROM hier_parts")
step("hier_sum", "SELECT sum((ss_ag / (ng - 1) - sd - 2 * sc - 2 * n2 * sb) / (2 * n3)) AS sa, sum(sb) AS sb, sum(sc) AS sc, sum(sd) AS sd FROM hier_sigma")
query(
    "amova_hierarchical",
    f"""SELECT {r("sa")} AS sigma_regions, {r("sb")} AS sigma_pops, {r("sc")} AS sigma_individuals, {r("sd")} AS sigma_within, {r("(sa + sb) / (sa + sb + sc + sd)")} AS phi_st, {r("sa / (sa + sb + sc + sd)")} AS phi_ct,
    {r("sb / (sb + sc + sd)")} AS phi_sc, {r("sc / (sc + sd)")} AS phi_is, {r("(sa + sb + sc) / (sa + sb + sc + sd)")} AS phi_it FROM hier_sum""",
)

#: Every pair of populations as a data set of two; only cells (not individuals) are joined.
step("pairs", "SELECT x.pop AS p1, y.pop AS p2, x.locus, x.n * 1e0 AS n1, y.n * 1e0 AS n2 FROM cells AS x JOIN cells AS y ON x.locus = y.locus AND x.pop < y.pop")
step("pair_alleles", "SELECT q.p1, q.p2, q.locus, q.n1, q.n2, g.allele, g.p AS x, h.p AS y, g.n_het / q.n1 AS hx, h.n_het / q.n2 AS hy FROM pairs AS q JOIN grid AS g ON g.pop = q.p1 AND g.locus = q.locus JOIN grid AS h ON h.pop = q.p2 AND h.locus = q.locus AND h.allele = g.allele WHERE g.n + h.n > 0")
step("pair_means", "SELECT *, (n1 + n2) / 2 AS nb, n1 + n2 - (n1 * n1 + n2 * n2) / (n1 + n2) AS nc, (n1 * x + n2 * y) / (n1 + n2) AS pb, (n1 * hx + n2 * hy) / (n1 + n2) AS hb FROM pair_alleles WHERE n1 >= 2 AND n2 >= 2")
step("pair_var", "SELECT *, (n1 * (x - pb) * (x - pb) + n2 * (y - pb) * (y - pb)) / nb AS s2 FROM pair_means")
step(
    "pair_theta",
    """SELECT p1, p2, sum(nb / nc * (s2 - (pb * (1 - pb) - s2 / 2 - hb / 4) / (nb - 1))) AS a, sum(nb / (nb - 1) * (pb * (1 - pb) - s2 / 2 - (2 * nb - 1) / (4 * nb) * hb)) AS b, sum(hb / 2) AS c FROM pair_var GROUP BY p1, p2""",
)
query("pairwise_theta", f"""SELECT p1, p2, {r("a / nullif(a + b + c, 0)")} AS theta, {r("CASE WHEN a > 0 AND a + b + c > 0 THEN (b + c) / (4 * a) END")} AS nm FROM pair_theta""")
step(
    "pair_nei",
    """SELECT p1, p2, avg(hs) AS hs, avg(1 - t2 + hs / (2 * nh) - ho / (4 * nh)) AS ht FROM (SELECT p1, p2, locus, nh, ho, t2, nh / (nh - 1) * (1 - s2 - ho / (2 * nh)) AS hs FROM (
    SELECT a.p1, a.p2, a.locus, max(2 / (1 / a.n1 + 1 / a.n2)) AS nh, max((c.ho + d.ho) / 2) AS ho, sum((x * x + y * y) / 2) AS s2, sum((x + y) * (x + y) / 4) AS t2
    FROM pair_alleles AS a JOIN cells AS c ON c.pop = a.p1 AND c.locus = a.locus JOIN cells AS d ON d.pop = a.p2 AND d.locus = a.locus WHERE a.n1 >= 2 AND a.n2 >= 2 GROUP BY a.p1, a.p2, a.locus) AS u) AS v GROUP BY p1, p2""",
)
query("pairwise_gst", f"""SELECT p1, p2, {r("(ht - hs) / nullif(ht, 0)")} AS gst, {r("(ht - hs) / nullif(ht, 0) / nullif((1 - hs) / (1 + hs), 0)")} AS gst_hedrick, {r("2 * (ht - hs) / nullif(1 - hs, 0)")} AS jost_d FROM pair_nei""")

#: Homogeneity of allele counts among populations, by locus; ``multiple`` gives the p values and their corrections.
step("homogeneity", "SELECT locus, sum((n - e) * (n - e) / e) AS chi2, CAST((count(DISTINCT pop) - 1) * (count(DISTINCT allele) - 1) AS INT) AS df FROM (SELECT g.locus, g.pop, g.allele, g.n, 2e0 * g.inds * a.n / t.g AS e FROM grid AS g JOIN alleles AS a ON a.locus = g.locus AND a.allele = g.allele JOIN ss_total AS t ON t.locus = g.locus) AS x GROUP BY locus")

#: Haploid loci: components among and within populations, and migrants by the haploid island model.
step("hap_cells", "SELECT locus, pop, count(*) * 1e0 AS n FROM hap WHERE allele IS NOT NULL GROUP BY locus, pop HAVING count(*) >= 2")
step("hap_pops", "SELECT locus, count(*) * 1e0 AS r, avg(n) AS nb, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS nc FROM hap_cells GROUP BY locus HAVING count(*) >= 2")
step("hap_alleles", "SELECT h.locus, h.pop, h.allele, count(*) * 1e0 AS c FROM hap AS h JOIN hap_cells AS n ON n.locus = h.locus AND n.pop = h.pop WHERE h.allele IS NOT NULL GROUP BY h.locus, h.pop, h.allele")
#: Populations without an allele add its squared mean frequency, so zeros need no rows.
step("hap_mean", "SELECT a.locus, a.allele, sum(a.c) / (max(w.r) * max(w.nb)) AS pb, sum(a.c * a.c / n.n) AS cp FROM hap_alleles AS a JOIN hap_cells AS n ON n.locus = a.locus AND n.pop = a.pop JOIN hap_pops AS w ON w.locus = a.locus GROUP BY a.locus, a.allele")
step("hap_var", "SELECT m.locus, w.r, w.nb, w.nc, m.pb, (m.cp - w.r * w.nb * m.pb * m.pb) / ((w.r - 1) * w.nb) AS s2 FROM hap_mean AS m JOIN hap_pops AS w ON w.locus = m.locus")
step("hap_parts", "SELECT locus, sum(nb / nc * (s2 - (pb * (1 - pb) - (r - 1) / r * s2) / (nb - 1))) AS a, sum(nb / (nb - 1) * (pb * (1 - pb) - (r - 1) / r * s2)) AS b FROM hap_var GROUP BY locus")
query("haploid_theta_by_locus", f"""SELECT locus, {r("a")} AS a, {r("b")} AS b, {r("a / nullif(a + b, 0)")} AS theta FROM hap_parts""")
query("haploid_theta", f"""SELECT {r("theta")} AS theta, {r("CASE WHEN theta > 0 THEN (1 - theta) / (2 * theta) END")} AS nm FROM (SELECT sum(a) / nullif(sum(a + b), 0) AS theta FROM hap_parts) AS x""")

#: Degrees of freedom of the hierarchical design with complete data, and in how many ways the populations can be shared among regions of these sizes (regions of one size are interchangeable).
step("design_pops", "SELECT pop, min(region) AS region, count(DISTINCT ind) AS n FROM geno WHERE pop IS NOT NULL GROUP BY pop HAVING count(DISTINCT ind) >= 2")
step("design_regions", "SELECT region, count(*) AS n FROM design_pops WHERE region IS NOT NULL GROUP BY region")
step("log_factorials", f"SELECT part, sum(ln(i)) AS v FROM (SELECT 'all' AS part, {series('1', 'n')} AS i FROM (SELECT count(*) AS n FROM design_pops) AS p UNION ALL SELECT 'sizes', {series('1', 'n')} FROM design_regions UNION ALL SELECT 'alike', {series('1', 'n')} FROM (SELECT count(*) AS n FROM design_regions GROUP BY n) AS r) AS x GROUP BY part")
query(
    "amova_design",
    """SELECT n_inds, n_pops, n_regions, n_regions - 1 AS df_regions, n_pops - n_regions AS df_pops, n_inds - n_pops AS df_individuals, n_inds AS df_within, 2 * n_inds - 1 AS df_total,
    CAST(round(exp((SELECT v FROM log_factorials WHERE part = 'all') - (SELECT v FROM log_factorials WHERE part = 'sizes') - (SELECT v FROM log_factorials WHERE part = 'alike'))) AS DOUBLE) AS arrangements
    FROM (SELECT CAST(sum(n) AS BIGINT) AS n_inds, count(*) AS n_pops, (SELECT count(*) FROM design_regions) AS n_regions FROM design_pops) AS d""",
)

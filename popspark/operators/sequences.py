"""Aligned sequences: sites, haplotypes, nucleotide diversity, neutrality tests, mismatches."""

from popspark.plans.compose import query, r, series, step

step("n_seqs", "SELECT pop, count(DISTINCT ind) * 1e0 AS n FROM sites GROUP BY pop")
#: Complete deletion: a site counts if every sequence has one of the four bases there.
step("valid_sites", "SELECT s.site FROM sites AS s CROSS JOIN (SELECT sum(n) AS n FROM n_seqs) AS t GROUP BY s.site HAVING count(CASE WHEN s.base IN ('A', 'C', 'G', 'T') THEN 1 END) = max(t.n)")
step("kept_sites", "SELECT s.ind, s.pop, s.site, s.base FROM sites AS s JOIN valid_sites AS v ON v.site = s.site")
step("n_sites", "SELECT count(DISTINCT site) * 1e0 AS l FROM kept_sites")
step("base_counts", "SELECT pop, site, base, count(*) * 1e0 AS n FROM kept_sites GROUP BY pop, site, base")
step("site_stats", "SELECT pop, site, sum(n) AS n, count(*) AS k, min(n) AS least_n, 1 - sum(n * n) / (sum(n) * sum(n)) AS h, count(CASE WHEN n = 1 THEN 1 END) AS singles, count(CASE WHEN n >= 2 THEN 1 END) AS twice FROM base_counts GROUP BY pop, site")
query(
    "site_summary",
    """SELECT pop, count(*) AS sites, count(CASE WHEN k > 1 THEN 1 END) AS segregating, CAST(sum(k - 1) AS BIGINT) AS eta, count(CASE WHEN k > 2 THEN 1 END) AS multiallelic, count(CASE WHEN twice >= 2 THEN 1 END) AS informative,
    count(CASE WHEN k = 2 AND least_n = 1 THEN 1 END) AS singletons FROM site_stats GROUP BY pop""",
)
query(
    "substitution_types",
    """SELECT pop, count(CASE WHEN lo = 'A' AND hi = 'G' OR lo = 'C' AND hi = 'T' THEN 1 END) AS transitions, count(CASE WHEN NOT (lo = 'A' AND hi = 'G' OR lo = 'C' AND hi = 'T') THEN 1 END) AS transversions
    FROM (SELECT pop, site, min(base) AS lo, max(base) AS hi FROM base_counts GROUP BY pop, site HAVING count(*) = 2) AS x GROUP BY pop""",
)
step("a_values", f"SELECT pop, n, sum(1e0 / i) AS a1, sum(1e0 / (i * i)) AS a2 FROM (SELECT pop, n, {series('1', 'CAST(n AS INT) - 1')} AS i FROM n_seqs WHERE n >= 4) AS x GROUP BY pop, n")
step("seq_stats", "SELECT s.pop, max(a.n) AS n, max(a.a1) AS a1, max(a.a2) AS a2, sum(s.h * s.n / (s.n - 1)) AS k, count(CASE WHEN s.k > 1 THEN 1 END) * 1e0 AS s, sum(s.k - 1) * 1e0 AS eta, sum(CASE WHEN s.k > 1 THEN s.singles ELSE 0 END) * 1e0 AS eta_s FROM site_stats AS s JOIN a_values AS a ON a.pop = s.pop GROUP BY s.pop")
query("nucleotide_diversity", f"""SELECT pop, {r("k")} AS k, {r("k / l")} AS pi, {r("s / a1")} AS theta_w, CAST(s AS BIGINT) AS s, CAST(eta AS BIGINT) AS eta, CAST(eta_s AS BIGINT) AS eta_s FROM seq_stats CROSS JOIN n_sites""")
step("tajima", "SELECT *, (n + 1) / (3 * (n - 1)) - 1 / a1 AS c1, 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1) AS c2 FROM seq_stats WHERE s > 0")
query("tajima_d", f"""SELECT pop, {r("(k - s / a1) / sqrt(c1 / a1 * s + c2 / (a1 * a1 + a2) * s * (s - 1))")} AS d FROM tajima""")
step("fu_li_c", "SELECT *, a1 + 1 / n AS an, 2 * (n * a1 - 2 * (n - 1)) / ((n - 1) * (n - 2)) AS c FROM seq_stats WHERE eta > 0")
step("fu_li_d", "SELECT *, c + (n - 2) / ((n - 1) * (n - 1)) + 2 / (n - 1) * (1.5e0 - (2 * an - 3) / (n - 2) - 1 / n) AS d FROM fu_li_c")
step(
    "fu_li_v",
    """SELECT *, (n * n / ((n - 1) * (n - 1)) * a2 + a1 * a1 * d - 2 * n * a1 * (a1 + 1) / ((n - 1) * (n - 1))) / (a1 * a1 + a2) AS vd,
    (d + 2 * (n * n + n + 3) / (9 * n * (n - 1)) - 2 / (n - 1) * (4 * a2 - 6 + 8 / n)) / (a1 * a1 + a2) AS vf FROM fu_li_d""",
)
step("fu_li_u", "SELECT *, n / (n - 1) * (a1 - n / (n - 1)) - vd AS ud, (n / (n - 1) + (n + 1) / (3 * (n - 1)) - 4 / (n * (n - 1)) + 2 * (n + 1) / ((n - 1) * (n - 1)) * (an - 2 * n / (n + 1))) / a1 - vf AS uf FROM fu_li_v")
query(
    "fu_li",
    f"""SELECT pop, {r("CASE WHEN ud * eta + vd * eta * eta > 0 THEN (n / (n - 1) * eta - a1 * eta_s) / sqrt(ud * eta + vd * eta * eta) END")} AS d_star, {r("CASE WHEN uf * eta + vf * eta * eta > 0 THEN (k - (n - 1) / n * eta_s) / sqrt(uf * eta + vf * eta * eta) END")} AS f_star FROM fu_li_u""",
)
step("own_singles", "SELECT s.pop, s.ind, sum(CASE WHEN b.n = 1 THEN 1e0 ELSE 0e0 END) AS u FROM kept_sites AS s JOIN base_counts AS b ON b.pop = s.pop AND b.site = s.site AND b.base = s.base GROUP BY s.pop, s.ind")
query("r2_statistic", f"""SELECT u.pop, {r("sqrt(avg((u.u - q.k / 2) * (u.u - q.k / 2))) / max(q.s)")} AS r2 FROM own_singles AS u JOIN seq_stats AS q ON q.pop = u.pop WHERE q.s > 0 GROUP BY u.pop""")
#: Haplotypes over all sites, in the order of the sites.
step("haps", "SELECT ind, pop, $joined(base ; site)$ AS h FROM kept_sites GROUP BY ind, pop")
step("haps_n", "SELECT pop, h, count(*) * 1e0 AS n, sum(count(*)) OVER (PARTITION BY pop) * 1e0 AS total FROM haps GROUP BY pop, h")
step("haps_all", "SELECT DISTINCT h FROM haps")
query("haplotypes", f"""SELECT h, count(DISTINCT pop) AS n_pops, CAST(sum(n) AS BIGINT) AS n FROM haps_n GROUP BY h""")
query("haplotype_diversity_sequences", f"""SELECT pop, count(*) AS n_haplotypes, {r("max(total) / (max(total) - 1) * (1 - sum(n * n) / (max(total) * max(total)))")} AS hd FROM haps_n WHERE total > 1 GROUP BY pop""")
#: Pairs of sequences are counted through the haplotypes of a population, one sequence standing for each.
step("hap_reps", "SELECT pop, h, min(ind) AS ind, count(*) * 1e0 AS n FROM haps GROUP BY pop, h")
step("rep_sites", "SELECT s.pop, s.ind, s.site, s.base, q.n FROM kept_sites AS s JOIN hap_reps AS q ON q.pop = s.pop AND q.ind = s.ind")
step("pair_diff", "SELECT x.pop, sum(CASE WHEN x.base <> y.base THEN 1 ELSE 0 END) AS d, max(x.n * y.n) AS w FROM rep_sites AS x JOIN rep_sites AS y ON x.pop = y.pop AND x.site = y.site AND x.ind < y.ind GROUP BY x.pop, x.ind, y.ind UNION ALL SELECT pop, 0, n * (n - 1) / 2 FROM hap_reps WHERE n > 1")
step("mismatch", "SELECT pop, d, sum(w) / sum(sum(w)) OVER (PARTITION BY pop) AS f FROM pair_diff GROUP BY pop, d")
query("mismatch_distribution", f"""SELECT pop, CAST(d AS BIGINT) AS d, {r("f")} AS f FROM mismatch""")
step("mismatch_full", f"SELECT g.pop, g.d, coalesce(m.f, 0e0) AS f FROM (SELECT pop, {series('0', 'most + 1')} AS d FROM (SELECT pop, CAST(max(d) AS INT) AS most FROM mismatch GROUP BY pop) AS x) AS g LEFT JOIN mismatch AS m ON m.pop = g.pop AND m.d = g.d")
query("raggedness", f"""SELECT pop, {r("sum((f - e) * (f - e))")} AS r FROM (SELECT pop, d, f, coalesce(lag(f) OVER (PARTITION BY pop ORDER BY d), 0e0) AS e FROM mismatch_full) AS x GROUP BY pop""")
step("pp_freq", "SELECT p.pop, q.h, coalesce(n.n, 0e0) / p.total AS f, p.total AS n FROM (SELECT pop, max(total) AS total FROM haps_n GROUP BY pop) AS p CROSS JOIN haps_all AS q LEFT JOIN haps_n AS n ON n.pop = p.pop AND n.h = q.h")
step("pp_mean", "SELECT h, avg(f) AS m FROM pp_freq GROUP BY h")
step("pp_dev", "SELECT x.pop, x.h, x.f, x.n, m.m, x.f - m.m AS e FROM pp_freq AS x JOIN pp_mean AS m ON m.h = x.h")
step("pp_pop", "SELECT pop, max(n) / (max(n) - 1) * (1 - sum(f * f)) AS hs, sum(e * e) AS e2 FROM pp_dev GROUP BY pop")
#: Two haplotypes differ by the number of sites at which their bases do, so sums over pairs of haplotypes are sums over sites of base frequencies.
step("pp_bases", "SELECT p.pop, p.n, b.site, b.base, coalesce(c.n, 0e0) / p.n AS f FROM n_seqs AS p CROSS JOIN (SELECT DISTINCT site, base FROM base_counts) AS b LEFT JOIN base_counts AS c ON c.pop = p.pop AND c.site = b.site AND c.base = b.base")
step("pp_base_mean", "SELECT site, base, avg(f) AS m FROM pp_bases GROUP BY site, base")
step("pp_pairs", "SELECT x.pop, max(x.n) / (max(x.n) - 1) * (max(l.l) - sum(x.f * x.f)) AS vs, -sum((x.f - m.m) * (x.f - m.m)) AS ed FROM pp_bases AS x JOIN pp_base_mean AS m ON m.site = x.site AND m.base = x.base CROSS JOIN n_sites AS l GROUP BY x.pop")
step("pp_total", "SELECT max(l.l) - sum(m.m * m.m) AS vt FROM pp_base_mean AS m CROSS JOIN n_sites AS l")
step("pp_m2", "SELECT sum(m * m) AS m2 FROM pp_mean")
step("pp_sums", "SELECT avg(p.hs) AS hs, avg(q.vs) AS vs, sum(p.e2) AS e2, sum(q.ed) AS ed, count(*) * 1e0 AS np FROM pp_pop AS p JOIN pp_pairs AS q ON q.pop = p.pop")
query(
    "pons_petit",
    f"""SELECT {r("hs")} AS hs, {r("ht")} AS ht, {r("1 - hs / ht")} AS gst, {r("vs")} AS vs, {r("vt")} AS vt, {r("1 - vs / vt")} AS nst
    FROM (SELECT s.hs, s.vs, 1 - m.m2 + s.e2 / (s.np * (s.np - 1)) AS ht, t.vt - s.ed / (s.np * (s.np - 1)) AS vt FROM pp_sums AS s CROSS JOIN pp_m2 AS m CROSS JOIN pp_total AS t) AS x""",
)
#: Differences summed over pairs of sequences: within a population each pair counts twice.
step("base_pairs", "SELECT x.pop AS p1, y.pop AS p2, sum(CASE WHEN x.base <> y.base THEN x.n * y.n ELSE 0e0 END) AS d FROM base_counts AS x JOIN base_counts AS y ON x.site = y.site AND x.pop <= y.pop GROUP BY x.pop, y.pop")
step("pop_diff", "SELECT b.p1, b.p2, b.d / (x.n * CASE WHEN b.p1 = b.p2 THEN y.n - 1 ELSE y.n END) AS d FROM base_pairs AS b JOIN n_seqs AS x ON x.pop = b.p1 JOIN n_seqs AS y ON y.pop = b.p2 WHERE b.p1 <> b.p2 OR x.n > 1")
query("dxy_da", f"""SELECT x.p1, x.p2, {r("x.d / l")} AS dxy, {r("greatest(0e0, x.d - (a.d + b.d) / 2) / l")} AS da FROM pop_diff AS x JOIN pop_diff AS a ON a.p1 = x.p1 AND a.p2 = x.p1 JOIN pop_diff AS b ON b.p1 = x.p2 AND b.p2 = x.p2 CROSS JOIN n_sites WHERE x.p1 < x.p2""")
#: Sites are left out pair by pair: those where one of the two has none of the four bases.
step("four_bases", "SELECT ind, site, CASE WHEN base IN ('A', 'C', 'G', 'T') THEN base END AS base FROM sites")
step(
    "pair_types",
    """SELECT i, j, n, ti / nullif(n, 0) AS p, tv / nullif(n, 0) AS q FROM (SELECT x.ind AS i, y.ind AS j, count(concat_bases) * 1e0 AS n, count(CASE WHEN concat_bases IN ('AG', 'GA', 'CT', 'TC') THEN 1 END) AS ti,
    count(CASE WHEN x.base <> y.base AND concat_bases NOT IN ('AG', 'GA', 'CT', 'TC') THEN 1 END) AS tv
    FROM four_bases AS x JOIN four_bases AS y ON x.site = y.site AND x.ind < y.ind GROUP BY x.ind, y.ind) AS t""".replace("concat_bases", "x.base || y.base"),
)
query("k2p_distance", f"""SELECT i, j, {r("CASE WHEN n = 0 THEN 0e0 WHEN 1 - 2 * p - q > 0 AND 1 - 2 * q > 0 THEN -0.5e0 * ln(1 - 2 * p - q) - 0.25e0 * ln(1 - 2 * q) ELSE 3e0 END")} AS k2p FROM pair_types""")
query(
    "phi_st_sequences",
    f"""SELECT {r("sb / (sb + msw)")} AS phi_st FROM (SELECT ((sst - ssw) / (np - 1) - ssw / (n - np)) / n0 AS sb, ssw / (n - np) AS msw FROM (SELECT t.sst, w.ssw, w.np, t.n, (t.n - w.n2 / t.n) / (w.np - 1) AS n0
    FROM (SELECT sum(CASE WHEN b.p1 = b.p2 THEN b.d / 2 ELSE b.d END) / max(t.n) AS sst, max(t.n) AS n FROM base_pairs AS b CROSS JOIN (SELECT sum(n) AS n FROM n_seqs) AS t) AS t CROSS JOIN (SELECT sum(b.d / (2 * c.n)) AS ssw, count(*) * 1e0 AS np, sum(c.n * c.n) AS n2 FROM base_pairs AS b JOIN n_seqs AS c ON c.pop = b.p1 WHERE b.p1 = b.p2) AS w) AS x) AS y""",
)
#: What Fu's F_S is made of: sequences, haplotypes and the mean number of differences of a population.
query("fu_fs_parts", f"""SELECT q.pop, CAST(q.n AS BIGINT) AS n, h.n_haplotypes, {r("q.k")} AS theta FROM seq_stats AS q JOIN (SELECT pop, count(*) AS n_haplotypes FROM haps_n GROUP BY pop) AS h ON h.pop = q.pop WHERE q.k > 0""")
#: Haplotypes by population, with those of one population only.
query("haplotype_table", """SELECT pop, h, CAST(n AS BIGINT) AS n, count(*) OVER (PARTITION BY h) = 1 AS private FROM haps_n""")

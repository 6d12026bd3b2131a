"""Linkage disequilibrium: index of association and biallelic measures."""

from popspark.plans.compose import query, r, step

#: Alleles not shared by two individuals of a population at a locus; pairs without data take the mean of population and locus.
step("ld_loci", "SELECT DISTINCT pop, locus FROM geno")
step("ld_inds", "SELECT DISTINCT pop, ind FROM geno")
step("ld_pairs", "SELECT x.pop, x.ind AS i, y.ind AS j FROM ld_inds AS x JOIN ld_inds AS y ON x.pop = y.pop AND x.ind < y.ind")
step("ld_means", "SELECT pop, locus, avg(2e0 - shared) AS m FROM ind_pairs GROUP BY pop, locus")
step("ld_d", "SELECT p.pop, p.i, p.j, l.locus, coalesce(2e0 - q.shared, m.m) AS d FROM ld_pairs AS p JOIN ld_loci AS l ON l.pop = p.pop LEFT JOIN ind_pairs AS q ON q.pop = p.pop AND q.i = p.i AND q.j = p.j AND q.locus = l.locus LEFT JOIN ld_means AS m ON m.pop = p.pop AND m.locus = l.locus")
step("ld_var", "SELECT pop, sum(v) AS ve, (sum(sqrt(v)) * sum(sqrt(v)) - sum(v)) / 2 AS cross_v FROM (SELECT pop, locus, var_samp(d) AS v FROM ld_d GROUP BY pop, locus) AS x GROUP BY pop")
query("index_of_association", f"""SELECT o.pop, {r("max(o.vd) / nullif(max(e.ve), 0) - 1")} AS ia, {r("(max(o.vd) - max(e.ve)) / nullif(2 * max(e.cross_v), 0)")} AS rd FROM (SELECT pop, var_samp(d) AS vd FROM (SELECT pop, i, j, sum(d) AS d FROM ld_d GROUP BY pop, i, j) AS x GROUP BY pop) AS o JOIN ld_var AS e ON e.pop = o.pop GROUP BY o.pop""")
query("pairwise_rd", f"""SELECT x.pop, x.locus AS l1, y.locus AS l2, {r("corr(x.d, y.d)")} AS rd FROM ld_d AS x JOIN ld_d AS y ON x.pop = y.pop AND x.i = y.i AND x.j = y.j AND x.locus < y.locus GROUP BY x.pop, x.locus, y.locus""")
step("first_state", "SELECT locus, min(allele) AS a FROM hap GROUP BY locus")
step(
    "haplo_tables",
    """SELECT x.pop, x.locus AS l1, y.locus AS l2, count(*) * 1e0 AS n, avg(CASE WHEN x.allele = f.a THEN 1e0 ELSE 0e0 END) AS pa, avg(CASE WHEN y.allele = g.a THEN 1e0 ELSE 0e0 END) AS pb,
    avg(CASE WHEN x.allele = f.a AND y.allele = g.a THEN 1e0 ELSE 0e0 END) AS pab FROM hap AS x JOIN hap AS y ON x.ind = y.ind AND x.locus < y.locus JOIN first_state AS f ON f.locus = x.locus JOIN first_state AS g ON g.locus = y.locus GROUP BY x.pop, x.locus, y.locus""",
)
query(
    "haploid_ld",
    f"""SELECT pop, l1, l2, {r("d")} AS d, {r("abs(d) / nullif(CASE WHEN d >= 0 THEN least(pa * (1 - pb), (1 - pa) * pb) ELSE least(pa * pb, (1 - pa) * (1 - pb)) END, 0)")} AS d_prime, {r("d * d / (pa * (1 - pa) * pb * (1 - pb))")} AS r2,
    {r("n * d * d / (pa * (1 - pa) * pb * (1 - pb))")} AS chi2 FROM (SELECT *, pab - pa * pb AS d FROM haplo_tables) AS x WHERE n >= 4 AND pa > 0 AND pa < 1 AND pb > 0 AND pb < 1""",
)

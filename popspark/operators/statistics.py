"""Descriptive statistics of traits."""

from popspark.plans.compose import query, r, series, step

query("trait_quantiles", f"""SELECT pop, trait, {r("$q(v, 0.25)$")} AS q1, {r("$q(v, 0.5)$")} AS median, {r("$q(v, 0.75)$")} AS q3 FROM traits GROUP BY pop, trait""")
step("medians", "SELECT pop, trait, $q(v, 0.5)$ AS m FROM traits GROUP BY pop, trait")
query("trait_mad", f"""SELECT t.pop, t.trait, {r("1.4826e0 * $q(abs(t.v - m.m), 0.5)$")} AS mad, {r("CASE WHEN min(t.v) > 0 THEN exp(avg(ln(greatest(t.v, 1e-300)))) END")} AS geomean, {r("CASE WHEN min(t.v) > 0 THEN 1 / avg(1 / nullif(t.v, 0)) END")} AS harmean FROM traits AS t JOIN medians AS m ON m.pop = t.pop AND m.trait = t.trait GROUP BY t.pop, t.trait""")
step("centred", "SELECT t.trait, t.v - m.m AS x FROM traits AS t JOIN (SELECT trait, avg(v) AS m FROM traits GROUP BY trait) AS m ON m.trait = t.trait")
step("moments", "SELECT trait, count(*) * 1e0 AS n, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM centred GROUP BY trait")
query("trait_shape", f"""SELECT trait, {r("m3 / power(m2, 1.5e0) * sqrt(n * (n - 1)) / (n - 2)")} AS skewness, {r("(n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6)")} AS kurtosis FROM moments WHERE n > 3 AND m2 > 0""")
query("trait_mode", "SELECT trait, v AS mode, n FROM (SELECT trait, v, count(*) AS n, row_number() OVER (PARTITION BY trait ORDER BY count(*) DESC, v) AS k FROM traits GROUP BY trait, v) AS x WHERE k = 1 AND n > 1")
step("histogram_scale", "SELECT trait, min(v) AS low, max(v) AS high, least(30, greatest(5, ceil(sqrt(count(*) * 1e0)))) AS k FROM traits GROUP BY trait HAVING max(v) > min(v)")
query("trait_histogram", "SELECT trait, class, count(*) AS n FROM (SELECT t.trait, CAST(least(s.k - 1, floor((t.v - s.low) / (s.high - s.low) * s.k)) AS BIGINT) AS class FROM traits AS t JOIN histogram_scale AS s ON s.trait = t.trait) AS x GROUP BY trait, class")
step("quartiles", "SELECT pop, trait, $q(v, 0.25)$ AS q1, $q(v, 0.75)$ AS q3 FROM traits GROUP BY pop, trait")
query("trait_box", f"""SELECT t.pop, t.trait, {r("min(CASE WHEN t.v >= q1 - 1.5e0 * (q3 - q1) THEN t.v END)")} AS low, {r("max(CASE WHEN t.v <= q3 + 1.5e0 * (q3 - q1) THEN t.v END)")} AS high, count(CASE WHEN t.v < q1 - 1.5e0 * (q3 - q1) OR t.v > q3 + 1.5e0 * (q3 - q1) THEN 1 END) AS outliers FROM traits AS t JOIN quartiles AS q ON q.pop = t.pop AND q.trait = t.trait GROUP BY t.pop, t.trait""")
#: Every two traits of an individual, whatever their names.
step("trait_pairs", "SELECT x.ind, x.pop, x.trait AS t1, y.trait AS t2, x.v AS x, y.v AS y FROM traits AS x JOIN traits AS y ON x.ind = y.ind AND x.trait < y.trait WHERE x.v IS NOT NULL AND y.v IS NOT NULL")
step("ranked", "SELECT pop, t1, t2, x, y, rank() OVER (PARTITION BY pop, t1, t2 ORDER BY x) + (count(*) OVER (PARTITION BY pop, t1, t2, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY pop, t1, t2 ORDER BY y) + (count(*) OVER (PARTITION BY pop, t1, t2, y) - 1) / 2e0 AS ry FROM trait_pairs")
query("trait_correlation", f"""SELECT pop, t1, t2, {r("corr(x, y)")} AS pearson, {r("corr(rx, ry)")} AS spearman FROM ranked GROUP BY pop, t1, t2""")
#: Agreement of populations with the states of each locus, as two partitions: adjusted Rand index, Fowlkes and Mallows. Pairs are counted from one table.
step("met", "SELECT locus, pop, allele, count(*) * 1e0 AS n FROM hap WHERE pop IS NOT NULL AND allele IS NOT NULL GROUP BY locus, pop, allele")
step("met_a", "SELECT locus, sum(n * n) AS s FROM (SELECT locus, pop, sum(n) AS n FROM met GROUP BY locus, pop) AS x GROUP BY locus")
step("met_b", "SELECT locus, sum(n * n) AS s FROM (SELECT locus, allele, sum(n) AS n FROM met GROUP BY locus, allele) AS x GROUP BY locus")
step("met_all", "SELECT m.locus, m.n, (m.s - m.n) / 2 AS shared, (a.s - m.n) / 2 AS a, (b.s - m.n) / 2 AS b, m.n * (m.n - 1) / 2 AS pairs FROM (SELECT locus, sum(n) AS n, sum(n * n) AS s FROM met GROUP BY locus) AS m JOIN met_a AS a ON a.locus = m.locus JOIN met_b AS b ON b.locus = m.locus")
query(
    "partition_agreement",
    f"""SELECT locus, CAST(n AS BIGINT) AS n, {r("CASE WHEN (a + b) / 2 - a * b / pairs = 0 THEN 1e0 ELSE (shared - a * b / pairs) / ((a + b) / 2 - a * b / pairs) END")} AS rand_adjusted,
    {r("CASE WHEN a > 0 AND b > 0 THEN shared / sqrt(a * b) ELSE 0e0 END")} AS fowlkes_mallows FROM met_all WHERE pairs > 0""",
)
#: Gaussian kernel density of each trait on POINTS points from its least to its greatest value, with the usual rule for the width.
POINTS = 64
step("kernel_width", "SELECT trait, n, low, high, CASE WHEN h > 0 THEN h ELSE 1e0 END AS h FROM (SELECT trait, n, low, high, 0.9e0 * least(sd, CASE WHEN iqr > 0 THEN iqr / 1.34e0 ELSE sd END) * power(n, -0.2e0) AS h FROM (SELECT trait, count(*) * 1e0 AS n, min(v) AS low, max(v) AS high, coalesce(stddev_samp(v), 0e0) AS sd, $q(v, 0.75)$ - $q(v, 0.25)$ AS iqr FROM traits WHERE v IS NOT NULL GROUP BY trait) AS x) AS y")
step("kernel_grid", f"SELECT trait, n, h, i, low + (high - low) * i / ({POINTS - 1} * 1e0) AS x FROM (SELECT trait, n, h, low, high, {series('0', str(POINTS - 1))} AS i FROM kernel_width) AS g")
query("trait_density", f"""SELECT g.trait, g.i AS point, {r("max(g.x)")} AS x, {r("sum(exp(-0.5e0 * (g.x - t.v) * (g.x - t.v) / (g.h * g.h))) / max(g.n * g.h * sqrt(2 * pi()))")} AS density FROM kernel_grid AS g JOIN traits AS t ON t.trait = g.trait AND t.v IS NOT NULL GROUP BY g.trait, g.i""")
#: Classes of a histogram by three rules: Sturges, Freedman and Diaconis, square root.
query(
    "trait_bins",
    """SELECT trait, CAST(n AS BIGINT) AS n, CAST(greatest(3, ceil(log2(n) + 1)) AS BIGINT) AS sturges, CAST(greatest(3, ceil(sqrt(n))) AS BIGINT) AS root,
    CAST(CASE WHEN iqr > 0 THEN greatest(3, least(60, ceil((high - low) / (2 * iqr / cbrt(n))))) ELSE 10 END AS BIGINT) AS freedman_diaconis
    FROM (SELECT trait, count(*) * 1e0 AS n, min(v) AS low, max(v) AS high, $q(v, 0.75)$ - $q(v, 0.25)$ AS iqr FROM traits WHERE v IS NOT NULL GROUP BY trait) AS x""",
)

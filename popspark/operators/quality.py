"""Quality control: missing data, clones, rare and fixed bands."""

from popspark.plans.compose import query, r, step

step("inds", "SELECT DISTINCT ind, pop FROM geno")
step("n_inds", "SELECT count(*) AS n FROM inds")
step("loci", "SELECT locus, min(least(a1, a2)) AS low, max(greatest(a1, a2)) AS high FROM geno GROUP BY locus")

query(
    "locus_qc",
    f"""SELECT g.locus, count(*) AS scored, max(t.n) - count(*) AS missing, {r("(max(t.n) - count(*)) / (max(t.n) * 1e0)")} AS p_missing,
    max(k.k) AS n_alleles, max(k.k) <= 1 AS monomorphic, {r("avg(CASE WHEN a1 <> a2 THEN 1e0 ELSE 0e0 END)")} AS ho
    FROM geno AS g CROSS JOIN n_inds AS t JOIN (SELECT locus, count(DISTINCT allele) AS k FROM copies GROUP BY locus) AS k ON k.locus = g.locus GROUP BY g.locus""",
)
query(
    "individual_qc",
    f"""SELECT g.ind, g.pop, count(*) AS scored, max(l.n) - count(*) AS missing, {r("(max(l.n) - count(*)) / (max(l.n) * 1e0)")} AS p_missing
    FROM geno AS g CROSS JOIN (SELECT count(*) AS n FROM loci) AS l GROUP BY g.ind, g.pop""",
)
query("population_sizes", "SELECT pop, count(*) AS n FROM inds GROUP BY pop")
step(
    "signatures",
    """SELECT ind, $joined(s ; locus)$ AS signature, count(*) AS scored FROM (SELECT ind, locus, concat(CAST(locus AS STRING), ':', CAST(least(a1, a2) AS STRING), '/', CAST(greatest(a1, a2) AS STRING), ' ') AS s FROM geno) AS g GROUP BY ind""",
)
query("clones", """SELECT ind, first_ind FROM (SELECT ind, min(ind) OVER (PARTITION BY signature) AS first_ind FROM signatures WHERE scored >= 4) AS x WHERE ind <> first_ind""")
query("band_classes", f"""SELECT band, {r("avg(x * 1e0)")} AS frequency, avg(x * 1e0) > 0 AND avg(x * 1e0) < 0.05e0 AS rare, avg(x * 1e0) > 0.95e0 AND avg(x * 1e0) < 1 AS fixed FROM bands GROUP BY band""")
query(
    "capabilities",
    """SELECT count(DISTINCT pop) >= 2 AS differentiation, count(DISTINCT ind) >= 3 AS distances, count(DISTINCT locus) >= 2 AS linkage,
    count(DISTINCT ind) >= 6 AND count(DISTINCT locus) >= 5 AS clustering, count(DISTINCT pop) AS n_pops, count(DISTINCT locus) AS n_loci, count(DISTINCT ind) AS n_inds FROM geno""",
)
#: What a set of diploid genotypes allows, gate by gate, and what is lacking.
step("pop_sizes", "SELECT pop, count(*) AS n FROM inds WHERE pop IS NOT NULL GROUP BY pop")
step("mapped_inds", "SELECT count(DISTINCT p.ind) AS n FROM places AS p JOIN inds AS i ON i.ind = p.ind WHERE p.lat IS NOT NULL AND p.lon IS NOT NULL")
step(
    "totals",
    """SELECT (SELECT count(DISTINCT ind) FROM inds) AS inds, (SELECT count(*) FROM loci) AS loci, (SELECT count(*) FROM loci WHERE low <> high) AS varied, (SELECT count(*) FROM pop_sizes WHERE n >= 2) AS pops,
    (SELECT count(*) FROM pop_sizes WHERE n >= 5) AS larger, (SELECT n FROM mapped_inds) AS mapped""",
)
_GATES = {
    "diversity": ("loci > 0 AND pops >= 1", "no population has two individuals"),
    "hwe": ("pops >= 1", "no population has two individuals"),
    "linkage": ("loci >= 2 AND pops >= 1", "two loci and a population of two individuals are needed"),
    "amova": ("pops >= 2", "two populations of two individuals are needed"),
    "fstats": ("pops >= 2", "two populations of two individuals are needed"),
    "distance": ("inds >= 3 AND varied >= 1", "three individuals and a polymorphic locus are needed"),
    "ordination": ("inds >= 3", "three individuals are needed"),
    "clustering": ("inds >= 6 AND varied >= 5", "six individuals and five polymorphic loci are needed"),
    "sequences": ("inds < 0", "genotypes hold no aligned sequences"),
    "demography": ("loci >= 2 AND larger >= 1", "two loci and a population of five individuals are needed"),
    "spatial": ("mapped >= 1 AND inds >= 10", "ten individuals and their places are needed"),
}
query("capability_gates", " UNION ALL ".join(f"SELECT '{gate}' AS gate, {test} AS ok, CASE WHEN {test} THEN '' ELSE '{why}' END AS why FROM totals" for gate, (test, why) in _GATES.items()))

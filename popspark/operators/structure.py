"""Assignment of individuals to populations.

Those of one home who bear the same genotype have the same terms. So the terms are made for genotypes, as the steps
below have it, and put into arrays over populations; an individual adds up the arrays of its loci, and no row
per individual, locus and population is formed or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popspark.plans.compose import query, r, step
from popspark.plans.working import kept

#: Values of the genotypes' arrays that are broadcast, at most.
BROADCAST = 1 << 21
#: The genotypes of a home, each in place of an individual.
BEARERS = "SELECT named_struct('a1', a1, 'a2', a2) AS ind, pop, locus, a1, a2 FROM {kinds_df}"

step("global_k", "SELECT locus, count(*) AS k FROM alleles GROUP BY locus")
#: Rannala and Mountain's criterion; in the home population the individual's own copies are left out.
step(
    "assign_terms",
    """SELECT g.ind, g.pop AS home, c.pop, g.locus, CASE WHEN g.a1 = g.a2 THEN 2 * ln(x.f) ELSE ln(2 * x.f * y.f) END AS ll FROM geno AS g JOIN cells AS c ON c.locus = g.locus AND c.n >= 5
    JOIN assign_freqs AS x ON x.pop = c.pop AND x.locus = g.locus AND x.allele = g.a1 AND x.own = CASE WHEN c.pop <> g.pop THEN 0 WHEN g.a1 = g.a2 THEN 2 ELSE 1 END
    JOIN assign_freqs AS y ON y.pop = c.pop AND y.locus = g.locus AND y.allele = g.a2 AND y.own = CASE WHEN c.pop <> g.pop THEN 0 WHEN g.a1 = g.a2 THEN 2 ELSE 1 END""",
)
step("assign_freqs", "SELECT g.pop, g.locus, g.allele, o.own, (greatest(g.n - o.own, 0) + 1e0 / k.k) / (2e0 * g.inds - CASE WHEN o.own > 0 THEN 2 ELSE 0 END + 1) AS f FROM grid AS g JOIN global_k AS k ON k.locus = g.locus CROSS JOIN (SELECT 0 AS own UNION ALL SELECT 1 UNION ALL SELECT 2) AS o")
step("assign_ll", "SELECT ind, home, pop, sum(ll) AS ll FROM assign_terms GROUP BY ind, home, pop")
query("assignment", f"""SELECT ind, home, pop AS best, {r("ll")} AS log_likelihood, {r("home_ll - ll")} AS lambda FROM (SELECT ind, home, pop, ll, max(CASE WHEN pop = home THEN ll END) OVER (PARTITION BY ind) AS home_ll, row_number() OVER (PARTITION BY ind ORDER BY ll DESC, pop) AS k FROM assign_ll) AS x WHERE k = 1""")
query("assignment_matrix", "SELECT home, best, count(*) AS n FROM (SELECT ind, home, pop AS best, row_number() OVER (PARTITION BY ind ORDER BY ll DESC, pop) AS k FROM assign_ll) AS x WHERE k = 1 GROUP BY home, best")


def best_homes(geno: DataFrame, terms: DataFrame) -> DataFrame:
    """ind, home, best, ll, home_ll of each individual, from the step ``assign_terms`` of ``BEARERS``."""
    terms = kept(terms.select("home", "locus", "ind.a1", "ind.a2", "pop", "ll"))
    pops = [x["pop"] for x in terms.select("pop").distinct().orderBy("pop").collect()]
    names = F.array(*map(F.lit, pops)).cast(f"array<{geno.schema['pop'].dataType.simpleString()}>")
    of = F.map_from_entries(F.collect_list(F.struct("pop", "ll")))
    kinds = kept(terms.groupBy("home", "locus", "a1", "a2").agg(of.alias("of")).select(F.col("home").alias("k_home"), *(F.col(c).alias(f"k_{c}") for c in ("locus", "a1", "a2")), F.transform(names, lambda p: F.element_at("of", p)).alias("lls")))
    if kinds.count() * len(pops) <= BROADCAST:
        kinds = F.broadcast(kinds)
    met = geno.join(kinds, F.col("pop").eqNullSafe(F.col("k_home")) & (F.col("locus") == F.col("k_locus")) & (F.col("a1") == F.col("k_a1")) & (F.col("a2") == F.col("k_a2")))
    add = lambda s, v: F.zip_with(s, v, lambda a, b: F.coalesce(a + b, a, b))
    sums = met.groupBy("ind", F.col("pop").alias("home")).agg(F.aggregate(F.collect_list("lls"), F.transform(names, lambda _: F.lit(None).cast("double")), add).alias("lls"))
    # Populations are in order, so the first of equal ones is the one that the SQL takes.
    at = lambda c, k: F.get(c, k.cast("int") - 1)
    own = sums.withColumn("ll", F.array_max("lls")).where("ll IS NOT NULL")
    own = own.select("ind", "home", at(names, F.array_position("lls", F.col("ll"))).alias("best"), "ll", at(F.col("lls"), F.array_position(names, F.col("home"))).alias("home_ll"))
    mine = Window.partitionBy("ind")
    return own.withColumn("home_ll", F.max("home_ll").over(mine)).withColumn("k", F.row_number().over(mine.orderBy(F.desc("ll"), "best"))).where("k = 1").drop("k")


def assignment(homes: DataFrame) -> DataFrame:
    return homes.select("ind", "home", "best", (F.round("ll", 6) + 0.0).alias("log_likelihood"), (F.round(F.col("home_ll") - F.col("ll"), 6) + 0.0).alias("lambda"))


def assignment_matrix(homes: DataFrame) -> DataFrame:
    return homes.groupBy("home", "best").agg(F.count("*").alias("n"))


#: Queries over ``best_homes``.
ASSIGNED = {"assignment": assignment, "assignment_matrix": assignment_matrix}

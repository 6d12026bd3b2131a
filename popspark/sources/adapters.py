"""Views of the star-schema test tables as genetic data, in SQL that Spark and DuckDB share.

Every operator reads these relations; a user's own data replaces them (``popspark.dataset``):

- geno: ind, pop, region, locus, a1, a2 (one row per scored diploid genotype)
- bands: ind, pop, band, x (0 or 1)
- hap: ind, pop, locus, allele (haploid loci)
- traits: ind, pop, trait, v
- places: ind, pop, lat, lon
- sites: ind, pop, site, base (aligned sequences, one row per site)
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.plans.compose import step

#: Lines of a partition (about), so that a task's memory doesn't grow with the tables.
LINES = 1 << 19


def genotypes(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """The rows of the step ``geno``, dealt by individuals to as many partitions as the lines need; what groups by individual shuffles no more."""
    parts = max(lineitem.sparkSession.sparkContext.defaultParallelism, -(-lineitem.count() // LINES))
    homes = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    people = orders.join(homes, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ind"), F.col("c_nationkey").alias("pop"), F.col("n_regionkey").alias("region"))
    lines = lineitem.select(F.col("l_orderkey").alias("ind"), F.col("l_linenumber").alias("locus"), "l_partkey", "l_suppkey")
    scored = lines.repartition(parts, "ind").join(people.repartition(parts, "ind"), "ind")
    return scored.groupBy("ind", "pop", "region", "locus").agg((F.min("l_partkey") % 6).alias("a1"), (F.min("l_suppkey") % 6).alias("a2"))


step(
    "geno",
    """SELECT l_orderkey AS ind, c_nationkey AS pop, n_regionkey AS region, l_linenumber AS locus,
    min(l_partkey) % 6 AS a1, min(l_suppkey) % 6 AS a2
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY l_orderkey, c_nationkey, n_regionkey, l_linenumber""",
)
step(
    "bands",
    """SELECT c_custkey AS ind, c_nationkey AS pop, band, CASE WHEN max(o_orderkey) IS NULL THEN 0 ELSE 1 END AS x
    FROM customer CROSS JOIN (SELECT DISTINCT concat(o_orderpriority, o_orderstatus) AS band FROM orders) AS b
    LEFT JOIN orders ON o_custkey = c_custkey AND concat(o_orderpriority, o_orderstatus) = band
    GROUP BY c_custkey, c_nationkey, band""",
)
step(
    "hap",
    """SELECT p_partkey AS ind, p_brand AS pop, 'type' AS locus, p_type AS allele FROM part
    UNION ALL SELECT p_partkey, p_brand, 'size', CAST(p_size % 8 AS VARCHAR(9)) FROM part
    UNION ALL SELECT p_partkey, p_brand, 'price', CAST(CAST(floor(p_retailprice) AS BIGINT) % 10 AS VARCHAR(9)) FROM part""",
)
step(
    "traits",
    """SELECT p_partkey AS ind, p_brand AS pop, 'size' AS trait, CAST(p_size AS DOUBLE) AS v FROM part
    UNION ALL SELECT p_partkey, p_brand, 'price', p_retailprice FROM part""",
)
step(
    "places",
    """SELECT o_orderkey AS ind, c_nationkey AS pop, (o_orderkey * 37 % 18000) / 100e0 - 90e0 AS lat, (o_orderkey * 91 % 36000) / 100e0 - 180e0 AS lon
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
#: Two signs of the embedding make one base; the list's element access is written alike in both engines from here on.
step(
    "sites",
    """SELECT vec_id AS ind, label AS pop, site, CASE WHEN u >= 0 THEN CASE WHEN v >= 0 THEN 'A' ELSE 'C' END ELSE CASE WHEN v >= 0 THEN 'G' ELSE 'T' END END AS base
    FROM (SELECT vec_id, label, site, $at(embedding, 2 * site - 1)$ AS u, $at(embedding, 2 * site)$ AS v
        FROM embeddings CROSS JOIN (SELECT """
    + "$series(1 ; 32)$"
    + """ AS site) AS s) AS e""",
)

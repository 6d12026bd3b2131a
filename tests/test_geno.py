"""Genotypes of the tables, and what follows from their numbers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark import dataset
from popspark.dataset import KINDS, Dataset, genotype_kinds, relation
from popspark.plans.compose import statement
from popspark.sources import adapters

TABLES = "/root/testdata/sf0.001"


def same(a: DataFrame, b: DataFrame) -> bool:
    return a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_partitions_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(adapters, "LINES", 100)
    read = [spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("lineitem", "orders", "customer", "nation")]
    made = adapters.genotypes(*read)
    rows = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) >= read[0].count() // 200 and max(r["count"] for r in rows) < 300
    views = dict(zip(("lineitem", "orders", "customer", "nation"), read, strict=True))
    sql = statement("SELECT * FROM geno", "spark")
    for t in views:
        sql = dataset._named(sql, t)
    assert same(relation(spark, TABLES, "geno"), spark.sql(sql, **{f"t_{t}": v for t, v in views.items()}))


def test_counts_of_genotypes_give_the_steps(spark):
    rows = [(i, p, "R", l, a, b) for p in ("A", None) for l in ("L1", "L2") for i, (a, b) in enumerate([(1, 2), (2, 1), (1, 1), (None, 2), (3, None), (None, None), (1, 2)])]
    geno = spark.createDataFrame(rows, "ind int, pop string, region string, locus string, a1 int, a2 int")
    for name in KINDS:
        plain = spark.sql(statement(f"SELECT * FROM {name}", "spark", {"geno": "SELECT * FROM {g}"}), g=geno)
        assert same(Dataset(spark, geno=geno).sql(f"SELECT * FROM {name}"), plain)
    assert genotype_kinds(geno).agg(F.sum("n")).first()[0] == len(rows)


def test_linkage_counts_an_individual_without_population_once(spark):
    from popspark.operators.association import multilocus_ld, pairwise_ld

    def geno(other):
        rows = [(i, "A" if i < 12 else other, "R", l, (i * 7 + k) % 3, (i * i + k) % 3) for i in range(24) for k, l in enumerate(("L1", "L2", "L3"))]
        return spark.createDataFrame(rows, "ind int, pop string, region string, locus string, a1 int, a2 int")

    for test in (multilocus_ld, pairwise_ld):
        none, told = ({tuple(r)[:-1] for r in test(geno(p), 9).collect() if r.pop in (None, "A")} for p in (None, "Z"))
        assert none == told and len(none) > 1


def test_sequences_asked_meet_all_others_in_blocks(spark, monkeypatch):
    from popspark.operators import patterns

    sites = spark.createDataFrame([(i, "P", s, "ACGT-"[(i * i + i * s + s) % 5]) for i in range(30) for s in range(12)], "ind bigint, pop string, site int, base string")
    columns = spark.sql(statement("SELECT * FROM patterns", "spark", {"sites": "SELECT * FROM {s}"}), s=sites)
    whole = patterns.sequence_distances(sites, columns).collect()
    monkeypatch.setattr(patterns, "BLOCK", 2)
    got = patterns.sequence_distances(sites, columns, 10)
    assert got.count() == 3 + 3 * 27
    told = {frozenset(r[:2]): r[2:] for r in whole}
    assert all(told[frozenset(r[:2])] == r[2:] for r in got.collect())

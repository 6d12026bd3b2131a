"""Assignment from arrays of genotypes."""

import random

from popspark.dataset import QUERIES, Dataset
from popspark.operators import structure
from popspark.plans.compose import statement


def _geno(spark):
    g = random.Random(3)
    rows = [(i, "ABC"[i % 3], "R", l, g.randrange(4), g.randrange(4)) for i in range(60) for l in ("L1", "L2", "L3") if g.random() < 0.9]
    rows += [(90, None, "R", "L1", 1, 2), (91, "A", "R", "L1", None, 2), (91, "A", "R", "L2", 0, 0), (92, "D", "R", "L3", 1, 1), (5, "A", "R", "L1", 1, 1)]
    return spark.createDataFrame(rows, "ind int, pop string, region string, locus string, a1 int, a2 int")


def test_equals_its_sql(spark, monkeypatch):
    geno = _geno(spark)
    for broadcast in (1 << 21, 0):
        monkeypatch.setattr(structure, "BROADCAST", broadcast)
        for name in structure.ASSIGNED:
            plain = spark.sql(statement(QUERIES[name], "spark", {"geno": "SELECT * FROM {g}"}), g=geno)
            got = Dataset(spark, geno=geno).result(name)
            assert got.columns == plain.columns and sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_forms_no_row_per_individual_locus_and_population(spark):
    plan = Dataset(spark, geno=_geno(spark)).result("assignment")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1

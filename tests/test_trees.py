import pytest

from popspark.operators import clustering, trees


def test_newick_and_ancestors(spark):
    text = "((a:1,'b c':2)95:0.5,(d[&x=1],e)'in':3);"
    rows = trees.edges(spark.createDataFrame([("t", text), ("u", None)], "tree string, newick string"))
    got = {(r.label, r.length) for r in rows.where("label IS NOT NULL").collect()}
    assert got == {("a", 1.0), ("b c", 2.0), ("d", None), ("e", None), ("in", 3.0)}
    assert [r.support for r in rows.where("support IS NOT NULL").collect()] == [0.95]
    groups = spark.createDataFrame([("x", "a"), ("x", "b c"), ("y", "a"), ("y", "d")], "grp string, label string")
    found = {r.grp: r for r in trees.common_ancestors(rows, groups).collect()}
    assert found["x"].monophyletic and not found["y"].monophyletic and found["y"].node == 0
    counts = {r.node: r.tips for r in trees.tip_counts(rows).collect()}
    assert counts[0] == 4


def test_split_support(spark):
    many = spark.createDataFrame([(1, "((a,b),(c,d));"), (2, "((a,b),(c,d));"), (3, "((a,c),(b,d));")], "tree int, newick string")
    got = {r.split: r.support for r in trees.split_support(trees.edges(many)).collect()}
    assert got == {"c,d": pytest.approx(2 / 3), "b,d": pytest.approx(1 / 3)}


def test_number_of_clusters(spark):
    runs = spark.createDataFrame([(k, v + d) for k, v in ((1, -100.0), (2, -50.0), (3, -45.0), (4, -44.0)) for d in (-1.0, 1.0)], "k int, lnp double")
    got = {r.k: r.delta_k for r in clustering.evanno(runs).collect()}
    assert got[1] is None and got[2] == pytest.approx(45 / 2**0.5) and got[3] == pytest.approx(4 / 2**0.5)


def test_units(spark):
    units = spark.createDataFrame([("Era", 1, 0.0, 66.0), ("Period", 2, 23.03, 66.0), ("Epoch", 3, 33.9, 56.0)], "name string, rank int, upper double, lower double")
    ages = spark.createDataFrame([(1, 40.0), (2, 60.0), (3, 1.0), (4, 100.0)], "id int, age double")
    assert {r.id: r.unit for r in clustering.units_of(ages, units).collect()} == {1: "Epoch", 2: "Period", 3: "Era", 4: None}

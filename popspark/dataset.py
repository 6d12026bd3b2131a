"""A data set: the relations that the operators read, bound to a Spark session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import popspark.operators  # noqa: F401  registers the operators
import popspark.sources.adapters  # noqa: F401  registers the relations
from popspark.operators import associated, ranked, structure
from popspark.operators.pairs import MADE, PAIRS, STEPS
from popspark.plans.compose import QUERIES, statement
from popspark.plans.working import kept
from popspark.sources.adapters import genotypes

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Queries with a Spark form of their own, of the step they read; their SQL is what they are held against.
OWN = PAIRS | {"index_of_association": ("geno", associated.index_of_association), "pairwise_rd": ("geno", associated.pairwise_rd), "correlogram": ("mapped_rows", ranked.correlogram), "kinship_slope": ("mapped_rows", ranked.kinship_slope)}


#: Steps that follow from the numbers of genotypes in a cell: individuals are counted once, whatever reads these.
KINDS = {
    "allele_counts": """SELECT pop, locus, allele, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN het THEN n ELSE 0 END) AS BIGINT) AS n_het FROM (SELECT pop, locus, a1 AS allele, a1 <> a2 AS het, n FROM {kinds_df}
    UNION ALL SELECT pop, locus, a2, a1 <> a2, n FROM {kinds_df}) AS c GROUP BY pop, locus, allele""",
    "genotypes": "SELECT pop, locus, least(a1, a2) AS a, greatest(a1, a2) AS b, CAST(sum(n) AS BIGINT) AS n FROM {kinds_df} GROUP BY pop, locus, least(a1, a2), greatest(a1, a2)",
}


def genotype_kinds(geno: DataFrame) -> DataFrame:
    """pop, locus, a1, a2, n: a row per genotype of a cell, kept."""
    return kept(geno.groupBy("pop", "locus", "a1", "a2").agg(F.count("*").alias("n")))


def _needs(sql: str, *steps: str) -> bool:
    return any(re.search(rf"(^WITH |,\n){s} AS \(", sql) for s in steps)


class Dataset:
    """DataFrames for some of geno, bands, hap, traits, places, sites; ``result`` runs an operator on them."""

    def __init__(self, spark: SparkSession, **relations: DataFrame):
        self.spark, self.relations = spark, relations

    def result(self, name: str) -> DataFrame:
        if name in OWN:
            step, run = OWN[name]
            return run(self.sql(f"SELECT * FROM {step}"))
        if name in structure.ASSIGNED:
            geno = self.relations["geno"]
            terms = self.spark.sql(statement("SELECT * FROM assign_terms", "spark", KINDS | {"geno": structure.BEARERS}), kinds_df=genotype_kinds(geno))
            return structure.ASSIGNED[name](structure.best_homes(geno, terms))
        if name in MADE:
            source, make, over = STEPS[MADE[name]]
            made = make(self.sql(f"SELECT * FROM {source}"))
            return Dataset(self.spark, **self.relations, made=made).sql(QUERIES[name], {MADE[name]: over.format(made="{made_df}")})
        return self.sql(QUERIES[name])

    def sql(self, select: str, given: dict[str, str] | None = None) -> DataFrame:
        """A SELECT over named steps; ``given`` replaces steps."""
        views = {k: f"SELECT * FROM {{{k}_df}}" for k in self.relations} | (given or {})
        frames = {f"{k}_df": v for k, v in self.relations.items()}
        if _needs(statement(select, "spark", views), *KINDS):
            views, frames["kinds_df"] = KINDS | views, genotype_kinds(self.relations["geno"])
        return self.spark.sql(statement(select, "spark", views), **frames)


def from_tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An operator's result over the adapter views of the tables in ``sf_dir``."""
    if name in OWN:
        step, run = OWN[name]
        return run(relation(spark, sf_dir, step))
    if name in structure.ASSIGNED:
        return Dataset(spark, geno=relation(spark, sf_dir, "geno")).result(name)
    if name in MADE:
        source, make, over = STEPS[MADE[name]]
        return _over_tables(spark, sf_dir, QUERIES[name], {MADE[name]: over.format(made="{made_df}")}, made_df=make(relation(spark, sf_dir, source)))
    return _over_tables(spark, sf_dir, QUERIES[name])


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the relations that operators read (geno, bands, ...), from the tables in ``sf_dir``."""
    return _over_tables(spark, sf_dir, f"SELECT * FROM {name}")


def _over_tables(spark: SparkSession, sf_dir: str, select: str, given: dict[str, str] | None = None, **frames: DataFrame) -> DataFrame:
    given = dict(given or {})
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if _needs(statement(select, "spark", given), "geno"):
        geno = genotypes(*(read(t) for t in ("lineitem", "orders", "customer", "nation")))
        if _needs(statement(select, "spark", given), *KINDS):
            given, frames["kinds_df"] = KINDS | given, genotype_kinds(geno)
        given, frames["geno_df"] = {"geno": "SELECT * FROM {geno_df}"} | given, geno
    sql = statement(select, "spark", given)
    used = [t for t in TABLES if f" {t} " in sql or f" {t}\n" in sql or f" {t})" in sql]
    for t in used:
        sql = _named(sql, t)
    return spark.sql(sql, **{f"t_{t}": read(t) for t in used}, **frames)


def _named(sql: str, table: str) -> str:
    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{t_{table}}}", sql)


def duck_sql(name: str) -> str:
    return statement(QUERIES[name], "duckdb")

"""Haplotype frequencies of two loci by EM, from the nine counts of two-locus genotypes.

Each locus is read as its first allele against all others. Of a diploid's two-locus genotypes only the
double heterozygote is ambiguous, so a pair of loci is one row of nine counts, whatever the number
of individuals, and the EM runs inside that row.
"""

from __future__ import annotations

from popspark.plans.compose import query, r, statement, step

#: Rounds of EM at most, the change of frequencies that ends it, individuals with both loci at least.
ROUNDS, NEAR, LEAST = 200, "1e-9", 4

step("first_allele", "SELECT locus, min(allele) AS a FROM alleles GROUP BY locus")
step("doses", "SELECT g.ind, g.pop, g.locus, CASE WHEN g.a1 = f.a THEN 1 ELSE 0 END + CASE WHEN g.a2 = f.a THEN 1 ELSE 0 END AS x FROM geno AS g JOIN first_allele AS f ON f.locus = g.locus WHERE g.a1 IS NOT NULL AND g.a2 IS NOT NULL")
_COUNTS = ", ".join(f"count(CASE WHEN x.x = {i} AND y.x = {j} THEN 1 END) * 1e0 AS n{i}{j}" for i in (2, 1, 0) for j in (2, 1, 0))
step("two_loci", f"SELECT x.pop, x.locus AS l1, y.locus AS l2, count(*) * 1e0 AS n, {_COUNTS} FROM doses AS x JOIN doses AS y ON x.ind = y.ind AND x.pop = y.pop AND x.locus < y.locus GROUP BY x.pop, x.locus, y.locus HAVING count(*) >= {LEAST}")
#: Copies of each haplotype that are certain; n11 are the double heterozygotes.
step("certain", "SELECT pop, l1, l2, n, n11 AS d, 2 * n22 + n21 + n12 AS c0, 2 * n20 + n21 + n10 AS c1, 2 * n02 + n12 + n01 AS c2, 2 * n00 + n01 + n10 AS c3 FROM two_loci")


def _round(f: str) -> tuple[str, ...]:
    """New frequencies from those in the fields of ``f``."""
    both = f"{f}f0 * {f}f3 + {f}f1 * {f}f2"
    coupled, apart = (f"d * {f}{x} * {f}{y} / CASE WHEN {both} = 0 THEN 1e0 ELSE {both} END" for x, y in (("f0", "f3"), ("f1", "f2")))
    return tuple(f"(c{k} + {coupled if k in (0, 3) else apart}) / (2 * n)" for k in range(4))


def _change(new: tuple[str, ...], f: str) -> str:
    return " + ".join(f"abs({v} - {f}f{k})" for k, v in enumerate(new))


START = ", ".join(f"0.25e0 AS f{k}" for k in range(4))
_NEW = _round("s.")
_FIELDS = ", ".join(f"'f{k}', {v}" for k, v in enumerate(_NEW))
#: Spark folds the rounds inside the row; DuckDB, as the oracle, takes them by recursion.
SPARK = f"""SELECT pop, l1, l2, n, e.f0 AS f0, e.f1 AS f1, e.f2 AS f2, e.f3 AS f3 FROM (SELECT *, aggregate(sequence(1, {ROUNDS}),
    named_struct('f0', 0.25D, 'f1', 0.25D, 'f2', 0.25D, 'f3', 0.25D, 'left', 1D),
    (s, i) -> CASE WHEN s.left < {NEAR} THEN s ELSE named_struct({_FIELDS}, 'left', {_change(_NEW, "s.")}) END) AS e FROM certain) AS x"""
_DUCK_NEW = _round("")
DUCK = f"""WITH RECURSIVE em AS (SELECT *, 0 AS i, {START}, 1e0 AS change FROM certain UNION ALL
    SELECT pop, l1, l2, n, d, c0, c1, c2, c3, i + 1, {", ".join(_DUCK_NEW)}, {_change(_DUCK_NEW, "")} FROM em WHERE i < {ROUNDS} AND change >= {NEAR})
    SELECT pop, l1, l2, n, f0, f1, f2, f3 FROM em QUALIFY row_number() OVER (PARTITION BY pop, l1, l2 ORDER BY i DESC) = 1"""

_MEASURES = f"""SELECT pop, l1, l2, CAST(n AS BIGINT) AS n, {r("f0")} AS f_ab, {r("f1")} AS f_a, {r("f2")} AS f_b, {r("f3")} AS f_none, {r("x")} AS d,
    {r("abs(x) / nullif(CASE WHEN x >= 0 THEN least(pa * (1 - pb), (1 - pa) * pb) ELSE least(pa * pb, (1 - pa) * (1 - pb)) END, 0)")} AS d_prime,
    {r("x * x / nullif(pa * (1 - pa) * pb * (1 - pb), 0)")} AS r2, {r("2 * n * x * x / nullif(pa * (1 - pa) * pb * (1 - pb), 0)")} AS chi2
    FROM (SELECT *, f0 + f1 AS pa, f0 + f2 AS pb, f0 - (f0 + f1) * (f0 + f2) AS x FROM (EM) AS e) AS y"""

query("haplotype_em", _MEASURES.replace("EM", SPARK))


def duck_sql() -> str:
    """The same by recursion, for DuckDB."""
    return statement(_MEASURES.replace("EM", DUCK), "duckdb")

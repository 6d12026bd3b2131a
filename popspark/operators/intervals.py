"""Bootstrap intervals over loci, per population: each replicate draws as many loci as there are, by a hash of its number."""

from popspark.plans.compose import query, r, series, step

REPLICATES = 1000
INDICES = ("na", "ne", "i", "ho", "he")


def draws(name: str, cells: str) -> None:
    """``name``: pop, rep, and the drawn rows of the step ``cells`` (pop, locus, ...) for populations of three loci at least."""
    step(f"{name}_ix", f"SELECT *, row_number() OVER (PARTITION BY pop ORDER BY locus) - 1 AS ix, count(*) OVER (PARTITION BY pop) AS n_loci FROM {cells}")
    step(f"{name}_slots", f"SELECT pop, n_loci, rep, {series('1', 'CAST(n_loci AS INT)')} AS slot FROM (SELECT pop, n_loci, {series('1', str(REPLICATES))} AS rep FROM (SELECT pop, max(n_loci) AS n_loci FROM {name}_ix GROUP BY pop HAVING max(n_loci) > 2) AS x) AS y")
    step(f"{name}_picks", f"SELECT pop, rep, $draw(concat('{name}/', CAST(pop AS VARCHAR(99)), '/', CAST(rep AS VARCHAR(9)), '/', CAST(slot AS VARCHAR(9))) ; n_loci)$ AS ix FROM {name}_slots")
    step(name, f"SELECT k.rep, c.* FROM {name}_picks AS k JOIN {name}_ix AS c ON c.pop = k.pop AND c.ix = k.ix")


def limits(*columns: str) -> str:
    return ", ".join(f"{r(f'$q({c}, {share})$')} AS {c}_{side}" for c in columns for share, side in ((0.025, "low"), (0.975, "high")))


step("index_cells", "SELECT pop, locus, na * 1e0 AS na, ne, i, ho, he FROM cell_stats")
draws("index_draws", "index_cells")
query("diversity_intervals", f"""SELECT pop, {limits(*INDICES)} FROM (SELECT pop, rep, {", ".join(f"avg({c}) AS {c}" for c in INDICES)} FROM index_draws GROUP BY pop, rep) AS x GROUP BY pop""")
step("fis_cells", "SELECT pop, locus, b, c FROM fis_parts WHERE k >= 2 AND b + c <> 0")
draws("fis_draws", "fis_cells")
query("fis_intervals", f"""SELECT pop, {limits("f")} FROM (SELECT pop, rep, 1 - sum(c) / sum(b + c) AS f FROM fis_draws GROUP BY pop, rep HAVING sum(b + c) > 0) AS x GROUP BY pop""")

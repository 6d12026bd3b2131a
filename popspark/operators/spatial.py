"""Spatial structure: kinship or Smouse and Peakall's r by distance class, with envelopes by shuffling places.

Both statistics of a pair are products of two rows: centred allele shares for Loiselle's kinship (with
the loci that both have as its denominator), centred bands for Smouse and Peakall's double-centred matrix,
whose rows' products are its elements. So a task holds a population's rows, never its pairs: tiles of
pairs are formed, put into classes and added up, replicate by replicate. All that leaves a task are sums by class.

Pairs lie within populations of ``LEAST`` mapped individuals or more. Classes hold (nearly) equal numbers
of pairs: their limits are found by counts over kilometres, then metres; pairs of one metre stay together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popspark.operators.permutation import GROUPS, NEAR, rng
from popspark.plans.working import kept

#: Tiles are small, so that a product stays on its task's core and in its cache.
LEAST, PAIRS, CLASSES, TILE = 5, 30, 10, 64
#: Half the Earth's girth in kilometres, and its mean radius.
FARTHEST, RADIUS = 20_040, 6371.0088


class Rows:
    """Rows of a population whose products are the statistic of a pair."""

    def __init__(self, people: pa.Table, kinship: bool):
        items = people["own"].to_pylist()
        codes = 1 + max((x["code"] for own in items for x in own), default=-1)
        loci = 1 + max((x["nth"] for own in items for x in own), default=-1)
        n = len(items)
        x, seen, locus = np.zeros((n, codes)), np.zeros((n, loci)), np.zeros(codes, np.int64)
        for i, own in enumerate(items):
            for v in own:
                x[i, v["code"]] += v["x"]
                seen[i, v["nth"]] = 1
                locus[v["code"]] = v["nth"]
        self.kinship = kinship
        have = seen[:, locus] if codes else seen
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(have.sum(axis=0) > 0, x.sum(axis=0) / have.sum(axis=0), 0)
        self.x = (x - mean) * have
        if kinship:
            spread = np.zeros(loci)
            np.add.at(spread, locus, mean**2)
            genes = 2 * seen.sum(axis=0)
            self.seen = seen
            self.den = np.where(genes > 0, 1 - spread, 0)
            self.more = np.where(genes > 1, self.den / np.maximum(1, genes - 1), 0)
        else:
            self.norm = (self.x**2).sum(axis=1)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Values and weights (None: all 1) of all pairs of the rows i and j; their class sums' ratio is the statistic."""
        dot = self.x[i] @ self.x[j].T
        if not self.kinship:
            return dot, (self.norm[i][:, None] + self.norm[j][None]) / 2
        a, b = self.seen[i], self.seen[j].T
        dot += (a * self.more) @ b
        den = (a * self.den) @ b
        if den.min() > 0:
            dot /= den
            return dot, None
        known = den > 0
        return np.divide(dot, den, out=np.zeros_like(dot), where=known), known.astype(float)


def kilometres(lat: np.ndarray, lon: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lon)
    a = np.sin((p[j][None] - p[i][:, None]) / 2) ** 2 + np.cos(p[i])[:, None] * np.cos(p[j])[None] * np.sin((q[j][None] - q[i][:, None]) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.minimum(1, np.sqrt(a)))


def tiles(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            yield np.arange(a, min(a + TILE, n)), np.arange(b, min(b + TILE, n))


def _distances(people: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Kilometres of the tile's pairs; 0 for those that don't count (one place, or seen in the other order)."""
    km = kilometres(people["lat"].to_numpy(), people["lon"].to_numpy(), i, j)
    return np.where(i[:, None] < j[None], km, 0)


def _packed(scores: DataFrame, places: DataFrame) -> DataFrame:
    """pop, ind, lat, lon, own (code, nth, x) of mapped individuals in populations large enough; ``scores``: pop, ind, locus, state, x."""
    states = scores.select("locus", "state").distinct()
    coded = states.withColumn("code", F.row_number().over(Window.orderBy("locus", "state")) - 1).withColumn("nth", F.dense_rank().over(Window.orderBy("locus")) - 1)
    where = places.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("ind").agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"))
    own = scores.join(coded, ["locus", "state"]).groupBy("pop", "ind").agg(F.collect_list(F.struct("code", "nth", F.col("x").cast("double").alias("x"))).alias("own"))
    mapped = own.where("pop IS NOT NULL").join(where, "ind")
    enough = mapped.groupBy("pop").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).select("pop")
    return kept(mapped.join(enough, "pop").select("pop", "ind", "lat", "lon", "own"))


def genotype_scores(geno: DataFrame) -> DataFrame:
    """Allele shares: half for each copy."""
    return geno.where("a1 IS NOT NULL AND a2 IS NOT NULL").select("pop", "ind", "locus", F.explode(F.array("a1", "a2")).alias("state"), F.lit(0.5).alias("x"))


def band_scores(bands: DataFrame) -> DataFrame:
    return bands.where("x IS NOT NULL").select("pop", "ind", F.col("band").alias("locus"), F.lit(1).alias("state"), "x")


def _limits(people: DataFrame, parts: int) -> tuple[np.ndarray, int]:
    """The first metre of each class but the first, and the number of pairs."""

    def counted(values: str, bins: int, pick) -> np.ndarray:
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("ind")
            out = np.zeros(bins, np.int64)
            for k, (i, j) in enumerate(tiles(rows.num_rows)):
                if k % parts == key[1].as_py():
                    km = _distances(rows, i, j)
                    out += np.bincount(pick(km[km > 0]), minlength=bins)
            at = np.flatnonzero(out)
            return pa.table({"at": at, "n": out[at]})

        made = people.drop("own").select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(GROUPS, "pop", "part").groupBy("pop", "part").applyInArrow(run, "at long, n long")
        total = np.zeros(bins, np.int64)
        for r in made.groupBy("at").agg(F.sum("n").alias("n")).collect():
            total[r["at"]] = r["n"]
        return total

    by_km = counted("km", FARTHEST, lambda km: np.floor(km).astype(np.int64))
    n = int(by_km.sum())
    if n < PAIRS:
        return np.empty(0, np.int64), n
    classes = max(2, min(CLASSES, n // PAIRS))
    ranks = [c * -(-n // classes) for c in range(1, classes) if c * -(-n // classes) < n]
    upto = np.cumsum(by_km)
    home = np.searchsorted(upto, ranks, "right")
    order = np.unique(home)

    def fine(km: np.ndarray) -> np.ndarray:
        metre = np.floor(km * 1000).astype(np.int64)
        slot = np.searchsorted(order, metre // 1000)
        inside = (slot < len(order)) & (order[np.minimum(slot, len(order) - 1)] == metre // 1000)
        return slot[inside] * 1000 + metre[inside] % 1000

    by_metre = counted("m", len(order) * 1000, fine).reshape(-1, 1000)
    out = []
    for rank, km in zip(ranks, home, strict=True):
        slot = int(np.searchsorted(order, km))
        out.append(int(km) * 1000 + int(np.searchsorted(np.cumsum(by_metre[slot]), rank - (upto[km] - by_km[km]), "right")))
    return np.unique(np.array(out)), n


def _sums(people: DataFrame, limits: np.ndarray, parts: int, replicates: int, kinship: bool) -> DataFrame:
    """b, k, v: sums over pairs, added over populations and parts; k runs over values, weights, kilometres, pairs by class, then the sums of a regression on ln km."""
    classes = len(limits) + 1

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ind")
        pop, part, n = str(key[0].as_py()), key[1].as_py(), rows.num_rows
        x = Rows(rows, kinship)
        mine = list(range(part, replicates + 1, parts))
        orders = [np.arange(n) if b == 0 else rng("places", pop, b).permutation(n) for b in mine]
        out = np.zeros((len(mine), 4 * classes + 5))
        for i, j in tiles(n):
            km = _distances(rows, i, j)
            told = km > 0
            # Pairs that don't count go to a class of their own.
            own = np.where(told, np.searchsorted(limits, np.floor(km * 1000), "right"), classes).ravel()
            log = np.log(np.where(told, km, 1))
            there = np.bincount(own, minlength=classes + 1)[:classes]
            plain = [log.sum(), (log * log).sum(), float(there.sum())]
            for row, (b, order) in enumerate(zip(mine, orders, strict=True)):
                value, weight = x.pairs(order[i], order[j])
                sums = np.bincount(own, value.ravel(), classes + 1)[:classes]
                weights = there if weight is None else np.bincount(own, weight.ravel(), classes + 1)[:classes]
                out[row, :classes] += sums
                out[row, classes : 2 * classes] += weights
                if b == 0:
                    out[row, 2 * classes : 3 * classes] += np.bincount(own, km.ravel(), classes + 1)[:classes]
                    out[row, 3 * classes : 4 * classes] += there
                if kinship:
                    x1, x2, m = plain if weight is None else (np.vdot(weight, log), np.vdot(weight, log * log), weights.sum())
                    out[row, 4 * classes :] += [sums.sum(), np.vdot(value, log), x1, x2, m]
        return pa.table({"b": pa.array(mine, pa.int32()), "v": pa.array(out.tolist(), pa.list_(pa.float64()))})

    units = people.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    made = units.repartition(GROUPS, "pop", "part").groupBy("pop", "part").applyInArrow(run, "b int, v array<double>")
    return kept(made.select("b", F.posexplode("v").alias("k", "v")).groupBy("b", "k").agg(F.sum("v").alias("v")))


def correlogram(scores: DataFrame, places: DataFrame, replicates: int = 999, kinship: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two tables. By class: class, n, low_km (its limit, by metres), km (mean), value, low95, high95, p (one-sided, positive), p_two.
    And slope, p_slope, sp, nb, n of kinship on ln km. Places are shuffled within populations. Under ``PAIRS`` pairs both are empty.
    """
    spark = scores.sparkSession
    people = _packed(scores, places)
    pops = people.select("pop").distinct().count()
    parts = max(1, min(replicates + 1, GROUPS // max(1, pops)))
    limits, n = _limits(people, parts)
    by_class = "class int, n long, low_km double, km double, value double, low95 double, high95 double, p double, p_two double"
    if n < PAIRS:
        return spark.createDataFrame([], by_class), spark.createDataFrame([], "slope double, p_slope double, sp double, nb double, n long")
    classes = len(limits) + 1
    sums = _sums(people, limits, parts, replicates, kinship)
    part = (F.col("k") / classes).cast("int")
    of = lambda p: F.max(F.when(part == p, F.col("v")))
    wide = sums.where(F.col("k") < 4 * classes).groupBy("b", (F.col("k") % classes).alias("class")).agg((of(0) / F.nullif(of(1), F.lit(0.0))).alias("value"), of(2).alias("km"), of(3).alias("pairs"))
    wide = wide.withColumn("seen", F.max(F.when(F.col("b") == 0, F.col("value"))).over(Window.partitionBy("class")))
    drawn = F.when(F.col("b") > 0, F.col("value"))
    up = (F.count_if((F.col("b") > 0) & (F.col("value") >= F.col("seen") - NEAR)) + 1) / (replicates + 1)
    down = (F.count_if((F.col("b") > 0) & (F.col("value") <= F.col("seen") + NEAR)) + 1) / (replicates + 1)
    pairs, km = (F.max(F.when(F.col("b") == 0, F.col(c))) for c in ("pairs", "km"))
    starts = spark.createDataFrame([(c, float(m) / 1000) for c, m in enumerate([0, *limits.tolist()])], "class int, low_km double")
    table = wide.groupBy("class").agg(pairs.cast("long").alias("n"), (km / pairs).alias("km"), F.max("seen").alias("value"), F.percentile(drawn, 0.025).alias("low95"), F.percentile(drawn, 0.975).alias("high95"), up.alias("p"), F.least(F.lit(1.0), 2 * F.least(up, down)).alias("p_two"))
    table = table.join(starts, "class").select("class", "n", "low_km", "km", "value", "low95", "high95", "p", "p_two")
    at = lambda k: F.max(F.when(F.col("k") == 4 * classes + k, F.col("v")))
    first = F.max(F.when(F.col("k") == 0, F.col("v"))) / F.max(F.when(F.col("k") == classes, F.col("v")))
    y, xy, x, xx, m = (at(k) for k in range(5))
    slopes = sums.groupBy("b").agg(((m * xy - x * y) / F.nullif(m * xx - x * x, F.lit(0.0))).alias("slope"), first.alias("f1"), m.alias("m"))
    slopes = slopes.withColumn("seen", F.max(F.when(F.col("b") == 0, F.col("slope"))).over(Window.partitionBy()))
    less = (F.count_if((F.col("b") > 0) & (F.col("slope") <= F.col("seen"))) + 1) / (replicates + 1)
    slope, f1 = F.max("seen"), F.max(F.when(F.col("b") == 0, F.col("f1")))
    line = slopes.agg(slope.alias("slope"), less.alias("p_slope"), (-slope / (1 - f1)).alias("sp"), F.when(slope < 0, (1 - f1) / -slope).alias("nb"), F.max(F.when(F.col("b") == 0, F.col("m"))).cast("long").alias("n"))
    return table, line if kinship else spark.createDataFrame([], line.schema)

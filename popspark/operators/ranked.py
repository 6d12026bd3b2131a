"""Correlogram and slope of Loiselle's kinship on distance, from pairs by blocks (``pairs``), without a row per pair.

Classes hold equal numbers of pairs in the order of (distance, i, j), so their limits are ranks. Distances are whole
millimetres; two passes over the pairs count them by ranges of ``WIDTH`` and then by millimetre in the few ranges where a
limit lies. A third pass adds up sums by class; only pairs of exactly a limit's distance leave their task, to be told
apart by their ids. The driver gets counts of ranges and of those millimetres, whatever the number of pairs.

Individuals of a population that share place and genotypes are alike in all of this but their ids, so they are one row with
a weight (``alike``), and pairs count as often as the weights' product; ids come back for the pairs at limits only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popspark.operators.pairs import kinship, meetings, tiles
from popspark.operators.spatial import RADIUS
from popspark.plans.working import kept

#: Millimetres of a range; pairs that make classes at least, classes at most; logarithms of kilometres are taken from here.
WIDTH, LEAST, CLASSES, MIDDLE = 1 << 21, 30, 10, 8.0
#: Rows and columns of a tile, which stays in a core's cache; tiles and pairs gathered before they are counted.
TALL, WIDE, BATCH, PAIRS = 256, 256, 64, 1 << 18
SUMS = ("km", "k", "x", "xx", "xk", "kk")


def alike(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of individuals (g, ind, own, lat, lon, w), ``ind`` the first of the w that share all else; and g, ind, member."""
    low, high = F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2")
    own = F.array_sort(F.collect_list(F.struct("locus", low, high, "s", "n", "p2"))).alias("own")
    people = kept(mapped.groupBy(F.col("pop").alias("g"), "ind").agg(own, F.first("lat").alias("lat"), F.first("lon").alias("lon")))
    said = ["g", "lat", "lon", "own"]
    rows = kept(people.groupBy(*said).agg(F.min("ind").alias("ind"), F.count("*").alias("w")).select("g", "ind", "own", "lat", "lon", "w"))
    return rows, people.withColumnRenamed("ind", "member").join(rows, said).select("g", "ind", "member")


def _over(people: DataFrame, run: Callable[[pa.Table, Iterator], Iterator[pa.RecordBatch]], fields: str, valued: bool = False) -> DataFrame:
    """What ``run`` makes of a meeting's rows and its tiles: row numbers of two sides, the pairs that have a kinship and a distance, their millimetres, weights and (``valued``) kinship."""

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("ind")
        of, half = kinship(rows), [np.radians(rows[c].to_numpy()) / 2 for c in ("lat", "lon")]
        (sin_lat, cos_lat), (sin_lon, cos_lon) = ((np.sin(v), np.cos(v)) for v in half)
        shrink, w = np.cos(2 * half[0]), rows["w"].to_numpy().astype(float)

        def told() -> Iterator[tuple[np.ndarray, ...]]:
            for x, y, counts in tiles(rows, key[1].as_py() == key[2].as_py(), TALL, WIDE):
                # Sines of half differences; equal places give exactly 0.
                u = np.outer(cos_lat[x], sin_lat[y]) - np.outer(sin_lat[x], cos_lat[y])
                v = np.outer(cos_lon[x], sin_lon[y]) - np.outer(sin_lon[x], cos_lon[y])
                far = 2 * RADIUS * np.arcsin(np.minimum(1, np.sqrt(u * u + np.outer(shrink[x], shrink[y]) * (v * v))))
                mm = np.floor(far * 1e6 + 0.5)
                value, known, _ = of(x, y, valued)
                ok = known & (mm > 0) if counts is None else known & counts & (mm > 0)
                at = np.flatnonzero(ok)
                if len(at):
                    yield x, y, at, mm.ravel()[at].astype(np.int64), np.outer(w[x], w[y]).ravel()[at], value.ravel()[at] if valued else None

        yield from run(rows, told())

    return people.groupBy("g", "p", "q").applyInArrow(meet, fields)


def _counted(people: DataFrame, bins: int, pick: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bins that pairs fall in, ascending, and their numbers of pairs."""

    def run(rows: pa.Table, told: Iterator) -> Iterator[pa.RecordBatch]:
        n = np.zeros(bins)
        for *_, mm, w, _ in told:
            n += np.bincount(pick(mm), w, bins)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at].astype(np.int64))], names=["at", "n"])

    found = _over(people, run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow().sort_by("at")
    return found["at"].to_numpy(), found["n"].to_numpy()


def by_class(mapped: DataFrame) -> DataFrame:
    """class, n, low, high, and sums over its pairs of km, kinship (k), x = ln km - ``MIDDLE``, x^2, x k, k^2.

    ``mapped``: pop, ind, locus, a1, a2, s, n, p2 (``kinship_steps``), lat, lon. Without ``LEAST`` pairs there is no class.
    """
    spark, kind = mapped.sparkSession, mapped.schema["ind"].dataType.simpleString()
    rows, members = alike(mapped)
    people = meetings(rows)
    ranges, count = _counted(people, int(np.pi * 6.3711e9) // WIDTH + 1, lambda mm: mm // WIDTH)
    n = int(count.sum())
    if n < LEAST:
        return spark.createDataFrame([], f"class bigint, n bigint, low double, high double, {', '.join(f'{c} double' for c in SUMS)}")
    per = -(-n // max(2, min(CLASSES, n // LEAST)))
    first = np.arange(per, n, per)
    wanted = np.unique(np.concatenate([[0, n - 1], first, first - 1]))
    upto = np.cumsum(count)
    home = ranges[np.unique(np.searchsorted(upto, wanted, "right"))]

    def counts_of(found: np.ndarray) -> pa.RecordBatch:
        at, which = np.unique(found[0].astype(np.int64), return_inverse=True)
        return pa.record_batch([pa.array(at), pa.array(np.bincount(which, found[1], len(at)).astype(np.int64))], names=["at", "n"])

    slots = np.full(int(ranges[-1]) + 1, -1)
    slots[home] = np.arange(len(home))

    def inside(mm: np.ndarray, w: np.ndarray) -> np.ndarray:
        slot = slots[mm // WIDTH]
        ok = np.flatnonzero(slot >= 0)
        return np.stack([slot[ok] * WIDTH + mm[ok] % WIDTH, w[ok]])

    def fine(rows: pa.Table, told: Iterator) -> Iterator[pa.RecordBatch]:
        found = [np.zeros((2, 0))]
        for *_, mm, w, _ in told:
            found.append(inside(mm, w))
            if len(found) == BATCH:
                found = [np.concatenate(found, axis=1)]
                if found[0].shape[1] > PAIRS:
                    yield counts_of(found.pop())
        yield counts_of(np.concatenate([np.zeros((2, 0)), *found], axis=1))

    # Pairs before a range, and within it before a millimetre, where a wanted rank lies.
    lines = _over(people, fine, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    before = spark.createDataFrame([(k, int(upto[i] - count[i])) for k, i in enumerate(np.searchsorted(ranges, home))], "slot bigint, start bigint")
    lines = lines.withColumn("slot", F.floor(F.col("at") / WIDTH)).join(F.broadcast(before), "slot")
    lines = lines.withColumn("start", F.col("start") + F.sum("n").over(Window.partitionBy("slot").orderBy("at")) - F.col("n"))
    holds = F.exists(F.array(*[F.lit(int(w)) for w in wanted]), lambda w: (w >= F.col("start")) & (w < F.col("start") + F.col("n")))
    ends = sorted((int(home[r["slot"]]) * WIDTH + r["at"] % WIDTH, r["start"], r["n"]) for r in lines.where(holds).collect())
    ties, starts = np.array([e[0] for e in ends]), np.array([e[1] for e in ends])
    limits = ties[np.searchsorted(starts, first, "right") - 1]

    # The class of a whole range, -1 where a limit or a tied distance lies in it.
    of_range = np.searchsorted(limits, np.arange(int(ranges[-1]) + 1) * WIDTH, "right")
    of_range[ties // WIDTH] = -1

    def sums(rows: pa.Table, told: Iterator) -> Iterator[pa.RecordBatch]:
        ids, g, classes = rows["ind"].combine_chunks(), rows["g"].combine_chunks(), len(limits) + 1
        total = np.zeros((1 + len(SUMS), classes))
        for x, y, at, mm, w, k in told:
            c, km = of_range[mm // WIDTH], mm / 1e6
            ln = np.log(km) - MIDDLE
            near = np.flatnonzero(c < 0)
            own = mm[near]
            tied = ties[np.minimum(np.searchsorted(ties, own), len(ties) - 1)] == own
            c[near] = np.where(tied, classes, np.searchsorted(limits, own, "right"))
            tie = near[tied]
            wk, wln = w * k, w * ln
            for row, v in zip(total, (w, w * km, wk, wln, wln * ln, wk * ln, wk * k), strict=True):
                row += np.bincount(c, v, classes + 1)[:classes]
            if len(tie):
                a, b = x[at[tie] // len(y)], y[at[tie] % len(y)]
                i, j = (ids.take(pa.array(v)) for v in (a, b))
                m, km, k, ln = len(a), km[tie], k[tie], ln[tie]
                yield pa.record_batch([pa.nulls(m, pa.int64()), pa.array(np.ones(m, np.int64)), pa.array(mm[tie]), g.take(pa.array(a)), i, j, *(pa.array(v) for v in (km, k, ln, ln * ln, ln * k, k * k))], names=names)
        some = np.flatnonzero(total[0])
        m = len(some)
        yield pa.record_batch([pa.array(some), pa.array(total[0, some].astype(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, g.type), pa.nulls(m, ids.type), pa.nulls(m, ids.type), *(pa.array(v[some]) for v in total[1:])], names=names)

    names, pop = ["class", "n", "mm", "g", "i", "j", *SUMS], rows.schema["g"].dataType.simpleString()
    made = kept(_over(people, sums, f"class bigint, n bigint, mm bigint, g {pop}, i {kind}, j {kind}, {', '.join(f'{c} double' for c in SUMS)}", True))
    begun = spark.createDataFrame([(e[0], e[1]) for e in ends], "mm bigint, start bigint")
    place = F.row_number().over(Window.partitionBy("mm").orderBy("i", "j")) - 1
    each = made.where("mm IS NOT NULL").join(members.toDF("g", "i", "m"), ["g", "i"]).join(members.toDF("g", "j", "o"), ["g", "j"])
    each = each.withColumns({"i": F.least("m", "o"), "j": F.greatest("m", "o")}).select(*made.columns)
    tied = each.drop("class").join(F.broadcast(begun), "mm").withColumn("class", F.floor((F.col("start") + place) / per))
    both = made.where("mm IS NULL").unionByName(tied.select(*made.columns))
    # The first and the last pair of each class are among the tied ones.
    return both.groupBy("class").agg(F.sum("n").alias("n"), F.min(F.when(F.col("mm").isNotNull(), F.col("km"))).alias("low"), F.max(F.when(F.col("mm").isNotNull(), F.col("km"))).alias("high"), *[F.sum(c).alias(c) for c in SUMS])


def _six(c):
    return F.round(c, 6) + 0.0


def correlogram(mapped: DataFrame) -> DataFrame:
    """class, n, low_km, high_km, km, kinship (means)."""
    return by_class(mapped).select("class", "n", _six("low").alias("low_km"), _six("high").alias("high_km"), _six(F.col("km") / F.col("n")).alias("km"), _six(F.col("k") / F.col("n")).alias("kinship"))


def kinship_slope(mapped: DataFrame) -> DataFrame:
    """slope, r2, n, sp, nb of kinship on ln km: a row, whose n is 0 without classes."""
    first = F.max(F.when(F.col("class") == 0, F.col("k") / F.col("n")))
    total = by_class(mapped).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), first.alias("f1"), *[F.sum(c).alias(c) for c in SUMS[1:]])
    n = F.col("n").cast("double")
    # As regr_r2 has it: no value without a spread of x, 1 without one of y.
    parts = total.select("n", "f1", (F.col("xx") - F.col("x") * F.col("x") / n).alias("sx"), (F.col("kk") - F.col("k") * F.col("k") / n).alias("sk"), (F.col("xk") - F.col("x") * F.col("k") / n).alias("sxk"))
    fit = parts.select("n", "f1", F.when(F.col("sx") > 0, F.col("sxk") / F.col("sx")).alias("b"), F.when(F.col("sx") > 0, F.when(F.col("sk") > 0, F.col("sxk") * F.col("sxk") / F.col("sx") / F.col("sk")).otherwise(1.0)).alias("r2"))
    b, f1 = F.col("b"), F.col("f1")
    return fit.select(_six("b").alias("slope"), _six("r2").alias("r2"), "n", _six(-b / (1 - f1)).alias("sp"), _six(F.when(b < 0, (1 - f1) / -b)).alias("nb"))

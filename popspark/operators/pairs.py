"""Pairs of individuals, block by block: a row per individual is dealt, never a row per pair and locus.

Individuals (of a population, or all) are dealt to blocks by a hash of their id, and each pair of blocks
meets in one group. There pairs are compared tile by tile and leave as they are made, so a task holds two
blocks and one tile, and the shuffle carries each individual once for every block of its group, at most ``MANY`` times
(``MANY`` over the square root of the number of groups) until blocks reach their largest size. Work and result grow with the square of the individuals, as all pairs do.

The SQL of the same queries (``QUERIES``) is what their results are held against: rows that repeat count
as its joins count them, and nulls as its expressions take them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.plans.working import kept

#: Individuals of a block at least (about), blocks until they grow, individuals and values of a block at most (about).
SMALL, MANY, LARGE, CELLS = 1024, 40, 1 << 15, 1 << 22
#: Rows and columns of a tile; tasks at most.
TALL, WIDE, TASKS = 128, 2048, 1024

#: From a group's rows (sorted by ind), what compares rows with rows: columns (values, known), and the pairs that count.
Tile = Callable[[np.ndarray, np.ndarray], tuple[list, np.ndarray | None]]


def half_up(x: np.ndarray) -> np.ndarray:
    """Six decimals, and no minus zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


def meetings(rows: DataFrame) -> DataFrame:
    """g, p, q, first, ind and the rest of ``rows`` (g, ind, own, ...): blocks p and q of group g in one partition; ``first``: of block p."""
    rows = kept(rows.where("g IS NOT NULL AND ind IS NOT NULL"))
    counts = kept(rows.groupBy("g").agg(F.count("*").alias("n"), F.max(F.size("own")).alias("most")))
    # Meetings of all groups keep the tasks busy, so many groups need fewer blocks each, and fewer copies of each row.
    many, n = -(-MANY // max(1, math.isqrt(counts.count()))), F.col("n")
    blocks = F.greatest(F.least(F.ceil(n / SMALL), F.lit(many)), F.ceil(n / LARGE), F.ceil(n * F.col("most") / CELLS), F.lit(1)).cast("int")
    sizes = counts.select("g", blocks.alias("blocks"))
    many = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    dealt = rows.join(sizes, "g").withColumn("home", F.pmod(F.xxhash64("ind"), "blocks").cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    p, q = F.least("home", "other"), F.greatest("home", "other")
    rest = [c for c in rows.columns if c != "g"]
    return met.select("g", p.alias("p"), q.alias("q"), (F.col("home") <= F.col("other")).alias("first"), *rest).repartition(int(min(TASKS, 4 * many)), "g", "p", "q")


def tiles(rows: pa.Table, same: bool, tall: int = 0, wide: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Row numbers of two sides, and (for one block with itself) which of their pairs count."""
    first, tall, wide = rows["first"].to_numpy(), tall or TALL, wide or WIDE
    a = np.arange(rows.num_rows) if same else np.flatnonzero(first)
    b = a if same else np.flatnonzero(~first)
    for s in range(0, len(a), tall):
        x = a[s : s + tall]
        for t in range(s if same else 0, len(b), wide):
            y = b[t : t + wide]
            yield x, y, x[:, None] < y[None] if same else None


def compared(rows: DataFrame, kernel: Callable[[pa.Table], Tile], fields: str, grouped: bool = False) -> DataFrame:
    """i, j and the kernel's columns of all pairs of a group, i < j; ``fields``: their names and types; ``grouped``: g comes first."""
    kind, g = rows.schema["ind"].dataType.simpleString(), rows.schema["g"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        people = pa.Table.from_batches(list(batches)).sort_by("ind")
        ids, tile = people["ind"].combine_chunks(), kernel(people)
        for x, y, told in tiles(people, key[1].as_py() == key[2].as_py()):
            columns, wanted = tile(x, y)
            pick = told if wanted is None else wanted if told is None else told & wanted
            if pick is None:
                r, c = np.repeat(x, len(y)), np.tile(y, len(x))
                take = np.ravel
            else:
                at = np.flatnonzero(pick)
                if not len(at):
                    continue
                r, c = x[at // len(y)], y[at % len(y)]
                take = lambda v, at=at: v.ravel()[at]
            made = [pa.array(take(v), mask=None if known is None else ~take(known)) for v, known in columns]
            own = [pa.repeat(key[0], len(r))] if grouped else []
            yield pa.RecordBatch.from_arrays([*own, ids.take(pa.array(np.minimum(r, c))), ids.take(pa.array(np.maximum(r, c))), *made], names)

    names = [*["g"][: int(grouped)], "i", "j", *(f.split()[0] for f in fields.split(", "))]
    return meetings(rows).groupBy("g", "p", "q").applyInArrow(run, f"g {g}, i {kind}, j {kind}, {fields}" if grouped else f"i {kind}, j {kind}, {fields}")


def items(people: pa.Table, *fields: str) -> tuple[np.ndarray, list[pa.Array]]:
    """The row of each item of ``own``, and its fields."""
    own = people["own"].combine_chunks()
    flat = own.flatten()
    return pc.list_parent_indices(own).to_numpy(), [flat.field(f) for f in fields]


def codes(values: pa.Array) -> tuple[np.ndarray, int]:
    """Numbers of equal values, -1 for null."""
    told = values.dictionary_encode()
    return told.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32), len(told.dictionary)


def slots(n: int, parent: np.ndarray, locus: np.ndarray, loci: int, *values: np.ndarray) -> list[list[tuple]]:
    """Per locus, per time that a row has it: who has it, and its values (one array over all rows each)."""
    order = np.lexsort((locus, parent))
    key = parent[order].astype(np.int64) * loci + locus[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    nth = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
    out: list[list[tuple]] = [[] for _ in range(loci)]
    for l in range(loci):
        mine = locus[order] == l
        for k in range(int(nth[mine].max(initial=-1)) + 1):
            at = order[mine & (nth == k)]
            has = np.zeros(n, bool)
            has[parent[at]] = True
            held = []
            for v in values:
                full = np.full(n, -1, v.dtype)
                full[parent[at]] = v[at]
                held.append(full)
            out[l].append((has, *held))
    return out


def counted(n: int, parent: np.ndarray, code: np.ndarray, width: int, weight: np.ndarray | None = None) -> np.ndarray:
    """rows x width: sums of weights by code."""
    return np.bincount(parent.astype(np.int64) * width + code, weight, n * width).reshape(n, width).astype(float)


def genotypes(people: pa.Table) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]:
    """Comparable loci of pairs, sums of squared distance, of shared alleles (0, 1, 2), and loci of one genotype."""
    parent, (locus, a, b) = items(people, "locus", "a1", "a2")
    m = len(a)
    allele, _ = codes(pa.concat_arrays([a, b]))
    a, b = allele[:m], allele[m:]
    locus, loci = codes(locus)
    # As least and greatest have it, one allele that is known stands for both; two unknown ones equal nothing.
    one, two = np.where(a < 0, b, a), np.where(b < 0, a, b)
    low, high = np.minimum(one, two), np.maximum(one, two)
    state = np.where((a < 0) | (b < 0), 0, np.where(a == b, 1, 2)).astype(np.int8)
    by_locus = slots(people.num_rows, parent, locus, loci, low, high, state)

    def tile(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        used, far, shared, alike = (np.zeros((len(x), len(y)), np.int32) for _ in range(4))
        for own in by_locus:
            for hx, lx, gx, sx in own:
                if not hx[x].any():
                    continue
                for hy, ly, gy, sy in own:
                    l1, g1, s1 = (v[x][:, None] for v in (lx, gx, sx))
                    l2, g2, s2 = (v[y][None] for v in (ly, gy, sy))
                    both = hx[x][:, None] & hy[y][None]
                    same_low = l1 == l2
                    same = (same_low & (g1 == g2) & (l1 >= 0) & both).view(np.int8)
                    common = ((same_low | (l1 == g2) | (g1 == l2) | (g1 == g2)) & (l1 >= 0) & (l2 >= 0) & both).view(np.int8)
                    d = np.where((s1 == 1) & (s2 == 1), np.int8(4), np.where((s1 == 2) & (s2 == 2), 2 - common, 3 - 2 * common))
                    used += both
                    far += d * (both.view(np.int8) & ~same & 1)
                    shared += common + same
                    alike += same
        return used, far, shared, alike

    return tile


def _own(rows: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """A row per individual: g (its population, or 0), ind, own."""
    g = F.col("pop") if "pop" in keys else F.lit(0)
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("own")).select(g.alias("g"), "ind", "own")


def _genotyped(geno: DataFrame) -> DataFrame:
    return _own(geno.where("locus IS NOT NULL"), ["pop", "ind"], "locus", "a1", "a2")


def individual_distances(geno: DataFrame) -> DataFrame:
    """i, j, used, smouse_peakall, dps of all pairs of a population."""
    loci = geno.select("locus").distinct().count()

    def kernel(people: pa.Table) -> Tile:
        of = genotypes(people)

        def tile(x: np.ndarray, y: np.ndarray) -> tuple[list, np.ndarray]:
            used, far, shared, _ = of(x, y)
            n = np.maximum(used, 1)
            return [(used.astype(np.int64), None), (half_up(far * loci / n), None), (half_up(1 - shared / 2 / n), None)], used > 0

        return tile

    return compared(_genotyped(geno), kernel, "used bigint, smouse_peakall double, dps double")


def alike(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """g, ind, own of the first individual of each set of rows in a population, own sorted; and g, ind, member: who has this set."""
    people = kept(people.where("g IS NOT NULL AND ind IS NOT NULL").withColumn("own", F.array_sort("own")))
    kinds = kept(people.groupBy("g", "own").agg(F.min("ind").alias("ind")).select("g", "ind", "own"))
    return kinds, people.withColumnRenamed("ind", "member").join(kinds, ["g", "own"]).select("g", "ind", "member")


def near_clones(geno: DataFrame) -> DataFrame:
    """i, j, comparable, identity of pairs of a population with four comparable loci, 95 % of them of one genotype.

    Individuals with the same genotypes are compared with others once, and stand for each other in the result.
    """
    # As least and greatest have it, one allele that is known stands for both.
    geno = geno.withColumns({"a1": F.least("a1", "a2"), "a2": F.greatest("a1", "a2")})
    # Without this many rows nobody reaches four comparisons, even with those who have a locus most often.
    often = geno.groupBy("pop", "ind", "locus").count().agg(F.max("count")).first()[0] or 1
    people, members = alike(_genotyped(geno).where(F.size("own") * often >= 4))
    members = kept(members)

    def kernel(rows: pa.Table) -> Tile:
        parent, (locus, a, b) = items(rows, "locus", "a1", "a2")
        m = len(a)
        allele, width = codes(pa.concat_arrays([a, b]))
        a, b = allele[:m].astype(np.int64), allele[m:].astype(np.int64)
        locus, loci = codes(locus)
        one, two = np.where(a < 0, b, a), np.where(b < 0, a, b)
        kinds, kind = np.unique(np.minimum(one, two) * width + np.maximum(one, two), return_inverse=True)
        kind = np.where(one < 0, -1, kind).astype(np.int16 if len(kinds) < 1 << 15 else np.int32)
        by_locus = slots(rows.num_rows, parent, locus, loci, kind)
        own = counted(rows.num_rows, parent, locus, loci).astype(np.float32)
        small = np.int16 if loci * max((len(x) for x in by_locus), default=0) ** 2 < 1 << 15 else np.int32

        def tile(x: np.ndarray, y: np.ndarray) -> tuple[list, np.ndarray]:
            used, alike = own[x] @ own[y].T, np.zeros((len(x), len(y)), small)
            for held in by_locus:
                for _, kx in held:
                    # What a row lacks equals nothing: -1 on one side, -2 on the other.
                    left = kx[x][:, None]
                    for _, ky in held:
                        right = ky[y]
                        alike += left == np.where(right < 0, -2, right).astype(right.dtype)[None]
            near = (used >= 4) & (20 * alike.astype(np.int32) >= 19 * used)
            at, share = np.flatnonzero(near), np.zeros(used.shape)
            share.ravel()[at] = half_up(alike.ravel()[at] / used.ravel()[at].astype(float))
            return [(used.astype(np.int64), None), (share, None)], near

        return tile

    between = compared(people, kernel, "comparable bigint, identity double", True)
    # What one set of rows gives with itself.
    rows = people.join(members.groupBy("g", "ind").count().where("count > 1"), ["g", "ind"], "left_semi").select("g", "ind", F.explode("own").alias("o"))
    cells = rows.groupBy("g", "ind", "o.locus", "o.a1", "o.a2").agg(F.count("*").alias("n")).groupBy("g", "ind", "locus").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a1").isNotNull(), F.col("n") * F.col("n")).otherwise(0)).alias("same"))
    used, same = F.sum(F.col("n") * F.col("n")), F.sum("same")
    within = cells.groupBy("g", "ind").agg(used.alias("comparable"), same.alias("same")).where("comparable >= 4 AND 20 * same >= 19 * comparable")
    within = within.select("g", F.col("ind").alias("i"), F.col("ind").alias("j"), "comparable", (F.round(F.col("same") / F.col("comparable"), 6) + 0.0).alias("identity"))
    met = between.unionByName(within).join(members.toDF("g", "i", "m"), ["g", "i"]).join(members.toDF("g", "j", "o"), ["g", "j"])
    return met.where("i <> j OR m < o").select(F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"), "comparable", "identity")


def loiselle_kinship(own: DataFrame) -> DataFrame:
    """i, j, kinship of all pairs of a population, from pop, ind, locus, a1, a2, s, n, p2 (``kinship_steps``)."""

    def kernel(people: pa.Table) -> Tile:
        of = kinship(people)

        def tile(x: np.ndarray, y: np.ndarray) -> tuple[list, np.ndarray]:
            value, known, met = of(x, y)
            return [(half_up(value), known)], met

        return tile

    return compared(_own(own, ["pop", "ind"], "locus", "a1", "a2", "s", "n", "p2"), kernel, "kinship double")


def kinship(people: pa.Table) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Loiselle's kinship of pairs, which of them have it, and which share a locus."""
    rows = people.num_rows
    parent, (locus, a, b, s, n, p2) = items(people, "locus", "a1", "a2", "s", "n", "p2")
    m = len(a)
    allele, _ = codes(pa.concat_arrays([a, b]))
    locus, loci = codes(locus)
    s, n, p2 = (v.to_numpy(zero_copy_only=False) for v in (s, n, p2))
    own, mean = counted(rows, parent, locus, loci), counted(rows, parent, locus, loci, s)
    q, size = np.zeros(loci), np.full(loci, 2.0)
    q[locus], size[locus] = p2, n
    more = q + (1 - q) / (size - 1)
    kinds, kind = np.unique(np.concatenate([locus, locus]).astype(np.int64) * (int(allele.max(initial=0)) + 1) + allele, return_inverse=True)
    copies = counted(rows, np.concatenate([parent, parent]), kind, len(kinds))
    # One product: equal alleles of a locus, less both means, and what doesn't depend on the genotypes.
    left, right = np.hstack([0.25 * copies, mean, own, own * more]), np.hstack([copies, -own, -mean, own])
    apart = own * (1 - q)

    def tile(x: np.ndarray, y: np.ndarray, valued: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray | None]:
        den = apart[x] @ own[y].T
        known = den != 0
        if not valued:
            return None, known, None
        num = left[x] @ right[y].T
        return np.divide(num, den, out=np.zeros_like(num), where=known), known, own[x] @ own[y].T > 0

    return tile


def band_distances(bands: DataFrame) -> DataFrame:
    """i, j, jaccard, dice, simple_matching, euclid2 of all pairs."""

    def kernel(people: pa.Table) -> Tile:
        rows = people.num_rows
        parent, (band, x) = items(people, "band", "x")
        band, width = codes(band)
        told = x.is_valid().to_numpy(zero_copy_only=False)
        held, seen = counted(rows, parent, band, width), counted(rows, parent, band, width, told)
        sums = counted(rows, parent, band, width, x.fill_null(0).to_numpy(zero_copy_only=False))

        def tile(x: np.ndarray, y: np.ndarray) -> tuple[list, np.ndarray]:
            met, n = held[x] @ held[y].T > 0, seen[x] @ seen[y].T
            a, left, right = sums[x] @ sums[y].T, sums[x] @ seen[y].T, seen[x] @ sums[y].T
            apart, any_, known = left + right - 2 * a, left + right - a, n > 0

            def share(top: np.ndarray, below: np.ndarray) -> np.ndarray:
                return half_up(1 - np.divide(top, below, out=np.ones_like(top), where=known & (below != 0)))

            matched = np.divide(apart, n, out=np.zeros_like(a), where=known)
            return [(share(a, any_), None), (share(2 * a, any_ + a), None), (half_up(matched), known), (half_up(apart), known)], met

        return tile

    return compared(_own(bands.where("band IS NOT NULL"), ["ind"], "band", "x"), kernel, "jaccard double, dice double, simple_matching double, euclid2 double")


def gower(traits: DataFrame) -> DataFrame:
    """i, j, gower of all pairs: the mean difference over traits, each divided by its range."""
    spans = traits.groupBy("trait").agg(F.when(F.max("v") > F.min("v"), F.max("v") - F.min("v")).otherwise(1.0).alias("span"))

    def kernel(people: pa.Table) -> Tile:
        parent, (trait, v, span) = items(people, "trait", "v", "span")
        trait, width = codes(trait)
        told = v.is_valid().to_numpy(zero_copy_only=False)
        by_trait = slots(people.num_rows, parent, trait, width, v.fill_null(0).to_numpy(zero_copy_only=False).astype(float), told)
        of = np.ones(width)
        of[trait] = span.to_numpy(zero_copy_only=False)

        def tile(x: np.ndarray, y: np.ndarray) -> tuple[list, np.ndarray]:
            far, n, met = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)), np.int32), np.zeros((len(x), len(y)), bool)
            for held, r in zip(by_trait, of, strict=True):
                for hx, vx, kx in held:
                    for hy, vy, ky in held:
                        met |= hx[x][:, None] & hy[y][None]
                        both = (hx & kx)[x][:, None] & (hy & ky)[y][None]
                        n += both
                        far += np.where(both, np.abs(vx[x][:, None] - vy[y][None]) / r, 0)
            return [(half_up(far / np.maximum(n, 1)), n > 0)], met

        return tile

    return compared(_own(traits.join(F.broadcast(spans), "trait"), ["ind"], "trait", "v", "span"), kernel, "gower double")


def haploid_p_distance(hap: DataFrame) -> DataFrame:
    """i, j, used, p of all pairs: the share of loci whose alleles differ."""

    def kernel(people: pa.Table) -> Tile:
        parent, (locus, allele) = items(people, "locus", "allele")
        locus, loci = codes(locus)
        allele, _ = codes(allele)
        by_locus = slots(people.num_rows, parent, locus, loci, allele)

        def tile(x: np.ndarray, y: np.ndarray) -> tuple[list, np.ndarray]:
            used, apart = (np.zeros((len(x), len(y)), np.int32) for _ in range(2))
            for held in by_locus:
                for hx, ax in held:
                    for hy, ay in held:
                        used += hx[x][:, None] & hy[y][None]
                        # Rows without the locus hold -1, as unknown alleles do.
                        apart += (ax[x][:, None] != ay[y][None]) & (ax[x] >= 0)[:, None] & (ay[y] >= 0)[None]
            return [(used.astype(np.int64), None), (half_up(apart / np.maximum(used, 1)), None)], used > 0

        return tile

    return compared(_own(hap.where("locus IS NOT NULL"), ["ind"], "locus", "allele"), kernel, "used bigint, p double")


#: Sites that are compared in one product.
SITES = 256


def sequences(people: pa.Table) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]:
    """Shared sites of pairs, sites where both have a base, of equal bases, of equal classes (purines, pyrimidines)."""
    rows = people.num_rows
    parent, (site, base) = items(people, "site", "base")
    site, width = codes(site)
    base = pc.index_in(base, pa.array(["A", "G", "C", "T"])).fill_null(4).to_numpy(zero_copy_only=False)
    at = (parent.astype(np.int64) * width + site) * 5 + base
    n = np.bincount(at, minlength=rows * width * 5).reshape(rows, width, 5)
    n = n.astype(np.min_scalar_type(n.max(initial=0)))

    def tile(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        met, both, same, like = (np.zeros((len(x), len(y)), np.float32) for _ in range(4))
        for s in range(0, width, SITES):
            a, b = (n[v, s : s + SITES].astype(np.float32) for v in (x, y))
            flat = lambda v: v.reshape(len(v), -1)
            same += flat(a[:, :, :4]) @ flat(b[:, :, :4]).T
            c, d = (np.stack([v[:, :, :2].sum(axis=2), v[:, :, 2:4].sum(axis=2)], axis=2) for v in (a, b))
            like += flat(c) @ flat(d).T
            both += c.sum(axis=2) @ d.sum(axis=2).T
            met += a.sum(axis=2) @ b.sum(axis=2).T
        return met, both, same, like

    return tile


def k2p_distance(sites: DataFrame) -> DataFrame:
    """i, j, k2p of all pairs, sites left out pair by pair."""

    def kernel(people: pa.Table) -> Tile:
        of = sequences(people)

        def tile(x: np.ndarray, y: np.ndarray) -> tuple[list, np.ndarray]:
            met, n, same, like = (v.astype(float) for v in of(x, y))
            with np.errstate(divide="ignore", invalid="ignore"):
                p, q = (like - same) / n, (n - like) / n
                u, v = 1 - 2 * p - q, 1 - 2 * q
                k2p = np.where((u > 0) & (v > 0), -0.5 * np.log(u) - 0.25 * np.log(v), 3.0)
            return [(half_up(np.where(n == 0, 0.0, k2p)), None)], met > 0

        return tile

    return compared(_own(sites.where("site IS NOT NULL"), ["ind"], "site", "base"), kernel, "k2p double")


def counts_of(rows: DataFrame, kernel: Callable[[pa.Table], Callable], fields: str) -> DataFrame:
    """What the kernel's tiles count, added up per meeting and over meetings: g, then ``fields`` (the last one is summed).

    The kernel gives (add, result) of a meeting's rows: ``add`` takes a tile and the pairs that count, ``result`` the columns.
    """
    kind = rows.schema["g"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        people = pa.Table.from_batches(list(batches)).sort_by("ind")
        add, result = kernel(people)
        for x, y, told in tiles(people, key[1].as_py() == key[2].as_py()):
            add(x, y, told)
        columns = [pa.array(v) for v in result()]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(columns[0]), key[0].type), *columns], names)

    names = ["g", *(f.split()[0] for f in fields.split(", "))]
    made = meetings(rows).groupBy("g", "p", "q").applyInArrow(run, f"g {kind}, {fields}")
    return made.groupBy(*names[:-1]).agg(F.sum(names[-1]).alias(names[-1]))


def mismatches(representatives: DataFrame) -> DataFrame:
    """pop, d, w: pairs of a population's sequences by the number of sites at which they differ, from pop, ind, site, base, n.

    ``n``: sequences that the individual stands for; pairs of one haplotype are not among these.
    """

    def kernel(people: pa.Table) -> tuple[Callable, Callable]:
        of, n = sequences(people), people["n"].to_numpy()
        found = np.zeros(0)

        def add(x: np.ndarray, y: np.ndarray, told: np.ndarray | None) -> None:
            nonlocal found
            met, _, same, _ = of(x, y)
            counts = met > 0 if told is None else told & (met > 0)
            here = np.bincount((met - same).astype(np.int64).ravel(), np.where(counts, n[x][:, None] * n[y][None], 0).ravel())
            total = np.zeros(max(len(found), len(here)))
            total[: len(found)] += found
            total[: len(here)] += here
            found = total

        def result() -> list[np.ndarray]:
            d = np.flatnonzero(found)
            return [d, found[d]]

        return add, result

    rows = representatives.where("site IS NOT NULL").groupBy("pop", "ind").agg(F.collect_list(F.struct("site", "base")).alias("own"), F.max("n").alias("n"))
    return counts_of(rows.select(F.col("pop").alias("g"), "ind", "own", "n"), kernel, "d bigint, w double").withColumnRenamed("g", "pop")


#: Queries whose Spark form is here: what they read, and how.
PAIRS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "individual_distances": ("geno", individual_distances),
    "near_clones": ("geno", near_clones),
    "loiselle_kinship": ("whole_own", loiselle_kinship),
    "band_distances": ("bands", band_distances),
    "gower": ("traits", gower),
    "haploid_p_distance": ("hap", haploid_p_distance),
    "k2p_distance": ("sites", k2p_distance),
}
#: Steps of queries that are made here: what they read, how, and the step over what is made (``made``).
STEPS: dict[str, tuple[str, Callable[[DataFrame], DataFrame], str]] = {
    "pair_diff": ("rep_sites", mismatches, "SELECT pop, d, w FROM {made} UNION ALL SELECT pop, 0, n * (n - 1) / 2 FROM hap_reps WHERE n > 1"),
}
#: The step of a query that is made here.
MADE = {"mismatch_distribution": "pair_diff", "raggedness": "pair_diff"}

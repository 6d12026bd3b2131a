"""Permutation tests by places dealt inside strata.

A replicate shuffles labels (populations, say) among the individuals of a stratum (all of them, a region,
a pair of populations). The individuals of a case lie in chunks by a hash. How many of each label a chunk
gets in a replicate is drawn from the multivariate hypergeometric distribution, halving the chunks
down to one; every chunk draws the same halves on its way, as the draws are seeded by the half, so no
task needs more than the sizes of the chunks. Inside its chunk it shuffles the labels it got. Together that is one
uniform shuffle of the stratum, and all that leaves a chunk is its sums: allele counts per label. So replicates
cost no shuffle of individuals, and a case of any size is shared among tasks.

Statistics add over loci, so alleles are counted in blocks of loci too. What depends on counts alone is
drawn from counts: whole populations among regions, gene copies among the individuals of a population.

Labels (populations) and regions are listed on the driver: a row for each, and not for each individual.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popspark.plans.working import kept

#: Individuals of a chunk (about), most chunks of a case, cells of counts in a block, groups of work that a test aims at.
#: Work is dealt to that many tasks by number, as its rows are too few bytes for Spark to split them by size.
CHUNK, CHUNKS, CELLS, GROUPS = 8192, 256, 1 << 20, 64
NEAR = 1e-12
#: Individuals of a population's chunk at most (about) in tests of pairs, individuals and replicates that are drawn at once, columns that are added up as a matrix.
LARGE, BLOCK, BATCH, WIDE = 1 << 18, 1 << 15, 256, 512
#: Places whose labels are drawn one by one, at least.
MANY = 4096


def rng(*key) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(repr(key).encode()))


def dealt(totals: np.ndarray, sizes: np.ndarray, chunk: int, replicates: int, *key) -> np.ndarray:
    """replicates x labels: how many of each label ``chunk`` gets when ``totals`` are dealt to chunks of ``sizes`` at random."""
    left = np.tile(totals.astype(np.int64), (replicates, 1))
    low, high = 0, len(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        draw, g = np.zeros_like(left), rng("half", *key, low, high)
        need, rest = np.full(replicates, int(sizes[low:mid].sum()), np.int64), left.sum(axis=1)
        for j in range(left.shape[1]):
            rest = rest - left[:, j]
            draw[:, j] = g.hypergeometric(left[:, j], rest, need)
            need = need - draw[:, j]
        if chunk < mid:
            left, high = draw, mid
        else:
            left, low = left - draw, mid
    return left


def arranged(counts: np.ndarray, g: np.random.Generator) -> np.ndarray:
    """So many places of each label, in random order.

    Of many places each draws its label by itself, with about the right chance; then random places of labels that are too many
    get those that are missing. As no step tells places apart, all orders are equally likely, as by a shuffle.
    """
    n, labels = int(counts.sum()), np.arange(len(counts), dtype=np.min_scalar_type(max(0, len(counts) - 1)))
    if n < MANY or len(counts) > 1 << 12:
        return g.permutation(np.repeat(labels, counts))
    drawn = np.repeat(labels, np.diff((np.cumsum(np.concatenate([[0], counts])) * 65536) // n))
    out, have = np.empty(n, labels.dtype), np.zeros(len(counts), np.int64)
    for s in range(0, n, BLOCK):
        raw = g.bit_generator.random_raw(BLOCK // 4).view(np.uint16)[: n - s]
        out[s : s + BLOCK] = drawn.take(raw, mode="clip")
        have += np.bincount(out[s : s + BLOCK], minlength=len(counts))
    over = np.maximum(0, have - counts)
    if not over.any():
        return out
    some = int(1.5 * n * np.max(over / np.maximum(1, have))) + 64
    while True:
        at = g.choice(n, min(n, some), replace=False)
        # In random order, the first places of a label give theirs up.
        at = at[np.argsort(out[at], kind="stable")]
        own = out[at]
        found = np.bincount(own, minlength=len(counts))
        if (found >= over).all():
            break
        some *= 2
    at = at[np.arange(len(at)) - (np.cumsum(found) - found)[own] < over[own]]
    out[at] = g.permutation(np.repeat(labels, np.maximum(0, counts - have)))
    return out


def shuffled(totals: np.ndarray, sizes: np.ndarray, chunk: int, replicates: int, *key) -> Iterator[np.ndarray]:
    """For each replicate the labels of the chunk's places, in random order."""
    counts = dealt(totals, sizes, chunk, replicates, *key)
    g = rng("places", *key, chunk)
    for own in counts:
        yield arranged(own, g)


def subsets(n: int, wanted: np.ndarray, g: np.random.Generator) -> np.ndarray:
    """For each size wanted, which of n places a uniform subset of that size holds.

    Places are taken one by one with about the right chance; then as many as are too many or missing are changed, any of them
    alike. As no step tells places apart, all subsets of the size are equally likely.
    """
    raw = g.bit_generator.random_raw(len(wanted) * n // 8 + 1).view(np.uint8)[: len(wanted) * n]
    taken = raw.reshape(len(wanted), n) < np.minimum(255, np.rint(256 * wanted / max(1, n))).astype(np.uint8)[:, None]
    for row, k, m in zip(taken, np.count_nonzero(taken, axis=1), wanted, strict=True):
        if k != m:
            row[g.choice(np.flatnonzero(row if k > m else ~row), abs(k - m), replace=False)] = k < m
    return taken


def subset_sums(n: int, sums: Callable[[int, int, np.ndarray], np.ndarray], width: int, wanted: np.ndarray, g: np.random.Generator) -> np.ndarray:
    """Sums (sizes x width) over a uniform subset of the n for each size wanted; ``sums(begin, end, taken)`` gives those of some places."""
    out = np.zeros((len(wanted), width), np.int64)
    for low in range(0, len(wanted), BATCH):
        need = wanted[low : low + BATCH].astype(np.int64)
        for s in range(0, n, BLOCK):
            e = min(n, s + BLOCK)
            here = g.hypergeometric(need, n - s - need, e - s)
            out[low : low + BATCH] += sums(s, e, subsets(e - s, here, g))
            need = need - here
    return out


class Alleles(NamedTuple):
    """Allele counts of labels: ``n`` copies and ``het`` copies in heterozygotes (labels x alleles); ``locus`` of each allele, ascending."""

    n: np.ndarray
    het: np.ndarray
    locus: np.ndarray

    def per_locus(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, np.flatnonzero(np.diff(self.locus, prepend=-1)), axis=-1)

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Values of loci, repeated for their alleles."""
        begin = np.flatnonzero(np.diff(self.locus, prepend=-1))
        return np.repeat(x, np.diff(np.append(begin, len(self.locus))), axis=-1)


def theta_parts(x: Alleles) -> np.ndarray:
    """Weir and Cockerham's a, b, c, summed over the alleles and loci, of diploid counts; populations of two individuals at least."""
    n = x.per_locus(x.n) / 2.0
    n = np.where(n >= 2, n, 0)
    r = (n > 0).sum(axis=0).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        total = n.sum(axis=0)
        nbar = total / r
        nc = (total - (n * n).sum(axis=0) / total) / (r - 1)
        wide = x.spread(n)
        p, h = np.where(wide > 0, x.n / (2 * wide), 0), np.where(wide > 0, x.het / wide, 0)
        r_, nb, nc_, t = (x.spread(v) for v in (r, nbar, nc, total))
        pbar, hbar = (wide * p).sum(axis=0) / t, (wide * h).sum(axis=0) / t
        s2 = (wide * (p - pbar) ** 2).sum(axis=0) / ((r_ - 1) * nb)
        inner = pbar * (1 - pbar) - (r_ - 1) / r_ * s2
        a = nb / nc_ * (s2 - (inner - hbar / 4) / (nb - 1))
        b = nb / (nb - 1) * (inner - (2 * nb - 1) / (4 * nb) * hbar)
    fits = r_ >= 2
    return np.array([a[fits].sum(), b[fits].sum(), hbar[fits].sum() / 2])


def _squares(x: Alleles, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Individuals and sums of squares of each row of counts and locus."""
    g = x.per_locus(counts).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return g / 2, np.where(g > 0, (g * g - x.per_locus(counts.astype(float) ** 2)) / (2 * g), 0)


def amova_parts(x: Alleles, region: np.ndarray | None = None, hets: np.ndarray | None = None) -> np.ndarray:
    """sigma of regions, populations, individuals and gene copies, summed over loci. ``hets``: heterozygotes of each locus, in place of those counted."""
    n, ss = _squares(x, x.n)
    tot_n, tot_ss = (v[0] for v in _squares(x, x.n.sum(axis=0, keepdims=True)))
    used = (n > 0).sum(axis=0).astype(float)
    within = (x.per_locus(x.het.sum(axis=0)) / 2 if hets is None else hets) * 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        sd = within / tot_n
        sc = (np.where(tot_n > used, (ss.sum(axis=0) - within) / (tot_n - used), 0) - sd) / 2
        n2 = (n * n).sum(axis=0)
        sa = np.zeros_like(sd)
        if region is None:
            n0 = (tot_n - n2 / tot_n) / (used - 1)
            sb = ((tot_ss - ss.sum(axis=0)) / (used - 1) - sd - 2 * sc) / (2 * n0)
        else:
            groups = int(region.max()) + 1
            member = (region[None, :] == np.arange(groups)[:, None]).astype(float)
            reg_n, reg_ss = _squares(x, member @ x.n)
            g = (reg_n > 0).sum(axis=0).astype(float)
            inner = np.where(reg_n > 0, (member @ (n * n)) / reg_n, 0).sum(axis=0)
            n_, n1, n3 = (tot_n - inner) / (used - g), (inner - n2 / tot_n) / (g - 1), (tot_n - (reg_n**2).sum(axis=0) / tot_n) / (g - 1)
            ss_ap = reg_ss.sum(axis=0) - ss.sum(axis=0)
            sb = (np.where(used > g, ss_ap / (used - g), 0) - sd - 2 * sc) / (2 * n_)
            sa = (np.where(g > 1, (tot_ss - reg_ss.sum(axis=0)) / (g - 1), 0) - sd - 2 * sc - 2 * n1 * sb) / (2 * n3)
    fits = (tot_n >= 2) & (used >= 2)
    return np.array([v[fits].sum() for v in (sa, sb, sc, sd)])


class Coded:
    """Genotypes with numbered alleles, in blocks of loci."""

    def __init__(self, geno: DataFrame, labels: int):
        scored = geno.where("a1 IS NOT NULL AND a2 IS NOT NULL")
        copies = scored.select("ind", "locus", (F.col("a1") != F.col("a2")).cast("int").alias("het"), F.explode(F.array("a1", "a2")).alias("allele"))
        kinds = copies.select("locus", "allele").distinct()
        self.blocks = 1 + kinds.count() * 2 * labels // CELLS
        kinds = kinds.withColumn("block", F.pmod(F.xxhash64("locus"), F.lit(self.blocks)).cast("int"))
        order = Window.partitionBy("block").orderBy("locus", "allele")
        self.alleles = kinds.withColumn("code", F.row_number().over(order) - 1).withColumn("nth", F.dense_rank().over(Window.partitionBy("block").orderBy("locus")) - 1)
        #: block, loci: the number of each allele's locus in the block.
        self.loci = self.alleles.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "nth"))), lambda s: s["nth"]).alias("loci"))
        #: ind, block, codes: 2 x allele + 1 in a heterozygote.
        self.packed = copies.join(self.alleles.select("locus", "allele", "block", "code"), ["locus", "allele"]).groupBy("ind", "block").agg(F.collect_list(F.col("code") * 2 + F.col("het")).alias("codes"))


def populations(geno: DataFrame) -> tuple[DataFrame, list, np.ndarray, list]:
    """(ind, pop, label, stratum), populations of two individuals at least, their regions' numbers, the regions."""
    inds = geno.groupBy("ind", "pop").agg(F.min("region").alias("region")) if "region" in geno.columns else geno.select("ind", "pop", F.lit(None).cast("int").alias("region")).distinct()
    size = inds.groupBy("pop").agg(F.count("*").alias("n"), F.min("region").alias("region")).where("n >= 2").orderBy("pop").collect()
    regions = sorted({s["region"] for s in size if s["region"] is not None})
    numbers = np.array([regions.index(s["region"]) if s["region"] is not None else -1 for s in size])
    kind = geno.schema["pop"].dataType
    table = geno.sparkSession.createDataFrame([(s["pop"], k, int(numbers[k])) for k, s in enumerate(size)], f"pop {kind.simpleString()}, label int, region_number int")
    return inds.select("ind", "pop").join(table, "pop"), [s["pop"] for s in size], numbers, regions


def permuted_counts(members: DataFrame, coded: Coded, replicates: int, labels: int) -> DataFrame:
    """name, block, b, loci, counts: int32 counts (labels x 2 alleles) of replicate b and chunk; b = 0 is the data.

    ``members``: name (of the case), ind, stratum, label.
    """
    per_case = members.groupBy("name").agg(F.count("*").alias("_n"))
    cases = per_case.count()
    chunks = F.greatest(F.lit(1), F.least(F.lit(CHUNKS), (F.col("_n") / CHUNK).cast("int")))
    inside = members.join(per_case, "name").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("ind", F.lit(11)), F.col("chunks")).cast("int")).drop("_n")
    parts = F.greatest(F.lit(1), F.least(F.lit(replicates), (F.lit(GROUPS / max(1, cases)) / F.col("chunks")).cast("int")))
    design = inside.groupBy("name", "chunks", "stratum", "label", "chunk").agg(F.count("*").alias("n")).groupBy("name", "chunks").agg(F.collect_list(F.struct("stratum", "label", "chunk", "n")).alias("design"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(coded.blocks - 1))).alias("block")
    units = design.select("*", blocks).join(coded.loci, "block").select("name", "block", "loci", "design", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), parts.alias("parts"))
    rows = inside.select("*", blocks).join(coded.packed, ["ind", "block"], "left").select("name", "block", "chunk", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "ind", "stratum", "label", "codes")
    out = pa.schema([("name", pa.string()), ("block", pa.int32()), ("b", pa.int32()), ("loci", pa.list_(pa.int32())), ("counts", pa.binary())])

    def run(people: pa.Table, unit: pa.Table) -> pa.Table:
        u = unit.to_pylist()[0]
        people = people.sort_by([("stratum", "ascending"), ("ind", "ascending")]).combine_chunks()
        name, chunk, part, parts_ = u["name"], u["chunk"], u["part"], u["parts"]
        alleles = len(u["loci"])
        design_ = pd.DataFrame(u["design"])
        stratum = people["stratum"].to_numpy()
        codes = people["codes"].combine_chunks()
        size = np.diff(codes.offsets.to_numpy()) if len(codes) else np.empty(0, np.int64)
        size = np.where(np.asarray(codes.is_valid()), size, 0)
        flat = codes.flatten().to_numpy()
        owner = np.repeat(np.arange(len(size)), size)
        mine = np.arange(part, replicates, parts_)
        streams = []
        for s in np.unique(stratum):
            own = design_[design_["stratum"] == s]
            names = np.sort(own["label"].unique())
            totals = own.groupby("label")["n"].sum().loc[names].to_numpy()
            sizes = own.groupby("chunk")["n"].sum().reindex(range(u["chunks"]), fill_value=0).to_numpy()
            streams.append((names, shuffled(totals, sizes, chunk, len(mine), name, int(s), part)))
        got = {"b": [], "counts": []}

        def count(label: np.ndarray, b: int) -> None:
            got["b"].append(b)
            got["counts"].append(np.bincount(label[owner] * (2 * alleles) + flat, minlength=labels * 2 * alleles).astype(np.int32).tobytes())

        if part == 0:
            count(people["label"].to_numpy().astype(np.int64), 0)
        for b in mine:
            count(np.concatenate([names[next(s)] for names, s in streams]).astype(np.int64), int(b) + 1)
        k = len(got["b"])
        return pa.table({"name": [name] * k, "block": [u["block"]] * k, "b": got["b"], "loci": [u["loci"]] * k, "counts": got["counts"]}, schema=out)

    keys = ["name", "block", "chunk", "part"]
    units = units.toDF("name", "block", "loci", "design", "chunks", "chunk", "part", "parts")
    rows, units = rows.repartition(GROUPS, *keys), units.repartition(GROUPS, *keys)
    return rows.groupBy(*keys).cogroup(units.groupBy(*keys)).applyInArrow(lambda a, b: run(a, b) if b.num_rows and a.num_rows else out.empty_table(), "name string, block int, b int, loci array<int>, counts binary")


def statistics(counts: DataFrame, labels: int, cases: int, parts: Callable[[str, int, Alleles], list[tuple[str, int, np.ndarray]]]) -> DataFrame:
    """name, b, parts: components that ``parts`` makes of each replicate's counts as (name, b, components), summed over blocks of loci."""
    slices = max(1, GROUPS // max(1, cases))

    def run(rows: pa.Table) -> pa.Table:
        made, total = [], {}
        shape, locus = (labels, -1, 2), np.array(rows["loci"][0].as_py())
        for b, c in zip(rows["b"].to_pylist(), rows["counts"], strict=True):
            own = np.frombuffer(c.as_buffer(), np.int32)
            total[b] = total[b] + own if b in total else own.astype(np.int64)
        for b, both in total.items():
            both = both.reshape(shape)
            made += parts(rows["name"][0].as_py(), b, Alleles(both.sum(axis=2), both[:, :, 1], locus))
        return pa.table({"name": [m[0] for m in made], "b": pa.array([m[1] for m in made], pa.int32()), "parts": pa.array([m[2].tolist() for m in made], pa.list_(pa.float64()))})

    grouped = counts.withColumn("slice", F.col("b") % slices).repartition(GROUPS, "name", "block", "slice").groupBy("name", "block", "slice")
    per_block = grouped.applyInArrow(run, "name string, b int, parts array<double>")
    added = per_block.select("name", "b", F.posexplode("parts").alias("k", "v")).groupBy("name", "b", "k").agg(F.sum("v").alias("v"))
    return added.groupBy("name", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("parts"))


def share(over: tuple[int, ...], of: tuple[int, ...]) -> Column:
    top, bottom = (sum((F.get("parts", F.lit(i)) for i in which), F.lit(0.0)) for which in (over, of))
    return F.when(bottom > 0, top / bottom)


def p_values(parts: DataFrame, **values: Column) -> DataFrame:
    """name, and of each value that of the data and p_<value>: replicates at least as large, the data counted in; replicates without a value don't count."""
    # A case has a row for each replicate.
    case = Window.partitionBy("name")
    out = parts.select("name", "b", *(v.alias(k) for k, v in values.items()))
    out = out.select("*", *(F.max(F.when(F.col("b") == 0, F.col(k))).over(case).alias(f"_{k}") for k in values))
    found = []
    for k in values:
        ran, ge = (F.count_if((F.col("b") > 0) & F.col(k).isNotNull() & more) for more in (F.lit(True), F.col(k) >= F.col(f"_{k}") - NEAR))
        found += [F.max(f"_{k}").alias(k), F.when((ran > 0) & F.max(f"_{k}").isNotNull(), (ge + 1) / (ran + 1)).alias(f"p_{k}")]
    return out.groupBy("name").agg(*found)


def pairings(counts: np.ndarray, replicates: int, g: np.random.Generator) -> Iterator[np.ndarray]:
    """Gene copies with these allele counts paired at random: for each first allele of a pair, replicates x second alleles.

    First copies of the pairs are drawn, then each allele's partners among the second ones: draws from counts, whatever their size.
    """
    n, total = int(counts.sum()) // 2, int(counts.sum())
    first, need, rest = np.zeros((replicates, len(counts)), np.int64), np.full(replicates, n), np.full(replicates, total)
    for j, c in enumerate(counts):
        rest = rest - c
        first[:, j] = g.hypergeometric(np.full(replicates, c), rest, need)
        need = need - first[:, j]
    second = counts - first
    for i in range(len(counts)):
        need, rest, drawn = first[:, i].copy(), second.sum(axis=1), np.zeros_like(second)
        for j in range(len(counts)):
            rest = rest - second[:, j]
            drawn[:, j] = g.hypergeometric(second[:, j], rest, need)
            need = need - drawn[:, j]
        second = second - drawn
        yield drawn


def homozygotes(counts: np.ndarray, replicates: int, g: np.random.Generator) -> np.ndarray:
    """Pairs of equal alleles, replicate by replicate."""
    return sum((drawn[:, i] for i, drawn in enumerate(pairings(counts, replicates, g))), np.zeros(replicates, np.int64))


def log_factorial(x: np.ndarray) -> np.ndarray:
    """ln x!, from sums up to 255 and Stirling's series beyond."""
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])
    y = np.maximum(x, 255) + 1.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 256, small[np.minimum(x, 255)], series)


def hwe_exact(genotypes: DataFrame, replicates: int = 1000, cells: int = 4_000_000) -> DataFrame:
    """pop, locus, n, p, p_deficit, p_excess: Monte Carlo exact test from the genotypes' numbers (pop, locus, a <= b, n).

    Gene copies are paired anew within population and locus; a replicate is drawn from the allele counts.
    """
    kinds = {c: genotypes.schema[c].dataType.simpleString() for c in ("pop", "locus")}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["a", "b"])
        pop, locus, m = part["pop"].iloc[0], part["locus"].iloc[0], part["n"].to_numpy(np.int64)
        codes, names = pd.factorize(pd.concat([part["a"], part["b"]]), sort=True)
        k, n = len(names), int(m.sum())
        out = {"pop": [pop], "locus": [locus], "n": [n]}
        if k < 2 or n < 2:
            return pd.DataFrame(out | {c: pd.Series([None], dtype=float) for c in ("p", "p_deficit", "p_excess")})
        a, b = codes[: len(m)], codes[len(m) :]
        copies = np.bincount(codes, weights=np.concatenate([m, m]), minlength=k).astype(np.int64)

        def score(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """n_het ln 2 - sum ln n_ij! and n_het."""
            het = table[:, ~np.eye(k, dtype=bool)].sum(axis=1)
            return het * np.log(2) - log_factorial(table).sum(axis=(1, 2)), het

        seen = np.zeros((1, k, k), np.int64)
        np.add.at(seen[0], (np.minimum(a, b), np.maximum(a, b)), m)
        as_seen, het = score(seen)
        g, hits = rng("hwe", pop, locus), np.zeros(3, np.int64)
        step = max(1, min(replicates, cells // (k * k)))
        for at in range(0, replicates, step):
            table = np.zeros((min(step, replicates - at), k, k), np.int64)
            for i, drawn in enumerate(pairings(copies, len(table), g)):
                table[:, i, i:] += drawn[:, i:]
                table[:, :i, i] += drawn[:, :i]
            scores, hets = score(table)
            hits += [(scores <= as_seen[0] + 1e-12 * abs(as_seen[0]) + 1e-9).sum(), (hets <= het[0]).sum(), (hets >= het[0]).sum()]
        p = (hits + 1) / (replicates + 1)
        return pd.DataFrame(out | {"p": [p[0]], "p_deficit": [p[1]], "p_excess": [p[2]]})

    return genotypes.select("pop", "locus", "a", "b", "n").groupBy("pop", "locus").applyInPandas(run, f"pop {kinds['pop']}, locus {kinds['locus']}, n bigint, p double, p_deficit double, p_excess double")


def from_counts(x: Alleles, replicates: int, region: np.ndarray | None, key: int) -> list[tuple[str, int, np.ndarray]]:
    """('CT' or 'IS', b, components): the tests that the counts of the data decide; populations move alike in all blocks of loci."""
    seen, out = amova_parts(x, region), []
    if region is not None:
        out = [("CT", 0, seen)] + [("CT", b, amova_parts(x, rng("regions", b).permutation(region))) for b in range(1, replicates + 1)]
    loci = int(x.locus[-1]) + 1
    hets = np.zeros((replicates, loci))
    for l in range(loci):
        own = x.n[:, x.locus == l]
        for p in np.flatnonzero(own.sum(axis=1)):
            hets[:, l] += own[p].sum() // 2 - homozygotes(own[p], replicates, rng("copies", key, l, int(p)))
    return [*out, ("IS", 0, seen), *(("IS", b + 1, amova_parts(x, region, hets[b])) for b in range(replicates))]


#: Components: sigma of regions, populations, individuals, copies. Each test's share of them.
PHI = {"ST": ((0, 1), (0, 1, 2, 3)), "SC": ((1,), (1, 2, 3)), "CT": ((0,), (0, 1, 2, 3)), "IS": ((2,), (2, 3))}


def amova_tests(geno: DataFrame, replicates: int = 999) -> DataFrame:
    """test, phi, p: individuals among populations (ST), among the populations of their region (SC), populations among regions (CT), gene copies within populations (IS).

    Without two regions there is no SC or CT. Populations of one individual take no part.
    """
    geno = kept(geno)
    inds, pops, region, regions = populations(geno)
    labels = len(pops)
    deep = len(regions) >= 2 and bool((region >= 0).all())
    where = region if deep else None
    coded = Coded(geno.join(inds.select("ind"), "ind", "left_semi"), labels)
    members = inds.select(F.lit("ST").alias("name"), "ind", F.lit(0).alias("stratum"), "label")
    if deep:
        members = members.unionByName(inds.select(F.lit("SC").alias("name"), "ind", F.col("region_number").alias("stratum"), "label"))

    def parts(name: str, b: int, x: Alleles) -> list[tuple[str, int, np.ndarray]]:
        more = from_counts(x, replicates, where, zlib.crc32(x.locus.tobytes())) if name == "ST" and b == 0 else []
        return [(name, b, amova_parts(x, where)), *more]

    found = statistics(permuted_counts(members, coded, replicates, labels), labels, 1 + deep, parts)
    phi = F.coalesce(*(F.when(F.col("name") == name, share(*which)) for name, which in PHI.items()))
    return p_values(found, phi=phi).select(F.col("name").alias("test"), "phi", F.col("p_phi").alias("p"))


def permuted_theta(geno: DataFrame, replicates: int = 999) -> DataFrame:
    """theta, p: individuals are shuffled among populations; loci stay together."""
    geno = kept(geno)
    inds, pops, _, _ = populations(geno)
    coded = Coded(geno.join(inds.select("ind"), "ind", "left_semi"), len(pops))
    members = inds.select(F.lit("theta").alias("name"), "ind", F.lit(0).alias("stratum"), "label")
    found = statistics(permuted_counts(members, coded, replicates, len(pops)), len(pops), 1, lambda name, b, x: [(name, b, theta_parts(x))])
    return p_values(found, theta=share((0,), (0, 1, 2))).select("theta", F.col("p_theta").alias("p"))


def holm(tests: DataFrame, p: str) -> DataFrame:
    """``tests`` with <p>_holm. Equal p values share a rank, so ranks are counted over the distinct ones; those of permutation tests are few."""
    values = tests.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("n"))
    up = Window.orderBy(p)
    before = F.sum("n").over(up) - F.col("n")
    ranked = values.select(p, "n", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("m"))
    corrected = ranked.select(p, F.max(F.least(F.lit(1.0), F.col(p) * (F.col("m") - F.col("before")))).over(up).alias(f"{p}_holm"))
    return tests.join(corrected, p, "left")


def paired_counts(members: DataFrame, coded: Coded, replicates: int) -> DataFrame:
    """As ``permuted_counts``, of all pairs of populations ("0-1", ...), from ind and label, without a row per individual and pair.

    An individual lies in one chunk of its population. Which of a pair's two labels its places get is drawn there for every
    other population; the sizes of all chunks, listed on the driver, say how many.
    """
    size = members.groupBy("label").agg(F.count("*").alias("n"))
    total = size.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    # Every chunk gives sums of every replicate and pair, so there are no more than keep the tasks busy, or than their size allows.
    share = F.greatest(F.ceil(F.col("n") * 2 * GROUPS / total), F.ceil(F.col("n") / LARGE))
    size = size.withColumn("chunks", F.greatest(F.lit(1), F.least(share, F.col("n") / CHUNK)).cast("int"))
    inside = kept(members.join(F.broadcast(size), "label").select("label", F.pmod(F.xxhash64("ind", F.lit(11)), "chunks").cast("int").alias("chunk"), "ind"))
    chunks = {r["label"]: np.zeros(r["chunks"], np.int64) for r in size.collect()}
    for r in inside.groupBy("label", "chunk").count().collect():
        chunks[r["label"]][r["chunk"]] = r["count"]
    loci = {r["block"]: r["loci"] for r in coded.loci.collect()}
    rows = inside.select("*", F.explode(F.sequence(F.lit(0), F.lit(coded.blocks - 1))).alias("block")).join(coded.packed, ["ind", "block"], "left")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, chunk, block = (k.as_py() for k in key)
        people = pa.Table.from_batches(list(batches)).sort_by("ind")
        codes, n = people["codes"].combine_chunks(), people.num_rows
        ends = np.concatenate([[0], np.cumsum(np.where(np.asarray(codes.is_valid()), np.diff(codes.offsets.to_numpy()), 0))])
        flat, width = codes.flatten().to_numpy(), 2 * len(loci.get(block, []))
        if not width:
            return

        owner = np.repeat(np.arange(n), np.diff(ends))
        copies = np.bincount(owner * width + flat, minlength=n * width).astype(np.uint8).reshape(n, width) if width <= WIDE else None

        def sums(s: int, e: int, taken: np.ndarray) -> np.ndarray:
            if copies is not None:
                # Sums of a block stay far below 2^24, so single precision is exact.
                return (taken.astype(np.float32) @ copies[s:e].astype(np.float32)).astype(np.int64)
            mine, codes = owner[ends[s] : ends[e]] - s, flat[ends[s] : ends[e]]
            return np.array([np.bincount(codes[t[mine]], minlength=width) for t in taken])

        whole = np.bincount(flat, minlength=width)
        for other in sorted(chunks.keys() - {label}):
            low, high = sorted((label, other))
            name, at = f"{low}-{high}", chunk + (len(chunks[low]) if label == high else 0)
            totals = np.array([chunks[low].sum(), chunks[high].sum()])
            first = dealt(totals, np.concatenate([chunks[low], chunks[high]]), at, replicates, name)[:, 0]
            counts = np.zeros((replicates + 1, 2, width), np.int32)
            counts[0, int(label == high)] = whole
            # The same places of a chunk in all blocks of loci.
            counts[1:, 0] = subset_sums(n, sums, width, first, rng("subsets", name, at))
            counts[1:, 1] = whole - counts[1:, 0]
            k = replicates + 1
            yield pa.record_batch([pa.array([name] * k), pa.array([block] * k, pa.int32()), pa.array(np.arange(k, dtype=np.int32)), pa.array([loci[block]] * k, pa.list_(pa.int32())), pa.array([c.tobytes() for c in counts])], names=["name", "block", "b", "loci", "counts"])

    tasks = min(4 * GROUPS, 2 * coded.blocks * sum(map(len, chunks.values())) + 1)
    return rows.repartition(tasks, "label", "chunk", "block").groupBy("label", "chunk", "block").applyInArrow(run, "name string, block int, b int, loci array<int>, counts binary")


def pairwise_tests(geno: DataFrame, replicates: int = 199) -> DataFrame:
    """p1, p2, theta, phi, their p by shuffling the individuals of the two populations, and Holm's correction over all pairs."""
    geno = kept(geno)
    inds, pops, _, _ = populations(geno)
    coded = Coded(geno.join(inds.select("ind"), "ind", "left_semi"), 2)
    last = len(pops) - 1
    counts = paired_counts(inds, coded, replicates)
    found = statistics(counts, 2, len(pops) * last // 2, lambda name, b, x: [(name, b, np.concatenate([theta_parts(x), amova_parts(x)]))])
    tests = kept(p_values(found, theta=share((0,), (0, 1, 2)), phi=share((3, 4), (3, 4, 5, 6))))
    tests = holm(holm(tests, "p_theta"), "p_phi")
    names = geno.sparkSession.createDataFrame(list(enumerate(pops)), f"k int, pop {geno.schema['pop'].dataType.simpleString()}")
    low, high = names.toDF("k1", "p1"), names.toDF("k2", "p2")
    tests = tests.withColumn("k1", F.split("name", "-")[0].cast("int")).withColumn("k2", F.split("name", "-")[1].cast("int"))
    return tests.join(low, "k1").join(high, "k2").select("p1", "p2", "theta", "p_theta", "p_theta_holm", "phi", "p_phi", "p_phi_holm")

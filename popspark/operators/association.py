"""Linkage disequilibrium of many loci: index of association, its standardised form, and their tests by shuffling.

Two individuals differ at a locus by the alleles they don't share (0, 1 or 2), so by their genotypes'
classes alone. Sums over pairs of individuals then follow from how often classes of two loci meet: with
N the table of two loci's classes and T, U the classes' distances, the sum of products over all pairs is
half of sum(N * (T N U)). No pair of individuals is formed.

A replicate shuffles each locus by itself. That needs the numbers of each class only: they are dealt to
places (``permutation.shuffled``), chunk by chunk where a population is large, and the tables add up.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popspark.operators.permutation import CHUNK, GROUPS, NEAR, shuffled
from popspark.plans.working import kept

#: Individuals of a population that is tested by itself, at least.
LEAST = 5
#: Genotype classes that are broadcast, at most.
KINDS = 1 << 18
#: Individuals of a chunk, at most (about), and of those whose classes are counted at once.
LARGE, BLOCK = 1 << 20, 1 << 15
#: Cells of a table of several loci, at most.
SEVERAL = 1 << 15


class Classes(NamedTuple):
    """A population's genotype classes: numbers (loci x classes, class 0 for no data) and distances (loci x classes x classes)."""

    n: np.ndarray
    far: np.ndarray

    @property
    def people(self) -> int:
        return int(self.n[0].sum())


def distance(x: tuple, y: tuple) -> float:
    """Alleles not shared by two genotypes."""
    if sorted(map(str, x)) == sorted(map(str, y)):
        return 0.0
    return 1.0 if set(x) & set(y) else 2.0


def classes_of(kinds: list[dict], people: int) -> Classes:
    """From rows of (nth locus, code, a, b, n); pairs without data take the mean distance of their locus."""
    loci, width = 1 + max(k["nth"] for k in kinds), 1 + max(k["code"] for k in kinds)
    n, far = np.zeros((loci, width), np.int64), np.zeros((loci, width, width))
    names: list[list[tuple | None]] = [[None] * width for _ in range(loci)]
    for k in kinds:
        n[k["nth"], k["code"]] = k["n"]
        names[k["nth"]][k["code"]] = (k["a"], k["b"])
    for l in range(loci):
        known = [c for c in range(1, width) if names[l][c] is not None]
        for c in known:
            for d in known:
                far[l, c, d] = distance(names[l][c], names[l][d])
        own = n[l].astype(float)
        total = own.sum()
        mean = own @ far[l] @ own / (total * (total - 1)) if total > 1 else 0.0
        far[l, 0, :] = far[l, :, 0] = mean
        n[l, 0] = people - n[l].sum()
    return Classes(n, far)


def moments(x: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of squares of each locus's distances over all pairs of individuals."""
    own = x.n.astype(float)
    alone = own[:, 0] * x.far[:, 0, 0]
    first = (np.einsum("lu,luv,lv->l", own, x.far, own) - alone) / 2
    second = (np.einsum("lu,luv,lv->l", own, x.far**2, own) - own[:, 0] * x.far[:, 0, 0] ** 2) / 2
    return first, second


def gathered(loci: int, size: int) -> list[list[int]]:
    """Sets of ``size`` loci at most that hold every pair of loci; of seven loci, seven sets of three."""
    left, out = {(a, b) for b in range(loci) for a in range(b)}, []
    while left:
        own = list(min(left))
        while len(own) < min(size, loci):
            more = {c: sum((min(a, c), max(a, c)) in left for a in own) for c in range(loci) if c not in own}
            own.append(max(more, key=lambda c: (more[c], -c)))
        own.sort()
        left -= {(a, b) for b in own for a in own if a < b}
        out.append(own)
    return out


def tables(codes: np.ndarray, width: int) -> np.ndarray:
    """pairs of loci x classes x classes, from the classes of individuals (loci x individuals)."""
    loci, n = codes.shape
    # Several loci are counted at once where that takes no more cells than there are individuals.
    size = max([s for s in (3, 4) if width**s <= min(n, SEVERAL)], default=2)
    sets = gathered(loci, size)
    counts = [np.zeros(width ** len(own), np.int64) for own in sets]
    kind = np.uint16 if width**size <= 1 << 16 else np.int64
    for s in range(0, n, BLOCK):
        some = codes[:, s : s + BLOCK].astype(kind)
        for own, count in zip(sets, counts, strict=True):
            at = some[own[0]]
            for l in own[1:]:
                at = at * kind(width) + some[l]
            count += np.bincount(at, minlength=len(count))
    out, seen = np.zeros((loci, loci, width, width), np.int64), set()
    for own, count in zip(sets, counts, strict=True):
        wide = count.reshape((width,) * len(own))
        for x, y in combinations(range(len(own)), 2):
            if (own[x], own[y]) not in seen:
                seen.add((own[x], own[y]))
                out[own[x], own[y]] = wide.sum(axis=tuple(k for k in range(len(own)) if k not in (x, y)))
    return out[np.triu_indices(loci, 1)]


def products(x: Classes, n: np.ndarray) -> np.ndarray:
    """Sums over pairs of individuals of the products of two loci's distances."""
    a, b = np.triu_indices(len(x.n), 1)
    n = n.astype(float)
    both = (n * (x.far[a] @ n @ x.far[b])).sum(axis=(1, 2))
    return (both - n[:, 0, 0] * x.far[a, 0, 0] * x.far[b, 0, 0]) / 2


def measures(x: Classes, n: np.ndarray, pairwise: bool) -> list[float | None]:
    """[I_A, r_d], or the correlation of each pair of loci."""
    m = x.people * (x.people - 1) / 2
    first, second = moments(x)
    a, b = np.triu_indices(len(x.n), 1)
    cross = products(x, n)
    var = (second - first**2 / m) / (m - 1) if m > 1 else np.zeros_like(first)
    if pairwise:
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (cross - first[a] * first[b] / m) / (m - 1) / np.sqrt(var[a] * var[b])
        return [float(v) if np.isfinite(v) else None for v in r]
    if m <= 1:
        return [None, None]
    total = (second.sum() + 2 * cross.sum() - first.sum() ** 2 / m) / (m - 1)
    spread = np.sqrt(np.maximum(0, var[a] * var[b])).sum()
    return [float(total / var.sum() - 1) if var.sum() > 0 else None, float((total - var.sum()) / (2 * spread)) if spread > 0 else None]


def _measured(geno: DataFrame, replicates: int, pairwise: bool, pooled: bool) -> tuple[DataFrame, DataFrame]:
    """(scope, b, n, measures) of the data (b = 0) and the replicates, and the loci by number."""
    geno = geno.where("a1 IS NOT NULL AND a2 IS NOT NULL").select("ind", "pop", "locus", F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b"))
    numbers = kept(geno.groupBy("pop", "locus", "a", "b").agg(F.count("*").alias("n")))
    kinds = numbers.select("locus", "a", "b").distinct()
    loci = kinds.select("locus").distinct().withColumn("nth", F.row_number().over(Window.orderBy("locus")) - 1)
    kinds = kept(kinds.withColumn("code", F.row_number().over(Window.partitionBy("locus").orderBy("a", "b"))).join(loci, "locus"))
    width = 1 + (kinds.agg(F.max("code")).first()[0] or 0)
    scope = F.concat(F.lit("="), F.col("pop").cast("string"))
    of = ["name", "nth", "code", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")]
    counts = numbers.join(kinds, ["locus", "a", "b"]).withColumn("name", F.explode(F.array(*([scope, F.lit("*")] if pooled else [scope])))).where("name IS NOT NULL").groupBy(*of).agg(F.sum("n").alias("n"))
    # A row per individual, grouped where the genotypes lie; a locus and its class are one number.
    coded = geno.join(F.broadcast(kinds) if kinds.count() <= KINDS else kinds, ["locus", "a", "b"]).select("ind", "pop", (F.col("nth") * width + F.col("code")).cast("int").alias("at"))
    people = coded.where("pop IS NOT NULL").groupBy("pop", "ind").agg(F.collect_list("at").alias("own")).select(scope.alias("name"), "ind", "own")
    if pooled:
        people = people.unionByName(coded.groupBy("ind").agg(F.collect_list("at").alias("own")).select(F.lit("*").alias("name"), "ind", "own"))
    people = kept(people)
    size = kept(people.groupBy("name").agg(F.count("*").alias("people")).where(F.col("people") >= LEAST))
    number, total = size.agg(F.count("*"), F.coalesce(F.sum("people"), F.lit(1))).first()
    # Every chunk gives tables of every replicate, so there are no more chunks than keep the tasks busy, or than their size allows.
    share = F.greatest(F.ceil(F.col("people") * 2 * GROUPS / total), F.ceil(F.col("people") / LARGE))
    size = size.withColumn("chunks", F.greatest(F.lit(1), F.least(share, F.col("people") / CHUNK)).cast("int"))
    packed = people.join(F.broadcast(size.select("name", "chunks")), "name").select("name", F.pmod(F.xxhash64("ind", F.lit(11)), "chunks").cast("int").alias("chunk"), "own")
    sizes = packed.groupBy("name", "chunk").count().groupBy("name").agg(F.collect_list(F.struct("chunk", "count")).alias("sizes"))
    design = counts.groupBy("name").agg(F.collect_list(F.struct("nth", "code", "a", "b", "n")).alias("kinds")).join(sizes, "name").join(size, "name")
    parts = F.greatest(F.lit(1), F.least(F.lit(max(1, replicates)), (F.lit(GROUPS / max(1, number)) / F.col("chunks")).cast("int")))
    units = design.withColumn("parts", parts).select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    schema = pa.schema([("name", pa.string()), ("b", pa.int32()), ("people", pa.int64()), ("kinds", pa.list_(pa.struct([("nth", pa.int32()), ("code", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))), ("measures", pa.list_(pa.float64())), ("tables", pa.binary())])

    def run(people: pa.Table, unit: pa.Table) -> pa.Table:
        if not unit.num_rows:
            return schema.empty_table()
        u = unit.to_pylist()[0]
        x = classes_of(u["kinds"], u["people"])
        wide, loci_ = x.n.shape[1], len(x.n)
        sizes_ = np.zeros(u["chunks"], np.int64)
        for s in u["sizes"]:
            sizes_[s["chunk"]] = s["count"]
        out = []

        def add(b: int, codes: np.ndarray) -> None:
            n = tables(codes, wide)
            whole = u["chunks"] == 1
            out.append({"name": u["name"], "b": b, "people": u["people"], "kinds": None if whole or u["chunk"] else u["kinds"], "measures": measures(x, n, pairwise) if whole else None, "tables": None if whole else n.astype(np.int32).tobytes()})

        if u["part"] == 0:
            codes = np.zeros((loci_, people.num_rows), np.int64)
            own = people["own"].combine_chunks()
            at = own.flatten().to_numpy()
            codes[at // width, pc.list_parent_indices(own).to_numpy()] = at % width
            add(0, codes)
        mine = range(u["part"], replicates, u["parts"])
        streams = [shuffled(x.n[l], sizes_, u["chunk"], len(mine), u["name"], l, u["part"]) for l in range(loci_)]
        for b in mine:
            add(b + 1, np.array([next(s) for s in streams]).reshape(loci_, -1))
        return pa.Table.from_pylist(out, schema)

    keys = ["name", "chunk", "part"]
    first = packed.select("name", "chunk", F.lit(0).alias("part"), "own")
    units = units.select(*(F.col(c).alias(f"u_{c}") if c in keys else F.col(c) for c in ("name", "chunk", "part", "kinds", "sizes", "people", "chunks", "parts")))

    def named(a: pa.Table, b: pa.Table) -> pa.Table:
        return run(a, b.rename_columns([c.removeprefix("u_") for c in b.column_names]))

    done = kept(first.repartition(GROUPS, *keys).groupBy(*keys).cogroup(units.repartition(GROUPS, *(f"u_{k}" for k in keys)).groupBy(*(f"u_{k}" for k in keys))).applyInArrow(named, "name string, b int, people bigint, kinds array<struct<nth:int,code:int,a:string,b:string,n:bigint>>, measures array<double>, tables binary"))

    classes: dict[str, Classes] = {}

    def joined(rows: pa.Table) -> pa.Table:
        # The first chunk's row has the classes, which a task makes once for each name.
        name = rows["name"][0].as_py()
        x = classes.get(name) or classes.setdefault(name, classes_of(rows["kinds"].drop_null()[0].as_py(), rows["people"][0].as_py()))
        n = sum(np.frombuffer(t.as_buffer(), np.int32).astype(np.int64) for t in rows["tables"]).reshape(-1, x.n.shape[1], x.n.shape[1])
        return pa.table({"name": [rows["name"][0].as_py()], "b": pa.array([rows["b"][0].as_py()], pa.int32()), "people": pa.array([x.people], pa.int64()), "measures": pa.array([measures(x, n, pairwise)], pa.list_(pa.float64()))})

    large = done.where("tables IS NOT NULL").groupBy("name", "b").applyInArrow(joined, "name string, b int, people bigint, measures array<double>")
    return done.where("tables IS NULL").select("name", "b", "people", "measures").unionByName(large), loci


def _tested(measured: DataFrame) -> DataFrame:
    """name, people, k, v (of the data), p."""
    values = measured.select("name", "b", "people", F.posexplode("measures").alias("k", "v"))
    seen = values.withColumn("seen", F.max(F.when(F.col("b") == 0, F.col("v"))).over(Window.partitionBy("name", "k")))
    ran = F.count_if((F.col("b") > 0) & F.col("v").isNotNull())
    ge = F.count_if((F.col("b") > 0) & (F.col("v") >= F.col("seen") - NEAR))
    return seen.groupBy("name", "people", "k").agg(F.max("seen").alias("v"), F.when((ran > 0) & F.max("seen").isNotNull(), (ge + 1) / (ran + 1)).alias("p"))


def _pop(geno: DataFrame):
    """The population of a name; null for all samples together."""
    return F.when(F.col("name") != "*", F.substring("name", 2, 1 << 30)).cast(geno.schema["pop"].dataType)


def multilocus_ld(geno: DataFrame, replicates: int = 999, pooled: bool = True) -> DataFrame:
    """pop (null: all samples pooled), n, n_loci, ia, rd, p: populations of five individuals at least; p by r_d, every locus shuffled by itself."""
    measured, loci = _measured(geno, replicates, False, pooled)
    tested = _tested(measured).groupBy("name", "people").agg(F.max(F.when(F.col("k") == 0, F.col("v"))).alias("ia"), F.max(F.when(F.col("k") == 1, F.col("v"))).alias("rd"), F.max(F.when(F.col("k") == 1, F.col("p"))).alias("p"))
    return tested.select(_pop(geno).alias("pop"), F.col("people").alias("n"), F.lit(loci.count()).cast("long").alias("n_loci"), "ia", "rd", "p")


def pairwise_ld(geno: DataFrame, replicates: int = 199, pooled: bool = True) -> DataFrame:
    """pop (null: pooled), l1, l2, rd, p: the correlation of two loci's distances over pairs of individuals."""
    measured, loci = _measured(geno, replicates, True, pooled)
    a, b = loci.toDF("l1", "n1"), loci.toDF("l2", "n2")
    pairs = a.join(b, F.col("n1") < F.col("n2")).withColumn("k", F.row_number().over(Window.orderBy("n1", "n2")) - 1)
    return _tested(measured).join(pairs, "k").select(_pop(geno).alias("pop"), "l1", "l2", F.col("v").alias("rd"), "p")

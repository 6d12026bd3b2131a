"""Hard negatives by one-dimensional distance keys.

Inner products become distances: each vector x gets one more component, sqrt(M^2 - |x|^2),
with M the largest norm; of an anchor q the added component is 0, so that
``distance^2 = |q|^2 + M^2 - 2 score``. Every row lies with its nearest pivot at a key, its
distance to it. Rows sorted by (pivot, key) are cut into pages.

A request (an anchor, a side of the labels, a range of scores, k) reads, round by round,
the rows whose key differs by at most ``reach`` from the anchor's own distance to their pivot:
all others are farther than ``reach`` by the triangle inequality. The reach grows until the
k-th score found, or the lowest score asked for, is out of reach of every row not read:
then the result is exact. Anchors travel in batches, so a page and a batch meet as two matrices.

Pivots are fitted to the ``SAMPLE`` rows of least hash of their id; this decides speed only.
Every row is indexed, and every anchor is answered exactly.

Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Shorter
vectors are filled up with zeros. Scores are exact while they stay below 2^53; a positive whose
score doesn't fit a long gets no negatives. Rows that
repeat are rows of their own, but an anchor that repeats is answered once; rows of the anchor's own
vec_id are never its positives. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popspark.llm.common import stored

#: Rows that the pivots are fitted to, and how many pivots there are.
SAMPLE, PIVOTS = 4096, 32
#: Rows of a page, anchors of a batch, batches that meet a page in one group, rows scored at a time.
PAGE, BATCH, SLICE, CHUNK = 16384, 512, 64, 1024
#: The first reach as a part of the spread of keys, and its growth from round to round.
FIRST_REACH, GROWTH = 0.25, 4.0
#: Distances are doubles; keys this close (relative to M) to the reach are read too.
SLACK = 1e-6

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def participants(embeddings: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, v (floor(256 x) as doubles); labels of every seventh id turned to the next."""
    usable = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) < DOUBLE('Infinity'))"
    turned = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("long")
    return embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), turned.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("v"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _pivots(rows: DataFrame, dim: int, m2: float) -> np.ndarray:
    """Centres of the sample after some rounds of k-means, started far apart."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    x = _augmented(_matrix(sample, dim), m2)
    chosen = [x[0]]
    nearest = np.full(len(x), np.inf)
    while len(chosen) < min(PIVOTS, len(x)):
        nearest = np.minimum(nearest, ((x - chosen[-1]) ** 2).sum(1))
        chosen.append(x[int(nearest.argmax())])
    pivots = np.array(chosen)
    for _ in range(8):
        own = _distances(x, pivots).argmin(1)
        for p in np.unique(own):
            pivots[p] = x[own == p].mean(0)
    return pivots


def _augmented(x: np.ndarray, m2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(1)))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T))


def _number() -> Iterator[int]:
    """Numbers that no other task of the job gives; the caller stores them."""
    at = TaskContext.get().partitionId() << 24
    while True:
        yield at
        at += 1


class Index:
    """Rows in pages by (pivot, key), in the shared folder."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        size = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")).alias("m2")).first()
        self.dim, self.m2 = size.dim or 0, size.m2 or 0.0
        self.pivots = _pivots(rows, self.dim, self.m2) if size.dim is not None else np.zeros((0, 1))
        self.slack = SLACK * max(1.0, self.m2**0.5)
        self.pages = self._pages()
        ends = self.pages.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
        self.low, self.high = ends.low or 0.0, ends.high or 0.0

    def _pages(self) -> DataFrame:
        dim, m2, pivots = self.dim, self.m2, self.pivots

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = _distances(_augmented(_matrix(b.column("v"), dim), m2), pivots)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own])], ["vec_id", "label", "v", "pivot", "key"])

        def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, held, rows = _number(), [], 0

            def pages(table: pa.Table, all_of_it: bool) -> tuple[list[dict], pa.Table]:
                out, pivot, start = [], table["pivot"].to_numpy(), 0
                while start < len(pivot):
                    end = min(int(np.searchsorted(pivot, pivot[start], "right")), start + PAGE)
                    if end == len(pivot) and not all_of_it and end - start < PAGE:
                        break
                    own = table.slice(start, end - start).combine_chunks()
                    key = own["key"].to_numpy()
                    x = _matrix(own["v"].combine_chunks(), dim)
                    narrow = np.abs(x).max(initial=0) < 2**31
                    out.append({"page": next(number), "pivot": int(pivot[start]), "low": key[0], "high": key[-1], "narrow": bool(narrow), "keys": key.tobytes(), "ids": own["vec_id"].to_numpy().tobytes(), "labels": own["label"].to_numpy().tobytes(), "x": x.astype(np.int32 if narrow else np.float64).tobytes()})
                    start = end
                return out, table.slice(start)

            for b in batches:
                held.append(b)
                rows += b.num_rows
                if rows >= 2 * PAGE:
                    out, left = pages(pa.Table.from_batches(held), False)
                    held, rows = left.to_batches(), left.num_rows
                    for p in out:
                        yield pa.RecordBatch.from_pylist([p], schema)
            if held:
                for p in pages(pa.Table.from_batches(held), True)[0]:
                    yield pa.RecordBatch.from_pylist([p], schema)

        schema = pa.schema([("page", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("narrow", pa.bool_()), ("keys", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary())])
        keys = self.rows.select("vec_id", "label", "v").mapInArrow(keyed, "vec_id long, label long, v array<double>, pivot int, key double")
        # vec_id too, so that copies of one vector are dealt to many tasks.
        dealt = keys.repartitionByRange("pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id")
        return stored(dealt.mapInArrow(paged, "page long, pivot int, low double, high double, narrow boolean, keys binary, ids binary, labels binary, x binary"), "pages")

    def anchors(self, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The chosen rows as (anchor, batch, pos, vec_id, label, norm2, d), and their batches packed; neighbours share a batch."""
        dim, m2, pivots = self.dim, self.m2, self.pivots

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("v"), dim)
                d = _distances(np.hstack([x, np.zeros((len(x), 1))]), pivots)
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * d.shape[1], d.ravel())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), pa.array(d.argmin(1).astype(np.int32)), pa.array((x * x).sum(1)), flat], ["vec_id", "label", "v", "near", "norm2", "d"])

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, k, at = _number(), 0, 0
            for b in batches:
                batch, pos = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int32)
                for i in range(b.num_rows):
                    at = next(number) if k % BATCH == 0 else at
                    batch[i], pos[i] = at, k % BATCH
                    k += 1
                names = ["vec_id", "label", "v", "norm2", "d"]
                yield pa.RecordBatch.from_arrays([pa.array(batch * BATCH + pos), pa.array(batch), pa.array(pos), *(b.column(n) for n in names)], ["anchor", "batch", "pos", *names])

        near = chosen.select("vec_id", "label", "v").distinct().mapInArrow(measured, "vec_id long, label long, v array<double>, near int, norm2 double, d array<double>")
        dealt = near.repartitionByRange("near", "vec_id").sortWithinPartitions("near", "vec_id")
        flat = stored(dealt.mapInArrow(numbered, "anchor long, batch long, pos int, vec_id long, label long, v array<double>, norm2 double, d array<double>"), "anchors")
        # At most BATCH rows a group.
        packed = flat.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "vec_id", "label", "v"))).alias("own"))
        packed = stored(packed.select("batch", F.col("own.vec_id").alias("ids"), F.col("own.label").alias("labels"), F.flatten(F.transform("own.v", lambda v: F.concat(v, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(v))))).alias("q")), "batches")
        self.slices = 1 + packed.count() // SLICE
        return flat.drop("v"), packed

    def search(self, requests: DataFrame, packed: DataFrame, k: int) -> DataFrame:
        """rid, vec_id, score, nth: the first ``k`` rows of each request by score, then vec_id.

        ``requests``: rid, batch, pos, norm2, d, same (label equal or different), low and high (scores, null: any).
        """
        spark, m2, slack, start = requests.sparkSession, self.m2, self.slack, FIRST_REACH * (self.high - self.low)
        directory = self.pages.select("page", "pivot", "low", "high")
        state = requests.withColumn("floor", F.coalesce("low", F.lit(float("-inf")))).withColumn("done", F.lit(-1.0))
        found = spark.createDataFrame([], "rid long, vec_id long, score double")
        while True:
            # No key is farther from an anchor's own distance than the larger of the two.
            need = F.least(F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") + m2 - 2 * F.col("floor"))), F.greatest(F.array_max("d"), F.lit(self.high)))
            state = state.withColumn("need", need).withColumn("reach", F.least("need", F.greatest(F.lit(start), GROWTH * F.col("done"))) + slack)
            state = stored(state, "requests")
            live = state.where("done < need")
            if live.isEmpty():
                break
            found = stored(self._best(found.unionByName(self._read(live, directory, packed, k)), k), "found")
            kth = found.groupBy("rid").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
            state = state.join(kth, "rid", "left").select(*requests.columns, F.greatest("floor", F.coalesce("least", "floor")).alias("floor"), F.greatest("done", "reach").alias("done"))
        ranked = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("nth", F.row_number().over(ranked))

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        ranked = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= k).drop("nth")

    def _read(self, live: DataFrame, directory: DataFrame, packed: DataFrame, k: int) -> DataFrame:
        """The best ``k`` rows of each request in each page, of those between ``done`` and ``reach``."""
        dim = self.dim
        hull = live.select("batch", "reach", F.posexplode("d").alias("pivot", "at")).groupBy("batch", "pivot").agg(F.min(F.col("at") - F.col("reach")).alias("from"), F.max(F.col("at") + F.col("reach")).alias("to"))
        # Batches are dealt to slices, so that a group stays bounded however many batches meet a page.
        dealt = F.pmod(F.xxhash64("batch"), F.lit(self.slices)).alias("slice")
        units = hull.join(directory, "pivot").where("high >= from AND low <= to").select("batch", "page", dealt)
        asked = live.groupBy("batch").agg(F.collect_list(F.struct("rid", "pos", "same", "floor", "high", "done", "reach", "d")).alias("asked"))
        many = asked.join(packed, "batch")
        left = units.select("page", "slice").distinct().join(self.pages, "page")
        right = units.toDF("batch", "of_page", "of_slice").join(many, "batch")

        def met(key: tuple, pages: pa.Table, batches: pa.Table) -> pa.Table:
            out = []
            for p in pages.to_pylist():
                keys, ids, labels = np.frombuffer(p["keys"]), np.frombuffer(p["ids"], np.int64), np.frombuffer(p["labels"], np.int64)
                x = np.frombuffer(p["x"], np.int32 if p["narrow"] else np.float64).reshape(-1, dim)
                for i in range(batches.num_rows):
                    b = batches.slice(i, 1)
                    asked = pa.Table.from_pylist(b["asked"][0].as_py())
                    q = b["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    out.append(_scored(asked, q, np.array(b["ids"][0].as_py()), np.array(b["labels"][0].as_py()), p["pivot"], keys, ids, labels, x, k))
            schema = pa.schema([("rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
            return pa.concat_tables(out) if out else schema.empty_table()

        return left.groupBy("page", "slice").cogroup(right.groupBy("of_page", "of_slice")).applyInArrow(met, "rid long, vec_id long, score double")


def _scored(asked: pa.Table, q: np.ndarray, own: np.ndarray, own_label: np.ndarray, pivot: int, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int) -> pa.Table:
    column = {n: asked[n].to_numpy() for n in ("rid", "pos", "same", "floor", "done", "reach")}
    high = asked["high"].fill_null(float("inf")).to_numpy() if pa.types.is_floating(asked["high"].type) else np.full(asked.num_rows, np.inf)
    at = np.array([d[pivot] for d in asked["d"].to_pylist()])
    pos, floor, done, reach = column["pos"], column["floor"].copy(), column["done"], column["reach"]
    same = column["same"].astype(bool)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(keys), CHUNK):
        z = slice(a, a + CHUNK)
        asks = np.flatnonzero((at - reach <= keys[z][-1]) & (at + reach >= keys[z][0]))
        if not len(asks):
            continue
        away = np.abs(at[asks, None] - keys[None, z])
        score = (q @ x[z].T.astype(np.float64))[pos[asks]]
        fits = (away <= reach[asks, None]) & (away > done[asks, None])
        fits &= (labels[None, z] == own_label[pos[asks], None]) == same[asks, None]
        fits &= (ids[None, z] != own[pos[asks], None]) | ~same[asks, None]
        fits &= (score <= high[asks, None]) & (score >= floor[asks, None])
        score = np.where(fits, score, -np.inf)
        if score.shape[1] > k:
            # The k-th best of this chunk bounds what later chunks need to give; equal scores stay, as ids decide.
            floor[asks] = np.maximum(floor[asks], np.partition(score, -k, axis=1)[:, -k])
        r, c = np.nonzero(fits & (score >= floor[asks, None]))
        got.append((asks[r], ids[z][c], score[r, c]))
    if got:
        r, v, s = (np.concatenate(part) for part in zip(*got, strict=True))
        order = np.lexsort((v, -s, r))
        r, v, s = r[order], v[order], s[order]
        begin = np.searchsorted(r, r)
        best = np.arange(len(r)) - begin < k
        r, v, s = r[best], v[best], s[best]
    else:
        r, v, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return pa.table({"rid": pa.array(column["rid"][r], pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3) -> DataFrame:
    """For each anchor and each of its best rows of the same label: the best rows of other labels that score 50 to 95 % of it."""
    spark: SparkSession = rows.sparkSession
    rows = stored(rows, "vectors")
    if rows.isEmpty():
        return spark.createDataFrame([], RESULT)
    index = Index(rows)
    flat, packed = index.anchors(anchors)
    asked = flat.select(F.col("anchor").alias("rid"), "batch", "pos", "norm2", "d", F.lit(True).alias("same"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    best = index.search(asked, packed, positives).select(F.col("rid").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "nth")
    best = best.join(flat.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    best = stored(best.withColumn("rid", F.col("anchor") * (positives + 1) + F.col("nth")).drop("nth"), "positives")
    # A score of a negative is whole; below zero the range is empty.
    ranges = best.where("positive_score >= 0 AND try_cast(positive_score AS BIGINT) IS NOT NULL").join(flat.select("anchor", "batch", "pos", "norm2", "d"), "anchor")
    ranges = ranges.select("rid", "batch", "pos", "norm2", "d", F.lit(False).alias("same"), F.ceil(F.col("positive_score") / 2).cast("double").alias("low"), F.floor((95 * F.col("positive_score").cast("long")).cast("decimal(28,0)") / 100).cast("double").alias("high"))
    hard = index.search(ranges, packed, negatives)
    out = hard.join(best, "rid")
    return out.select("anchor_id", "positive_id", hard["nth"].cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("positive_score").try_cast("long").alias("positive_score"), F.col("score").try_cast("long").alias("negative_score"))


def mined(embeddings: DataFrame, every: int = 50) -> DataFrame:
    rows = participants(embeddings)
    return hard_negatives(rows, rows.where(F.col("vec_id") % every == 0))

"""Repeated byte strings by a logarithmic family of sampled suffix arrays.

Every window of ``length`` bytes has an anchor: of the grams of ``length - reach + 1`` bytes that start in
its first ``reach`` places, the one of least hash, the leftmost of equals. Equal windows have their
anchor at the same offset, so it's enough to sort the suffixes that start at anchors (about one
place in ``reach / 2``). A suffix array holds them in the order of a 64-bit fingerprint of their first
gram, as only equal beginnings matter here; all suffixes in the order of their bytes would be 65 times as many.

1. A new batch gets its array (``Family.add``), is scanned against every level that exists, by
   merging sorted buckets, and gives the grams that start in two places. Levels of equal size
   merge, so a batch is rewritten log2 times.
2. The windows of one anchor lie next to each other: its stretch of text. Stretches with equal
   text (128 bits) are repeats as a whole. An anchor whose gram is shared but whose stretch isn't
   lies at the edge of a repeat: its stretch meets one of each other kind with the same gram, and
   their windows are compared one by one.
3. A gram with more than ``HOT`` kinds of stretches isn't compared in one task: the fingerprints
   of its windows are counted by a shuffle.

Nothing is sampled away: the anchors are a function of the text, and every window has one. Two
different windows are taken for one with a chance of 2^-128 a pair.

A null text is empty. A text shorter than ``length`` has no windows. Rows that repeat are documents of
their own, so all their windows repeat; a null doc_id is a document like others. Further columns are
ignored. An empty table gives no rows. Texts of any length are read in slabs, never whole in the arrays of a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import discard, frugal, shared_dir, stored
from popspark.llm.wordarrays import U64, mixed

LENGTH = 200
#: Batches that the query deals the documents to.
BATCHES = 4
#: Window starts that a task looks at together, stretches that it compares together, kinds of stretches that make a gram hot.
SLAB, GROUP, HOT = 1 << 18, 4096, 8192

ANCHOR = "doc_id long, text_hash long, x int, lo short, hi short, core long, o1 long, o2 long"
SPAN = "doc_id long, text_hash long, begin int, end int"


def reach_of(length: int) -> int:
    """Places that an anchor may have in a window: a power of two, about two thirds of it."""
    return 1 << max(0, (length * 7 // 10).bit_length() - 1)


class Prints:
    """Fingerprints of stretches of one byte array, from running sums of powers modulo 2^64."""

    BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

    def __init__(self, data: np.ndarray):
        self.sums = []
        for power, table in zip(_powers(_size(len(data)))[0], _tables(), strict=True):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * power[: len(data)], out=sums[1:])
            self.sums.append(sums)
        self.inverse = _powers(_size(len(data)))[1]

    def of(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return mixed((s[end] - s[begin]) * self.inverse[which][begin] + (end - begin).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        s = self.sums[0]
        n = len(s) - size
        return mixed((s[size:] - s[:n]) * self.inverse[0][:n] + U64(size))


def _size(n: int) -> int:
    return 1 << max(12, int(n).bit_length())


@cache
def _powers(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    def powers(r: int) -> np.ndarray:
        out = np.full(n, r, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return [powers(r) for r in Prints.BASES], [powers(pow(r, -1, 1 << 64)) for r in Prints.BASES]


@cache
def _tables() -> list[np.ndarray]:
    return [mixed(np.arange(1, 257, dtype=np.uint64) * U64(k)) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each row begins (and the last ends)."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and len(column) else np.empty(0, np.uint8)), at


def anchors_in(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, x, lo, hi, core, o1, o2) of the anchors of every row's windows: a window that starts at x - d, lo <= d <= hi, has x as its anchor."""
    reach = reach_of(length)
    gram, mask = length - reach + 1, U64((1 << (SLAB + length).bit_length()) - 1)
    for p0 in range(int(at[0]), int(at[-1]), SLAB):
        part = data[p0 : min(p0 + SLAB + length - 1, int(at[-1]))]
        n = len(part) - length + 1
        if n <= 0:
            continue
        prints = Prints(part)
        grams = prints.grams(gram)
        least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while step < reach:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        valid = np.ones(n, bool)
        for e in at[np.searchsorted(at, p0, "right") : np.searchsorted(at, p0 + len(part), "right")] - p0:
            valid[max(0, e - length + 1) : e] = False
        window = np.flatnonzero(valid)
        if not len(window):
            continue
        owner = (least[window] & mask).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        first, last, x = window[new], window[np.append(new[1:] - 1, len(window) - 1)], owner[new]
        row = np.searchsorted(at, p0 + x, "right") - 1
        yield row, p0 + x - at[row], x - last, x - first, grams[x], prints.of(first, last + length, 0), prints.of(first, last + length, 1)


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("bytes"))


def anchors(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = _bytes(b.column("bytes"))
            for row, x, lo, hi, core, o1, o2 in anchors_in(data, at, length):
                own = b.select(["doc_id", "text_hash"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(x.astype(np.int32)), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16)), *(pa.array(v.view(np.int64)) for v in (core, o1, o2))], names=["doc_id", "text_hash", "x", "lo", "hi", "core", "o1", "o2"])

    return documents.mapInArrow(frugal(run), ANCHOR)


class Family:
    """Levels of suffix arrays: a binary counter of batches. ``shared`` collects the grams that start in two places."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str, str]] = []  # batches, table, path
        self.shared: list[DataFrame] = []

    def _written(self, array: DataFrame) -> tuple[str, str]:
        """The array as sorted buckets, so that scans and merges of arrays need no shuffle."""
        name = f"suffixes_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        array.write.bucketBy(self.buckets, "core").sortBy("core").option("path", path).saveAsTable(name)
        return name, path

    def _dropped(self, name: str, path: str) -> None:
        gone = self.spark.table(name)
        gone._stored_at = path
        discard(gone)
        self.spark.sql(f"DROP TABLE {name}")

    def add(self, grams: DataFrame) -> None:
        """A batch of anchors: its array is scanned against all levels, then takes its place among them."""
        name, path = self._written(grams.groupBy("core").agg((F.count("*") > 1).alias("twice")))
        new = self.spark.table(name)
        found = new.where("twice").select("core")
        for _, level, _ in self.levels:
            found = found.unionByName(new.join(self.spark.table(level).select("core"), "core", "left_semi").select("core"))
        self.shared.append(stored(found, "shared"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            old_size, old, old_path = self.levels.pop()
            merged, merged_path = self._written(self.spark.table(old).select("core").join(self.spark.table(name).select("core"), "core", "full"))
            self._dropped(old, old_path)
            self._dropped(name, path)
            name, path, size = merged, merged_path, size + old_size
        self.levels.append((size, name, path))

    def twice(self) -> DataFrame:
        """core: every gram that starts in two places of what was added."""
        out = self.shared[0]
        for more in self.shared[1:]:
            out = out.unionByName(more)
        return out.distinct()

    def close(self) -> None:
        for _, name, path in self.levels:
            self._dropped(name, path)
        for part in self.shared:
            discard(part)
        self.levels, self.shared = [], []


def _stretches(documents: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """members with the text of their stretch."""
    own = members.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("x", "lo", "hi", "core", "single", "hot")).alias("own"))
    own = own.toDF("own_id", "own_hash", "own")
    both = documents.join(own, documents["doc_id"].eqNullSafe(own["own_id"]) & (documents["text_hash"] == own["own_hash"])).select("doc_id", "text_hash", "bytes", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = _bytes(b.column("bytes"))
            own = b.column("own")
            flat, size = own.flatten(), np.diff(own.offsets.to_numpy())
            row = np.repeat(np.arange(len(own)), size)
            x, lo, hi = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            begin, end = at[row] + x - hi, at[row] + x - lo + length
            for a in range(0, len(row), GROUP):
                z = slice(a, a + GROUP)
                text = pa.array([data[s:e].tobytes() for s, e in zip(begin[z].tolist(), end[z].tolist(), strict=True)], pa.binary())
                keys = b.select(["doc_id", "text_hash"]).take(pa.array(row[z]))
                yield pa.RecordBatch.from_arrays([*keys.columns, *(flat.field(k).slice(a, GROUP) for k in range(6)), text], names=["doc_id", "text_hash", "x", "lo", "hi", "core", "single", "hot", "stretch"])

    return both.mapInArrow(frugal(run), "doc_id long, text_hash long, x int, lo short, hi short, core long, single boolean, hot boolean, stretch binary")


def _windows(stretches: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, number of the window in it, two fingerprints) of every window."""
    data, at = _bytes(stretches)
    data, at = data[at[0] : at[-1]], at - at[0]
    n = np.diff(at) - length + 1
    which = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    begin = at[which] + nth
    prints = Prints(data)
    return which, nth, prints.of(begin, begin + length, 0), prints.of(begin, begin + length, 1)


def _compared(table: pa.Table, length: int) -> pa.RecordBatch:
    """Spans of the windows in single stretches that another stretch of ``table`` has too."""
    table = table.combine_chunks()
    which, nth, w1, w2 = _windows(table["stretch"].combine_chunks(), length)
    order = np.argsort(w1, kind="stable")
    a, b = w1[order], w2[order]
    equal = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1]), [False]])
    twice = np.zeros(len(which) + 1, bool)
    twice[order] = equal[:-1] | equal[1:]
    twice[:-1] &= table["single"].to_numpy()[which]
    # Runs of such windows within one stretch.
    hit = np.flatnonzero(twice[:-1])
    if not len(hit):
        hit = np.empty(0, np.int64)
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (which[hit[1:]] != which[hit[:-1]])
    first = hit[new]
    last = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] if len(hit) else first
    own = which[first]
    base = table["x"].to_numpy().astype(np.int64)[own] - table["hi"].to_numpy().astype(np.int64)[own]
    keys = table.select(["doc_id", "text_hash"]).take(pa.array(own)).combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in keys.columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array((base + nth[first]).astype(np.int32)), pa.array((base + nth[last] + length).astype(np.int32))], names=["doc_id", "text_hash", "begin", "end"])


def _edges(stretches: DataFrame, length: int) -> DataFrame:
    """Spans in single stretches of grams that aren't hot: a gram's stretches meet in one task, at most ``HOT`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < GROUP:
                continue
            table = pa.Table.from_batches(held)
            core = table["core"].to_numpy()
            cut = int(np.searchsorted(core, core[-1]))
            if cut:
                yield _compared(table.slice(0, cut), length)
            held, rows = table.slice(cut).to_batches(), rows - cut
        if rows:
            yield _compared(pa.Table.from_batches(held), length)

    dealt = stretches.where("NOT hot").select("doc_id", "text_hash", "x", "hi", "core", "single", "stretch").repartition("core").sortWithinPartitions("core")
    return dealt.mapInArrow(frugal(run), SPAN)


def _hot_edges(stretches: DataFrame, length: int) -> DataFrame:
    """The same of hot grams: windows counted by their fingerprints, wherever they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                which, nth, w1, w2 = _windows(part.column("stretch"), length)
                begin = (part.column("x").to_numpy().astype(np.int64) - part.column("hi").to_numpy())[which] + nth
                keys = part.select(["doc_id", "text_hash", "single"]).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(begin.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], names=["doc_id", "text_hash", "single", "begin", "w1", "w2"])

    windows = stretches.where("hot").select("doc_id", "text_hash", "x", "hi", "single", "stretch").mapInArrow(frugal(run), "doc_id long, text_hash long, single boolean, begin int, w1 long, w2 long")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.count_if("single").alias("singles")).where("n > 1 AND singles > 0").select("w1", "w2")
    return windows.where("single").join(twice, ["w1", "w2"], "left_semi").select("doc_id", "text_hash", "begin", (F.col("begin") + length).alias("end"))


def repeated_spans(documents: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """doc_id, text_hash, begin, end: stretches of bytes, possibly overlapping, that strings of ``length`` bytes found twice cover."""
    spark = documents.sparkSession
    found = stored(anchors(documents, length), "anchors")
    family = Family(spark)
    for b in range(batches):
        family.add(found.where(F.pmod("text_hash", F.lit(batches)) == b))
    # Stored first: with a plain table on the other side Spark can split a gram that has many anchors.
    twice = stored(family.twice(), "twice")
    family.close()
    held = stored(found.join(twice, "core", "left_semi"), "held")
    discard(found)
    discard(twice)
    kinds = stored(held.groupBy("core", "o1", "o2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "x", "lo", "hi")).alias("one")), "kinds")
    whole = held.join(kinds.where("n > 1").select("core", "o1", "o2"), ["core", "o1", "o2"], "left_semi").select("doc_id", "text_hash", (F.col("x") - F.col("hi")).alias("begin"), (F.col("x") - F.col("lo") + length).alias("end"))
    edge = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles")).where("kinds > 1 AND singles > 0").select("core", (F.col("kinds") > HOT).alias("hot"))
    members = kinds.join(edge, "core").select("one.*", "core", (F.col("n") == 1).alias("single"), "hot")
    stretches = stored(_stretches(documents, members, length), "stretches")
    spans = stored(whole.unionByName(_edges(stretches, length)).unionByName(_hot_edges(stretches, length)), "spans")
    for done in (held, kinds, stretches):
        discard(done)
    return spans


def without_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): every document without the bytes that repeated strings cover."""
    documents = _documents(docs)
    spans = repeated_spans(documents, length, batches).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    spans = spans.toDF("own_id", "own_hash", "spans")
    both = documents.join(spans, documents["doc_id"].eqNullSafe(spans["own_id"]) & (documents["text_hash"] == spans["own_hash"]), "left").select("doc_id", "bytes", F.col("spans.begin").alias("begin"), F.col("spans.end").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, runs, kept = [], [], []
            for text, begin, end in zip(b.column("bytes"), b.column("begin"), b.column("end"), strict=True):
                whole = text.as_buffer()
                if not begin.is_valid:
                    removed.append(0)
                    runs.append(0)
                    kept.append(whole.to_pybytes())
                    continue
                lo, hi = begin.values.to_numpy(), np.maximum.accumulate(end.values.to_numpy())
                new = np.concatenate([[True], lo[1:] > hi[:-1]])
                lo, hi = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]
                removed.append(int((hi - lo).sum()))
                runs.append(len(lo))
                stays = zip([0, *hi.tolist()], [*lo.tolist(), whole.size], strict=True)
                view = memoryview(whole)
                kept.append(b"".join(view[s:e] for s, e in stays))
            n = [x.as_buffer().size for x in b.column("bytes")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(frugal(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    out = without_repeats(docs, length, batches)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Exact Jaccard join of word shingle sets by an inverted index with set-relation skipping.

Sets: distinct shingles of ``SHINGLE`` words (A-Z lower-cased; words are runs of
``[^\\x20\\x09-\\x0D]``), as 64-bit hashes. Texts that are equal share one set from the start.

Index: shingles have one order everywhere, frequent ones last. Two sets can only reach
the threshold if they share a shingle among the first n - ceil(t n) + 1 of each, so
only those are posted, with their place in the set. Lists of one entry are dropped.
List entries are skipped by size, and by position: a shared shingle at places i and j
leaves at most 1 + min(n - i, m - j) - 1 more to share. What passes is held against
parities of both sets that the entries carry; only pairs left by these leave their task.

Set relations: in each list the members are first held against the list's leader, the
set that shares most with others. A set that is highly similar to its leader takes over
the leader's links: it is in the leader's component without any pair inside that
component being computed, so a list whose sets all belong together is skipped whole,
and a group of thousands of copies costs thousands of comparisons, not millions. What
is left are pairs across components. Sets held against one leader R are its family; their
answers bound each other's, |s & x| <= min(|s & R|, |x & R|) + min(|s - R|, |x - R|), and a
parity sketch bounds the overlap from above; only pairs that pass both, of sets that no link
has joined yet, are compared, exactly, on whole sets. Pairs of different families meet in the lists.

Every pair that reaches the threshold therefore is either found or joins two sets
already in one component. Rows: a row per document; rows that repeat a text are
linked (equal sets); null or empty texts have an empty set and are linked with
nothing. doc_id may repeat or be null: links are between texts, and a component's id
is the smallest doc_id that is not null. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import bounded, discard, frugal, shared_dir, stored, text_key, text_or_empty
from popspark.llm.graph import components

#: Shingles known to be frequent: at most so many are broadcast (8 bytes each), each in at least HOT_SETS sets.
HOT_SHINGLES = 1 << 20
HOT_SETS = 24
#: Ids that a broadcast may hold, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rounds of leaders; the pairs left over are all compared, so this is a matter of speed only.
ROUNDS = 2
#: Sets of a family that a task compares with as many others.
FAMILY_BLOCK = 2000
#: Bytes of shingles of a family that a task compares with as many others.
FAMILY_BYTES = 32 << 20

#: Bytes of texts that are hashed at a time (about); longer words are hashed one by one.
PIECE, LONG = 1 << 20, 64
#: Entries of a list that a task compares with as many others, and pairs that it holds.
LIST_BLOCK, PAIRS = 2000, 1 << 19
#: Bytes of the parities that a list's entry carries.
BRIEF = 64

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: The first k of eight bytes.
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` begin, and their hashes, eight bytes at a time over all words."""
    n = len(data)
    low = np.full(n + 8, 32, np.uint8)
    low[:n] = LOWER[np.frombuffer(data, np.uint8)]
    space = SPACE[low]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((n + 1,), "<u8", low, 0, (1,))
    h = mixed((eight[start] & HEAD[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * M3))
    k, more = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(more):
        h[more] = mixed(h[more] * M2 + (eight[start[more] + k] & HEAD[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(low[start[i] : start[i] + size[i]].tobytes())
    return start, h


def joined(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words."""
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * (M1, M2, M3)[i % 3] + h[i : len(h) - k + 1 + i]
    return mixed(out)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text; texts are hashed about ``PIECE`` bytes at a time."""
    held = texts.fill_null("").cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(held).to_numpy())
    at = 0
    while at < len(held):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        # A blank parts the texts.
        start, h = hashed_words(b" ".join(held.slice(at, to - at).to_pylist()))
        first = np.searchsorted(start, np.concatenate([[0], ends[at:to] - before + np.arange(1, to - at + 1)]))
        runs = joined(h, size) if len(h) >= size else None
        for a, b in itertools.pairwise(first.tolist()):
            own = runs[a : b - size + 1] if b - a >= size else joined(h[a:b], b - a) if b > a else h[:0]
            own.sort()
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        at = to


def shingles(text: str | None, size: int) -> np.ndarray:
    """The ascending distinct shingle hashes of a text."""
    return next(shingle_sets(pa.array([text], pa.string()), size))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def sketch(hashes: np.ndarray) -> bytes:
    """Parity of the shingles per bit: the bits in which two sketches differ number at most the shingles in which the sets do.

    The number of bits is a power of two about the size of the set; a longer sketch folds to a shorter one by exclusive or.
    """
    bits = 64 if len(hashes) == 0 else max(64, 1 << int(len(hashes) - 1).bit_length())
    return parities(hashes, bits)


def parities(hashes: np.ndarray, bits: int) -> bytes:
    at = ((hashes * M2) >> np.uint64(17)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ after folding to the shorter one's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def distinct_texts(docs: DataFrame) -> DataFrame:
    """sid, key, first_id, text: one row per text, numbered once and written."""
    rows = docs.select("doc_id", text_key().alias("key"), text_or_empty().alias("text"))
    one = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("text").alias("text"))
    return stored(one.withColumn("sid", F.monotonically_increasing_id()), "texts")


def _dealt(values: dict[str, np.ndarray], bucket: np.ndarray, n: int) -> Iterator[tuple[int, dict[str, bytes]]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    sorted_values = {k: v[order] for k, v in values.items()}
    for b in range(n):
        if cut[b] < cut[b + 1]:
            yield b, {k: v[cut[b] : cut[b + 1]].tobytes() for k, v in sorted_values.items()}


def _sizes_and_counts(texts: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """Rows of two kinds: sid, n, sketch, brief (parities) of each text; bucket, shingles, counts of the shingles that could be posted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sid", "n", "sketch", "brief", "bucket", "shingles", "counts"]
        for b in batches:
            sizes, sketches, briefs, low = [], [], [], [np.empty(0, np.uint64)]
            for h in shingle_sets(b.column(1), size):
                sizes.append(len(h))
                sketches.append(sketch(h))
                briefs.append(parities(h, 8 * BRIEF))
                low.append(h[: 2 * prefix_length(len(h), percent)] >> np.uint64(16))
            k = b.num_rows
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(briefs, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=names)
            values, counts = np.unique(np.concatenate(low), return_counts=True)
            rows = list(_dealt({"v": values, "c": counts.astype(np.uint32)}, (values % np.uint64(buckets)).astype(np.int32), buckets))
            k = len(rows)
            yield pa.record_batch(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1]["v"] for r in rows], pa.binary()), pa.array([r[1]["c"] for r in rows], pa.binary())],
                names=names,
            )

    return texts.select("sid", "text").mapInArrow(frugal(run), "sid bigint, n bigint, sketch binary, brief binary, bucket int, shingles binary, counts binary")


def _frequent(counted: DataFrame) -> np.ndarray:
    """The most frequent shingles (48 bits), rarest first; HOT_SHINGLES at most, so they fit in a broadcast."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate([np.frombuffer(x, np.uint64) for x in part["shingles"]])
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in part["counts"]])
        values, at = np.unique(v, return_inverse=True)
        total = np.bincount(at, weights=c, minlength=len(values)).astype(np.int64)
        keep = total >= HOT_SETS
        return pd.DataFrame({"shingle": values[keep].view(np.int64), "n": total[keep]})

    hot = counted.where("bucket IS NOT NULL").select("bucket", "shingles", "counts").groupBy("bucket").applyInPandas(run, "shingle bigint, n bigint")
    top = hot.orderBy(F.desc("n"), "shingle").limit(HOT_SHINGLES).toPandas()
    return top["shingle"].to_numpy(np.int64).view(np.uint64)[::-1].copy() if len(top) else np.empty(0, np.uint64)


def ordered(h: np.ndarray, hot_sorted: np.ndarray, hot_rank: np.ndarray) -> np.ndarray:
    """A set's shingles in the index order: by hash, but frequent ones behind all others, by frequency."""
    if not len(hot_sorted) or not len(h):
        return h
    short = h >> np.uint64(16)
    at = np.minimum(np.searchsorted(hot_sorted, short), len(hot_sorted) - 1)
    rank = np.where(hot_sorted[at] == short, hot_rank[at] + 1, 0)
    return h[np.argsort(rank, kind="stable")]


def index_lists(texts: DataFrame, hot: np.ndarray, size: int, percent: int, buckets: int) -> DataFrame:
    """token, sid, n, pos, len: the index's lists that have two entries or more."""
    spark = texts.sparkSession
    by_value = np.argsort(hot)
    shipped = spark.sparkContext.broadcast((hot[by_value], by_value.astype(np.int64)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_sorted, hot_rank = shipped.value
        for b in batches:
            token, sid, n, pos = ([np.empty(0, kind)] for kind in (np.uint64, np.int64, np.uint32, np.uint32))
            for s, h in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), size), strict=True):
                p = prefix_length(len(h), percent) if len(h) else 0
                token.append(ordered(h, hot_sorted, hot_rank)[:p])
                sid.append(np.full(p, s, np.int64))
                n.append(np.full(p, len(h), np.uint32))
                pos.append(np.arange(p, dtype=np.uint32))
            tokens = np.concatenate(token)
            bucket = (mixed(tokens) % np.uint64(buckets)).astype(np.int32)
            rows = list(_dealt({"t": tokens, "s": np.concatenate(sid), "n": np.concatenate(n), "p": np.concatenate(pos)}, bucket, buckets))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[1][c] for r in rows], pa.binary()) for c in "tsnp")], names=["bucket", "t", "s", "n", "p"])

    def lists(part: pd.DataFrame) -> pd.DataFrame:
        t, s, n, p = (np.concatenate([np.frombuffer(x, kind) for x in part[c]]) for c, kind in (("t", np.uint64), ("s", np.int64), ("n", np.uint32), ("p", np.uint32)))
        _, at, count = np.unique(t, return_inverse=True, return_counts=True)
        keep = count[at] > 1
        return pd.DataFrame({"token": t[keep].view(np.int64), "sid": s[keep], "n": n[keep].astype(np.int64), "pos": p[keep].astype(np.int64), "len": count[at][keep]})

    posted = texts.select("sid", "text").mapInArrow(frugal(post), "bucket int, t binary, s binary, n binary, p binary")
    return stored(posted.groupBy("bucket").applyInPandas(lists, "token bigint, sid bigint, n bigint, pos bigint, len bigint"), "lists")


def sets_of(need: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """sid, set (ascending shingle hashes) of the texts in ``need`` (sid)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([h.tobytes() for h in shingle_sets(b.column(1), size)], pa.binary())], names=["sid", "set"])

    return texts.join(bounded(need, BROADCAST_IDS), "sid", "left_semi").select("sid", "text").mapInArrow(frugal(make), "sid bigint, set binary")


def overlaps(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """a, b, na, nb, common: exact overlaps of the sets of distinct pairs (a, b), written."""
    need = stored(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct(), "need")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb, common = [], [], []
            for x, y in zip(b.column(2), b.column(3)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                na.append(len(u))
                nb.append(len(v))
                common.append(len(np.intersect1d(u, v, assume_unique=True)))
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (na, nb, common))], names=["a", "b", "na", "nb", "common"])

    sets = stored(sets_of(need, texts, size), "sets")
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("set").alias("sb")), "b")
    out = stored(both.select("a", "b", "sa", "sb").mapInArrow(frugal(meet), "a bigint, b bigint, na bigint, nb bigint, common bigint"), "overlaps")
    discard(sets)
    return out


def _linked(percent: int):
    return 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))


def _sketch_bound(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([apart(x, y) for x, y in zip(a, b)], dtype="int64")


def component_labels(docs: DataFrame, size: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(texts, labels): the distinct texts (sid, key, first_id, text) and sid, n, label (a sid; equal for linked sets)."""
    spark = docs.sparkSession
    shared_dir(spark)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = distinct_texts(docs)
    counted = stored(_sizes_and_counts(texts, size, percent, buckets), "counts")
    sizes = stored(counted.where("sid IS NOT NULL").select("sid", "n", "sketch", "brief"), "sizes")
    hot = _frequent(counted)
    discard(counted)
    lists = index_lists(texts, hot, size, percent, buckets)
    score = lists.groupBy("sid").agg(F.sum("len").alias("score"))
    labels = seen = None
    fits = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    left = stored(lists.join(score, "sid").withColumn("label", F.col("sid")), "entries")
    discard(lists)
    for r in range(ROUNDS):
        # The first leader of a list is the set that shares most; later rounds try others of the same lists.
        rank = F.struct("score", "sid") if r == 0 else F.struct(F.xxhash64("sid", F.lit(r)).alias("score"), "sid")
        leaders = left.groupBy("token").agg(F.max(F.struct(rank.alias("k"), F.col("sid").alias("lead"), F.col("n").alias("n2"), F.col("label").alias("label2"))).alias("m"))
        met = left.join(leaders.select("token", F.col("m.lead").alias("lead"), F.col("m.n2").alias("n2"), F.col("m.label2").alias("label2"), F.col("m.k").alias("k")), "token")
        near = met.where((F.col("label") != F.col("label2")) & fits).groupBy("sid", "lead").agg(F.count("*").alias("shared"))
        # A set is held against the leader that it shares most listed shingles with.
        best = near.groupBy("sid").agg(F.max(F.struct("shared", "lead")).alias("m")).select(F.col("sid").alias("a"), F.col("m.lead").alias("b"))
        found = overlaps(stored(best, "leaders"), texts, size)
        seen = found if seen is None else seen.unionByName(found)
        new = found.where(_linked(percent)).select("a", "b")
        # Earlier links come in as the stars that they were reduced to.
        links = new if labels is None else labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(new)
        labels = stored(components(links), "labels")
        entries = left.drop("label").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        mixed_lists = entries.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
        past, left = left, stored(entries.join(mixed_lists, "token", "left_semi"), "entries")
        discard(past)
        if new.isEmpty():
            break
    # What is left are pairs across components. Sets that were held against one leader are compared as its family ...
    told = stored(seen, "seen")
    lead = told.groupBy("a").agg(F.max(F.struct("common", "b")).alias("m")).select(F.col("a").alias("sid"), F.col("m.b").alias("family"), F.col("m.common").alias("common"))
    open_sets = left.select("sid", "n", "label").distinct().join(lead, "sid", "left")
    members = open_sets.where("family IS NOT NULL").join(sizes.select("sid", "sketch"), "sid")
    members = stored(members.join(sets_of(stored(members.select("sid"), "need"), texts, size), "sid"), "open")
    close = stored(family_links(members, percent), "close")
    discard(members)
    # ... and all others wherever they meet in a list, if size and position allow.
    listed = left.join(lead.select("sid", "family"), "sid", "left").join(sizes.select("sid", "brief"), "sid")
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("n2")) / (100 + percent))
    across = across_families(stored(listed, "open-lists"), percent)
    pairs = across.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("n2").alias("n2"))
    pairs = stored(pairs, "across")
    side = lambda c: sizes.select(F.col("sid").alias(c), F.col("sketch").alias(f"s{c}"))
    differ = F.pandas_udf(_sketch_bound, "bigint")
    passed = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("apart", differ("sa", "sb"))
    passed = passed.where(F.col("n") + F.col("n2") - F.col("apart") >= 2 * need).select("a", "b")
    answered = told.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    passed = passed.join(answered, ["a", "b"], "left_anti")
    last = overlaps(stored(passed, "passed"), texts, size)
    before = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = stored(components(before.unionByName(close).unionByName(last.where(_linked(percent)).select("a", "b"))), "labels")
    every = sizes.select("sid", "n").join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    return texts, every.select("sid", "n", F.coalesce("label", "sid").alias("label"))


def across_families(listed: DataFrame, percent: int) -> DataFrame:
    """a < b, n, n2: pairs of a list that size, position and parities let reach the threshold, of two labels and not of one family.

    ``listed`` has token, sid, n, pos, label, family (may be null), brief. Long lists are cut into blocks, and a group takes two;
    the lists of a partition come sorted, so a task reads them one behind the other.
    """
    size = listed.groupBy("token").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("k"))
    rows = listed.join(size, "token").withColumn("own", F.pmod(F.xxhash64("sid", F.lit(5)), F.col("k")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    names = ["token", "i", "j", "own", "sid", "n", "pos", "label", "family", "brief"]
    rows = rows.select("token", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), *names[3:])
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        token, i, j, own, sid, n, pos, label = (t[c].to_numpy().astype(np.int64) for c in names[:8])
        family = t["family"].fill_null(-1).to_numpy()
        brief = np.frombuffer(b"".join(t["brief"].to_pylist()), np.uint64).reshape(len(sid), -1)
        change = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        cut = np.concatenate([[0], change, [len(sid)]])
        after = np.repeat(cut[1:], np.diff(cut)) - np.arange(len(sid)) - 1
        total = np.concatenate([[0], np.cumsum(after)])
        at = 0
        while at < len(sid):
            to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
            x = np.repeat(np.arange(at, to), after[at:to])
            y = x + 1 + np.arange(len(x)) - (total[x] - total[at])
            at = to
            ok = (label[x] != label[y]) & ((family[x] != family[y]) | (family[x] < 0)) & ((i[x] == j[x]) | (own[x] != own[y]))
            x, y = x[ok], y[ok]
            least = -(-percent * (n[x] + n[y]) // (100 + percent))
            ok = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= least)
            x, y, least = x[ok], y[ok], least[ok]
            apart = np.bitwise_count(brief[x] ^ brief[y]).sum(axis=1, dtype=np.int64)
            ok = (n[x] + n[y] - apart >= 2 * least) & (sid[x] != sid[y])
            x, y = x[ok], y[ok]
            a, b = np.where(sid[x] < sid[y], x, y), np.where(sid[x] < sid[y], y, x)
            # A pair meets in many lists.
            _, first = np.unique(np.stack([sid[a], sid[b]]), axis=1, return_index=True) if len(a) else (None, np.zeros(0, np.int64))
            a, b = a[first], b[first]
            yield pa.record_batch([pa.array(v) for v in (sid[a], sid[b], n[a], n[b])], names=["a", "b", "n", "n2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            key = np.stack([t[c].to_numpy() for c in names[:3]])
            # The last group may go on in the next batch.
            last = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from pairs(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from pairs(held)

    sorted_rows = rows.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return sorted_rows.mapInArrow(frugal(run), "a bigint, b bigint, n bigint, n2 bigint")


def family_links(members: DataFrame, percent: int) -> DataFrame:
    """a < b: links between sets of one family, as many as join all that belong together.

    ``members`` has family (the leader's sid), sid, n, label, common (shingles shared with the leader), sketch, set.
    Of the shingles of s at most n - common lie outside the leader, and of those inside at
    most the smaller common are in the other set: pairs that this or the sketches keep apart
    need no comparison, and neither do sets that links found so far have joined, so a family
    whose sets mostly reach each other costs about a comparison a set. Large families are cut into
    blocks, and a task takes two blocks: FAMILY_BLOCK sets and FAMILY_BYTES of shingles each.
    """
    parts = F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(8 * F.sum("n") / FAMILY_BYTES)).cast("int")
    size = members.groupBy("family").agg(parts.alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    rows = members.join(size.select("family", "k"), "family").withColumn("own", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("k")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("family", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "sid", "n", "label", "common", "sketch", "set")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        cross = int(part["i"].iloc[0]) != int(part["j"].iloc[0])
        part = part.sort_values("sid")
        sid, n, label, common, own = (part[c].to_numpy(np.int64).copy() for c in ("sid", "n", "label", "common", "own"))
        bits = min(map(len, part["sketch"]))
        folded = []
        for x in part["sketch"]:
            v = np.frombuffer(x, np.uint8)
            while len(v) > bits:
                v = v[: len(v) // 2] ^ v[len(v) // 2 :]
            folded.append(v)
        sketches = np.stack(folded)
        sketches = sketches.view(np.uint64) if bits % 8 == 0 else sketches
        sets = [np.frombuffer(x, np.uint64) for x in part["set"]]
        out: list[tuple[int, int]] = []
        for k in range(len(sid) - 1):
            rest = slice(k + 1, None)
            need = -(-percent * (n[k] + n[rest]) // (100 + percent))
            least = np.minimum(common[k], common[rest])
            most = np.minimum(n[k] - common[k], n[rest] - common[rest]) + least
            ok = (label[rest] != label[k]) & (most >= need) & (100 * np.minimum(n[k], n[rest]) >= percent * np.maximum(n[k], n[rest]))
            if cross:
                ok &= own[rest] != own[k]
            at = np.flatnonzero(ok)
            differ = np.bitwise_count(sketches[k + 1 + at] ^ sketches[k]).sum(axis=1, dtype=np.int64)
            passed = n[k] + n[k + 1 + at] - differ >= 2 * need[at]
            # The most alike first: they join the others to this set soonest.
            at = at[passed][np.argsort(differ[passed], kind="stable")]
            for j, least_common in zip((k + 1 + at).tolist(), need[at].tolist()):
                if label[j] != label[k] and len(np.intersect1d(sets[k], sets[j], assume_unique=True)) >= least_common:
                    out.append((sid[k], sid[j]))
                    label[label == label[j]] = label[k]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("family", "i", "j").applyInPandas(run, "a bigint, b bigint")


def by_text(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """key, n, component, first_key: per distinct text its set's size, component id, and the text that stays of the component."""
    texts, labels = component_labels(docs, size, percent)
    known = texts.select("sid", "key", "first_id").join(labels, "sid")
    first = F.min(F.struct(F.col("first_id").isNull().alias("null"), "first_id", "key")).alias("m")
    named = known.groupBy("label").agg(first).select("label", F.col("m.first_id").alias("component"), F.col("m.key").alias("first_key"))
    return stored(known.join(named, "label").select("key", "n", "component", "first_key"), "by-key")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of ``docs``."""
    rows = docs.select("doc_id", text_key().alias("key")).join(by_text(docs, size, percent), "key")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """The columns of ``docs``; of each component the row with the smallest doc_id stays, and all rows without a word."""
    found = by_text(docs, size, percent).select("key", "n", F.col("component").alias("least"), "first_key")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_key().alias("key")).join(found, "key")
    empty = F.col("n") == 0
    first = F.col("id").eqNullSafe(F.col("least")) & (F.col("key") == F.col("first_key"))
    kept = rows.where(empty | first)
    # Only rows that repeat both doc_id and text can still be more than one of a component.
    out = kept.where(~empty).dropDuplicates(["id", "key"]).unionByName(kept.where(empty))
    return out.select([F.col("row")[c].alias(c) for c in docs.columns])

"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line kept per group.

A line is normalised to its words (``wordarrays``) in lower case, without punctuation and symbols. Equal normalised lines are
one line from the start. Two lines are linked if their edit similarity in words (1 - distance
/ words of the longer) reaches ``least``, 0.8 at least. Of each connected group the first
occurrence (by doc_id, nulls last, then line) stays.

Candidates come from lists of one kind of posting:

* Blocks: a line has a SimHash of 64 bits, cut into two blocks of 32; fingerprints that differ
  in one bit agree in a block for certain, others with some probability. Measured over all
  pairs at 0.8, SimHash finds well under half of them with any number of blocks that keeps lists
  short, so it can't be the only way:
* Runs: an edit spoils at most three of the n - 2 runs of three words. Lines that reach the
  similarity therefore share one of the first 3 (1 - least) n + 1 distinct runs of each in one
  order of all runs. The order puts frequent runs last and runs of long words first; any order
  would be right. Lines of five and four words also post their runs of two. No pair is missed
  unless 48 bits of the keys of two lines agree, besides size class and parities: they then count as one line of a list.

Lists of at most LIST lines give all pairs that the bounds of size and of differing words
leave, neither of which loses a pair. Longer lists are first held against one leader. A line
is verified against one of its candidates first; pairs inside a component need no
comparison, so a family of thousands costs thousands of comparisons. Then the pairs across
components are verified, those of the longer lists where the list's lines meet: no pair leaves
its task but a link that joins two components there.

Lines of marks alone are linked with nothing; of those that are equal up to white space the first stays. Blank
lines are never dropped. Null texts are empty: one line
without a word. A document is the pair of doc_id and text (by 128 bits); rows that repeat both are
treated alike. Ids of any type that can be compared; other columns, of any name, pass
through; ``text`` and ``n_chars`` are rewritten. Rows must come in the same order when a task
runs again, as they do from files: an occurrence in a posting is named by its task and place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm import wordarrays
from popspark.llm.common import bounded, discard, frugal, give_back, stored, text_or_empty
from popspark.llm.graph import components

SIMILARITY = 0.8
BLOCKS = 2
#: Lines of a list of which all pairs are formed at once; longer lists have a leader.
LIST = 16
#: Rounds of leaders in longer lists; the pairs left over are all compared, so this is a matter of speed only.
TURNS = 2
#: Lines of a longer list that a task holds against as many others.
LIST_BLOCK = 4096
#: Lines that share one number of postings' blobs.
MOST_LINES = 1 << 16
#: Slots of the table of frequent runs (a byte each, broadcast), and how many of them are filled. An order only: no run is left out.
SLOT_BITS, ORDERED_SLOTS = 23, 1 << 20
#: Documents with a dropped or wanted line, or line ids, that a broadcast may hold; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Size classes: sizes of a class differ by three in a hundred at most; the last has no upper end.
CLASSES = 256
LOW = np.ceil(1.03 ** np.arange(CLASSES) - 1e-9).astype(np.int64)
HIGH = np.append(LOW[1:] - 1, 1 << 40)
SAME_WORDS = np.uint64((1 << 48) - 1)


def words_by_line(text: str) -> list[list[str]]:
    """The words of each line, in lower case and without the signs."""
    low = text.lower()
    for sign in "\t\x0b\x0c\r" + wordarrays.SIGNS:
        if sign in low:
            low = low.replace(sign, " ")
    return [[w for w in line.split(" ") if w] for line in low.split("\n")]


def normalised(line: str) -> str:
    return " ".join(words_by_line(line)[0])


def trimmed(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """Both without the beginning and the end that they share."""
    for side in (1, -1):
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            same = a[low:mid] == b[low:mid] if side == 1 else a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low]
            low, high = (mid, high) if same else (low, mid - 1)
        a, b = (a[low:], b[low:]) if side == 1 else (a[: len(a) - low], b[: len(b) - low])
    return a, b


def distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences, a row of the table at a time as the bits of one number."""
    a, b = trimmed(a, b)
    if not a or not b:
        return max(len(a), len(b))
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, up, down, score = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) & full) ^ up) | eq
        plus, minus = down | (full & ~(d | up)), up & d
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(x | plus)), plus & x
    return score


def similar(a: Sequence, b: Sequence, least: float = SIMILARITY) -> bool:
    n = max(len(a), len(b))
    most = n - least * n + 1e-9
    if n - min(len(a), len(b)) > most:
        return False
    a, b = trimmed(a, b)
    # What is left bounds the distance from above; from below, an edit changes one element of each bag.
    if max(len(a), len(b)) <= most:
        return True
    bag = Counter(a)
    bag.subtract(b)
    if max(sum(v for v in bag.values() if v > 0), -sum(v for v in bag.values() if v < 0)) > most:
        return False
    return distance(a, b) <= most


def _edits(size: np.ndarray, least: float) -> np.ndarray:
    """The most edits between two lines of which the longer has ``size`` words."""
    return np.floor((1 - least) * size + 1e-9).astype(np.int64)


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _blobs(values: np.ndarray, cut: np.ndarray, rows: list[int]) -> pa.Array:
    return pa.array([values[cut[k] : cut[k + 1]].tobytes() for k in rows], pa.binary())


def _buckets(spark: SparkSession) -> int:
    """Parts in which postings meet."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _parts(texts: pa.Array, cut: Callable[[list[str]], wordarrays.Lines] = wordarrays.lines_of) -> Iterator[tuple[int, wordarrays.Lines]]:
    """The lines of ``texts`` a slice at a time, with the number of the slice's first text."""
    for start, some in wordarrays.slices(texts):
        found = cut(some)
        for a in range(0, len(found.size), MOST_LINES):
            yield start, found.part(a, min(a + MOST_LINES, len(found.size)))


def identified(docs: DataFrame, *columns: Column) -> DataFrame:
    """r1, r2 (128 bits of doc_id and text) and ``columns``."""
    text = text_or_empty()
    return docs.select(F.xxhash64("doc_id", text).alias("r1"), F.xxhash64(F.lit(1), text, "doc_id").alias("r2"), *columns)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2, line, k1, k2 (128 bits of the normalised line, or of its marks) of each line that isn't blank; and rows of bucket, runs (all runs of three words)."""
    buckets = _buckets(docs.sparkSession)
    names = ["doc_id", "r1", "r2", "line", "k1", "k2", "bucket", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(b: pa.RecordBatch, at: int, x: wordarrays.Lines) -> pa.RecordBatch:
            k1, k2 = wordarrays.keys(x)
            rows, n = pa.array(at + x.text), len(x.size)
            return pa.record_batch([*(b.column(i).take(rows) for i in range(3)), pa.array(x.line.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)

        for b in batches:
            for at, x in _parts(b.column(3), wordarrays.mark_lines):
                yield told(b, at, x)
            for at, x in _parts(b.column(3)):
                yield told(b, at, x)
                gram = wordarrays.grams(x, 3)[1]
                dealt = np.sort((((gram >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (gram & np.uint64(0xFFFFFFFF)))
                cut = np.searchsorted(dealt, np.arange(buckets + 1).astype(np.uint64) << np.uint64(32))
                parts = [k for k in range(buckets) if cut[k] < cut[k + 1]]
                empty = (pa.nulls(len(parts), t) for t in (b.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))
                yield pa.record_batch([*empty, pa.array(parts, pa.int32()), _blobs(dealt.astype(np.uint32), cut, parts)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return identified(docs, F.col("doc_id"), text_or_empty().alias("text")).select("doc_id", "r1", "r2", "text").mapInArrow(frugal(run), f"doc_id {kind}, r1 bigint, r2 bigint, line int, k1 bigint, k2 bigint, bucket int, runs binary")


def frequent(table: DataFrame) -> np.ndarray:
    """A rank for each slot of runs: 0 for most, higher the more often its most frequent run was met."""

    def count(part: pa.Table) -> pa.Table:
        runs = np.sort(np.concatenate([np.frombuffer(v.as_buffer(), np.uint32) for v in part["runs"]]))
        cut = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1], [True]]))
        n = np.diff(cut)
        often = n > LIST // 2
        return pa.table({"slot": pa.array(_slot(runs[cut[:-1][often]].astype(np.uint64)).astype(np.int32)), "n": pa.array(n[often])})

    counted = table.where("bucket IS NOT NULL").select("bucket", "runs").groupBy("bucket").applyInArrow(count, "slot int, n bigint")
    top = counted.groupBy("slot").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "slot").limit(ORDERED_SLOTS)
    top = stored(top, "frequent-runs").toArrow()
    rank = np.zeros(1 << SLOT_BITS, np.uint8)
    rank[top["slot"].to_numpy()] = np.minimum(6 * np.log2(top["n"].to_numpy() + 1.0), 127).astype(np.uint8)
    return rank


def postings(x: wordarrays.Lines, rank: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, token): what each line posts."""
    line, gram, width = wordarrays.grams(x, 3)
    often = rank[_slot(gram)].astype(np.uint64)
    place = np.where(often > 0, often + np.uint64(128), (127 - np.minimum(width, 127)).astype(np.uint64))
    # Line, rank, and the run itself make one number to sort by.
    order = np.argsort((line.astype(np.uint64) << np.uint64(48)) | (place << np.uint64(40)) | (gram >> np.uint64(24)))
    line, gram = line[order], gram[order]
    new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (gram[1:] != gram[:-1])])) if len(line) else np.empty(0, np.int64)
    line, gram = line[new], gram[new]
    count = np.bincount(line, minlength=len(x.size))
    nth = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    most = np.floor(3 * (1 - least) * x.size + 1e-9).astype(np.int64) + 1
    first = nth < most[line]
    two_line, two, _ = wordarrays.grams(x, 2)
    small = (x.size[two_line] == 4) | (x.size[two_line] == 5)
    told = np.flatnonzero(x.size > 3)
    halves = wordarrays.simhash(x).view(np.uint32).reshape(-1, BLOCKS)[told].astype(np.uint64)
    blocks = [wordarrays.mixed(halves[:, i] + np.uint64((i + 1) << 40)) for i in range(BLOCKS)]
    return np.concatenate([line[first], two_line[small], *[told] * BLOCKS]), np.concatenate([gram[first], two[small], *blocks])


def near(i: np.ndarray, j: np.ndarray, size: np.ndarray, mark: np.ndarray, least: float) -> np.ndarray:
    """Whether entries i and j (size of i not over that of j, by class) may reach the similarity."""
    longer, gap = HIGH[size[j]], np.maximum(LOW[size[j]] - HIGH[size[i]], 0)
    bits = np.bitwise_count((mark[i] ^ mark[j]) & SAME_WORDS).astype(np.int64)
    return (HIGH[size[i]] >= least * LOW[size[j]] - 1e-9) & (bits <= 2 * _edits(longer, least) - gap)


def pairs_by_step(key: np.ndarray, size: np.ndarray, mark: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """(i, j): the pairs of entries of equal ``key`` (sorted; sizes ascend in it) that the bounds leave, those of one distance in the order at a time."""
    i, step = np.arange(max(0, len(key) - 1)), 1
    while len(i):
        j = i + step
        on = (key[i] == key[j]) & (HIGH[size[i]] >= least * LOW[size[j]] - 1e-9)
        i, j = i[on], j[on]
        ok = near(i, j, size, mark, least)
        yield np.stack([i[ok], j[ok]])
        step += 1
        i = i[i + step < len(key)]


def pairs_of_runs(key: np.ndarray, size: np.ndarray, mark: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All of ``pairs_by_step`` at once."""
    return tuple(np.concatenate([np.empty((2, 0), np.int64), *pairs_by_step(key, size, mark, least)], axis=1))


FOUND = "a bigint, b bigint, k1 bigint, k2 bigint, token bigint, size int, mark bigint"


def _found(n: int, **values: np.ndarray) -> dict[str, pa.Array]:
    kinds = dict(x.split() for x in FOUND.split(", "))
    return {c: pa.array(values[c].astype(np.int64)).cast(pa.int64() if k == "bigint" else pa.int32()) if c in values else pa.nulls(n, pa.int64() if k == "bigint" else pa.int32()) for c, k in kinds.items()}


def meet(docs: DataFrame, rank: np.ndarray, least: float) -> DataFrame:
    """Rows of three kinds: a, b (occurrences that may be near); a, k1, k2 (the line of an occurrence); token, a, size, mark (entries of long lists)."""
    spark = docs.sparkSession
    buckets = _buckets(spark)
    shipped = spark.sparkContext.broadcast(rank)
    names = ["bucket", "at", "token", "line", "tokens", "size", "mark", "key", "k1", "k2"]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, at = shipped.value, TaskContext.get().partitionId() << 20
        for b in batches:
            for _, x in _parts(b.column(0)):
                k1, k2 = wordarrays.keys(x)
                # 16 bits of the key beside the parities, 32 others on their own.
                mark, key = wordarrays.parity(x) | (k1 << np.uint64(48)), (k1 >> np.uint64(32)).astype(np.uint32)
                size = (np.searchsorted(LOW, x.size, "right") - 1).astype(np.uint8)
                # A line that repeats in the slice posts once.
                _, one = np.unique(k1 ^ (k2 << np.uint64(1)), return_index=True)
                single = np.zeros(len(k1), bool)
                single[one] = True
                line, token = postings(x, ranks, least)
                keep = single[line]
                line, token = line[keep], token[keep]
                bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | (line.astype(np.uint64) << np.uint64(16)))
                line, bucket, token = line[order], bucket[order], token[order].astype(np.uint32)
                head = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (bucket[1:] != bucket[:-1])])) if len(line) else np.empty(0, np.int64)
                many = np.diff(np.append(head, len(line)))
                cut, lines_cut = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(bucket[head], np.arange(buckets + 1))
                rows = [k for k in range(buckets) if cut[k] < cut[k + 1]]
                of, n = line[head], len(rows)
                yield pa.record_batch(
                    [pa.array(rows, pa.int32()), pa.array([at] * n, pa.int64()), _blobs(token, cut, rows), *(_blobs(v, lines_cut, rows) for v in (of.astype(np.uint16), many.astype(np.uint32), size[of], mark[of], key[of])), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                    names=names,
                )
                yield pa.record_batch([pa.array([at % buckets], pa.int32()), pa.array([at], pa.int64()), *(pa.nulls(1, pa.binary()) for _ in range(6)), pa.array([k1.tobytes()], pa.binary()), pa.array([k2.tobytes()], pa.binary())], names=names)
                at += 1

    def gather(part: pa.Table) -> pa.Table:
        out = []
        at = part["at"].to_numpy()
        read = lambda c, kind: [np.frombuffer(v.as_buffer() if v.is_valid else b"", kind) for v in part[c]]
        k1, k2 = read("k1", np.int64), read("k2", np.int64)
        for i in range(len(at)):
            if len(k1[i]):
                ref = (int(at[i]) << 16) + np.arange(len(k1[i]))
                out.append(_found(len(ref), a=ref, k1=k1[i], k2=k2[i]))
        line = read("line", np.uint16)
        ref = np.concatenate([(int(s) << 16) + v.astype(np.int64) for s, v in zip(at, line)] or [np.empty(0, np.int64)])
        token, many, size, mark, key = (np.concatenate(read(c, kind)) for c, kind in (("token", np.uint32), ("tokens", np.uint32), ("size", np.uint8), ("mark", np.uint64), ("key", np.uint32)))
        entry = np.repeat(np.arange(len(ref), dtype=np.uint32), many)
        order = np.argsort(token, kind="stable")
        token, entry = token[order], entry[order]
        same = token[1:] == token[:-1]
        shared = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])) if len(token) else np.empty(0, np.int64)
        token, entry = token[shared], entry[shared]
        order = np.lexsort((key[entry], mark[entry], size[entry], token))
        token, entry = token[order], entry[order]
        s, m, k = size[entry], mark[entry], key[entry]
        # The same line from several slices counts once.
        once = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (s[1:] != s[:-1]) | (m[1:] != m[:-1]) | (k[1:] != k[:-1])])) if len(token) else np.empty(0, np.int64)
        token, entry, s, m = token[once], entry[once], s[once].astype(np.int64), m[once]
        cut = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(token) else np.zeros(1, np.int64)
        length = np.diff(cut)
        run = np.repeat(np.arange(len(length)), length)
        short = np.flatnonzero(length[run] <= LIST)
        i, j = pairs_of_runs(run[short], s[short], m[short], least)
        i, j = short[i], short[j]
        long = np.flatnonzero(length[run] > LIST)
        lead = (cut[:-1] + length // 2)[run[long]]
        lo, hi = np.minimum(long, lead), np.maximum(long, lead)
        ok = (long != lead) & near(lo, hi, s, m, least)
        a, b = ref[entry[np.concatenate([i, lo[ok]])]], ref[entry[np.concatenate([j, hi[ok]])]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        out.append(_found(len(both), a=both[:, 0], b=both[:, 1]))
        whole = (token[long].astype(np.int64) << 20) | (int(part["bucket"][0].as_py()) & 0xFFFFF)
        out.append(_found(len(long), token=whole, a=ref[entry[long]], size=s[long], mark=m[long].view(np.int64)))
        # The entries of a bucket are the largest thing that a worker holds.
        give_back()
        return pa.concat_tables([pa.table(t) for t in out])

    posted = docs.select(text_or_empty().alias("text")).mapInArrow(frugal(post), "bucket int, at bigint, token binary, line binary, tokens binary, size binary, mark binary, key binary, k1 binary, k2 binary")
    return posted.groupBy("bucket").applyInArrow(gather, FOUND)


def _texts(lines: DataFrame, uniq: DataFrame, docs: DataFrame) -> DataFrame:
    """lid, t, n, sketch of the lines (lid): their text, words, and whether the counted words of each of about 2 n classes are odd in number."""
    need = lines.join(uniq.select("lid", "first.r1", "first.r2", "first.line"), "lid")
    wanted = stored(need.groupBy("r1", "r2").agg(F.collect_list(F.struct("lid", "line")).alias("wanted")), "wanted")
    rows = identified(docs, text_or_empty().alias("text")).join(bounded(wanted, BROADCAST_ROWS), ["r1", "r2"])
    each = rows.select("wanted", F.split("text", "\n", -1).alias("ls")).select(F.expr("inline(transform(wanted, x -> struct(x.lid AS lid, ls[x.line] AS t)))"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # No text has a newline here, and each has a word.
            for lo, x in _parts(b.column(1)):
                at = lo + x.text
                bits = np.left_shift(64, np.ceil(np.log2(np.maximum(x.size, 32) / 32)).astype(np.int64))
                start = np.cumsum(bits) - bits
                place = np.repeat(start, x.size) + ((wordarrays.counted(x) >> np.uint64(13)) & np.repeat(bits - 1, x.size).astype(np.uint64)).astype(np.int64)
                odd = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8))
                sketches = [odd[s // 8 : (s + n) // 8].tobytes() for s, n in zip(start, bits)]
                yield pa.record_batch([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(x.size), pa.array(sketches, pa.binary())], names=["lid", "t", "n", "sketch"])

    out = stored(each.mapInArrow(frugal(sketched), "lid bigint, t string, n bigint, sketch binary").dropDuplicates(["lid"]), "texts")
    discard(wanted)
    return out


def _apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ after folding to the shorter one's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """a, b of those pairs (distinct) whose lines have the edit similarity; a wide sketch first drops most of the others without their texts, which go at the end."""
    side = lambda c, *more: texts.select(F.col("lid").alias(c), *[F.col(m).alias(m + c) for m in more])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            most = 2 * _edits(np.maximum(na, nb), least) - np.abs(na - nb)
            bits = np.array([_apart(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(4), b.column(5))], np.int64)
            yield b.select([0, 1]).filter(pa.array(bits <= most))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                ok = [similar(words_by_line(x)[0], words_by_line(y)[0], least) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").select("a", "b", "na", "nb", "sketcha", "sketchb")
    left = stored(both.mapInArrow(passing, "a bigint, b bigint"), "passing")
    full = left.join(side("a", "t"), "a").join(side("b", "t"), "b").select("a", "b", "ta", "tb")
    out = stored(full.mapInArrow(frugal(close), "a bigint, b bigint"), "similar")
    discard(texts)
    discard(left)
    return out


def _bits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of each line in ``texts``, and 256 bits of it as ``parity`` has 48."""
    size, bits = [np.empty(0, np.int64)], [np.empty((0, 4), np.uint64)]
    for _, x in _parts(texts):
        place = np.repeat(np.arange(len(x.size)), x.size) * 256 + ((wordarrays.counted(x) >> np.uint64(13)) & np.uint64(255)).astype(np.int64)
        odd = (np.bincount(place, minlength=256 * len(x.size)) & 1).astype(np.uint8)
        size.append(x.size)
        bits.append(np.packbits(odd).view(np.uint64).reshape(-1, 4))
    return np.concatenate(size), np.concatenate(bits)


def across_lists(entries: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """a, b (lines): links that join the labels within long lists (token, lid, size, mark, label), blocks of which meet in a task with their texts.

    A pair that shares several lists is looked at in one of them, that of the least number. Lists of one number are one list.
    """
    entries = entries.withColumn("token", F.hash("token"))
    size = entries.groupBy("token").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("k"))
    rows = entries.join(size, "token").withColumn("own", F.pmod(F.xxhash64("lid"), F.col("k")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Whole lists share groups; a block of a split list is a group of its own.
    bucket = F.when(F.col("k") > 1, F.xxhash64("token", F.least("own", "with"), F.greatest("own", "with"))).otherwise(F.pmod(F.xxhash64("token"), F.lit(4 * parts)))
    rows = rows.select(bucket.alias("bucket"), "token", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "lid", "size", "mark", "label")
    lists = entries.groupBy("lid").agg(F.collect_set("token").alias("tokens"))
    told = rows.select("bucket", "lid").distinct().join(texts.select("lid", "t").join(lists, "lid"), "lid")
    none = [F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("bucket", "lid")]
    both = rows.withColumns({"t": F.lit(None).cast("string"), "tokens": F.lit(None).cast("array<int>")}).unionByName(told.select("bucket", "lid", *none, "t", "tokens"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        lines = part[part["t"].notna()].sort_values("lid")
        part = part[part["t"].isna()].sort_values(["token", "i", "j", "size", "lid"])
        ids, text, lists = lines["lid"].to_numpy(np.int64), lines["t"].to_list(), lines["tokens"].to_list()
        n, bits = _bits(pa.array(text, pa.string()))
        words, held = cache(lambda k: words_by_line(text[k])[0]), cache(lambda k: frozenset(lists[k].tolist()))
        at = np.searchsorted(ids, part["lid"].to_numpy(np.int64))
        label = np.unique(part["label"].to_numpy(np.int64), return_inverse=True)[1]
        token, own, cross = part["token"].to_numpy(), part["own"].to_numpy(), (part["i"] != part["j"]).to_numpy()
        group = part.groupby(["token", "i", "j"], sort=False).ngroup().to_numpy()
        # Labels that links found here have joined have one top.
        top, out = np.arange(len(label)), []
        for x, y in pairs_by_step(group, part["size"].to_numpy(np.int64), part["mark"].to_numpy(np.int64).view(np.uint64), least):
            ok = (top[label[x]] != top[label[y]]) & (~cross[x] | (own[x] != own[y]))
            x, y = x[ok], y[ok]
            a, b = at[x], at[y]
            apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            left = np.flatnonzero(apart <= 2 * _edits(np.maximum(n[a], n[b]), least) - np.abs(n[a] - n[b]))
            for u, v, t, p, q in zip(a[left].tolist(), b[left].tolist(), token[x[left]].tolist(), label[x[left]].tolist(), label[y[left]].tolist()):
                if top[p] != top[q] and min(held(u) & held(v)) == t and similar(words(u), words(v), least):
                    top[top == top[p]] = top[q]
                    out.append((ids[u], ids[v]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return both.groupBy("bucket").applyInPandas(run, "a bigint, b bigint")


def _mixed(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled entries of the long lists that hold more than one label."""
    known = _labelled(entries, "lid", labels, "label")
    mixed = known.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    return known.join(mixed, "token", "left_semi")


def leaders(entries: DataFrame, turn: int, least: float) -> DataFrame:
    """a, b: each line of the mixed lists with one line of another label, a leader that it shares the most lists with. Leaders change with the turn."""
    lead = F.max(F.struct(F.xxhash64("lid", F.lit(turn)).alias("h"), F.col("lid").alias("lead"), F.col("size").alias("size2"), F.col("mark").alias("mark2"), F.col("label").alias("label2"))).alias("m")
    met = entries.join(entries.groupBy("token").agg(lead).select("token", "m.*"), "token").where("label <> label2")
    low, high = F.array(*[F.lit(int(x)) for x in LOW]), F.array(*[F.lit(int(x)) for x in HIGH])
    small, large = F.least("size", "size2"), F.greatest("size", "size2")
    bits = F.bit_count((F.col("mark").bitwiseXOR(F.col("mark2"))).bitwiseAND(F.lit(int(SAME_WORDS))))
    most = 2 * F.floor((1 - least) * high[large] + 1e-9) - F.greatest(low[large] - high[small], F.lit(0))
    fits = met.where((high[small] >= least * low[large] - 1e-9) & (bits <= most))
    best = fits.groupBy("lid", "lead").count().groupBy("lid").agg(F.max(F.struct("count", "lead")).alias("m"))
    return best.select(F.least("lid", "m.lead").alias("a"), F.greatest("lid", "m.lead").alias("b")).distinct()


def _labelled(rows: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """``rows`` with the label of the line in ``column``: itself where it has no link."""
    known = labels.select(F.col("node").alias(column), F.col("label").alias(name))
    return rows.join(known, column, "left").withColumn(name, F.coalesce(name, column))


def groups(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(lines, places): ``line_table``, and k1, k2, first (r1, r2, line): the kept occurrence of each line that repeats or has near lines."""
    if least < SIMILARITY:
        raise ValueError(f"runs of three words are lossless from a similarity of {SIMILARITY} on")
    table = stored(line_table(docs), "lines-and-runs")
    lines = stored(table.where("k1 IS NOT NULL").drop("bucket", "runs"), "lines")
    rank = frequent(table)
    discard(table)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2", "line")).alias("first")
    uniq = stored(lines.groupBy("k1", "k2").agg(first, F.count("*").alias("n")).withColumn("lid", F.monotonically_increasing_id()), "uniq")
    found = stored(meet(docs, rank, least), "found")
    pairs = found.where("b IS NOT NULL").select("a", "b").distinct()
    entries = found.where("token IS NOT NULL").select("token", "a", "size", "mark")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("a")).unionByName(entries.select("a")).distinct()
    named = found.where("k1 IS NOT NULL").select("a", "k1", "k2").join(ends, "a").join(uniq.select("k1", "k2", "lid"), ["k1", "k2"])
    named = stored(named.select(F.col("a").alias("ref"), "lid"), "named")
    both = pairs.join(named.select(F.col("ref").alias("a"), F.col("lid").alias("x")), "a").join(named.select(F.col("ref").alias("b"), F.col("lid").alias("y")), "b").where("x <> y")
    near_lines = stored(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-lines")
    entries = stored(entries.join(named, entries["a"] == named["ref"]).select("token", "lid", "size", "mark").distinct(), "long-lists")
    discard(found)
    discard(named)
    # One candidate of each line decides most; then what lies across components is left.
    stars = stored(near_lines.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "stars")
    links = _verified(stars, _texts(_ends(stars), uniq, docs), least)
    labels = stored(components(links), "labels")
    for turn in range(TURNS):
        entries = stored(_mixed(entries, labels), "open-lists")
        best = stored(leaders(entries, turn, least), "leaders")
        new = _verified(best, _texts(_ends(best), uniq, docs), least)
        entries = entries.drop("label")
        if new.isEmpty():
            break
        labels = stored(components(_stars(labels).unionByName(new)), "labels")
    entries = stored(_mixed(entries, labels), "mixed-lists")
    rest = _labelled(_labelled(near_lines, "a", labels, "la"), "b", labels, "lb").where("la <> lb").select("a", "b")
    rest = stored(rest.join(stars, ["a", "b"], "left_anti"), "across")
    texts = _texts(_ends(rest).unionByName(entries.select("lid")).distinct(), uniq, docs)
    more = stored(across_lists(entries, texts, least), "links").unionByName(_verified(rest, texts, least))
    labels = stored(components(_stars(labels).unionByName(more)), "labels")
    linked = stored(uniq.join(labels.withColumnRenamed("node", "lid"), "lid").select("k1", "k2", "first", "label"), "linked")
    kept = linked.join(linked.groupBy("label").agg(F.min("first").alias("kept")), "label").select("k1", "k2", F.col("kept").alias("first"))
    alone = uniq.where("n > 1").join(labels.select(F.col("node").alias("lid")), "lid", "left_anti").select("k1", "k2", "first")
    return lines, stored(kept.unionByName(alone), "places")


def _stars(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


def dropped_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """r1, r2, drop: the line numbers to drop of each document that loses any."""
    lines, places = groups(docs, least)
    places = places.select("k1", "k2", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("r1", "r2", "line")])
    other = " OR ".join(f"{c} <> first_{c}" for c in ("r1", "r2", "line"))
    extra = lines.join(places, ["k1", "k2"]).where(other)
    return stored(extra.groupBy("r1", "r2").agg(F.collect_set("line").alias("drop")), "dropped")


def _cut(docs: DataFrame, least: float) -> DataFrame:
    """row (all columns of ``docs``), text_kept, n_lines, n_dropped."""
    gone = dropped_lines(docs, least)
    rows = identified(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.split(text_or_empty(), "\n", -1).alias("ls"))
    both = rows.join(bounded(gone, BROADCAST_ROWS), ["r1", "r2"], "left")
    kept = F.expr("array_join(transform(array_except(sequence(0, size(ls) - 1), drop), i -> ls[i]), '\\n')")
    return both.select(
        "row",
        F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(kept).alias("text_kept"),
        F.size("ls").cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
    )


def _columns(docs: DataFrame) -> list:
    """The columns of ``docs`` out of ``row``, with the kept text and its length in characters as n_chars."""
    new = {"text": F.col("text_kept"), "n_chars": F.coalesce(F.length("text_kept"), F.lit(0)).cast("long")}
    return [new.get(c, F.col("row")[c]).alias(c) for c in docs.columns]


def deduped(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The columns of ``docs`` with the kept lines as ``text``, and n_lines, n_dropped instead of any columns of these names."""
    own = [c for c, name in zip(_columns(docs), docs.columns) if name not in ("n_lines", "n_dropped")]
    return _cut(docs, least).select(*own, "n_lines", "n_dropped")


def with_text_left(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The columns of ``docs`` with the kept lines as ``text``; documents that lost a line and have no word left go."""
    left = (F.col("n_dropped") == 0) | F.col("text_kept").rlike(r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]")
    return _cut(docs, least).where(left).select(_columns(docs))


def line_dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the lines that stay, joined by newlines)."""
    rows = deduped(docs.select("doc_id", "text"), least)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty(), 256).alias("kept_sha256"))

"""Token counts by a separator scan over flat token files without an index.

A flat token file is one run of token ids, each document closed by the end-of-document
id, cut into blocks of a fixed number of tokens wherever they fall. ``write_flat``
makes such files (shards), ``read_flat`` takes raw binary ones, and ``scan`` counts:

1. each block is searched by itself, vectorised, for the separator; it yields the
   lengths of the documents that lie in it whole and a summary (tokens before its
   first separator, tokens behind its last one, separators),
2. a prefix scan over the summaries of a shard gives every block the number of
   documents that closed before it and the tokens carried into it,
3. each block's first separator closes the carried document.

Step 2 runs over one small row per block. A shard's last document may lack its
separator (a cut file); it is reported with ``closed`` false if it has any token.
Empty documents are separators in a row and count 0 tokens. Null texts are empty;
documents that repeat are counted each time; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popspark.llm.bpe import encoder
from popspark.llm.common import stored

BLOCK_TOKENS = 1 << 16
TOKEN_TYPE = "<u4"


def write_flat(docs: DataFrame, path: str, pattern: str, separator: int, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(blocks, order): shard, block, tokens (little-endian 32-bit ids); and shard, ordinal, doc_id, as written.

    One shard per task. A task holds one block and one batch of texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(path, pattern), TaskContext.get().partitionId()
        rest, done, seen = np.empty(0, TOKEN_TYPE), 0, 0
        names = ["shard", "block", "tokens", "first", "doc_ids"]
        kind = None

        def out(tokens: np.ndarray, ids: list, first: int) -> pa.RecordBatch:
            return pa.record_batch([pa.array([shard], pa.int64()), pa.array([done], pa.int64()), pa.array([tokens.tobytes()], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(kind))], names=names)

        for b in batches:
            kind = b.column(0).type
            ids, first = b.column(0).to_pylist(), seen
            seen += len(ids)
            for i in range(0, len(ids), 64):
                text = f" {separator} ".join(enc.encode_joined(t or "") for t in b.column(1)[i : i + 64].to_pylist()) + f" {separator}"
                rest = np.concatenate([rest, np.array(text.split(), TOKEN_TYPE)])
                while len(rest) >= block:
                    yield out(rest[:block], ids, first)
                    rest, done, first, ids = rest[block:], done + 1, seen, []
            if ids:
                yield out(np.empty(0, TOKEN_TYPE), ids, first)
        if len(rest):
            yield out(rest, [], seen)

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = stored(docs.select("doc_id", "text").mapInArrow(run, f"shard bigint, block bigint, tokens binary, first bigint, doc_ids array<{kind}>"), "flat")
    order = both.select("shard", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("shard", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return both.where(F.length("tokens") > 0).select("shard", "block", "tokens"), order


def read_flat(spark: SparkSession, path: str, block: int = BLOCK_TOKENS) -> DataFrame:
    """shard, block, tokens of raw binary files; shards are numbered in order of their paths.

    A task reads a whole file (2 GB at most, Spark's bound for ``binaryFile``) and cuts
    it, so large corpora should come as many files.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    shard = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("shard"))
    width = np.dtype(TOKEN_TYPE).itemsize * block

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                view = memoryview(data.as_buffer())
                for k in range(0, max(1, -(-len(view) // width))):
                    yield pa.record_batch([pa.array([name.as_py()]), pa.array([k], pa.int64()), pa.array([view[k * width : (k + 1) * width].tobytes()], pa.binary())], names=["path", "block", "tokens"])

    blocks = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "path string, block bigint, tokens binary")
    return blocks.join(shard, "path").select("shard", "block", "tokens")


def _search(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "n_tokens", "n_closed", "head", "tail", "inner"]
        for b in batches:
            rows = []
            for data in b.column(2):
                ids = np.frombuffer(data.as_buffer(), TOKEN_TYPE)
                at = np.flatnonzero(ids == separator)
                head, tail = (int(at[0]), len(ids) - 1 - int(at[-1])) if len(at) else (len(ids), 0)
                rows.append((len(ids), len(at), head, tail, np.diff(at) - 1 if len(at) else at))
            cols = list(zip(*rows)) or [()] * 5
            lists = pa.array([x.tolist() for x in cols[4]], pa.list_(pa.int64()))
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols[:4]), lists], names=names)

    return run


def scan(blocks: DataFrame, separator: int) -> DataFrame:
    """shard, ordinal, n_tokens, closed for every document of every shard."""
    found = blocks.select("shard", "block", "tokens").mapInArrow(_search(separator), "shard bigint, block bigint, n_tokens bigint, n_closed bigint, head bigint, tail bigint, inner array<bigint>")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Tokens read before a block, less those up to the last separator before it, are carried into it.
    read = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    placed = found.withColumn("read", read).withColumn("ordinal", F.coalesce(F.sum("n_closed").over(before), F.lit(0)))
    cut = F.when(F.col("n_closed") > 0, F.col("read") + F.col("n_tokens") - F.col("tail"))
    placed = placed.withColumn("carried", F.col("read") - F.coalesce(F.max(cut).over(before), F.lit(0)))
    placed = placed.withColumn("final", F.col("block") == F.max("block").over(Window.partitionBy("shard")))
    open_end = F.when(F.col("n_closed") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("n_tokens"))
    ends = F.when(F.col("n_closed") > 0, F.concat(F.array(F.col("carried") + F.col("head")), "inner")).otherwise(F.array().cast("array<bigint>"))
    docs = placed.select("shard", "ordinal", F.posexplode(ends).alias("i", "n_tokens")).select("shard", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    left = placed.where(F.col("final") & (open_end > 0)).select("shard", (F.col("ordinal") + F.col("n_closed")).alias("ordinal"), open_end.alias("n_tokens"), F.lit(False).alias("closed"))
    return docs.unionByName(left)


def counts(docs: DataFrame, path: str, pattern: str, separator: int) -> DataFrame:
    """doc_id, shard, ordinal, n_tokens: the documents written to flat shards and counted from them."""
    blocks, order = write_flat(docs, path, pattern, separator)
    return scan(blocks, separator).join(order, ["shard", "ordinal"]).select("doc_id", "shard", "ordinal", "n_tokens")

"""What the text operators share: table reading, working tables in the shared folder, text keys."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session leaves the setting unset (tests, a laptop) a temporary
    folder takes its place, and is removed at exit.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        there = tempfile.mkdtemp(prefix="popspark-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


#: Lets Spark delete the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again.

    This cuts lineage and fixes the values that depend on the task (row numbers,
    order of arrival), so a lost executor never makes two readers disagree.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # Anew, as a plan takes the setting when it is made.
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the working table behind ``df``; only for tables whose readers have all been stored themselves."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded(keys: DataFrame, most: int) -> DataFrame:
    """``keys``, to be broadcast only where a count shows at most ``most`` rows of a few numbers each."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """SHA-256 of the whole text: equal keys stand for equal texts."""
    return F.unhex(F.sha2(text_or_empty(column), 256))


def give_back() -> None:
    """Return the memory that Arrow and numpy freed to the system: Spark keeps a Python worker, and what it holds, for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` (batches to batches) as it is, with the task's memory given back when it ends."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole

"""What several corpus operators share: stage tables, shingle hashes, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial, wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters; bytes.split() uses the same six.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5

#: Most bytes of a batch that goes to a Python worker while a stage table is written.
BATCH_BYTES = "8m"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests on one machine) a temporary one is set.

    On a cluster it has to be set: a folder of one machine's own would hide the rows that other machines write.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="priorwake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that hold for what runs inside, given with _ for the dots after spark.sql."""
    names = {f"spark.sql.{k.replace('_', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, tag: str, batch_bytes: str = BATCH_BYTES) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, lost executors lose nothing.

    Python workers get batches of at most batch_bytes, and the shuffle files of the write go when it is done. The tables
    of an application lie under one folder, which release() removes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/priorwake/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    with settings(spark, execution_arrow_maxBytesPerBatch=batch_bytes, classic_shuffleDependency_fileCleanup_enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


#: What a worker keeps over its tasks, until another function than its owner's runs in it.
KEEP: dict = {}


def trim(keep: bool = False) -> None:
    """Hand this process's freed memory back to the system, and without keep what KEEP holds, too."""
    if not keep:
        KEEP.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries
        pass


def trimmed(work: Callable[[Iterator], Iterator] | None = None, *, keep: bool = False) -> Callable:
    """A worker's function that hands its freed memory back at its end: workers are used again, and idle ones would hold it.

    What others have left in KEEP goes before it begins, unless keep says that it is the owner.
    """
    if work is None:
        return partial(trimmed, keep=keep)

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        if KEEP and not keep:
            trim()
        try:
            yield from work(batches)
        finally:
            trim(keep)

    return run


def small_batches(spark: SparkSession, batch_bytes: str = BATCH_BYTES) -> None:
    """From now on in this session, Python workers get batches of at most batch_bytes: for results that others write."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing lazy reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stage_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete this application's stage tables; call it when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/priorwake/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def require(df: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lowered; bytes.lower() leaves all other letters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, as int64.

    A text of 1 to size-1 words has one shingle, the whole sequence; a text without words (or null) has none.
    Two different shingles share a hash with probability 2**-64.
    """
    words = lower_words(text)
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    with np.errstate(over="ignore"):
        width = min(size, n)
        total = np.full(n - width + 1, width * 0x51ED27, np.uint64)
        for j in range(width):
            total += h[j : n - width + 1 + j] * _MULTIPLIERS[j % 5] * np.uint64(2 * (j // 5) + 1)
        return np.unique(mix64(total).view(np.int64))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: long): component is the smallest node reachable.

    Alternating large-star and small-star rounds on written tables, until nothing changes: a path of n nodes takes
    some log n rounds. A hub's edges meet its minimum in a plain sort-merge join, whose skewed side adaptive execution
    splits; minima are partial aggregates. Only the last round's tables are kept. Nodes without edges are not returned.
    """
    a, b = F.col("a"), F.col("b")
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    before = None
    while (after := now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()) != before:
        before = after
        if not after[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        nearest = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(now.join(nearest, now.lo == nearest.u).select("hi", F.col("m").alias("lo")).distinct(), "large")
        least = materialize(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), "least")
        small = large.join(least, large.hi == least.u).where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        old, now = now, materialize(small.union(least.select("u", "m")).distinct(), "edges")
        for t in (old, nearest, large, least):
            discard(t)
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)

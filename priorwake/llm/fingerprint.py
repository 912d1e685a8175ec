"""Document fingerprints: bottom-k sketches of word shingle hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, require, shingle_hashes

K = 256


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k smallest shingle hashes of a text, ascending; all of them where there are no more than k."""
    return shingle_hashes(text)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what a and b were made of."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    if len(a) < k:
        return float(len(a))
    return (k - 1) / ((float(a[k - 1]) + 2.0**63 + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity, exact where both are whole; two empty sketches resemble each other fully."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; an empty a is contained in everything."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return len(np.intersect1d(a, b, assume_unique=True)) / len(a)
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, common / distinct_count(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<i8").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<i8")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per document: doc_id, fingerprint (base64 of int64), n_shingles (estimate). No shuffle.

    A null or empty text has the empty fingerprint; equal texts have equal ones; rows with equal ids stay apart.
    """
    require(docs, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sketch(t, k) for t in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "fingerprint": [encode(x) for x in made], "n_shingles": pa.array([distinct_count(x, k) for x in made], pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"doc_id {kind}, fingerprint string, n_shingles double")


def merge_fingerprints(prints: DataFrame, key: str, *, k: int = K, salts: int = 64) -> DataFrame:
    """(key, fingerprint, n_shingles) of all fingerprints of each key, as if their texts were one.

    Each salt keeps its k smallest hashes before the key's salts meet, so a key that holds a third of all rows costs
    its last task salts * k hashes.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [decode(s) if s else np.empty(0, np.int64) for s in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
            yield pa.record_batch({"key": b.column(0).take(pa.array(at)), "h": pa.array(np.concatenate(hashes) if hashes else np.empty(0, np.int64), pa.int64())})

    kind = prints.schema[key].dataType.simpleString()
    rows = prints.select(key, "fingerprint").mapInArrow(unpack, f"key {kind}, h long").withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts)))
    rows = rows.groupBy("key", "salt", "h").agg(F.lit(1).alias("one"))
    for by in (["key", "salt"], ["key"]):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= k)
    lists = rows.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("hs"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.array(x, np.int64) for x in b.column(1).to_pylist()]
            yield pa.record_batch({"key": b.column(0), "fingerprint": [encode(x) for x in made], "n_shingles": pa.array([distinct_count(x, k) for x in made], pa.float64())})

    return lists.mapInArrow(pack, f"key {kind}, fingerprint string, n_shingles double").withColumnRenamed("key", key)


def edited(text: str, following: str) -> str:
    """The last third of a text (floor, code points) replaced by as much of the start of the following one, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_following(docs: DataFrame, work, schema: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs work(triples) over (doc_id, text, following text) of all documents, in descending order of ids.

    The document after the last is the first. One shuffle moves each text once: ids near quantiles cut the ids into
    buckets, each bucket is sorted within its partition, and its first row is also sent to the end of the bucket above,
    whose last row it follows. Null ids come last, equal ids are ordered by text, descending.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [(i + 1) / n for i in range(n)], 20 * n).alias("q")).first()["q"]
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(cuts, b.column(0).drop_null().to_numpy(zero_copy_only=False))
            yield pa.record_batch({"b": pa.array(at, pa.int32()), "id": b.column(0).drop_null()})

    # The largest id of each bucket that has any: at most n + 1 rows. They are the upper bounds from here on.
    heads = ids.mapInArrow(bucket, "b int, id long").groupBy("b").agg(F.max("id").alias("id")).collect()
    bounds = np.array(sorted(r["id"] for r in heads), np.int64)
    m = len(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = np.asarray(b.column(0).is_valid())
            i = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.where(known, np.searchsorted(bounds, i), 0).astype(np.int32)
            first = np.flatnonzero(known & (bounds[at] == i)) if m else np.arange(len(i))
            yield pa.record_batch({"bucket": at, "copy": pa.array(np.zeros(len(i), bool)), "id": b.column(0), "text": b.column(1)})
            if len(first):
                up = (at[first] + 1) % max(m, 1)
                take = pa.array(first)
                yield pa.record_batch({"bucket": up.astype(np.int32), "copy": pa.array(np.ones(len(first), bool)), "id": b.column(0).take(take), "text": b.column(1).take(take)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.mapInArrow(deal, "bucket int, copy boolean, id long, text string").repartition(partitions(spark), "bucket")
    rows = rows.sortWithinPartitions("bucket", "copy", F.col("id").desc_nulls_last(), F.col("text").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def triples():
            held = None
            for b in batches:
                for at, copy, i, t in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                    if held and held[0] == at:
                        yield held[1], held[2], t
                        held = None
                    if not copy:
                        held = (at, i, t)

        yield from work(triples())

    return rows.mapInArrow(run, schema)


def edit_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and what they tell of each other and of the next text."""

    def work(triples) -> Iterator[pa.RecordBatch]:
        last, cols = (None, None), []

        def flush():
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained", "n_shingles"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*cols, strict=True), kinds, strict=True)], names)

        for i, text, following in triples:
            own = last[1] if text is last[0] else sketch(text, k)
            other = edited(text, following)
            theirs, after = sketch(other, k), sketch(following, k)
            last = (following, after)
            cols.append((i, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), encode(own), encode(theirs), resemblance(own, theirs, k), resemblance(own, after, k), containment(own, theirs, k), distinct_count(own, k)))
            if len(cols) == 500:
                yield flush()
                cols.clear()
        if cols:
            yield flush()

    return with_following(
        docs,
        work,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained double, n_shingles double",
        id_col=id_col,
        text_col=text_col,
    )


def op2_query(spark, sf_dir: str) -> DataFrame:
    return edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, partitions, require, trimmed

TABLES, HASHES, PROBES, SEED = 10, 3, 8, 7
#: Alternatives per hash from which the probes are taken.
ALTERNATIVES = 4
#: Rows of a part of a bucket, and most bytes of their vectors; parts are compared with each other pair by pair.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Products that are held at once.
STRIP = 1 << 19


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    rows, n = x.shape
    h = 1
    while h < n:
        y = x.reshape(rows, -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(8)
def _signs(width: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).choice([-1.0, 1.0], (tables, hashes, 3, width))


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """int64 codes [rows, tables, 1 + probes] of unit rows; the first of each table is the row's own bucket.

    A hash is the signed axis nearest to the rotated row. The probes are the combinations of near axes with the least
    squared loss, over the hashes of a table together.
    """
    rows, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((rows, width))
    padded[:, :d] = x
    near = min(ALTERNATIVES, width)
    combos = np.array(list(product(range(near), repeat=hashes)))
    out = np.zeros((rows, tables, 1 + probes), np.int64)
    for t, signs in enumerate(_signs(width, tables, hashes, seed)):
        axes, loss = [], np.zeros((rows, len(combos)))
        for k in range(hashes):
            y = padded
            for s in signs[k]:
                y = hadamard(y * s)
            at = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(y, at, 1)
            axes.append(at * 2 + (value > 0))
            gap = np.abs(value[:, :1]) - np.abs(value)
            loss += gap[:, combos[:, k]] ** 2
        best = np.argsort(loss, axis=1, kind="stable")[:, : 1 + probes]
        for k in range(hashes):
            out[:, t, : best.shape[1]] += np.take_along_axis(axes[k], combos[best][:, :, k], 1) * (2 * width) ** k
        out[:, t, best.shape[1] :] = out[:, t, :1]
        # Lengths never meet: the length is part of the code.
        out[:, t] = out[:, t] * 65_537 + d
    return out


def _vectors(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The vectors as doubles; None for those that are null, empty, zero or not finite throughout."""
    flat, ends = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
    nulls = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    if column.null_count:  # flatten() leaves out what null lists cover
        sizes = [0 if x is None else x for x in column.value_lengths().to_pylist()]
        ends = np.r_[0, np.cumsum(sizes)]
    for i, ok in enumerate(column.is_valid().to_pylist()):
        v = values[ends[i] : ends[i + 1]]
        good = ok and len(v) and not nulls[ends[i] : ends[i + 1]].any() and np.isfinite(v).all() and v.any()
        yield v if good else None


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def _classes(df: DataFrame) -> DataFrame:
    """(vec_id, cls): the class of equal vectors, null for those that link with nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = [None if v is None else xxhash.xxh3_64_intdigest((v + 0.0).tobytes()) - 2**63 for v in _vectors(b.column(1))]
            yield pa.record_batch({"vec_id": b.column(0), "cls": pa.array(cls, pa.int64())})

    return df.mapInArrow(work, "vec_id long, cls long")


def _distinct_vectors(df: DataFrame) -> DataFrame:
    """(cls, v binary of doubles), one row a class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = {xxhash.xxh3_64_intdigest((v + 0.0).tobytes()) - 2**63: v.tobytes() for v in _vectors(b.column(1)) if v is not None}
            yield pa.record_batch({"cls": pa.array(list(made), pa.int64()), "v": pa.array(list(made.values()), pa.binary())})

    return df.mapInArrow(work, "cls long, v binary").dropDuplicates(["cls"])


def _stack(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit rows) for each length of vector in a column of binaries."""
    rows = [_unit(np.frombuffer(v.as_buffer(), np.float64)) for v in column]
    lengths = np.array([len(v) for v in rows])
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, np.stack([rows[i] for i in at])


def _bucket_rows(vectors: DataFrame, **how) -> DataFrame:
    """(tab, bucket, own, cls): where each class lives and where it probes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for j in range(0, whole.num_rows, 2048):
                b = whole.slice(j, 2048)
                cls = b.column(0).to_numpy()
                for at, x in _stack(b.column(1)) if b.num_rows else ():
                    codes = buckets(x, **how)
                    n, tables, width = codes.shape
                    own = np.zeros((n, tables, width), bool)
                    own[:, :, 0] = True
                    keep = own | (codes != codes[:, :, :1])
                    tab = np.broadcast_to(np.arange(tables, dtype=np.int32)[None, :, None], codes.shape)
                    who = np.broadcast_to(cls[at][:, None, None], codes.shape)
                    yield pa.record_batch({"tab": tab[keep], "bucket": codes[keep], "own": pa.array(own[keep]), "cls": who[keep]})

    return vectors.mapInArrow(trimmed(work), "tab int, bucket long, own boolean, cls long")


def _first_meeting(codes: np.ndarray, i: np.ndarray, j: np.ndarray, tab: int, bucket: int) -> np.ndarray:
    """Places of the pairs (i, j) of rows with codes [rows, tables, 1 + probes] that meet here first over tables and buckets."""
    left = np.arange(len(i))
    for t in range(tab + 1):
        a, b = codes[i[left], t], codes[j[left], t]
        into_a, into_b = (b == a[:, :1]).any(1), (a == b[:, :1]).any(1)
        if t < tab:
            left = left[~(into_a | into_b)]
        else:
            at_a, at_b = np.where(into_a, a[:, 0], np.iinfo(np.int64).max), np.where(into_b, b[:, 0], np.iinfo(np.int64).max)
            left = left[np.minimum(at_a, at_b) == bucket]
    return left


def _linked(x: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of the pairs of rows with cosine >= least, in double precision, strip by strip."""
    n, step = len(x), max(1, STRIP // max(1, len(x)))
    for k in range(0, n, step):
        product = x[k : k + step] @ x[k:].T
        i, j = np.nonzero(product >= least - 1e-9)
        later = i < j
        i, j = i[later], j[later]
        cos = product[i, j]
        close = np.flatnonzero(np.abs(cos - least) < 1e-9)  # the order of a sum may decide: these are summed alike everywhere
        for c in range(0, len(close), 1024):
            some = close[c : c + 1024]
            cos[some] = np.einsum("ij,ij->i", x[k + i[some]], x[k + j[some]])
        yes = cos >= least
        yield i[yes] + k, j[yes] + k


class _Sets:
    """Disjoint sets of n places, joined by arrays of pairs; the root is the smallest place."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _compare(rows: DataFrame, least: float, **how) -> DataFrame:
    """(cls, root, links) of each block of each bucket: links are counted, never listed, and root connects the block."""

    def block(tab: int, bucket: int, bi: int, bj: int, t: pa.Table) -> pa.RecordBatch | None:
        own, blk, cls, mult = (t.column(c).to_numpy(zero_copy_only=False) for c in ("own", "blk", "cls", "mult"))
        if not own.any() or len(cls) < 2:
            return None
        order = np.argsort(cls, kind="stable")  # pairs have the smaller class first, so a pair's sum is the same everywhere
        own, blk, cls, mult = own[order], blk[order], cls[order], mult[order]
        v = t.column("v").combine_chunks().take(pa.array(order))
        x = np.stack([_unit(np.frombuffer(v[k].as_buffer(), np.float64)) for k in range(len(v))])
        sets, links, used = _Sets(len(cls)), np.zeros(len(cls), np.int64), np.zeros(len(cls), bool)
        codes = None
        for i, j in _linked(x, least):
            # In a block of two parts only pairs across them are new.
            new = (own[i] | own[j]) & (blk[i] != blk[j] if bi != bj else True)
            i, j = i[new], j[new]
            if not len(i):
                continue
            codes = buckets(x, **how) if codes is None else codes
            sets.join(i, j)
            used[i] = used[j] = True
            for k in range(0, len(i), 20_000):
                a, b = i[k : k + 20_000], j[k : k + 20_000]
                first = _first_meeting(codes, a, b, tab, bucket)
                np.add.at(links, a[first], mult[b[first]])
                np.add.at(links, b[first], mult[a[first]])
        if codes is None:
            return None
        return pa.record_batch({"cls": cls[used], "root": cls[sets.root][used], "links": links[used]})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(4)], 1) if b.num_rows else np.empty((0, 4))
            ends = np.r_[np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)] if len(keys) else []
            start = 0
            for end in ends:
                now = tuple(int(v) for v in keys[start])
                if now != key and held:
                    if (out := block(*key, pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                key = now
                held.append(b.slice(start, end - start))
                start = end
        if held and (out := block(*key, pa.Table.from_batches(held))) is not None:
            yield out

    return rows.mapInArrow(trimmed(work), "cls long, root long, links long")


def embedding_duplicates(
    df: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.9,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Pairs with cosine >= least link when they meet in a bucket of one of the tables, as owner and owner or owner
    and prober; each is verified in double precision. With the defaults a pair at cosine 0.9 in 64 dimensions is
    found with probability 0.9995, nearer ones more surely. Equal vectors are one class, so copies cost nothing and
    link with certainty. A bucket of over `block` rows (fewer where vectors are so wide that BLOCK_BYTES would be
    exceeded) is cut into parts, and every pair of parts is a group of its own. Links are counted where a pair first
    meets and never listed; products are made strip by strip, so a group of near copies costs time but no memory.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths never link. Rows with equal or null ids are rows of their own; component_id is the smallest id of the
    component, null if it has none. An empty table gives an empty result.
    """
    require(df, id_col, vector_col)
    how = {"tables": tables, "hashes": hashes, "probes": probes, "seed": seed}
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    ids = materialize(_classes(rows), "classes")
    classes = ids.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("mult"), F.min("vec_id").alias("first"))
    classes = materialize(classes, "copies")
    vectors = materialize(_distinct_vectors(rows).join(classes.select("cls", "mult"), "cls"), "vectors")

    widest = vectors.agg(F.max(F.octet_length("v"))).first()[0] or 8
    block = max(2, min(block, BLOCK_BYTES // widest))
    placed = materialize(_bucket_rows(vectors.select("cls", "v"), **how), "buckets")
    full = placed.groupBy("tab", "bucket").agg(F.count("*").alias("m"), F.count_if("own").alias("owners")).where("m > 1 AND owners > 0")
    full = materialize(full.select("tab", "bucket", F.ceil(F.col("m") / block).cast("int").alias("parts")), "full")
    met = placed.join(full, ["tab", "bucket"]).withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other"))
    met = met.join(vectors, "cls").select("tab", "bucket", "bi", "bj", "own", "blk", "cls", "mult", "v")
    met = met.repartition(partitions(df.sparkSession), "tab", "bucket", "bi", "bj").sortWithinPartitions("tab", "bucket", "bi", "bj")
    found = materialize(_compare(met, least, **how), "found")
    for t in (placed, full, vectors):
        discard(t)

    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("g", F.coalesce("component", "cls")).join(links, "cls", "left")
    named = materialize(named.select("cls", "mult", "first", "g", F.coalesce("links", F.lit(0)).alias("links")), "named")
    named = named.join(named.groupBy("g").agg(F.min("first").alias("component_id")), "g").select("cls", "component_id", (F.col("mult") - 1 + F.col("links")).alias("n_links"))
    out = ids.join(materialize(named, "result"), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_query(spark, sf_dir: str) -> DataFrame:
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

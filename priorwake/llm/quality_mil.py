"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of WORDS words. Every passage is described by the shares of its bytes' kinds and by
how its words repeat, and encoded by one layer; gated attention weighs the encodings, and the weighted sum is scored.
Encoder, gates and scorer are learned together from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

WORDS = 100
#: Most labelled documents that the classifier is fitted on, taken in the order of a hash of their ids.
SAMPLE = 3000
ENCODED, GATES = 24, 12
SLICE = 1 << 20

_KINDS = (b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" ", b"\t\x0b\x0c\r", b"\n", b".", b",", b"!", b"?", b"|", b"%", b"$", b"&", b"*", b"#", b"@", b"'\"`", b"-_", b":;", b"()[]{}", b"<>/=+\\^~", bytes(range(128, 192)), bytes(range(192, 256)))
_OF = np.full(256, len(_KINDS), np.int64)
for _i, _k in enumerate(_KINDS):
    _OF[list(_k)] = _i
_NK = len(_KINDS) + 1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_RANDOM = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
FEATURES = _NK + 7


def _byte_runs(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of texts of about `most` bytes; a longer text is a run of its own."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield flat[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def passages(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features [passage, FEATURES], first passage of each text and the end). A text without words is one passage of zeros."""
    n = len(offsets) - 1
    solid = ~_BLANK[b]
    start = solid.copy()
    if len(b):
        inner = offsets[1:-1]
        joined = solid[1:] & solid[:-1]
        edge = np.zeros(len(b), bool)
        edge[inner[inner < len(b)]] = True
        start[1:] &= ~joined | edge[1:]
    words_at = np.flatnonzero(start)
    doc_of_word = np.searchsorted(offsets, words_at, "right") - 1
    per_doc = np.bincount(doc_of_word, minlength=n)
    many = np.maximum(1, -(-per_doc // WORDS))
    first = np.r_[0, np.cumsum(many)]
    before = np.cumsum(per_doc) - per_doc
    bag = first[doc_of_word] + (np.arange(len(words_at)) - before[doc_of_word]) // WORDS
    x = np.zeros((first[-1], FEATURES))
    if not len(words_at):
        return x, first
    # Every byte belongs to the passage of the word before it, those before the first word to the first passage.
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    word = np.cumsum(start) - 1
    own = np.where((word >= 0) & (doc_of_word[np.maximum(word, 0)] == doc_of_byte), bag[np.maximum(word, 0)], first[doc_of_byte])
    kinds = np.bincount(own * _NK + _OF[b], minlength=first[-1] * _NK).reshape(-1, _NK)
    x[:, :_NK] = kinds / np.maximum(1, kinds.sum(1, keepdims=True))
    place = np.minimum(np.arange(len(b)) - words_at[np.maximum(word, 0)], 63)
    mixed = np.where(solid & (word >= 0), _RANDOM[b] * _PLACE[place], np.uint64(0))
    h = np.add.reduceat(mixed, words_at)
    length = np.add.reduceat((solid & (word >= 0)).astype(np.int64), words_at)
    count = np.bincount(bag, minlength=first[-1])
    per = lambda v: np.bincount(bag, weights=v, minlength=first[-1]) / np.maximum(1, count)
    again = np.r_[False, (h[1:] == h[:-1]) & (bag[1:] == bag[:-1])]
    twice = np.zeros(len(h), bool)
    twice[2:] = (h[2:] == h[:-2]) & (bag[2:] == bag[:-2])
    order = np.lexsort((h, bag))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (bag[order][1:] != bag[order][:-1])]
    distinct = np.bincount(bag[order][new], minlength=first[-1])
    x[:, _NK] = per(length) / 10
    x[:, _NK + 1] = per((length > 12).astype(float))
    x[:, _NK + 2] = per(again.astype(float))
    x[:, _NK + 3] = per(twice.astype(float))
    x[:, _NK + 4] = distinct / np.maximum(1, count)
    x[:, _NK + 5] = np.log1p(count) / 5
    x[:, _NK + 6] = per(_UPPER[b[words_at]].astype(float))
    return x, first


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray):
        w, at = self.weights, first[:-1]
        h = np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["w"]
        bag = np.repeat(np.arange(len(at)), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return _sigmoid(z @ w["c"] + w["d"]), (h, t, s, a, z, bag, at)

    def score(self, texts: pa.Array) -> np.ndarray:
        parts = [self.forward(*passages(b, offsets))[0] for b, offsets in _byte_runs(texts)]
        return np.concatenate(parts) if parts else np.empty(0)


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, *, steps: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Model:
    """Full-batch Adam on the mean log loss of the documents."""
    rng = np.random.default_rng(seed)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {"W": init(x.shape[1], ENCODED), "b": np.zeros(ENCODED), "V": init(ENCODED, GATES), "U": init(ENCODED, GATES), "w": init(GATES), "c": init(ENCODED), "d": np.array(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))}
    model = Model(x.mean(0), x.std(0) + 1e-3, weights)
    scaled = ((x - model.mean) / model.scale).clip(-8, 8)
    m = {k: np.zeros_like(v) for k, v in weights.items()}
    v2 = {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, steps + 1):
        p, (h, t, s, a, z, bag, at) = model.forward(x, first)
        dl = (p - y) / len(y)
        dz = dl[:, None] * weights["c"]
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, at)[bag])
        dg = de[:, None] * weights["w"]
        dt, ds = dg * s * (1 - t**2), dg * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ weights["V"].T + ds @ weights["U"].T
        dp = dh * (1 - h**2)
        grads = {"W": scaled.T @ dp, "b": dp.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ dl, "d": dl.sum()}
        for k, g in grads.items():
            g = g + decay * weights[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.999 * v2[k] + 0.001 * g * g
            weights[k] = weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(labelled: DataFrame, *, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", sample: int = SAMPLE, seed: int = 5) -> Model:
    """A model of at most `sample` labelled documents, the first by a hash of id and text; texts stay on the cluster, passage features come.

    Without documents of both labels the model scores every text with the smoothed share of label 1.
    """
    require(labelled, text_col, label_col, id_col)
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.xxhash64(F.lit(seed), id_col, text_col).alias("k"), F.col(label_col).cast("int").alias("y"), F.col(text_col).alias("text"))
    # The cut is found on hashes alone; then only the chosen texts are read.
    chosen = rows.select("k").orderBy("k").limit(sample).agg(F.max("k")).first()[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for flat, offsets in _byte_runs(b.column(2)):
                x, first = passages(flat, offsets)
                n = len(offsets) - 1
                for i in range(n):
                    f = x[first[i] : first[i + 1]].astype(np.float32)
                    yield pa.record_batch({"k": b.column(0).slice(at + i, 1), "y": b.column(1).slice(at + i, 1), "f": pa.array([f.tobytes()], pa.binary())})
                at += n

    if chosen is None:
        return train(np.zeros((2, FEATURES)), np.array([0, 1, 2]), np.array([0, 1]), steps=1)
    got = rows.where(F.col("k") <= chosen).mapInArrow(work, "k long, y int, f binary").toArrow().sort_by("k")
    bags = [np.frombuffer(f, np.float32).reshape(-1, FEATURES) for f in got.column("f").to_pylist()]
    y = np.array(got.column("y").to_pylist(), float)
    first = np.r_[0, np.cumsum([len(x) for x in bags])]
    return train(np.concatenate(bags).astype(float), first, y, seed=seed, steps=250 if 0 < y.sum() < len(y) else 1)


def score_quality(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score of 0 to 1 of each whole text; null and empty texts are scored as one passage of zeros. No shuffle."""
    require(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.score(texts), pa.float64())

    return docs.withColumn(out, read(F.col(text_col)))


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    # Labels are few columns of few rows: their side is shuffled, and the texts of the sample only are read twice.
    marked = labels.where(F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    model = fit(_sampled(docs.select("doc_id", "text"), marked))
    out = score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))


def _sampled(docs: DataFrame, marked: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents of the first `sample` labels in a hash order, with their label: at most so many rows, so they are broadcast."""
    few = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.join(F.broadcast(few), "doc_id")

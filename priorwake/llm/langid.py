"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

Text likelihoods come from byte trigrams counted over all labelled texts. What a declaration or a suffix says is
learned from how the text's languages spread over it, by grouped sums of the texts' own posteriors; a host's prior is
smoothed towards its domain's and that towards the corpus's. A document's own share is taken off all these sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, require, trim, trimmed

BUCKETS = 1 << 14
#: Trigrams overlap, so their evidence counts for a part.
TEMPER = 0.25
#: Most bytes that are scored at once.
SLICE = 1 << 19
#: Most bytes of a host table that is broadcast; a larger one is joined by its key.
SMALL = 16 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, A-Z lowered; offsets) of runs of texts of about SLICE bytes; a longer text is a run of its own."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, "right")) - 1)
        yield _LOWER[flat[offsets[start] : offsets[end]]], offsets[start : end + 1] - offsets[start]
        start = end


def _trigrams(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and whether it lies within one text."""
    code = np.zeros(len(b), np.uint32)
    if len(b) > 2:
        x = b.astype(np.uint32)
        code[:-2] = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(18)
    inside = np.ones(len(b), bool)
    for back in (1, 2):
        at = offsets[1:] - back
        inside[at[at >= offsets[:-1]]] = False
    return code, inside


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    seen: tuple[tuple[np.ndarray, np.ndarray], ...]  # by language: its buckets and their logs
    unseen: tuple[float, ...]  # by language: the log of every other bucket

    def row(self, language: int) -> np.ndarray:
        logs = np.full(BUCKETS, self.unseen[language])
        buckets, own = self.seen[language]
        logs[buckets] = own
        return logs

    def likelihoods(self, texts: pa.Array) -> np.ndarray:
        """[text, language + 2]: tempered log likelihoods, share of letters among what is no white space, trigrams."""
        parts = []
        for b, offsets in _slices(texts):
            code, inside = _trigrams(b, offsets)
            sums = lambda v: (lambda c: c[offsets[1:]] - c[offsets[:-1]])(np.r_[0.0, np.cumsum(v, dtype=np.float64)])
            cols = [sums(np.where(inside, self.row(k)[code], 0.0)) * TEMPER for k in range(len(self.languages))]
            solid = sums(~_SPACE[b])
            cols += [sums(_LETTER[b]) / np.maximum(solid, 1), sums(inside)]
            parts.append(np.stack(cols, 1))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages) + 2))


def fit_text_model(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Add-half trigram frequencies of every language, of all texts with a label.

    Labels are compared by the code that they start with, so regional tags count for their language; a label that
    starts with none is lowered and stays a language of its own, a blank one is no label. What comes to the driver are
    the counts of the buckets that a language has, at most BUCKETS each. Without labelled texts the model has no languages
    and everything is rejected.
    """
    require(labelled, text_col, lang_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = np.array(batch.column(0).to_pylist(), object), 0
            for b, offsets in _slices(batch.column(1)):
                code, inside = _trigrams(b, offsets)
                n = len(offsets) - 1
                names, own = np.unique(langs[at : at + n], return_inverse=True)
                owner = np.repeat(own.astype(np.int32), np.diff(offsets))
                for k, lang in enumerate(names):
                    counts = np.bincount(code[inside & (owner == k)], minlength=BUCKETS)
                    total[lang] = total.get(lang, 0) + counts
                at += n
                if len(total) > 256:
                    yield from given(total)
                    total.clear()
        yield from given(total)

    def given(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.record_batch({"lang": pa.array([lang] * len(some), pa.string()), "bucket": some.astype(np.int32), "n": counts[some].astype(np.int64)})

    label = F.col(lang_col).cast("string")
    blank = F.trim(label) == ""
    rows = labelled.select(F.when(~blank, F.coalesce(code_of(label), F.lower(F.trim(label)))).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL")
    counts = materialize(rows.mapInArrow(trimmed(work), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    lists = counts.groupBy("lang").agg(F.sum("n").alias("all"), F.collect_list(F.struct("bucket", "n")).alias("own"))
    t = lists.select("lang", "all", F.col("own.bucket").alias("bucket"), F.col("own.n").alias("n")).toArrow().sort_by([("all", "descending"), ("lang", "ascending")])
    seen, unseen = [], []
    for k in range(t.num_rows):
        whole = t.column("all")[k].as_py() + 0.5 * BUCKETS
        buckets, n = (t.column(c)[k].values.to_numpy() for c in ("bucket", "n"))
        seen.append((buckets, np.log((n + 0.5) / whole)))
        unseen.append(float(np.log(0.5 / whole)))
    return TextModel(tuple(t.column("lang").to_pylist()), tuple(seen), tuple(unseen))


def code_of(value: Column) -> Column:
    """The two or three letters that a language tag starts with, lowered; null for anything else."""
    code = F.regexp_extract(F.lower(F.trim(value)), r"^([a-z]{2,3})(?![a-z])", 1)
    return F.when(code != "", code)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(url: Column) -> Column:
    """A language-like first step of the path, else the last label of the host."""
    step = code_of(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2}(?:-[A-Za-z]{2})?)(?:[/?#]|$)", 1))
    return F.coalesce(F.concat(F.lit("/"), step), F.concat(F.lit("."), code_of(F.substring_index(host_of(url), ".", -1))))


def visible_text(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>|&[a-z0-9#]{1,8};", " ")


def declared_of(html: Column) -> Column:
    return code_of(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1))


def _sums(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)])


def identify(
    rows: DataFrame,
    model: TextModel,
    *,
    text: Column,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    strength: float = 5.0,
    least: float = 0.6,
    letters: float = 0.3,
) -> DataFrame:
    """rows with _lang, _confidence, _text_lang, _rejected; all other columns are kept as they are, those of these names are replaced.

    _lang is the language of the highest posterior, of equal ones the first of the model. A row is rejected, with _lang
    null, if its text is null or has no letters, if letters are less than `letters` of what is no white space, or if the
    posterior stays below `least`. Rows without a declaration, suffix or host simply lack that evidence; null hosts share
    no prior. Repeated rows are evidence for each other. Texts are scored whole, the fusion is one pass over a row's sums without Python, and
    texts are not shuffled as long as the host table has at most SMALL bytes and is broadcast; a larger one is joined, with
    null hosts spread over all tasks. An empty table gives no rows.
    """
    n = len(model.languages)
    results = ("_lang", "_confidence", "_text_lang", "_rejected")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in results]
    none = F.lit(None).cast("string")
    if not n:
        return rows.select(*kept, none.alias("_lang"), F.lit(0.0).alias("_confidence"), none.alias("_text_lang"), F.lit(True).alias("_rejected"))
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def read(texts: pa.Array) -> pa.Array:
        made = held.value.likelihoods(texts)
        made = np.concatenate((made, _posterior(made, n)), 1)
        trim()
        return pa.ListArray.from_arrays(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32), made.ravel())

    # Filters on its result stay above it; below, they would read each text once more, in a second worker of the task.
    read = read.asNondeterministic()
    facts = {"lid__dec": code_of(declared) if declared is not None else none, "lid__suf": suffix if suffix is not None else none, "lid__host": host if host is not None else none}
    facts["lid__dom"] = domain if domain is not None else facts["lid__host"]
    rows = rows.select(*kept, read(text).alias("lid__r"), *[v.alias(k) for k, v in facts.items()])
    keys = [k for k in facts]
    seen = materialize(rows.select(*keys, F.slice("lid__r", n + 3, n).alias("p"), F.col("lid__r")[n + 1].alias("m")).where("m > 0").drop("m"), "posteriors")
    everything = seen.agg(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)]).first()
    base = np.array([everything[f"s{i}"] for i in range(n)]) + 0.5
    base = base / base.sum()

    def evidence(key: str, name: str) -> tuple[DataFrame, np.ndarray, int]:
        """(key, name): the sums of a key, which is a short code, so there are at most some 40,000; their totals; the number of keys."""
        t = materialize(_sums(seen.where(F.col(key).isNotNull()), [key], n), name)
        total = t.agg(F.count("*").alias("k"), *[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"t{i}") for i in range(n)]).first()
        return t.select(key, F.array(*[f"s{i}" for i in range(n)]).alias(name)), np.array([total[f"t{i}"] for i in range(n)]), total["k"]

    dec, dec_total, decs = evidence("lid__dec", "lid__dec_sums")
    suf, suf_total, sufs = evidence("lid__suf", "lid__suf_sums")
    hosts = _sums(seen.where(F.col("lid__host").isNotNull()), ["lid__host", "lid__dom"], n)
    domains = _sums(hosts.withColumn("p", F.array(*[f"s{i}" for i in range(n)])), ["lid__dom"], n)
    hosts = hosts.select("lid__host", "lid__dom", F.array(*[f"s{i}" for i in range(n)]).alias("lid__hs"))
    domains = domains.select("lid__dom", F.array(*[f"s{i}" for i in range(n)]).alias("lid__ds"))
    hosts = materialize(hosts.join(domains, "lid__dom").select(F.col("lid__host").alias("lid__h2"), F.col("lid__dom").alias("lid__d2"), "lid__hs", "lid__ds"), "hosts")
    size = hosts.agg(F.sum(F.octet_length("lid__h2") + F.octet_length("lid__d2") + F.lit(16 * n + 64))).first()[0] or 0
    out = rows.join(F.broadcast(dec), "lid__dec", "left").join(F.broadcast(suf), "lid__suf", "left")
    if size <= SMALL:
        out = out.join(F.broadcast(hosts), (out["lid__host"] == hosts["lid__h2"]) & (out["lid__dom"] == hosts["lid__d2"]), "left")
    else:  # no host has a zero byte, so these keys meet nothing
        key = F.coalesce("lid__host", F.concat(F.lit("\x00"), F.pmod(F.hash("lid__r"), F.lit(4093)).cast("string")))
        out = out.withColumn("lid__key", key)
        out = out.join(hosts, (out["lid__key"] == hosts["lid__h2"]) & (out["lid__dom"] == hosts["lid__d2"]), "left")

    # The fusion runs in the JVM, on arrays with a place for each language: a task has one Python worker, for the texts.
    both, total_of = F.zip_with, lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    vector = lambda values: F.array(*[F.lit(float(v)) for v in values])
    less = lambda sums: F.coalesce(both(sums, "lid__own", lambda v, o: F.greatest(v - o, F.lit(0.0))), vector([0.0] * n))
    smooth = lambda sums, whole, up: both(sums, up, lambda v, u: (v + strength * u) / (F.col(whole) + strength))

    def told(sums: str, whole: np.ndarray, k: int) -> Column:
        rest = both(vector(whole), "lid__own", lambda t, o: F.greatest(t - o, F.lit(0.0)) + F.lit(0.5 * (k + 1)))
        return F.when(F.col(sums).isNotNull(), both(less(sums), rest, lambda v, r: F.log((v + 0.5) / r))).otherwise(vector([0.0] * n))

    plus = lambda x, y: both(x, y, lambda v, w: v + w)
    r, names = F.col("lid__r"), F.array(*[F.lit(x) for x in model.languages])
    out = out.select(*kept, F.slice(r, 1, n).alias("lid__logs"), F.slice(r, n + 3, n).alias("lid__own"), r[n].alias("lid__letters"), r[n + 1].alias("lid__seen"), "lid__hs", "lid__ds", "lid__dec_sums", "lid__suf_sums")
    out = out.withColumns({"lid__h1": less("lid__hs"), "lid__d1": less("lid__ds")})
    out = out.withColumns({"lid__hn": total_of("lid__h1"), "lid__dn": total_of("lid__d1")})
    prior = smooth("lid__h1", "lid__hn", smooth("lid__d1", "lid__dn", vector(base)))
    fused = both("lid__logs", prior, lambda v, p: v + F.log(p))
    out = out.withColumn("lid__total", plus(plus(fused, told("lid__dec_sums", dec_total, decs)), told("lid__suf_sums", suf_total, sufs)))
    out = out.withColumn("lid__most", F.array_max("lid__total"))
    out = out.withColumn("lid__post", F.transform("lid__total", lambda v: F.exp(v - F.col("lid__most"))))
    out = out.withColumn("lid__sure", F.lit(1.0) / total_of("lid__post"))
    out = out.withColumn("lid__no", (F.col("lid__letters") < letters) | (F.col("lid__letters") <= 0) | (F.col("lid__sure") < least))
    first = lambda values, v: F.element_at(names, F.array_position(values, v).cast("int"))
    return out.select(
        *kept,
        F.when(~F.col("lid__no"), first("lid__post", F.lit(1.0))).alias("_lang"),
        F.round("lid__sure", 6).alias("_confidence"),
        F.when(F.col("lid__seen") > 0, first("lid__logs", F.array_max("lid__logs"))).alias("_text_lang"),
        F.col("lid__no").alias("_rejected"),
    )


def _posterior(read: np.ndarray, n: int) -> np.ndarray:
    """A text's own posteriors of the n languages; zeros for a text without trigrams."""
    soft = np.exp(read[:, :n] - read[:, :n].max(1, keepdims=True, initial=-np.inf))
    return np.where(read[:, n + 1 :] > 0, soft / soft.sum(1, keepdims=True), 0.0)


def identify_pages(pages: DataFrame, model: TextModel, **how) -> DataFrame:
    """identify() of web pages (url, html)."""
    require(pages, "url", "html")
    url, html = F.col("url"), F.col("html")
    return identify(pages, model, text=visible_text(html), declared=declared_of(html), suffix=suffix_of(url), host=host_of(url), domain=domain_of(host_of(url)), **how)


def identify_documents(docs: DataFrame, model: TextModel, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **how) -> DataFrame:
    """identify() of documents: lang is what they declare, source stands for the host."""
    require(docs, text_col, lang_col, source_col)
    return identify(docs, model, text=F.col(text_col), declared=F.col(lang_col), host=F.col(source_col).cast("string"), **how)


def op10_query(spark, sf_dir: str) -> DataFrame:
    model = fit_text_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
    return out.select("page_id", F.col("_lang").alias("lang"), F.col("_confidence").alias("confidence"), F.col("_text_lang").alias("text_lang"), F.col("_rejected").alias("rejected"))

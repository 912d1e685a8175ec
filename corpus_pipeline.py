"""The corpus pipeline: language, near-duplicates, secrets, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes each one's rows in the shared folder and reads
them again for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwake.llm import jaccard, langid, mixing, pieces, secrets
from priorwake.llm.common import materialize, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence settles; lang becomes that language.

    Rejected are null and empty texts, texts of few letters, and those whose posterior stays low (langid.identify);
    repeated rows are judged alike and all stay, other columns go, an empty table gives no rows.
    """
    small_batches(spark)
    model = langid.fit_text_model(docs)
    told = langid.identify_documents(docs, model)
    return told.where(~F.col("_rejected")).withColumn("lang", F.col("_lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar ones: of the rows with the id that names it, the one with the first text.

    Rows without shingles are in no component and all stay. Rows whose id is null or repeated are told apart by their
    sets of shingles, so each is decided by the component that its own text is in.
    """
    found = materialize(jaccard.similar_components(docs), "found")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    # Dropped are documents of another's component: their ids are joined, never their texts with each other.
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    kept = docs.where("doc_id IS NOT NULL").join(gone.unionByName(repeated).distinct(), "doc_id", "left_anti").select(*COLUMNS)
    unclear = docs.join(repeated, "doc_id", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))
    if not unclear.limit(1).count():
        return kept
    unclear = jaccard.with_set_id(unclear)
    named = found.where(F.col("set_id").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = named.select(F.col("doc_id").alias("id"), F.col("set_id").alias("set"), "component").distinct()
    heads = unclear.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("set_id") == F.col("set")))
    heads = heads.groupBy("component").agg(F.min(F.struct("text", *[c for c in COLUMNS if c != "text"])).alias("x")).select("x.*")
    return kept.unionByName(unclear.where("set_id IS NULL").select(*COLUMNS)).unionByName(heads.select(*COLUMNS))


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret blanked out that isn't a widely copied example; no document goes.

    Spans keep their length: each character of a span becomes an asterisk, so other offsets stay right.
    """
    found = secrets.scan_secrets(docs, keep=COLUMNS[1:])
    hidden = F.filter("spans", lambda x: ~x["copied"])
    blank = F.aggregate(
        hidden,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("s")),
        lambda acc, x: F.when(
            x["e"] > acc["at"],
            F.struct(
                x["e"].alias("at"),
                F.concat(acc["s"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.repeat(F.lit("*"), x["e"] - F.greatest(x["s"], acc["at"]))).alias("s"),
            ),
        ).otherwise(acc),
        lambda acc: F.concat(acc["s"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return found.withColumn("text", F.when(F.size(hidden) > 0, blank).otherwise(F.col("text"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target has it repeated; those taken no time go."""
    mixed = mixing.mix(docs, nearest=True, keep=("text", "lang", "n_chars"))
    return mixed.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their best pieces, the scores of the n best paths and whether decoding gives the text back.

    Every row gives a row, repeated ones alike; other columns go. A null or empty text has no pieces.
    """
    small_batches(spark)
    return pieces.digests(docs.select(*COLUMNS), pieces.Vocabulary.load()).select("doc_id", "lang", "source", "n_chars", "n_pieces", "score", "ids_sha256", "path_scores", "round_trip")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_free), ("mixture", mixture), ("pieces", encoded)]
#: Components, posteriors and lattice searches are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

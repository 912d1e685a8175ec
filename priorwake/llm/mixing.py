"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, require

BINS = 4096


def word_count(text) -> F.Column:
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def cyclic_weights(totals: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds weight 1, 2, .. cycle, repeating over the sources in the order of their code points, null last."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    return totals.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double"))


def water_fill(totals: DataFrame, max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """Adds target to (source, source_size, weight), one row a source.

    The budget is share times all sizes. A source never gets more than max_epochs times its size; what it leaves goes
    to the others by weight, until none is above. That fixed point is target = min(cap, level * weight) for one
    level: with the sources in ascending order of cap / weight, the clamped ones are a prefix, and the level after
    the first i clamps is (budget - their caps) / (the rest's weights). Where even all caps together stay below the
    budget, every source gets its cap; a weight of 0 or below gets 0. Works on one row a source, never on documents.
    """
    t = totals.withColumn("weight", F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    t = t.withColumn("ratio", ratio)
    order = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    live = F.col("weight") > 0
    t = (
        t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum(F.when(live, F.col("cap"))).over(order), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    )
    level = F.when(live & (F.col("all_weight") - F.col("weight_before") > 0), (F.col("budget") - F.col("caps_before")) / (F.col("all_weight") - F.col("weight_before")))
    # The first source in this order that its level does not clamp sets the level of all that follow.
    t = t.withColumn("level", level).withColumn("clamped", live & (F.col("cap") <= F.col("level") * F.col("weight")))
    final = F.min(F.when(live & ~F.col("clamped"), F.struct("ratio", "level"))).over(everything)
    t = t.withColumn("final", final["level"])
    target = F.when(~live, F.lit(0.0)).when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return t.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: float = 3.0,
    share: float = 1.0,
    cycle: int = 3,
    seed: int = 20240611,
    nearest: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, repeats, taken, plus the columns of keep.

    repeats = floor(target / source_size) for every document of a source; one more for those first in a seeded order
    whose sizes fill the fractional rest, so a source misses its target by less than one document, from below. With
    nearest the document that crosses the rest is taken too where that comes nearer and max_epochs allows it: a source
    then misses its target by at most half that document. The rule of OP6_SQL is the one without. The order is a
    hash of the seed and the id cut into BINS bins: bin totals are partial sums, and only the one bin in which the rest
    runs out is ordered row by row, so no task ever sees a whole source.
    Documents meet one row a source, a table that is broadcast while it is small; kept texts of the cut bins alone move.

    A null text has size 0 and is taken 0 times; a null source is a source of its own, the last. Documents with
    equal ids are separate rows and split a tie by size and text. Extra columns are left alone. An empty table gives
    an empty result.
    """
    require(docs, id_col, text_col, source_col)
    text = F.col(text_col)
    tie = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256), 1, 15)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text).alias("size"),
        F.conv(tie, 16, 10).cast("long").alias("u"),
        F.xxhash64(text).alias("content"),
        *[F.col(c).alias(f"keep_{c}") for c in keep],
    )
    base = materialize(base.withColumn("bin", F.shiftright("u", 60 - 12).cast("int")), "sizes")
    bins = base.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    bins = materialize(bins, "bins")
    totals = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    plan = materialize(water_fill(cyclic_weights(totals, cycle), max_epochs, share), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    cuts = (
        bins.join(plan, bins.source.eqNullSafe(plan.source))
        .drop(plan.source)
        .withColumn("whole", whole)
        .withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size"), 6))
        .withColumn("upto", F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")))
        .withColumn("before", F.col("upto") - F.col("bin_size"))
    )
    # One row a source: sizes are never negative, so its bins up to `full` lie inside the rest, and at most one is cut by it.
    crossed = (F.col("upto") > F.col("rest")) & (F.col("before") < F.col("rest"))
    cuts = cuts.groupBy("source", "source_size", "target", "whole", "rest").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("bin"))).alias("full"), F.max(F.when(crossed, F.col("bin"))).alias("cut"), F.max(F.when(crossed, F.col("before"))).alias("before")
    )
    cuts = materialize(cuts, "cuts")
    rows = base.join(cuts, base.source.eqNullSafe(cuts.source)).drop(cuts.source)
    inside, cut = F.coalesce(F.col("bin") <= F.col("full"), F.lit(False)), F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
    within = Window.partitionBy("source", "bin").orderBy("u", F.col("doc_id").asc_nulls_last(), "size", "content")
    plain = rows.where(~cut).withColumn("extra", F.when(inside & (F.col("size") > 0), F.lit(1)).otherwise(F.lit(0)))
    split = rows.where(cut).withColumn("run", F.col("before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    taken = F.col("run") <= F.col("rest")
    if nearest:
        over, under = F.col("run") - F.col("rest"), F.col("rest") - (F.col("run") - F.col("size"))
        taken |= (over < under) & (F.col("whole") * F.col("source_size") + F.col("run") <= F.col("source_size") * F.lit(float(max_epochs)))
    split = split.withColumn("extra", F.when(taken & (F.col("size") > 0), F.lit(1)).otherwise(F.lit(0))).drop("run")
    out = plain.unionByName(split)
    repeats = (F.col("whole") + F.col("extra")).cast("int")
    return out.select(
        "doc_id", "size", "source", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).cast("long").alias("taken"), *[F.col(f"keep_{c}").alias(c) for c in keep]
    )


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


OP6_SQL = """
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256('20240611:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS u, text
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w,
                   source_size * 3.0::DOUBLE AS cap FROM totals),
ordered AS (SELECT *, cap / w AS ratio, (sum(source_size) OVER ())::DOUBLE AS budget, sum(w) OVER () AS all_w,
              coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
              coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
            FROM weighed),
levels AS (SELECT *, (budget - caps_before) / (all_w - w_before) AS lvl FROM ordered),
final AS (SELECT lvl FROM levels WHERE NOT (cap <= lvl * w) ORDER BY ratio, lvl LIMIT 1),
plan AS (SELECT source, source_size, least(cap, coalesce((SELECT lvl FROM final) * w, cap)) AS target FROM levels),
rows AS (SELECT b.*, p.source_size, p.target,
           CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS whole,
           sum(b.size) OVER (PARTITION BY b.source ORDER BY u, b.doc_id NULLS LAST, b.size, b.text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
         FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       (size * (whole + CASE WHEN run <= round(target - whole * source_size, 6) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows
"""

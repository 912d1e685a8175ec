"""Ranking and threshold metrics of scores (higher: likelier positive).

Rows are first summed by score; the cumulative counts over distinct scores then run over ranges of scores: totals of
ranges are few, and within a range the running sums stay in its task, so no task sees all scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorwake.functions import ascending, bounds_below, ratio

RANGES = 256


def curve(df: DataFrame, score: str, label: str, ranges: int = RANGES) -> DataFrame:
    """(score, tp, fp, positives, negatives): counts at threshold >= score, one row a distinct score. Null scores and labels are left out; NaN is the highest score."""
    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("score"))
    by = by.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    bounds = by.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()["q"]
    by = by.withColumn("part", bounds_below(F.col("score"), ascending(bounds)))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # over `ranges` rows at most
    parts = by.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("n").alias("nn"))
    parts = parts.select(
        "part",
        F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("p0"),
        F.coalesce(F.sum("nn").over(above), F.lit(0)).alias("n0"),
        F.sum("pp").over(Window.partitionBy()).alias("positives"),
        F.sum("nn").over(Window.partitionBy()).alias("negatives"),
    )
    upto = Window.partitionBy("part").orderBy(F.desc("score"))
    out = by.withColumns({"cp": F.sum("p").over(upto), "cn": F.sum("n").over(upto)}).join(F.broadcast(parts), "part")
    return out.select("score", (F.col("p0") + F.col("cp")).alias("tp"), (F.col("n0") + F.col("cn")).alias("fp"), "positives", "negatives", "p", "n")


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by trapezoids, null without both classes. A distinct score adds n * (tp - p / 2)."""
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0))
    return curve(df, score, label).agg((area / F.when(F.max("positives") * F.max("negatives") > 0, F.max("positives") * F.max("negatives"))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over thresholds of recall gained times precision; 0 without positives."""
    gained = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return curve(df, score, label).agg(F.coalesce(gained / F.when(F.max("positives") > 0, F.max("positives")), F.lit(0.0)).alias("average_precision"))


def recall_under_fpr(df: DataFrame, score: str, label: str, caps=(0.01, 0.001)) -> DataFrame:
    """(fpr_cap, recall, threshold): the best recall with a false-positive rate of at most the cap; of equals the higher threshold.

    Where every threshold is above the cap, recall is 0 and the threshold infinite.
    """
    c = curve(df, score, label).withColumns({"tpr": ratio(F.col("tp"), F.col("positives")), "fpr": ratio(F.col("fp"), F.col("negatives"))})
    best = c.agg(*[F.max(F.when(F.col("fpr") <= cap, F.struct("tpr", "score"))).alias(f"b{i}") for i, cap in enumerate(caps)])
    rows = F.array(
        *[
            F.struct(F.lit(float(cap)).alias("fpr_cap"), F.coalesce(F.col(f"b{i}.tpr"), F.lit(0.0)).alias("recall"), F.coalesce(F.col(f"b{i}.score"), F.lit(float("inf"))).alias("threshold"))
            for i, cap in enumerate(caps)
        ]
    )
    return best.select(F.explode(rows).alias("x")).select("x.*")


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """(tn, fp, fn, tp, precision, recall, f1) at score >= threshold; ratios without a denominator are 0."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    out = df.agg(F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))
    return out.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")),
        }
    )


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, f1) of the threshold with the highest F1, the higher one of equals."""
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("positives"))
    f1 = 2 * precision * recall / (precision + recall + F.lit(1e-12))
    return curve(df, score, label).agg(F.max(F.struct(f1.alias("f1"), F.col("score").alias("threshold"))).alias("b")).select("b.threshold", "b.f1")


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """negatives / positives, 0 without positives."""
    return df.agg(ratio(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("positive_weight"))


def all_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> dict[str, float]:
    """The metrics by name, for reports."""
    out = {**roc_auc(df, score, label).first().asDict(), **average_precision(df, score, label).first().asDict()}
    for r in recall_under_fpr(df, score, label).collect():
        out[f"recall_at_fpr_{r['fpr_cap']:g}"] = r["recall"]
    return out | confusion(df, score, label, threshold).first().asDict()


def compare(frames: dict[str, DataFrame]) -> DataFrame:
    """(model, metric, value, delta): one-row metric frames side by side, delta against the first."""
    base, out = None, []
    for name, f in frames.items():
        long = f.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in f.columns]), F.array(*[F.col(c).cast("double") for c in f.columns]))).alias("metric", "value"))
        long = long.withColumn("model", F.lit(name))
        base = base if base is not None else long.select("metric", F.col("value").alias("base"))
        out.append(long)
    return reduce(DataFrame.unionByName, out).join(base, "metric", "left").select("model", "metric", "value", (F.col("value") - F.col("base")).alias("delta"))

"""Boosted-tree classifiers over encoded features. Their splits are Spark's: scores are not those of other libraries."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _vectors(df: DataFrame, features) -> DataFrame:
    # Trees here have no missing values: -999 lies below every code and amount, so nulls can be split off.
    df = df.withColumns({f"_x_{f}": F.coalesce(F.col(f).cast("double"), F.lit(-999.0)) for f in features})
    return VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="_x").transform(df)


def fit(train: DataFrame, features, label: str, *, iterations: int = 50, rate: float = 0.1, depth: int = 5, seed: int = 20260826, early: DataFrame | None = None, subsample: float = 1.0) -> GBTClassificationModel:
    """Positives weigh negatives / positives. With early rows, boosting stops when they no longer improve."""
    from .metrics import class_weight

    weight = class_weight(train, label).first()[0]
    made = train if early is None else train.withColumn("_early", F.lit(False)).unionByName(early.withColumn("_early", F.lit(True)))
    made = made.withColumns({"_y": F.col(label).cast("double"), "_w": F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0))})
    how = {"validationIndicatorCol": "_early"} if early is not None else {}
    return GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=iterations, stepSize=rate, maxDepth=depth, seed=seed, subsamplingRate=subsample, **how).fit(_vectors(made, features))


def score(model: GBTClassificationModel, df: DataFrame, features, out: str = "score") -> DataFrame:
    scored = model.transform(_vectors(df, features)).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*df.columns, out)


def importance(spark: SparkSession, model: GBTClassificationModel, features) -> DataFrame:
    """(feature, gain, splits), by gain and name."""
    import re

    splits = [0] * len(features)
    for tree in model.trees:
        for i in re.findall(r"If \(feature (\d+)", tree.toDebugString):
            splits[int(i)] += 1
    rows = [(f, float(g), n) for f, g, n in zip(features, model.featureImportances.toArray(), splits, strict=True)]
    return spark.createDataFrame(rows, "feature string, gain double, splits int").orderBy(F.desc("gain"), "feature")


def save(model: GBTClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)

"""Category codes fitted on training rows, and the model matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorwake.contracts import require_columns


def fit_codes(train: DataFrame, columns) -> DataFrame:
    """(column, value, code): the sorted distinct non-null values of each column, numbered from 1.

    The numbering runs within a column over its distinct values only.
    """
    require_columns(train, columns)
    one = lambda c: train.where(F.col(c).isNotNull()).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).distinct()
    values = reduce(DataFrame.unionByName, map(one, columns))
    return values.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy("value")))


def encode(df: DataFrame, codes: DataFrame, columns) -> DataFrame:
    """The columns replaced by their codes: -1 for null, 0 for values that training did not have."""
    for c in columns:
        mine = codes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = df.withColumn("_v", F.col(c).cast("string")).join(mine, F.col("_v") == F.col("_value"), "left")
        df = df.withColumn(c, F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(F.coalesce("_code", F.lit(0))).cast("int")).drop("_v", "_value", "_code")
    return df


def matrix(df: DataFrame, features, label: str, out: str = "features") -> DataFrame:
    """df with a vector of the features as floats, NaN for null, and the label as a byte."""
    df = df.withColumns({f: F.coalesce(F.col(f).cast("float"), F.lit(float("nan")).cast("float")) for f in features})
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df.withColumn(label, F.col(label).cast("byte")))

"""Exact profiles: missingness, cardinality, frequent values, quantiles, label rate, id coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorwake.contracts import require_columns
from priorwake.functions import ascending, bounds_below, ratio

LEVELS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def missingness(df: DataFrame, columns=None) -> DataFrame:
    """(column, null_count, total_rows, null_percent) of every column, in one pass over the table."""
    columns = list(columns or df.columns)
    require_columns(df, columns)
    one = df.agg(F.count("*").alias("total_rows"), *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count")) for i, c in enumerate(columns)])
    one = one.select("total_rows", F.explode(rows).alias("x")).select("x.column", "x.null_count", "total_rows")
    return one.withColumn("null_percent", ratio(F.col("null_count") * 100, F.col("total_rows")))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value as string, n) of the non-null values."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def cardinality(df: DataFrame, columns) -> DataFrame:
    """(column, non_null, distinct_values, unique_percent, singletons, singleton_percent); percents are of non-null rows."""
    require_columns(df, columns)

    def one(c: str) -> DataFrame:
        t = frequencies(df, c).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("non_null"), F.count("*").alias("distinct_values"), F.count_if(F.col("n") == 1).alias("singletons"))
        return t.select(
            F.lit(c).alias("column"),
            "non_null",
            "distinct_values",
            ratio(F.col("distinct_values") * 100, F.col("non_null")).alias("unique_percent"),
            "singletons",
            ratio(F.col("singletons") * 100, F.col("non_null")).alias("singleton_percent"),
        )

    return reduce(DataFrame.unionByName, map(one, columns))


def top_values(df: DataFrame, columns, k: int = 20) -> DataFrame:
    """(column, value, n): each column's k most frequent values, ties in the order of the value."""
    require_columns(df, columns)
    one = lambda c: frequencies(df, c).orderBy(F.desc("n"), "value").limit(k).select(F.lit(c).alias("column"), "value", "n")
    return reduce(DataFrame.unionByName, map(one, columns))


def nearest_quantiles(df: DataFrame, column: str, levels=LEVELS, cuts: int = 256) -> DataFrame:
    """(level, value): the value at index round((n - 1) * level), halves up, of the sorted non-null values. Exact; NaN is the highest value.

    Approximate quantiles cut the values into `cuts` ranges; counts of the ranges tell which range holds each index,
    and only these ranges are ordered, each in a task of its own.
    """
    require_columns(df, [column])
    spark = df.sparkSession
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    bounds = values.agg(F.percentile_approx("v", [i / cuts for i in range(1, cuts)], 10 * cuts).alias("q")).first()["q"]
    schema = "level double, value double"
    if not bounds:
        return spark.createDataFrame([(float(x), None) for x in levels], schema)
    placed = values.withColumn("part", bounds_below(F.col("v"), ascending(bounds)))
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most `cuts` rows
    total, wanted = sum(sizes.values()), []
    for level in levels:
        index, before = int((total - 1) * level + 0.5), 0
        for p in sorted(sizes):
            if index < before + sizes[p]:
                wanted.append((float(level), p, index - before + 1))
                break
            before += sizes[p]
    ranked = placed.where(F.col("part").isin(sorted({w[1] for w in wanted})))
    # Equal values are one row with their count, so a value that most rows share is no large partition.
    ranked = ranked.groupBy("part", "v").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    want = spark.createDataFrame(wanted, "level double, p int, r long")
    hit = (F.col("part") == F.col("p")) & (F.col("r") > F.col("upto") - F.col("n")) & (F.col("r") <= F.col("upto"))
    return ranked.join(F.broadcast(want), hit).select("level", F.col("v").alias("value"))


def label_rate(df: DataFrame, label: str) -> DataFrame:
    """(total_rows, positives, negatives, null_labels, positive_rate)."""
    c = F.col(label)
    out = df.agg(F.count("*").alias("total_rows"), F.count_if(c == 1).alias("positives"), F.count_if(c == 0).alias("negatives"), F.count_if(c.isNull()).alias("null_labels"))
    return out.withColumn("positive_rate", ratio(F.col("positives"), F.col("total_rows")))


def time_span(df: DataFrame, time: str) -> DataFrame:
    """(first, last, distinct_times, repeated_times): repeated are the rows beyond each time's first."""
    by = df.where(F.col(time).isNotNull()).groupBy(time).agg(F.count("*").alias("n"))
    return by.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("distinct_times"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_times"))


def unique_ids(df: DataFrame, id_col: str) -> DataFrame:
    """(total_rows, unique_ids, duplicates): duplicates are the rows beyond each id's first."""
    by = df.groupBy(id_col).agg(F.count("*").alias("n"))
    out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count(id_col).alias("unique_ids"))
    return out.withColumn("duplicates", F.col("total_rows") - F.col("unique_ids"))


def id_coverage(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """(left_rows, right_rows, covered, orphans, coverage_percent): left rows with a right id, right ids without a left row."""
    ids = right.select(id_col).distinct()
    covered = left.select(id_col).join(ids, id_col, "left_semi").agg(F.count("*").alias("covered"))
    orphans = right.select(id_col).join(left.select(id_col).distinct(), id_col, "left_anti").agg(F.count("*").alias("orphans"))
    rows = left.agg(F.count("*").alias("left_rows")).crossJoin(right.agg(F.count("*").alias("right_rows")))  # one row each
    out = rows.crossJoin(covered).crossJoin(orphans)
    return out.withColumn("coverage_percent", ratio(F.col("covered") * 100, F.col("left_rows")))

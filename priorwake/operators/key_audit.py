"""Audit of candidate entity keys: coverage, recurrence, coherence, fragmentation, and a recommendation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorwake.contracts import DAY, Partition, require_columns
from priorwake.functions import any_of, composite_key, filled, ratio


def distinct_with_null(c: Column) -> Column:
    """Distinct values where null is one of them."""
    return F.count_distinct(c) + F.max(F.when(c.isNull(), F.lit(1)).otherwise(F.lit(0)))


def keyed(df: DataFrame, candidates: dict[str, tuple]) -> DataFrame:
    """df with a column key_{name} for every candidate whose columns it has; null where a part is."""
    ok = {n: parts for n, parts in candidates.items() if all(not isinstance(p, str) or p in df.columns for p in parts)}
    return df.withColumns({f"key_{n}": composite_key(parts) for n, parts in ok.items()})


def audit_key(
    df: DataFrame, name: str, *, time: str, train: Partition, validation: Partition, spread: tuple[str, ...] = (), several: tuple[str, ...] = (), proxy: tuple[str, ...] = (), null_is_value: bool = True
) -> DataFrame:
    """One row of measures of the key column key_{name} over the train and validation rows.

    spread: numeric columns whose deviation within a key tells its coherence; several: columns that should have one
    value per key; proxy: columns of a coarser key. null_is_value counts null among the values of `several`.
    A key without any non-null value has zeros and nulls.
    """
    key = f"key_{name}"
    require_columns(df, [key, time, *spread, *several, *proxy])
    rows = df.where(F.col(time).between(train.start, validation.end))
    known, in_train, in_later = F.col(key).isNotNull(), train.holds(time), validation.holds(time)
    row = rows.agg(
        F.count("*").alias("total_rows"),
        F.count_if(known).alias("covered"),
        F.count_if(in_train).alias("train_rows"),
        F.count_if(in_train & known).alias("train_covered"),
        F.count_if(in_later).alias("validation_rows"),
        F.count_if(in_later & known).alias("validation_covered"),
    )
    several_n = (lambda c: distinct_with_null(F.col(c))) if null_is_value else (lambda c: F.count_distinct(F.col(c)))
    per = (
        rows.where(known)
        .groupBy(key)
        .agg(
            F.count("*").alias("n"),
            F.count_if(in_train).alias("n_train"),
            F.count_if(in_later).alias("n_later"),
            ((F.max(time) - F.min(time)) / F.lit(float(DAY))).alias("span"),
            F.min(time).alias("first"),
            F.max(time).alias("last"),
            *[filled(F.stddev_samp(c)).alias(f"std_{c}") for c in spread],
            (F.count_distinct(F.struct(*spread)) if spread else F.lit(1)).alias("tuples"),
            *[several_n(c).alias(f"several_{c}") for c in several],
        )
    )
    questionable = any_of([F.col(f"several_{c}") > 1 for c in several]) if several else F.lit(False)
    keys = per.agg(
        F.count("*").alias("uids"),
        F.avg("n").alias("mean_rows"),
        F.median("n").alias("median_rows"),
        F.max("n").alias("max_rows"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.avg("span").alias("mean_span_days"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
        # Validation rows whose key occurs in train: counted in the same aggregate, so no join is needed.
        F.coalesce(F.sum(F.when(F.col("n_train") > 0, F.col("n_later"))), F.lit(0)).alias("known_rows"),
        *[F.avg(f"std_{c}").alias(f"mean_std_{c}") for c in spread],
        F.avg((F.col("tuples") > 1).cast("double")).alias("collision_rate"),
        F.avg(questionable.cast("double")).alias("questionable_rate"),
    )
    out = row.crossJoin(keys)  # one row each
    if proxy:
        coarse = rows.where(known).select(composite_key(proxy).alias("proxy"), key).where("proxy IS NOT NULL").distinct().groupBy("proxy").agg(F.count("*").alias("m"))
        out = out.crossJoin(coarse.agg(F.avg("m").alias("mean_uids_per_proxy"), F.max("m").alias("max_uids_per_proxy")))
    return out.select(
        F.lit(name).alias("candidate"),
        ratio(F.col("covered"), F.col("total_rows")).alias("coverage"),
        ratio(F.col("train_covered"), F.col("train_rows")).alias("train_coverage"),
        ratio(F.col("validation_covered"), F.col("validation_rows")).alias("validation_coverage"),
        ratio(F.col("known_rows"), F.col("validation_covered")).alias("known_rate"),
        *[c for c in out.columns if c not in ("total_rows", "covered", "train_rows", "train_covered", "validation_rows", "validation_covered", "known_rows")],
    )


def audit_keys(df: DataFrame, candidates: dict[str, tuple], **how) -> DataFrame:
    """One row per candidate key that the table's columns allow; the table is read once per candidate, pruned to its columns."""
    df = keyed(df, candidates)
    names = [n for n in candidates if f"key_{n}" in df.columns]
    return reduce(DataFrame.unionByName, [audit_key(df, n, **how) for n in names])


def recommend(audit: DataFrame, spread_column: str | None = None, most: float = 100.0) -> DataFrame:
    """The candidate with the highest coverage * (1 - questionable) * known rate, among those of small enough spread."""
    score = F.col("coverage") * (1 - F.coalesce("questionable_rate", F.lit(1.0))) * F.col("known_rate")
    fit = audit.where(F.col(f"mean_std_{spread_column}") < most) if spread_column else audit
    return fit.select("candidate", score.alias("score")).orderBy(F.desc("score"), "candidate").limit(1)


def known_unknown(train: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """(known, unknown): later rows whose non-null key occurs, or doesn't occur, in train. Semi joins, no value lists."""
    seen = train.where(F.col(key).isNotNull()).select(key).distinct()
    have = later.where(F.col(key).isNotNull()).select(key)
    known = have.join(seen, key, "left_semi").agg(F.count("*").alias("known"))
    return known.crossJoin(have.join(seen, key, "left_anti").agg(F.count("*").alias("unknown")))  # one row each

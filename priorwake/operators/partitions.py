"""Chronological partitions: validation of their bounds and a one-pass audit of a table against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorwake.contracts import LOCKED, Partition, require_columns
from priorwake.functions import any_of, ratio


def validate_boundaries(partitions=LOCKED) -> None:
    """Raises ValueError unless the partitions are non-empty intervals that follow each other without overlap or gap."""
    if not partitions:
        raise ValueError("no partitions")
    for p in partitions:
        if p.start > p.end:
            raise ValueError(f"{p.name} starts after its end")
    for a, b in zip(partitions, partitions[1:], strict=False):
        if b.start <= a.end:
            raise ValueError(f"{a.name} and {b.name} overlap")
        if b.start != a.end + 1:
            raise ValueError(f"gap between {a.name} and {b.name}")


def partition_audit(df: DataFrame, time: str, label: str, partitions=LOCKED) -> DataFrame:
    """One row per partition: name, start, end, rows, positives, positive_rate, and of the whole table total_rows,
    min_time, max_time, null_times, null_labels, outside."""
    require_columns(df, [time, label])
    validate_boundaries(partitions)
    t, y = F.col(time), F.col(label)
    inside = [p.holds(t) for p in partitions]
    one = df.agg(
        F.count("*").alias("total_rows"),
        F.min(t).alias("min_time"),
        F.max(t).alias("max_time"),
        F.count_if(t.isNull()).alias("null_times"),
        F.count_if(y.isNull()).alias("null_labels"),
        F.count_if(t.isNotNull() & ~any_of(inside)).alias("outside"),
        *[F.count_if(c).alias(f"rows{i}") for i, c in enumerate(inside)],
        *[F.count_if(c & (y == 1)).alias(f"pos{i}") for i, c in enumerate(inside)],
    )
    each = F.array(
        *[
            F.struct(F.lit(p.name).alias("name"), F.lit(p.start).cast("long").alias("start"), F.lit(p.end).cast("long").alias("end"), F.col(f"rows{i}").alias("rows"), F.col(f"pos{i}").alias("positives"))
            for i, p in enumerate(partitions)
        ]
    )
    out = one.select(F.explode(each).alias("x"), "total_rows", "min_time", "max_time", "null_times", "null_labels", "outside")
    return out.select("x.*", ratio(F.col("x.positives"), F.col("x.rows")).alias("positive_rate"), "total_rows", "min_time", "max_time", "null_times", "null_labels", "outside")


def enforce(audit: DataFrame, partitions=LOCKED) -> None:
    """Raises ValueError if the audited table has nulls, rows outside or a range other than the partitions'."""
    row = audit.first()
    if row["null_times"] or row["null_labels"]:
        raise ValueError("null times or labels")
    if row["outside"]:
        raise ValueError(f"{row['outside']} rows outside the partitions")
    if (row["min_time"], row["max_time"]) != (partitions[0].start, partitions[-1].end):
        raise ValueError("the table's range is not the partitions'")


def only(df: DataFrame, time: str, partition: Partition) -> DataFrame:
    return df.where(partition.holds(time))

"""Column expressions: composite keys, guarded ratios, days and bins."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from priorwake.contracts import DAY


def composite_key(columns, sep: str = "|") -> Column:
    """The columns' strings joined by sep; null if any is null, unlike concat_ws."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(sep)] * bool(parts) + [(F.col(c) if isinstance(c, str) else c).cast("string")]
    return F.concat(*parts)


def all_of(conditions) -> Column:
    return reduce(operator.and_, conditions)


def any_of(conditions) -> Column:
    return reduce(operator.or_, conditions)


def ratio(numerator: Column, denominator: Column, otherwise: float = 0.0) -> Column:
    """numerator / denominator as double; `otherwise` where the denominator is 0 or null."""
    return F.when(denominator != 0, numerator.cast("double") / denominator).otherwise(F.lit(otherwise))


def day_number(time: Column, length: int = DAY) -> Column:
    """Floor of time / length, also below zero."""
    return F.floor(time / F.lit(length))


def relative_day(time: Column, days_since: Column) -> Column:
    """The day that lies days_since before the event's day."""
    return day_number(time) - days_since


def amount_bin(amount: Column, width: float = 200.0, bins: int = 10) -> Column:
    return F.least(F.greatest(F.floor(amount / F.lit(width)), F.lit(0)), F.lit(bins - 1)).cast("int")


def filled(value: Column, default: float = 0.0) -> Column:
    """NaN and null become default."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(default)), F.lit(default))


def replaced(value: Column, mapping: dict, default, null=None) -> Column:
    """value by a small mapping; default for what it lacks, null's value for null. Large mappings are joined: operators.encode."""
    if not mapping:
        return F.when(value.isNull(), F.lit(null)).otherwise(F.lit(default))
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.when(value.isNull(), F.lit(null)).otherwise(F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default)))


def bounds_below(value: Column, bounds: list[float]) -> Column:
    """How many of the bounds, ascending and distinct, are below a value: a binary search in one expression. NaN is above all numbers, as in sorting."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(float(bounds[middle])), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(bounds))


def ascending(bounds: list[float] | None) -> list[float]:
    """Distinct bounds in Spark's order, a NaN last."""
    numbers = sorted({float(b) for b in bounds or [] if b == b})
    return numbers + [float("nan")] * any(b != b for b in bounds or [])

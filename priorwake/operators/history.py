"""Strict-prior history of a key: aggregates over the key's rows with strictly smaller event times.

A row never sees itself, rows of its own time or later rows. With whole times the frame is RANGE .. 1 PRECEDING; with
fractional times the same frame runs over the dense rank of the time within the key. All expressions of one key share
one exchange, one sort and as many window nodes as they have frames. Rows without a key get a group of their own each,
so that they make no hot partition, and defaults instead of history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwake.contracts import is_integral

BEGIN = Window.unboundedPreceding


class History:
    """Expressions over the strict past of key (a nullable column) in df; rows() has the columns they need."""

    def __init__(self, df: DataFrame, key: str, time: str, id_col: str):
        self.key, self.time, self.id = key, time, id_col
        self.known = F.col(key).isNotNull()
        self.own = F.when(F.col(key).isNull(), F.col(id_col))
        self.order = time
        if not is_integral(df, time):
            self.order = f"_rank_{key}"
            df = df.withColumn(self.order, F.dense_rank().over(Window.partitionBy(F.col(key), self.own).orderBy(time)))
        self.df = df
        self.group = Window.partitionBy(F.col(key), self.own)
        self.past = self.group.orderBy(self.order).rangeBetween(BEGIN, -1)

    def count(self, of: Column | None = None) -> Column:
        """Prior rows (with a value); 0 without a key."""
        n = F.count(F.lit(1) if of is None else of).over(self.past)
        return F.when(self.known, n).otherwise(F.lit(0))

    def _agg(self, made: Column) -> Column:
        return F.when(self.known, made.over(self.past))

    def sum(self, c: str) -> Column:
        return self._agg(F.sum(c))

    def mean(self, c: str) -> Column:
        return self._agg(F.avg(c))

    def min(self, c: str) -> Column:
        return self._agg(F.min(c))

    def max(self, c: str) -> Column:
        return self._agg(F.max(c))

    def std(self, c: str) -> Column:
        """Sample deviation; 0 for fewer than two prior rows."""
        return F.coalesce(self._agg(F.stddev_samp(c)), F.lit(0.0))

    def slope(self, y: str, x: str) -> Column:
        """Least-squares slope of y on x; 0 where it is not defined."""
        return F.coalesce(F.nanvl(self._agg(F.regr_slope(F.col(y), F.col(x).cast("double"))), F.lit(0.0)), F.lit(0.0))

    def recency(self, within: int | None = None) -> Column:
        """Time since the last prior row; null without one or beyond `within` (which is included)."""
        age = F.col(self.time) - self.max(self.time)
        return age if within is None else F.when(age <= within, age)

    def age(self) -> Column:
        """Time since the first prior row; 0 without one."""
        return F.coalesce(F.col(self.time) - self.min(self.time), F.lit(0))

    def zscore(self, c: str) -> Column:
        std = self.std(c)
        return F.when(std > 0, (F.col(c) - self.mean(c)) / std).otherwise(F.lit(0.0))

    def burst(self, width: int) -> Column:
        """Rows in [t - width, t) less those in [t - 2 width, t - width); 0 without a key.

        Closed frames on the time itself, so fractions of a second are exact too.
        """
        by_time = self.group.orderBy(self.time)
        near, far, now = (F.count(F.lit(1)).over(by_time.rangeBetween(-a, 0)) for a in (width, 2 * width, 0))
        return F.when(self.known, near * 2 - now - far).otherwise(F.lit(0))

    def firsts(self, value: str) -> Column:
        """1 on the first row of each (key, value), by time and id. A column to add before distinct()."""
        first = F.row_number().over(Window.partitionBy(F.col(self.key), self.own, F.col(value)).orderBy(self.time, self.id)) == 1
        return F.when(first & F.col(value).isNotNull() & self.known, F.lit(1)).otherwise(F.lit(0))

    def distinct(self, firsts: str) -> Column:
        """Number of distinct prior values, of the column that firsts() made; 0 without a key."""
        return F.when(self.known, F.coalesce(F.sum(firsts).over(self.past), F.lit(0))).otherwise(F.lit(0))

    def entropy(self, bin_col: str, bins: int = 10) -> Column:
        """Shannon entropy, base 2, of the prior rows' bins; 0 without history."""
        n = self.count()
        total = F.lit(0.0)
        for b in range(bins):
            p = self.count(F.when(F.col(bin_col) == b, F.lit(1))) / F.when(n > 0, n)
            total = total - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))
        return F.when(n > 0, total).otherwise(F.lit(0.0))

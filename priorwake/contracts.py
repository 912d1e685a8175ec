"""Column roles, chronological partitions and the checks every builder makes before it plans anything."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400
#: Columns that hold what is to be predicted. No feature builder accepts them.
LABELS = frozenset({"isFraud", "label", "target"})


@dataclass(frozen=True)
class Roles:
    """Which columns of an event table play which part."""

    id: str = "TransactionID"
    time: str = "TransactionDT"
    amount: str = "TransactionAmt"
    category: str = "ProductCD"
    card: tuple[str, ...] = ("card1", "card2", "card3", "card4", "card5", "card6")
    device: str = "DeviceInfo"
    address: str = "addr1"

    @property
    def entity(self) -> tuple[str, ...]:
        return (*self.card, self.address)


@dataclass(frozen=True)
class Partition:
    """A named interval of event times, both ends included."""

    name: str
    start: int
    end: int

    def holds(self, time: Column | str) -> Column:
        return (F.col(time) if isinstance(time, str) else time).between(self.start, self.end)


#: The locked split, in seconds.
LOCKED = (Partition("train", 86_400, 11_059_199), Partition("validation", 11_059_200, 13_391_999), Partition("final_test", 13_392_000, 15_811_131))


def require_columns(df: DataFrame, columns) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def refuse_labels(columns) -> None:
    found = sorted(LABELS & set(columns))
    if found:
        raise ValueError(f"labels are no input of a feature: {', '.join(found)}")


def require_events(df: DataFrame, id_col: str, *never_null: str) -> None:
    """One pass: ids are unique and the given columns have no null."""
    row = df.agg(F.count("*").alias("n"), F.count_distinct(F.col(id_col)).alias("u"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in never_null]).first()
    if row["n"] != row["u"]:
        raise ValueError(f"{id_col} is not unique: {row['n']} rows, {row['u']} ids")
    bad = [c for c in never_null if row[f"null_{c}"]]
    if bad:
        raise ValueError(f"nulls in {', '.join(bad)}")


def is_integral(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def whole_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp_ntz, fractions cut, whatever the session's zone."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


@dataclass(frozen=True)
class Specification:
    """What a feature set promises, fit for JSON."""

    name: str
    key: tuple[str, ...]
    features: dict[str, str]
    rule: str = "a row sees only rows of its key with a strictly smaller event time"
    never_read: tuple[str, ...] = field(default=tuple(sorted(LABELS)))

    def as_dict(self) -> dict:
        return {"name": self.name, "key": list(self.key), "features": dict(self.features), "rule": self.rule, "never_read": list(self.never_read)}

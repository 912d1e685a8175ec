"""Strict-prior history of unbounded event streams.

A row may only see strictly earlier event times, so it cannot be scored before all rows of its time have come. Rows are
buffered by key until the watermark passes their time; then each time's rows are scored from the state and only
afterwards update it. Rows that come after their time was emitted are dropped: they would change the past.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: State: rows that wait, then the number, sum, sum of squared deviations and last time of those that were emitted.
_STATE = "ids array<bigint>, times array<timestamp>, amounts array<double>, n bigint, mean double, m2 double, last timestamp"
_OUT = "key string, id bigint, ts timestamp, prior_count bigint, amt_mean double, amt_std double, recency double"


def _advance(ready: list[tuple], n: int, mean: float, m2: float, last) -> tuple[list[tuple], int, float, float, object]:
    """Scores (time, id, amount) rows in order, whole times at once, and returns them with the new state."""
    out, i = [], 0
    while i < len(ready):
        j = i
        while j < len(ready) and ready[j][0] == ready[i][0]:
            j += 1
        std = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
        age = None if last is None else (ready[i][0] - last).total_seconds()
        out += [(ident, t, n, mean if n else None, std, age) for t, ident, _ in ready[i:j]]
        for _, _, amount in ready[i:j]:
            n += 1
            delta = amount - mean
            mean += delta / n
            m2 += delta * (amount - mean)
        last, i = ready[i][0], j
    return out, n, mean, m2, last


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ids, times, amounts, n, mean, m2, last = state.get if state.exists else ([], [], [], 0, 0.0, 0.0, None)
    waiting = list(zip(times, ids, amounts, strict=True))
    for f in frames:
        waiting += [(t.to_pydatetime(), int(i), float(a)) for t, i, a in zip(f["ts"], f["id"], f["amount"], strict=True)]
    mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms").to_pydatetime()
    waiting = sorted(w for w in waiting if last is None or w[0] > last)
    ready = [w for w in waiting if w[0] < mark]
    waiting = [w for w in waiting if w[0] >= mark]
    out, n, mean, m2, last = _advance(ready, n, mean, m2, last)
    state.update(([w[1] for w in waiting], [w[0] for w in waiting], [w[2] for w in waiting], n, mean, m2, last))
    if waiting:
        state.setTimeoutTimestamp(int(pd.Timestamp(waiting[0][0]).timestamp() * 1000) + 1)
    yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", "id", "ts", "prior_count", "amt_mean", "amt_std", "recency"])


def strict_prior_stream(events: DataFrame, *, key: str, id_col: str, ts: str, amount: str, delay: str = "10 minutes") -> DataFrame:
    """prior_count, amt_mean, amt_std and recency (seconds) of a stream of events, emitted once their time is final.

    delay bounds how late rows may come. Rows without key or time have no history and are left out.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts"), F.col(amount).cast("double").alias("amount")
    )
    rows = rows.withWatermark("ts", delay)
    return rows.groupBy("key").applyInPandasWithState(_step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

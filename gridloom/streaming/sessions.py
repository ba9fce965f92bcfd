"""Sessions with a closing event, by custom state: timers on event time, and late rows kept aside.

A session of a key ends after a pause of more than ``gap``, or with an event that closes it (a purchase, say), which no
window of Spark's own expresses. Events wait in the key's state until the watermark has passed them, so they may come in
any order within ``lateness``; a timer on event time closes what the watermark has passed. A row that comes later than
that is handed on as it is, marked ``late``. Rows later than ``HORIZON`` are dropped and counted by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How far behind Spark's own watermark stays, so that late rows reach the state instead of being dropped.
HORIZON_DAYS = 30
_HORIZON = HORIZON_DAYS * 86_400_000_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOUND = "kind string, {key}, started bigint, ended bigint, n bigint, total double, closed boolean"
_COLUMNS = ["started", "ended", "n", "total", "closed"]

Event = tuple[int, float, bool]


def finished(events: list[Event], watermark: int, gap: int) -> tuple[list[tuple], list[Event], int | None]:
    """Of events in order: the sessions that are over at the watermark, the events that stay, and when to look again.

    Times are microseconds. No event up to the watermark is to come.
    """
    out, first = [], 0
    for i, (at, _, closes) in enumerate(events):
        if at > watermark:
            break
        follows = events[i + 1][0] if i + 1 < len(events) else None
        if closes or (at + gap <= watermark and (follows is None or follows - at > gap)):
            run = events[first : i + 1]
            out.append((run[0][0], at, len(run), sum(v for _, v, _ in run), closes))
            first = i + 1
    rest = events[first:]
    return out, rest, next_look(rest, watermark, gap)


def next_look(events: list[Event], watermark: int, gap: int) -> int | None:
    """The next time at which one of the events may end a session."""
    return min((t for t in (at if closes else at + gap for at, _, closes in events) if t > watermark), default=None)


class _Sessions(StatefulProcessor):
    def __init__(self, key: str, gap: int, lateness: int):
        self.key, self.gap, self.lateness = key, gap, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at bigint, value double, closes boolean")

    def _watermark(self, timers) -> int:
        """The time that all accepted events have passed."""
        return timers.getCurrentWatermarkInMs() * 1000 + _HORIZON - self.lateness

    def _set_timer(self, again: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if again is not None:
            self.handle.registerTimer(-(-(again + self.lateness - _HORIZON) // 1000))

    def _frame(self, key: tuple, kind: str, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=_COLUMNS)
        out.insert(0, self.key, key[0])
        out.insert(0, "kind", kind)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        began, passed = timerValues.getCurrentWatermarkInMs() > 0, self._watermark(timerValues)
        late, taken = [], []
        for batch in rows:
            for at, value, closes in zip(batch["at"], batch["value"], batch["closes"], strict=True):
                (late if began and at <= passed else taken).append((int(at), float(value), bool(closes)))
        if taken:
            events = sorted([*(tuple(e) for e in self.open.get()), *taken])
            self.open.put(events)
            self._set_timer(next_look(events, passed if began else 0, self.gap))
        yield self._frame(key, "late", [(at, at, 1, value, closes) for at, value, closes in late])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        done, rest, again = finished(sorted(tuple(e) for e in self.open.get()), self._watermark(timerValues), self.gap)
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        self._set_timer(again)
        yield self._frame(key, "session", done)

    def close(self) -> None:
        pass


def _micros(interval: str, spark: SparkSession) -> int:
    return spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval '{interval}')").first()[0]


def closing_sessions(events: DataFrame, key: str, at: str, value: str, closes: Column, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """A stream of ``kind`` (``session`` or ``late``), the key, ``started``, ``ended``, ``n``, ``total`` and ``closed`` (by its event).

    Sessions come once the watermark has passed them. A null time or key is in no session; a null value counts as zero.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    given = events.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key), F.col(at).cast("timestamp").alias("__at"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"), F.coalesce(closes, F.lit(False)).alias("closes")
    )
    stream = given.withWatermark("__at", f"{HORIZON_DAYS} days").groupBy(key)
    schema = FOUND.format(key=f"`{key}` {dict(events.dtypes)[key]}")
    out = stream.transformWithStateInPandas(_Sessions(key, _micros(gap, spark), _micros(lateness, spark)), schema, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})


def apart(path: str, late_path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that puts sessions and late rows into folders of the batch's own, so that a batch done again counts once."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            kept.where("kind = 'session'").drop("kind").write.mode("overwrite").parquet(f"{path}/batch={number}")
            kept.where("kind = 'late'").drop("kind").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        finally:
            kept.unpersist()

    return write

"""Leases in keyed state, ended by event-time timers.

The state store holds one open lease per key.  A timer at its end lets it out
when the watermark passes, without a further event of the key and without
reading any other key's state.  A lease ends by the last beat and that beat's
own ttl, so the ttl may change from beat to beat.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trialframe.streaming.leases import micros

#: Settings for a query on timed_leases(): its state store must be RocksDB's.
TIMER_STATE = {
    "spark__sql__streaming__stateStore__providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
_LEASE = "began long, ends long, beats long, last long"


class _OpenLease(StatefulProcessor):
    """The open lease of a key; times in microseconds, timers in milliseconds."""

    def __init__(self, key_names: list[str]) -> None:
        self.names = key_names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", _LEASE)

    def _row(self, key: tuple, began: int, ends: int, beats: int) -> tuple:
        return (*key, began, ends, beats)

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[*self.names, "began", "ends", "beats"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lease = self.lease.get()
        before = lease
        done: list[tuple] = []
        beats = sorted(b for part in rows for b in zip(part["at"], part["ttl"], strict=True))
        for at, ttl in ((int(a), int(t)) for a, t in beats):
            if lease is None:
                lease = (at, at + ttl, 1, at)
                continue
            began, ends, count, last = lease
            if at >= ends:
                done.append(self._row(key, began, ends, count))
                lease = (at, at + ttl, 1, at)
            elif at >= last:
                lease = (began, at + ttl, count + 1, at)
            elif at + ttl > began:
                # An earlier micro-batch brought later beats: this one cannot move the end.
                lease = (min(began, at), ends, count + 1, last)
            else:
                done.append(self._row(key, at, at + ttl, 1))
        if lease is not None and lease != before:
            if before is not None:
                self.handle.deleteTimer(_timer(before[1]))
            self.handle.registerTimer(_timer(lease[1]))
            self.lease.update(lease)
        yield from self._frame(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lease = self.lease.get()
        if lease is not None:
            self.lease.clear()
            yield from self._frame([self._row(key, *lease[:3])])

    def close(self) -> None:
        pass


def _timer(ends: int) -> int:
    """The first millisecond by whose watermark the lease has ended."""
    return -(-ends // 1000)


def timed_leases(beats: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Leases whose end the watermark has reached (append mode).

    ``beats``: keys, ts, ttl_seconds; a null time or ttl opens nothing.  Beats
    behind the watermark of the micro-batch before are dropped.  Within a micro-batch beats count in order
    of time; one that a later micro-batch brings joins the lease it falls in.
    Start the query under ``TIMER_STATE``.  A key's beats of a micro-batch pass
    through one task: for very busy keys bound the micro-batch.
    """
    key_fields = [beats.schema[k] for k in keys]
    out = T.StructType([*key_fields, *[T.StructField(c, T.LongType()) for c in ("began", "ends", "beats")]])
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = beats.where("ts is not null and ttl_seconds is not null").withWatermark("ts", delay)
    rows = rows.select(*keys, "ts", at, micros(F.col("ttl_seconds")).alias("ttl"))
    leases = rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_OpenLease(keys), outputStructType=out, outputMode="append", timeMode="eventTime"
    )
    return leases.select(
        *keys, F.timestamp_micros("began").alias("lease_start"), F.timestamp_micros("ends").alias("lease_end"), "beats"
    )


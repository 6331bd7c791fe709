"""Stateful operators over streams: a sliding-window limiter with doubling lockouts, and cutoffs that run out.

State is kept by Spark for each key.  The limiter's has a time to live, after which the store drops it; a cutoff is
dropped by a timer of its own, which also tells so in the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, ts double, allowed boolean, retry_after double"
STATE = "times array<double>, until double"
CUTOFFS = "subject string, cutoff double, live boolean"
#: Timers and times to live are kept by this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(state: tuple[list[float], float], at: float, limit: int, window: float, base: float, most: float) -> tuple[tuple[list[float], float], bool, float]:
    """Next state (times in the window, locked until), whether the event passes, and seconds to wait."""
    times, until = state
    if at < until:
        return state, False, until - at
    times = [t for t in times if t > at - window] + [at]
    if len(times) <= limit:
        return (times, 0.0), True, 0.0
    wait = min(base * 2.0 ** (len(times) - limit - 1), most)
    return (times, at + wait), False, wait


class Limiter(StatefulProcessor):
    def __init__(self, limit: int, window: float, base: float, most: float, ttl: float):
        self.rule, self.ttl = (limit, window, base, most), int(1000 * ttl)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attempts", STATE, self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times, until = self.state.get() if self.state.exists() else ([], 0.0)
        now, out = (list(times), until), []
        for at in sorted(t for frame in rows for t in frame["ts"].tolist()):
            now, allowed, wait = decide(now, at, *self.rule)
            out.append((key[0], at, allowed, wait))
        self.state.update((now[0], now[1]))
        yield pd.DataFrame(out, columns=["key", "ts", "allowed", "retry_after"])

    def close(self) -> None:
        pass


class Cutoffs(StatefulProcessor):
    def __init__(self, ttl: float):
        self.ttl = int(1000 * ttl)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("cutoff", "cutoff double")

    def _end(self, cutoff: float) -> int:
        return int(1000 * cutoff) + self.ttl

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        was = self.state.get()[0] if self.state.exists() else None
        newest = max([t for frame in rows for t in frame["cutoff"].tolist()] + ([] if was is None else [was]))
        # one that has run out already never was; an older one changes nothing
        if newest == was or self._end(newest) <= timerValues.getCurrentProcessingTimeInMs():
            return
        if was is not None:
            self.handle.deleteTimer(self._end(was))
        self.state.update((newest,))
        self.handle.registerTimer(self._end(newest))
        yield pd.DataFrame([(key[0], newest, True)], columns=["subject", "cutoff", "live"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            cutoff = self.state.get()[0]
            self.state.clear()
            yield pd.DataFrame([(key[0], cutoff, False)], columns=["subject", "cutoff", "live"])

    def close(self) -> None:
        pass


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, output: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df.groupBy(key).transformWithStateInPandas(processor, output, "Append", "ProcessingTime")


def limited(events: DataFrame, limit: int = 5, window: float = 60.0, base: float = 60.0, most: float = 900.0, ttl: float | None = None) -> DataFrame:
    """(key, ts, allowed, retry_after) of a stream of attempts (key string, ts seconds as double).

    State of a key: its times within the window and the end of its lockout; it goes ``ttl`` seconds after the last
    attempt, by default when neither can matter any more."""
    return _stateful(events, "key", Limiter(limit, window, base, most, window + most if ttl is None else ttl), OUTPUT)


def cutoffs(changes: DataFrame, ttl: float) -> DataFrame:
    """(subject, cutoff, live) of a stream of cutoffs (subject string, cutoff seconds as double): each newer one of a subject,
    and with ``live`` false its end after ``ttl`` seconds, when what it cuts off has run out by itself."""
    return _stateful(changes, "subject", Cutoffs(ttl), CUTOFFS)

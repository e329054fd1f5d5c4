"""Streams whose state has timers: debounced changes, and files that vanish.

Spark keeps the state by key (a map, a value, timers) and calls back when time passes; the work on one key's rows is a small
step. The session needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider, as ``with_timers`` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A path's changes are told once nothing came for this long; a file not seen for this long is gone; milliseconds.
QUIET_MS, ABSENT_MS = 500, 60_000


def with_timers(spark: SparkSession) -> SparkSession:
    """The session, with the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


class _Quiet(StatefulProcessor):
    """One row for each burst, when the timer that every change puts off has run out. State: changes so far, the first's and last's time."""

    def __init__(self, path: str, time: str, quiet: int):
        self.path, self.time, self.quiet = path, time, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "n bigint, first bigint, last bigint")

    def _told(self, key: tuple, n: int, first: int, last: int) -> pd.DataFrame:
        return pd.DataFrame({self.path: [key[0]], "n": [n], "first": pd.to_datetime([first], unit="ms"), "last": pd.to_datetime([last], unit="ms")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(t.value // 1_000_000) for part in rows for t in part[self.time])
        done = []
        n, first, last = self.burst.get() if self.burst.exists() else (0, 0, 0)
        for t in times:
            if n and t > last + self.quiet:  # two bursts in one batch
                done.append((n, first, last))
                n = 0
            n, first, last = (n + 1, min(first, t), max(last, t)) if n else (1, t, t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.burst.update((n, first, last))
        self.handle.registerTimer(last + self.quiet)
        yield pd.concat([self._told(key, *d) for d in done]) if done else pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.burst.exists():
            yield pd.DataFrame()
            return
        n, first, last = self.burst.get()
        self.burst.clear()
        yield self._told(key, n, first, last)

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, path: str, time: str, quiet_ms: int = QUIET_MS, late: str = "0 seconds") -> DataFrame:
    """``(path, n, first, last)``: a row for each burst of changes of a path, told once event time has passed its last change by
    ``quiet_ms``. Changes later than the watermark don't count."""
    kind = changes.schema[path].dataType.simpleString()
    rows = changes.withWatermark(time, late).groupBy(path)
    return rows.transformWithStateInPandas(_Quiet(path, time, quiet_ms), f"{path} {kind}, n bigint, first timestamp, last timestamp", "append", "eventTime")


class _Seen(StatefulProcessor):
    """State of a folder: each path's hash and when it was seen last; one timer a folder looks for those that weren't seen again."""

    def __init__(self, folder: str, absent: int):
        self.folder, self.absent = folder, absent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "path string", "hash string, seen bigint")

    def _told(self, key: tuple, found: list[tuple[str, str, int]]) -> pd.DataFrame:
        if not found:
            return pd.DataFrame()
        return pd.DataFrame({self.folder: [key[0]] * len(found), "path": [f[0] for f in found], "change": [f[1] for f in found], "at": pd.to_datetime([f[2] for f in found], unit="ms")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, last = [], 0
        for part in rows:
            for path, digest, t in part.sort_values("seen", kind="stable")[["path", "hash", "seen"]].itertuples(index=False):
                t = int(t.value // 1_000_000)
                last = max(last, t)
                if not self.files.containsKey((path,)):
                    found.append((path, "added", t))
                elif self.files.getValue((path,))[0] != digest:
                    found.append((path, "changed", t))
                self.files.updateValue((path,), (digest, t))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(last + self.absent)
        yield self._told(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [(p[0], seen + self.absent) for p, (_, seen) in list(self.files.iterator())]
        gone = sorted((p, until) for p, until in held if until <= now)
        for p, _ in gone:
            self.files.removeKey((p,))
        left = [until for _, until in held if until > now]
        if left:
            self.handle.registerTimer(min(left))
        yield self._told(key, [(p, "removed", until) for p, until in gone])

    def close(self) -> None:
        pass


def presence(listings: DataFrame, folder: str, absent_ms: int = ABSENT_MS, late: str = "0 seconds") -> DataFrame:
    """``(folder, path, change, at)`` of listings (folder, path, hash, seen) that come again and again: a path that is new is ``added``, one
    whose hash is another ``changed``, and one that no listing had for ``absent_ms`` of event time ``removed``. A folder's paths are one
    key's state; use folders that are small, or parts of them."""
    kind = listings.schema[folder].dataType.simpleString()
    rows = listings.withWatermark("seen", late).groupBy(folder)
    return rows.transformWithStateInPandas(_Seen(folder, absent_ms), f"{folder} {kind}, path string, change string, at timestamp", "append", "eventTime")

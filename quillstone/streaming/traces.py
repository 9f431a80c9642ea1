"""Traces of model calls as a stream: starts and ends of requests, in any order, pair up in keyed state.

Rows are (request_id, kind: start or end, at, prompt, content, total_tokens, error). Each change of a request gives its trace anew, with a version that grows; the last version of
each request is what operators.prompts.traces() gives on all rows at once: the last end counts, an end that comes before its start waits for it, a request without an end
is open. A request that is open for ``expiry`` of processing time becomes a failure; an end that comes later still takes its place.

State is kept as long as a request is open, and then for ``keep`` of processing time in case of later ends; timers clear it. After that a late end without its start is
a row that waits, and goes after ``keep`` too.

Edge cases: rows without a request id or a kind are left out; of several starts the earliest counts, by time and then prompt; repeated rows change nothing but the version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

EVENTS = "request_id string, kind string, at timestamp, prompt string, content string, total_tokens long, error string"
TRACES = "request_id string, start_time timestamp, end_time timestamp, prompt string, content string, total_tokens long, error string, duration_ms double, version long"
EXPIRED = "no end came"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def _plain(x):
    return None if x is None or pd.isna(x) else x


class Pairing(StatefulProcessor):
    """The state of a request: its start, its last end, whether it has expired, and how many versions it has had."""

    def __init__(self, expiry_ms: int, keep_ms: int):
        self.expiry_ms, self.keep_ms = expiry_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begun = handle.getValueState("begun", "at timestamp, prompt string")
        self.ended = handle.getValueState("ended", "at timestamp, content string, total_tokens long, error string")
        self.told = handle.getValueState("told", "version long, expired boolean")

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _trace(self, key: str, expired: bool) -> pd.DataFrame:
        at, prompt = self.begun.get()
        end = self.ended.get() if self.ended.exists() else (None, None, None, EXPIRED if expired else None)
        version = (self.told.get()[0] if self.told.exists() else 0) + 1
        self.told.update((version, expired))
        took = (end[0] - at).total_seconds() * 1000 if end[0] is not None else None
        return pd.DataFrame({"request_id": [key], "start_time": [at], "end_time": [end[0]], "prompt": [prompt], "content": [end[1]], "total_tokens": pd.array([end[2]], "Int64"), "error": [end[3]], "duration_ms": [took], "version": [version]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun = tuple(self.begun.get()) if self.begun.exists() else None
        ended = tuple(self.ended.get()) if self.ended.exists() else None
        for df in rows:
            for r in df.itertuples():
                if r.kind == "start":
                    new = (r.at, _plain(r.prompt))
                    begun = new if begun is None else min(begun, new, key=lambda x: (x[0], x[1] or ""))
                elif r.kind == "end":
                    tokens = _plain(r.total_tokens)
                    new = (r.at, _plain(r.content), None if tokens is None else int(tokens), _plain(r.error))
                    ended = new if ended is None else max(ended, new, key=lambda x: (x[0], x[1] or ""))
        if begun is not None:
            self.begun.update(begun)
        if ended is not None:
            self.ended.update(ended)
        now = timerValues.getCurrentProcessingTimeInMs()
        open_ = begun is not None and ended is None
        self._timer(now + (self.expiry_ms if open_ else self.keep_ms))
        if begun is not None:
            yield self._trace(key[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.begun.exists() and not self.ended.exists() and not self.told.get()[1]:
            yield self._trace(key[0], True)
            self._timer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        else:
            for state in (self.begun, self.ended, self.told):
                state.clear()

    def close(self) -> None:
        pass


def traced(events: DataFrame, expiry_ms: int = 3_600_000, keep_ms: int = 86_400_000) -> DataFrame:
    """A stream of EVENTS to one of TRACES. The session needs the RocksDB state store (STATE); as timers are of
    processing time, a query always has a next batch and ends when it is stopped."""
    known = events.where("request_id is not null and kind in ('start', 'end') and at is not null")
    return known.groupBy("request_id").transformWithStateInPandas(Pairing(expiry_ms, keep_ms), TRACES, "Update", "ProcessingTime")


def last_versions(rows: DataFrame) -> DataFrame:
    """The trace of each request, from all versions that a stream has written."""
    best = Window.partitionBy("request_id").orderBy(F.desc("version"))
    return rows.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place", "version")

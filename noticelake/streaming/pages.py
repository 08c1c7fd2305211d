"""Versions of pages on a stream: state per address, and fetches out of order put in order before they count.

A fetch waits until the watermark has passed its time; those that are due are then taken in
order of time and number, so the versions do not depend on how fetches fall into batches.
The state of an address is its last content with its version, and what waits. Fetches later
than the watermark allows are dropped by the engine, as everywhere.

Defined results: a null content is a content of its own; equal fetches change nothing; rows
that wait when a stream is stopped stay in its checkpoint; with ``idle_days`` an address that
has not been fetched for so long is forgotten, and its next fetch is version 1 again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State stores that keep their data off the heap, which stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class PageVersions(StatefulProcessor):
    """The rows whose content differs from the one before, numbered from 1, with the previous content."""

    def __init__(self, keys: list[str], number: str, idle_days: int | None):
        self.keys, self.number, self.idle = keys, number, idle_days and idle_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "content string, version long, at long")
        self.waiting = handle.getListState("waiting", "at long, number long, content string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = []
        for batch in rows:
            for at, number, content in zip(batch["at"], batch[self.number], batch["content"], strict=True):
                self.waiting.appendValue((int(at), int(number), content))
                due.append(int(at))
        self.handle.registerTimer(-(-min(due) // 1000))
        yield self._none(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready, later = [r for r in rows if r[0] <= upto * 1000], [r for r in rows if r[0] > upto * 1000]
        content, version, seen = self.last.get() if self.last.exists() else (None, 0, None)
        out = []
        for at, number, new in ready:
            if version == 0 or new != content:
                out.append((number, new, content if version else None, version + 1))
                content, version = new, version + 1
            seen = at
        if ready:
            self.last.update((content, version, seen))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-later[0][0] // 1000))
        else:
            self.waiting.clear()
        if self.idle and seen is not None:
            forget = -(-seen // 1000) + self.idle
            if not later and forget <= upto:
                self.last.clear()
            else:
                self.handle.registerTimer(forget)
        yield self._frame(key, out)

    def close(self) -> None:
        pass

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[self.number, "content", "previous", "version"]).astype({self.number: "int64", "version": "int64"})
        for i, (name, value) in enumerate(zip(self.keys, key, strict=True)):
            out.insert(i, name, value)
        return out

    def _none(self, key: tuple) -> pd.DataFrame:
        return self._frame(key, [])


def page_versions(fetches: DataFrame, keys: list[str], number: str, content: str, ts: str = "ts", late: str = "1 day", idle_days: int | None = None) -> DataFrame:
    """(keys, number, content, previous, version) of a stream of fetches, as version_chain() gives them for a table."""
    use_rocksdb(fetches.sparkSession)
    timed = fetches.select(*keys, F.col(ts).cast("timestamp").alias("event_time"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(number).cast("long").alias(number), F.col(content).cast("string").alias("content"))
    kinds = ", ".join(f"{k} {timed.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, {number} long, content string, previous string, version long"
    marked = timed.filter("event_time is not null").withWatermark("event_time", late)
    return marked.groupBy(*keys).transformWithStateInPandas(PageVersions(keys, number, idle_days), schema, "Append", "EventTime")

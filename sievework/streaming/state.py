"""Keyed state of streams: first dates of URLs and registered records, kept in the state store by key.

A batch reads the state of its own keys only and writes what changed, so its work does not grow with what came
before. State is checkpointed with the stream's offsets: a restart goes on where the last committed batch ended. Where a
watermark is asked for, a timer ends a key's state once the watermark has passed its last row by the retention, and
rows later than the watermark are dropped, so that state is bounded by the keys of that time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """The store that keyed state needs, while a query starts; a query keeps the settings that it started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class _Kept(StatefulProcessor):
    """One text value of state for each key, and a timer that ends it after the last row where retention is given."""

    def __init__(self, event_time: str | None, retention_ms: int | None):
        self.event_time, self.retention_ms = event_time, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", StructType([StructField("value", StringType())]))

    def times(self, frame: pd.DataFrame) -> int:
        """The last event time of some rows, in milliseconds."""
        return int(frame[self.event_time].max().timestamp() * 1000) if self.retention_ms is not None and len(frame) else 0

    def keep(self, value: str | None, last: int) -> None:
        self.value.update((value,))
        if self.retention_ms is not None:
            ends = max([last + self.retention_ms, *self.handle.listTimers()])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.value.clear()
        yield from ()

    def close(self) -> None:
        pass


class Earliest(_Kept):
    """Gives a key's least text whenever it falls: rows (key, value)."""

    def __init__(self, key: str, value: str, event_time: str | None, retention_ms: int | None):
        super().__init__(event_time, retention_ms)
        self.names = key, value

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.value.get()[0] if self.value.exists() else None
        least, last = known, 0
        for frame in rows:  # a key's rows come in parts
            came = frame[self.names[1]].dropna()
            least = min([*([least] if least is not None else []), *([came.min()] if len(came) else [])], default=None)
            last = max(last, self.times(frame))
        fresh = not self.value.exists() or least != known
        self.keep(least, last)
        if fresh:
            yield pd.DataFrame({self.names[0]: [key[0]], self.names[1]: [least]})


class Registered(_Kept):
    """Gives the first record of a key; a record of the key with another digest is an error."""

    def __init__(self, columns: list[str], digest: str | None, event_time: str | None, retention_ms: int | None):
        super().__init__(event_time, retention_ms)
        self.columns, self.digest = columns, digest

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, last, first = self.value.exists(), 0, None
        digests = {self.value.get()[0]} if known else set()
        for frame in rows:  # a key's rows come in parts
            digests |= {None if pd.isna(d) else str(d) for d in frame[self.digest].unique()} if self.digest else {None}
            if len(digests) > 1:
                raise ValueError(f"{key[0]} is registered with another digest")
            last = max(last, self.times(frame))
            first = frame.head(1)[self.columns] if first is None and len(frame) else first
        self.keep(digests.pop(), last)
        if not known and first is not None:
            yield first


def by_key(stream: DataFrame, key: str, processor: StatefulProcessor, schema: StructType | str, watermark: str | None, event_time: str) -> DataFrame:
    """The processor's rows over the stream's keys."""
    if watermark:
        stream = stream.withWatermark(event_time, watermark)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Update", "EventTime" if watermark else "None")


def retention(watermark: str | None, spark: SparkSession) -> int | None:
    """The watermark's delay in milliseconds: how long after its last row a key is kept."""
    if not watermark:
        return None
    return spark.sql(f"SELECT unix_millis(TIMESTAMP'2000-01-01' + INTERVAL {watermark}) - unix_millis(TIMESTAMP'2000-01-01')").first()[0]

"""Stateful streams whose state is bounded: buffers with timers, ring buffers, caches whose entries end.

The state of a key is what these processors say and no more: a buffer until it is sent off, the last points, an entry until it
ends. A micro-batch's rows of a key come in frames of bounded size. Null texts count as empty; rows with a null time aren't
ordered and come first. State lives in the RocksDB store beside the checkpoint, so a restart takes up where a run ended.
"""

from __future__ import annotations

import heapq
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .run import work_folder

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Drained:
    """What a run put out, with the column epoch, and what it told of itself."""

    rows: DataFrame
    progress: list = field(default_factory=list)

    def state_rows(self) -> int:
        """Rows of state that are left, over all operators."""
        return sum(op["numRowsTotal"] for op in self.progress[-1]["stateOperators"]) if self.progress else 0

    def late_rows(self) -> int:
        """Rows that came after the watermark and were left out."""
        return sum(op["numRowsDroppedByWatermark"] for p in self.progress for op in p["stateOperators"])


def run_available(stream: DataFrame, mode: str, state: str | None = None) -> Drained:
    """Runs the stream on all that is there, in as many micro-batches as the source makes of it.

    state: a folder of an earlier run's, to take up where that ended; its rows are put out once. A stream with timers of
    processing time has no end of its own: run_until().
    """
    return _run(stream, mode, state, {"availableNow": True}, lambda run: run.awaitTermination())


def run_until(stream: DataFrame, mode: str, rows: int, state: str | None = None, after: float = 0.0, timeout: float = 60.0) -> Drained:
    """Runs the stream until it has read this many rows, and `after` seconds longer; after `timeout` seconds it raises."""

    def wait(run) -> None:
        end, seen = time.monotonic() + timeout, {}
        try:
            while sum(seen.values()) < rows:
                if time.monotonic() > end:
                    raise TimeoutError(f"{sum(seen.values())} of {rows} rows after {timeout} seconds")
                if run.exception():
                    raise run.exception()
                time.sleep(0.1)
                seen |= {p["batchId"]: p["numInputRows"] for p in map(_told, run.recentProgress)}
            time.sleep(after)
        finally:
            run.stop()

    return _run(stream, mode, state, {"processingTime": "500 milliseconds"}, wait)


def _told(progress) -> dict:
    return progress if isinstance(progress, dict) else json.loads(progress.json)


def _run(stream: DataFrame, mode: str, state: str | None, trigger: dict, wait: Callable) -> Drained:
    spark, out = stream.sparkSession, work_folder(stream.sparkSession)
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    epochs = []

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")  # a batch that is run again is written again
        epochs.append(epoch)

    try:
        run = stream.writeStream.outputMode(mode).option("checkpointLocation", state or f"{out}/state").foreachBatch(put).trigger(**trigger).start()
        wait(run)
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", epoch long"
    rows = spark.read.schema(fields).option("basePath", f"{out}/rows").parquet(*(f"{out}/rows/epoch={e}" for e in sorted(set(epochs)))) if epochs else spark.createDataFrame([], fields)
    return Drained(rows, [json.loads(p.json) for p in run.recentProgress])


class _Flush(StatefulProcessor):
    def __init__(self, key: str, text: str, millis: int, least: int, send: Callable[[str], bool] | None, event_time: bool) -> None:
        self.key, self.text, self.millis, self.least, self.send, self.event_time = key, text, millis, least, send, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "text string")
        self.size = handle.getValueState("size", "chars long")

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chars, idle = (self.size.get()[0], False) if self.size.exists() else (0, True)
        for frame in rows:
            texts = [t for t in frame[self.text] if t]
            if texts:
                self.parts.appendList([(t,) for t in texts])
                chars += sum(map(len, texts))
        self.size.update((chars,))
        if idle:  # a key's clock runs while it has a buffer
            self.handle.registerTimer(max(0, self._now(timerValues)) // self.millis * self.millis + self.millis)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        chars = self.size.get()[0] if self.size.exists() else 0
        at = expiredTimerInfo.getExpiryTimeInMs()
        if chars >= self.least:
            text = "".join(t for (t,) in self.parts.get())
            if self.send is None or self.send(text):
                self.parts.clear()
                self.size.clear()
                yield pd.DataFrame({self.key: [key[0]], "at": [at], "flushed": [text]})
                return
        if chars:  # too little, or it wasn't taken: the buffer stays
            self.handle.registerTimer(max(at, self._now(timerValues)) // self.millis * self.millis + self.millis)
        else:
            self.size.clear()


def timed_flush(stream: DataFrame, key: str, text: str, seconds: int = 5, least: int = 100, send: Callable[[str], bool] | None = None, event_time: str | None = None) -> DataFrame:
    """key, at (milliseconds), flushed: at every tick of `seconds` a key's buffer is put out if it has `least` characters or more.

    send: is given the buffer, and if it says no, the buffer stays and is offered at the next tick. Ticks are of processing time,
    or of the watermark if event_time names the column that has one. A key without a buffer has no state and no timer.
    """
    kinds = dict(stream.dtypes)
    own = stream.select(*dict.fromkeys((key, text, *([event_time] if event_time else []))))
    processor = _Flush(key, text, seconds * 1000, least, send, event_time is not None)
    return own.groupBy(key).transformWithStateInPandas(processor, f"{key} {kinds[key]}, at long, flushed string", "append", "EventTime" if event_time else "ProcessingTime")


class _Ring(StatefulProcessor):
    def __init__(self, key: str, order: str, names: list[str], kinds: list[str], size: int) -> None:
        self.key, self.order, self.names, self.kinds, self.size = key, order, names, kinds, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", ", ".join(f"{n} {k}" for n, k in zip(self.names, self.kinds, strict=True)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.names.index(self.order)
        rank = lambda p: (p[at], p)
        last = [tuple(p) for p in self.points.get()] if self.points.exists() else []
        for frame in rows:
            new = zip(*(frame[n].tolist() for n in self.names), strict=True)
            last = heapq.nlargest(self.size, [*last, *new], key=rank)
        last.sort(key=rank)
        self.points.put(last)
        yield pd.DataFrame({self.key: [key[0]], "points": [[dict(zip(self.names, p, strict=True)) for p in last]]})


def ring_buffer(stream: DataFrame, key: str, order: str, values: list[str], size: int = 60) -> DataFrame:
    """key, points: the last `size` points of a key by `order` (an integer column), then values; put out whenever they change (update mode)."""
    kinds = dict(stream.dtypes)
    names = [order, *values]
    points = f"array<struct<{', '.join(f'{n}: {kinds[n]}' for n in names)}>>"
    return stream.select(key, *names).groupBy(key).transformWithStateInPandas(_Ring(key, order, names, [kinds[n] for n in names], size), f"{key} {kinds[key]}, points {points}", "update", "None")


class _Cache(StatefulProcessor):
    def __init__(self, key: str, value: str, kind: str, millis: int, compute: Callable[[pd.Series], pd.Series]) -> None:
        self.key, self.value, self.kind, self.millis, self.compute = key, value, kind, millis, compute

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "k string", f"v {self.kind}", ttlDurationMs=self.millis)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            asked = frame[self.key].tolist()
            known = {k: self.entries.getValue((k,))[0] for k in dict.fromkeys(asked) if self.entries.containsKey((k,))}
            missing = frame.drop_duplicates(self.key)
            missing = missing[~missing[self.key].isin(known)]
            if len(missing):
                for k, v in zip(missing[self.key].tolist(), self.compute(missing[self.value]).tolist(), strict=True):
                    self.entries.updateValue((k,), (v,))
            hits, got, fresh = [], [], set()
            for k in asked:
                hits.append(k in known or k in fresh)
                fresh.add(k)
                got.append(known[k] if k in known else self.entries.getValue((k,))[0])
            yield pd.DataFrame({self.key: asked, "answer": got, "hit": hits})


def cached(stream: DataFrame, key: str, value: str, compute: Callable[[pd.Series], pd.Series], kind: str = "string", seconds: int = 3600, shards: int = 64) -> DataFrame:
    """key, answer, hit: compute(value) once for each key, asked again after `seconds` of processing time, when its entry is dropped.

    Entries are a map in the state of a shard of keys (strings). In a micro-batch the first row of a new key is the miss.
    """
    kinds = dict(stream.dtypes)
    own = stream.select(F.pmod(F.xxhash64(key), F.lit(shards)).alias("_shard"), key, value)
    return own.groupBy("_shard").transformWithStateInPandas(_Cache(key, value, kind, seconds * 1000, compute), f"{key} {kinds[key]}, answer {kind}, hit boolean", "append", "ProcessingTime")


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key as it arrives; a key is forgotten once the watermark has passed its time by `delay`."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def closed_sessions(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """key, start, end, n of sessions that the watermark has closed; put out once and then forgotten. Rows that come later are counted as late."""
    windows = stream.withWatermark(time, delay).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return windows.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")

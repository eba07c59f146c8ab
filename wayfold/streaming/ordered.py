"""Ordered state over streams: rows wait until the watermark says that nothing earlier can come, then go on in order.

Each key holds its waiting rows in a list state and what it has come to in a value state. A timer at the latest waiting row
fires once the watermark passes it; the rows at or before the watermark are then taken in order of time, whatever order
they came in, so the output is that of the batch twin. When a key has been silent for ``idle`` behind its last row, a second
timer closes what is open and clears its state: state is bounded by the keys active within watermark and idle time.

These need the RocksDB state store (``use_rocksdb``); rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.trackers import Kalman, kalman_steps

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Ordered(StatefulProcessor):
    """Buffering, order and expiry; subclasses say what a row does. ``row_schema`` begins with ``t_ms bigint``."""

    row_schema = "t_ms bigint"
    state_schema = "n bigint"
    columns: tuple[str, ...] = ()

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.state = handle.getValueState("state", self.state_schema)
        self.last = handle.getValueState("last", "t_ms bigint")

    def take(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        """The state after a row, and rows to give."""
        raise NotImplementedError

    def finish(self, key: tuple, state: tuple | None) -> list[tuple]:
        """What an expiring key still has to give."""
        return []

    def fields(self, rows: pd.DataFrame) -> list[tuple]:
        """Input rows in the shape of ``row_schema``."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in self.fields(part)]
        if new:
            self.waiting.appendList(new)
            for t in {r[0] for r in new}:
                self.handle.registerTimer(t + 1)
        yield pd.DataFrame([], columns=list(self.columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        state = tuple(self.state.get()) if self.state.exists() else None
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in ready:
            if last is not None and r[0] >= last + self.idle_ms:  # silent too long before this row, whenever it is seen
                out, state = out + self.finish(key, state), None
            state, given = self.take(key, state, r)
            out, last = out + given, r[0]
        if ready:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            if state is not None:
                self.state.update(state)
            self.last.update((last,))
            self.handle.registerTimer(last + self.idle_ms)
        elif last is not None and mark >= last + self.idle_ms and not (later and later[0][0] < last + self.idle_ms):
            out += self.finish(key, state)
            self.state.clear()
            self.last.clear()
        yield pd.DataFrame(out, columns=list(self.columns))


class _Passages(Ordered):
    """Opens at a score of ``on``, closes at ``off`` or by silence."""

    row_schema = "t_ms bigint, event_id bigint, t_us bigint, score double"
    state_schema = "active boolean, start_us bigint, end_us bigint, n bigint"
    columns = ("seq_id", "start_us", "end_us", "n")

    def __init__(self, on: float, off: float, idle_ms: int):
        super().__init__(idle_ms)
        self.on, self.off = on, off

    def fields(self, rows):
        t = rows["ts"].astype("datetime64[us]").astype("int64")
        return [(int(u // 1000), int(e), int(u), float(s)) for u, e, s in zip(t, rows["event_id"], rows["score"])]

    def take(self, key, state, row):
        active, start, end, n = state or (False, 0, 0, 0)
        _, _, t, score = row
        out = []
        if score >= self.on and not active:
            active, start, n = True, t, 0
        elif score <= self.off and active:
            out.append((key[0], start, end, n))
            active = False
        if active:
            end, n = t, n + 1
        return (active, start, end, n), out

    def finish(self, key, state):
        return [(key[0], *state[1:])] if state and state[0] else []


def passages(rows: DataFrame, on: float, off: float, idle: str) -> DataFrame:
    """Passage events of a stream (seq_id, event_id, ts, score) with a watermark on ``ts``, rows in any order within it."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.groupBy("seq_id").transformWithStateInPandas(_Passages(on, off, wait), "seq_id bigint, start_us bigint, end_us bigint, n bigint", "append", "eventTime")


class _Tracks(Ordered):
    row_schema = "t_ms bigint, step bigint, zx double, zy double"
    state_schema = "step bigint, x double, y double, vx double, vy double, pp double, pv double, vv double"
    columns = ("vehicle_id", "step", "x", "y")

    def __init__(self, config: Kalman, idle_ms: int):
        super().__init__(idle_ms)
        self.config = config

    def fields(self, rows):
        t = rows["ts"].astype("datetime64[us]").astype("int64") // 1000
        return [(int(a), int(b), float(x), float(y)) for a, b, x, y in zip(t, rows["step"], rows["zx"], rows["zy"])]

    def take(self, key, state, row):
        _, step, x, y = row
        if state is None:
            state = (step, x, y, 0.0, 0.0, self.config.start, 0.0, self.config.start)
            return state, [(key[0], *state[:3])]
        out = []
        if step > state[0]:
            for s, state in kalman_steps(self.config, state, step, (x, y)):
                out.append((key[0], s, state[1], state[2]))
        return tuple(float(v) if k else int(v) for k, v in enumerate(state)), out


def tracks(measured: DataFrame, idle: str, config: Kalman | None = None) -> DataFrame:
    """Constant-velocity tracks of a stream (vehicle_id, step, ts, zx, zy): measurements in any order within the watermark
    give the steps that the plain filter gives in order of time; a vehicle silent for ``idle`` is forgotten."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    return measured.groupBy("vehicle_id").transformWithStateInPandas(_Tracks(config or Kalman(), wait), "vehicle_id bigint, step bigint, x double, y double", "append", "eventTime")

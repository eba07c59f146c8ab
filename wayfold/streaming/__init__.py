"""Streams of events: windows, sessions, passage events and tracks with watermarks and a stated policy for late rows.

Each has a batch twin among the queries; over the same rows a stream gives the twin's rows for all windows that the
watermark has closed. Rows later than the watermark are dropped by Spark. State of windows, sessions and ``passages`` goes
once the watermark passes it; ``tracks`` here knows no time and keeps one state a vehicle. ``streaming.ordered`` has both as
stateful processors: rows in any order within the watermark, and state that expires with silence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trackers import Kalman, kalman_steps

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def read_events(spark: SparkSession, path: str, late: str, per_trigger: int = 1) -> DataFrame:
    """Event files as a stream, ``per_trigger`` files at a time; rows later than ``late`` behind the latest may be dropped."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.withWatermark("ts", late)


def tumbling(events: DataFrame, width: str, *keys: str) -> DataFrame:
    """Counts by fixed windows and keys; a window is given once, when the watermark passes its end."""
    return events.groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start_us"), *keys, "n")


def sliding(events: DataFrame, width: str, step: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start_us"), *keys, "n")


def sessions(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    """Runs of rows closer than ``gap``; the last session of a key stays open until the watermark passes it."""
    g = events.groupBy(*keys, F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select(*keys, F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


def distinct_events(events: DataFrame, *keys: str) -> DataFrame:
    """Repeated deliveries within the watermark are dropped."""
    return events.dropDuplicatesWithinWatermark(list(keys))


PASSAGES = "seq_id bigint, start_us bigint, end_us bigint, n bigint"
_OPEN = "active boolean, start_us bigint, end_us bigint, n bigint"


def passages(rows: DataFrame, on: float, off: float, idle: str) -> DataFrame:
    """Passage events of a stream (seq_id, ts, score): a passage opens at a score of ``on`` or more and closes at ``off`` or
    less, or when its key has been ``idle`` for that long. Rows of a key must not be later than the watermark; within a
    trigger they are taken in order of time."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, start, end, n = state.get if state.exists else (False, 0, 0, 0)
        out = []
        if state.hasTimedOut:
            if active:
                out.append((key[0], start, end, n))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("ts")
            for t, score in zip((rows["ts"].astype("datetime64[us]").astype("int64")).tolist(), rows["score"].tolist()):
                if score >= on and not active:
                    active, start, n = True, t, 0
                elif score <= off and active:
                    out.append((key[0], start, end, n))
                    active = False
                if active:
                    end, n = t, n + 1
            state.update((active, start, end, n))
            last = int(rows["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["seq_id", "start_us", "end_us", "n"])

    return rows.groupBy("seq_id").applyInPandasWithState(step, PASSAGES, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)


TRACKS = "vehicle_id bigint, step bigint, x double, y double"
_STATE = "step bigint, x double, y double, vx double, vy double, pp double, pv double, vv double"


def tracks(measured: DataFrame, config: Kalman | None = None) -> DataFrame:
    """Constant-velocity tracks of a stream (vehicle_id, step, zx, zy), one state a vehicle: every step from the first
    measurement to the latest is given once; measurements at or before a step already given come too late and are left
    out."""
    c = config or Kalman()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = (state.get if state.exists else None), []
        for r in pd.concat(list(frames)).sort_values("step").itertuples():
            if now is None:
                now = (int(r.step), float(r.zx), float(r.zy), 0.0, 0.0, c.start, 0.0, c.start)
                out.append((key[0], *now[:3]))
            elif r.step > now[0]:
                for s, now in kalman_steps(c, now, int(r.step), (r.zx, r.zy)):
                    out.append((key[0], s, now[1], now[2]))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=["vehicle_id", "step", "x", "y"])

    return measured.groupBy("vehicle_id").applyInPandasWithState(step, TRACKS, _STATE, "append", GroupStateTimeout.NoTimeout)

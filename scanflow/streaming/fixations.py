"""Anchored segments of a live gaze stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from scanflow.operators.folds import fold_chunk

OUTPUT = StructType(
    [StructField("session_id", LongType())]
    + [StructField(c, DoubleType()) for c in ("start_s", "end_s", "duration", "center_x", "center_y")]
    + [StructField("n", LongType())]
)
_SLOT = StructType([StructField("slot", LongType())])
_SAMPLES = StructType([StructField(c, ArrayType(DoubleType())) for c in ("t", "x", "y", "at_ms")])
_FOLD = StructType(
    [StructField(c, DoubleType()) for c in ("start_s", "anchor_x", "anchor_y", "end_s")]
    + [StructField("n", LongType()), StructField("sum_x", DoubleType()), StructField("sum_y", DoubleType())]
    + [StructField("at_ms", DoubleType())]
)


class AnchoredSegments(StatefulProcessor):
    """Samples wait in time slots until the watermark passes a slot's end; then the slot is folded in time order.

    A batch touches the slots its own samples fall into and those that have become ripe, nothing else: a slot has its own
    entry in the map and its own timer, and timers of a session come in the order of their times. Only the last of a run of
    slots has a timer for the session's end. State besides the slots is one open segment. A session ends when the watermark
    is ``idle_ms`` past its last sample, and its open segment with it. The batch fold has no such rule: there a segment goes
    on over any gap if the next sample lies within the radius.
    """

    def __init__(self, radius: float, gap: float, min_duration: float, idle_ms: int, slot_ms: int):
        if idle_ms < slot_ms:
            raise ValueError("a session cannot end before its slot")
        self.radius, self.gap, self.min_duration, self.idle_ms, self.slot_ms = radius, gap, min_duration, idle_ms, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", _SLOT, _SAMPLES)
        self.open = handle.getValueState("open", _FOLD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            at = pdf["at"].astype("datetime64[us]").astype("int64").to_numpy() / 1000.0
            columns = [pdf[c].to_numpy(float) for c in ("time_seconds", "px", "py")] + [at]
            slots = np.floor_divide(at, self.slot_ms).astype(np.int64)
            found = np.unique(slots).tolist()
            for slot, later in zip(found, [*found[1:], None]):
                fresh = [c[slots == slot].tolist() for c in columns]
                if self.slots.containsKey((slot,)):
                    fresh = [list(old) + new for old, new in zip(self.slots.getValue((slot,)), fresh)]
                else:
                    self.handle.registerTimer((slot + 1) * self.slot_ms)
                self.slots.updateValue((slot,), tuple(fresh))
                # set here and not when the slot is folded: a timer set by a timer would wait for one more batch; a slot
                # that another one follows before the session could end needs none
                ends = int(np.ceil(max(fresh[3]))) + self.idle_ms
                if later is None or (later + 1) * self.slot_ms > ends:
                    self.handle.registerTimer(ends)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        state = list(self.open.get()) if self.open.exists() else None
        done = []
        if state is not None and state[7] + self.idle_ms <= due:
            done.append(state)
            self.open.clear()
            state = None
        slot = (due // self.slot_ms - 1,)
        if due % self.slot_ms == 0 and self.slots.containsKey(slot):
            t, x, y, at = (np.asarray(c, dtype=float) for c in self.slots.getValue(slot))
            order = np.lexsort((y, x, t))
            *closed, last = fold_chunk(t[order], x[order], y[order], None if state is None else state[:7], self.radius, self.gap)
            done += closed
            self.slots.removeKey(slot)
            self.open.update((*(float(v) for v in last[:4]), int(last[4]), *(float(v) for v in last[5:7]), float(np.ceil(at.max()))))
        yield from self._rows(key, done)

    def close(self) -> None:
        pass

    def _rows(self, key, done: list[list]) -> Iterator[pd.DataFrame]:
        kept = [s for s in done if s[3] - s[0] >= self.min_duration]
        if kept:
            rows = [(key[0], s[0], s[3], s[3] - s[0], s[5] / s[4], s[6] / s[4], int(s[4])) for s in kept]
            yield pd.DataFrame(rows, columns=OUTPUT.fieldNames())


def stream_fixations(
    samples: DataFrame,
    delay: str = "10 seconds",
    radius: float = 0.05,
    min_duration: float = 0.5,
    gap: float = 0.2,
    idle_ms: int = 60_000,
    slot_ms: int = 1_000,
) -> DataFrame:
    """Segments of a stream of (session_id, at, time_seconds, px, py); late samples are dropped.

    Samples are folded when the watermark has passed the end of their slot of ``slot_ms``, so a segment appears at most that much
    later; a slot's samples of one session are held together. The state lives in RocksDB: set ``spark.sql.streaming.stateStore.providerClass``.
    """
    return (
        samples.withWatermark("at", delay)
        .groupBy("session_id")
        .transformWithStateInPandas(
            statefulProcessor=AnchoredSegments(radius, gap, min_duration, idle_ms, slot_ms),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )

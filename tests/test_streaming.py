"""Slots and timers of the live fold, driven by hand."""

import numpy as np
import pandas as pd
import pytest

from scanflow.operators.folds import fold_chunk
from scanflow.streaming.fixations import AnchoredSegments, OUTPUT


class Map:
    def __init__(self):
        self.rows, self.touched = {}, []

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        self.touched.append(key[0])
        return self.rows[key]

    def updateValue(self, key, value):
        self.touched.append(key[0])
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


class Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


class Handle:
    """What Spark gives a processor: state, and timers that fire in the order of their times."""

    def __init__(self):
        self.map, self.value, self.timers, self.registered = Map(), Value(), set(), []

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return self.value

    def registerTimer(self, at):
        self.timers.add(at)
        self.registered.append(at)


class Due:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def drive(batches, delay_ms, **options):
    """Rows the processor gives for batches of (time, x, y), and the slots that each batch touched."""
    handle, out, touched, mark, top = Handle(), [], [], 0, 0
    processor = AnchoredSegments(**options)
    processor.init(handle)
    for batch in [*batches, None]:
        handle.map.touched.clear()
        if batch is not None:
            rows = [r for r in batch if r[0] * 1000 > mark]
            pdf = pd.DataFrame(rows, columns=["time_seconds", "px", "py"])
            pdf["at"] = pd.to_datetime((pdf["time_seconds"] * 1e6).round().astype("int64"), unit="us")
            for part in (pdf[::2], pdf[1::2]):  # rows of a key come in pieces
                if len(part):
                    out += [tuple(r) for p in processor.handleInputRows((1,), iter([part]), None) for r in p.itertuples(index=False)]
            top = max([top, *(int(r[0] * 1000) for r in rows)])
        mark = max(mark, top - delay_ms) if batch is not None else 1 << 50
        for at in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(at)
            out += [tuple(r) for p in processor.handleExpiredTimer((1,), None, Due(at)) for r in p.itertuples(index=False)]
        touched.append(set(handle.map.touched))
    assert not handle.map.rows and not handle.value.exists()
    return out, touched, handle


@pytest.mark.parametrize("slot_ms", [100, 1000, 7000])
def test_live_fold_equals_the_fold_of_all(slot_ms):
    rng = np.random.default_rng(2)
    n = 600
    t = np.round(np.cumsum(rng.choice([0.005, 0.05, 0.3], n)) + 100, 3)
    x, y = np.cumsum(rng.normal(0, 0.03, n)), np.cumsum(rng.normal(0, 0.03, n))
    want = [(p[0], p[3], p[4]) for p in fold_chunk(t, x, y, None, 0.1, 0.01)]
    place = np.argsort(t + rng.uniform(0, 1.5, n))  # samples come up to 1.5 s late
    rows = [(t[i], x[i], y[i]) for i in place]
    batches = [rows[i : i + 40] for i in range(0, n, 40)]
    got, touched, _ = drive(batches, 2000, radius=0.1, gap=0.01, min_duration=0.0, idle_ms=60_000, slot_ms=slot_ms)
    assert sorted((round(r[1], 6), round(r[2], 6), r[6]) for r in got) == sorted((round(a, 6), round(b, 6), c) for a, b, c in want)
    assert list(OUTPUT.fieldNames())[1:3] == ["start_s", "end_s"]
    # a batch touches the slots of its samples and those that end before the watermark, not all that wait
    for batch, seen in zip(batches[1:], touched[1:]):
        own = {int(r[0] * 1000 // slot_ms) for r in batch}
        first = min(own) - 2000 // slot_ms - 2
        assert all(s in own or first <= s for s in seen) and len(seen) <= len(own) + 4000 // slot_ms + 2


def test_a_long_pause_ends_a_session():
    rows = [[(1.0 + 0.1 * i, 0.0, 0.0) for i in range(10)], [(200.0, 0.0, 0.0), (200.1, 0.0, 0.0)], [(400.0, 0.0, 0.0)]]
    got, _, _ = drive(rows, 1000, radius=0.1, gap=0.01, min_duration=0.0, idle_ms=60_000, slot_ms=1000)
    assert [(round(r[1], 3), round(r[2], 3), r[6]) for r in sorted(got)] == [(1.0, 1.9, 10), (200.0, 200.1, 2), (400.0, 400.0, 1)]
    with pytest.raises(ValueError):
        AnchoredSegments(0.1, 0.1, 0.1, 10, 1000)


def test_only_the_last_of_a_run_of_slots_has_an_end_timer():
    rows = [[(1.0 + i, 0.0, 0.0) for i in range(20)] + [(100.0 + i, 0.0, 0.0) for i in range(5)]]
    got, _, handle = drive(rows, 1000, radius=0.1, gap=0.01, min_duration=0.0, idle_ms=30_000, slot_ms=500)
    assert [(r[1], r[2], r[6]) for r in sorted(got)] == [(1.0, 20.0, 20), (100.0, 104.0, 5)]
    # 25 slots, and the ends of two runs in each of the two pieces of the batch
    assert len(handle.registered) == 25 + 4

"""Anchored folds in chunks against a plain loop."""

import numpy as np
import pandas as pd
import pytest

from scanflow.operators import folds

POINTS = [
    (0, 0.10, 0.10), (0.5, 0.12, 0.10), (1, 0.11, 0.11), (2, 0.10, 0.12),
    (2.5, 0.50, 0.50), (3, 0.52, 0.50), (3.5, 0.10, 0.10), (5.5, 0.12, 0.12),
]


def frames_of(spark, points):
    pdf = pd.DataFrame(points, columns=["time_seconds", "px", "py"])
    return spark.createDataFrame(pdf.assign(session_id=1, frame_idx=range(len(pdf))))


@pytest.mark.parametrize("size", [100, 3])
def test_known_fixations(spark, size):
    df = frames_of(spark, POINTS)
    got = folds.fixations(df, radius=0.15, min_duration=2, gap=0.01, size=size).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s, r.n) for r in got] == [(0, 2, 4), (3.5, 5.5, 2)]
    assert [r.center_x for r in got] == pytest.approx([0.1075, 0.11])
    (one,) = folds.fixations(df, radius=0.15, min_duration=2, gap=0.6, size=size).collect()
    assert (one.start_s, one.end_s, one.n) == (0, 5.5, 8)
    assert (one.center_x, one.center_y) == pytest.approx((0.20875, 0.20625))


def loop(t, x, y, radius, gap):
    out, s = [], 0
    for i in range(1, len(x)):
        if np.hypot(x[i] - x[s], y[i] - y[s]) > radius and t[i] - t[i - 1] > gap:
            out.append((t[s], t[i - 1], i - s))
            s = i
    return [*out, (t[s], t[-1], len(x) - s)]


@pytest.mark.parametrize("size", [1000, 24])
def test_chunks_equal_loop(spark, size):
    rng = np.random.default_rng(0)
    parts, want = [], []
    for s in range(5):
        n = 240
        t = np.arange(n) / 24
        x, y = np.cumsum(rng.normal(0, 0.03, n)), np.cumsum(rng.normal(0, 0.03, n))
        if s == 1:  # nothing ever breaks: every chunk is quiet
            x[:], y[:] = 0, 0
        if s == 2:  # a long quiet stretch between movements
            x[50:200], y[50:200] = x[50], y[50]
        if s == 3:  # some steps are short enough to be forgiven
            t = np.cumsum(rng.choice([0.005, 0.05], n))
        parts.append(pd.DataFrame({"session_id": s, "frame_idx": range(n), "time_seconds": t, "px": x, "py": y}))
        want += [(s, round(a, 6), round(b, 6), c) for a, b, c in loop(t, x, y, 0.1, 0.01)]
    df = spark.createDataFrame(pd.concat(parts))
    got = folds.anchored_segments(df, radius=0.1, gap=0.01, size=size).collect()
    assert sorted((r.session_id, round(r.start_s, 6), round(r.end_s, 6), r.n) for r in got) == sorted(want)


def scores_high(hists, threshold):
    return all(np.corrcoef(a, b)[0, 1] >= threshold for a, b in zip(hists, hists[1:]))


@pytest.mark.parametrize("width", [1000.0, 5.0])
def test_similar_episodes_equal_loop(spark, width):
    rng = np.random.default_rng(1)
    base = np.cumsum(rng.normal(0, 1, (80, 6)), axis=0)
    episodes = [(1, i, 2.0 * i, 2.0 * i + 1.5, None if i % 9 == 8 else "cup") for i in range(19)]
    kept, anchor = [0], 0
    for j in range(1, len(episodes)):
        at = np.floor(np.linspace(episodes[anchor][2], episodes[j][3], 5) * 2).astype(int)
        named = episodes[anchor][4] and episodes[j][4]
        if not (named and scores_high([base[f] for f in at if f < 80], 0.4)):
            kept.append(j)
            anchor = j
    features = spark.createDataFrame(
        pd.DataFrame({"session_id": 1, "frame_idx": range(80), "hist": [list(map(float, h)) for h in base]})
    )
    table = spark.createDataFrame(episodes, "session_id long, pos long, start_s double, end_s double, object string")
    got = folds.drop_consecutive_similar(table, features, fps=2.0, threshold=0.4, width=width)
    assert sorted(r.pos for r in got.collect()) == kept
    assert 1 < len(kept) < len(episodes)


def test_steady_drift_needs_few_rounds(spark, monkeypatch):
    n, size = 64 * 30, 30
    t = np.arange(n) / 24
    x = 0.013 * np.arange(n)  # breaks every eighth row: no chunk begins where a segment does
    y = np.zeros(n)
    df = spark.createDataFrame(pd.DataFrame({"session_id": 1, "frame_idx": range(n), "time_seconds": t, "px": x, "py": y}))
    calls = []
    plain = folds.cut
    monkeypatch.setattr(folds, "cut", lambda d: calls.append(1) or plain(d))
    got = folds.anchored_segments(df, radius=0.1, gap=0.01, size=size).collect()
    want = [(round(a, 6), round(b, 6), c) for a, b, c in loop(t, x, y, 0.1, 0.01)]
    assert sorted((round(r.start_s, 6), round(r.end_s, 6), r.n) for r in got) == sorted(want)
    assert len(calls) <= 2 + 2 * 8


def test_every_session_has_its_own_parameters(spark):
    rng = np.random.default_rng(5)
    parts, want, own = [], [], []
    for s in range(6):
        n = 300
        t = np.cumsum(rng.choice([0.005, 0.05], n))
        x, y = np.cumsum(rng.normal(0, 0.03, n)), np.cumsum(rng.normal(0, 0.03, n))
        if s % 2:
            x[60:240], y[60:240] = x[60], y[60]  # quiet chunks
        radius, gap, least = 0.05 + 0.05 * s, 0.01 if s % 3 else 0.001, 0.1 * s
        parts.append(pd.DataFrame({"session_id": s, "frame_idx": range(n), "time_seconds": t, "px": x, "py": y}))
        if s < 5:  # the last one has no parameters and gives nothing
            own.append((s, radius, gap, least))
            want += [(s, round(a, 6), round(b, 6), c) for a, b, c in loop(t, x, y, radius, gap) if b - a >= least]
    parameters = spark.createDataFrame(own, "session_id long, radius double, gap double, min_duration double")
    df = spark.createDataFrame(pd.concat(parts))
    got = folds.fixations(df, size=24, parameters=parameters).collect()
    assert sorted((r.session_id, round(r.start_s, 6), round(r.end_s, 6), r.n) for r in got) == sorted(want)


def test_parameters_of_data_sets(spark):
    df = spark.createDataFrame([(1, "EGTEA"), (2, "egoexo"), (3, "unknown"), (4, None)], "session_id long, source string")
    rows = {r.session_id: (r.radius, r.min_duration, r.gap) for r in folds.source_parameters(df, "source", 480).collect()}
    assert rows == {1: (0.15, 2.0, 0.01), 2: (0.2, 2.0, 0.01)}


def test_a_long_similar_run_settles_in_few_rounds(spark, monkeypatch):
    """64 chunks that all look like the first episode."""
    rng = np.random.default_rng(0)
    n, fps = 64 * 6, 2.0
    episodes = [(1, i, 10.0 * i, 10.0 * i + 8, "cup") for i in range(n)]
    wave = np.cos(np.arange(16) * np.pi / 8)
    hists = [(wave + rng.normal(0, 0.01, 16)).tolist() for _ in range(int(episodes[-1][3] * fps) + 1)]
    features = spark.createDataFrame(pd.DataFrame({"session_id": 1, "frame_idx": range(len(hists)), "hist": hists}))
    table = spark.createDataFrame(episodes, "session_id long, pos long, start_s double, end_s double, object string")
    rounds, plain = [], folds.cut
    monkeypatch.setattr(folds, "cut", lambda d: rounds.append(1) or plain(d))
    got = folds.drop_consecutive_similar(table, features, fps=fps, threshold=0.7, width=60.0)
    assert [r.pos for r in got.collect()] == [0] and len(rounds) <= 8

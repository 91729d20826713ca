"""Anchored folds: segmentations whose next break depends on the current anchor.

Such a fold is sequential within a session, yet a session may be far too long for one
task. Every chunk is therefore folded on its own, as if a segment began at its first
row, and the open segment at the end of a chunk is handed to the next one. A chunk whose
assumed entry differs from what the previous chunk hands over is folded again, together
with the chunks after it in its block; blocks double in length each round. Rounds go on
until no chunk's entry changes, which makes the result exact, and their number grows with the
logarithm of a session's chunks. A block is a stream: a task holds one chunk of it at a time.
Quiet chunks, which no break touches, are crossed by adding their totals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scanflow.functions.timecode import frame_index
from scanflow.operators import joins, ordered, segments
from scanflow.session import cut

_STATE = "start_s double, anchor_x double, anchor_y double, end_s double, n long, sum_x double, sum_y double"
_BLOCK = "_block"
_FIELDS = ["start_s", "anchor_x", "anchor_y", "end_s", "n", "sum_x", "sum_y"]


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash by ``keys`` over all shuffle partitions: Python work is worth a core per partition,
    however few bytes AQE sees in it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _first_break(x, y, may_break, begin, ax, ay, radius) -> int:
    """First row from ``begin`` on that may break and lies beyond ``radius``; -1 without one."""
    width = 64
    while begin < len(x):
        part = slice(begin, begin + width)
        beyond = (x[part] - ax) ** 2 + (y[part] - ay) ** 2
        hit = np.flatnonzero((np.sqrt(beyond) > radius) & may_break[part])
        if hit.size:
            return begin + int(hit[0])
        begin += width
        width *= 2
    return -1


def fold_chunk(t, x, y, entry: list | None, radius: float, gap: float) -> list[list]:
    """Pieces of one chunk: closed segments, then the one left open. ``entry`` is the open
    segment handed in, or None when the first row starts one."""
    may_break = np.diff(t, prepend=-np.inf if entry is None else entry[3]) > gap
    cx, cy = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(y)])
    state = [t[0], x[0], y[0], t[0], 0, 0.0, 0.0] if entry is None else entry
    at, search = 0, 1 if entry is None else 0
    pieces = []
    while True:
        stop = _first_break(x, y, may_break, search, state[1], state[2], radius)
        upto = len(x) if stop < 0 else stop
        if upto > at:
            state[3] = t[upto - 1]
        state[4] += upto - at
        state[5] += cx[upto] - cx[at]
        state[6] += cy[upto] - cy[at]
        pieces.append(state)
        if stop < 0:
            return pieces
        state = [t[stop], x[stop], y[stop], t[stop], 0, 0.0, 0.0]
        at, search = stop, stop + 1


def _run(frames: DataFrame, by: list[str], radius: float | None, gap: float | None) -> DataFrame:
    """Fold the chunks of every (session, block) in order; only one chunk is held at a time.

    A block's first chunk takes its entry from the columns ``e_*`` (null: its first row starts a segment),
    each following one the segment that the chunk before leaves open. Without ``radius`` and ``gap`` a session's own are
    in the columns of that name, and the pieces carry them on.
    """
    owned = ["radius", "gap"] if radius is None else []
    group = [*by, _BLOCK]
    keys = [*by, ordered.CHUNK]
    totals = ["low_x", "high_x", "low_y", "high_y", "sx_chunk", "sy_chunk", "last_s"]
    schema = T.StructType(
        [frames.schema[k] for k in keys]
        + list(T._parse_datatype_string(_STATE).fields)
        + list(T._parse_datatype_string("open boolean, e_start_s double, n_chunk long").fields)
        + [T.StructField(c, T.DoubleType()) for c in [*totals, *owned]]
    )
    arrow_schema = to_arrow_schema(schema)

    def table_of(first: dict, t, x, y, entry: list | None) -> tuple[pa.Table, list]:
        start = None if entry is None else entry[0]
        reach, step = (first[c] for c in owned) if owned else (radius, gap)
        pieces = fold_chunk(t, x, y, None if entry is None else list(entry), reach, step)
        n = len(pieces)
        columns = {k: [first[k]] * n for k in [*keys, *owned]}
        columns |= {f: [p[i] for p in pieces] for i, f in enumerate(_FIELDS)}
        columns |= {"open": [False] * (n - 1) + [True], "e_start_s": [start] * n, "n_chunk": [len(t)] * n}
        for name, value in zip(totals, (x.min(), x.max(), y.min(), y.max(), x.sum(), y.sum(), t[-1])):
            columns[name] = [float(value)] * n
        return pa.table(columns, schema=arrow_schema), pieces[-1]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, held = None, [], None  # of the chunk being read; the open segment and its block

        def close():
            nonlocal held
            t, x, y = (np.concatenate(c) for c in zip(*parts))
            own = tuple(first[k] for k in group)
            if held is not None and held[0] == own:
                entry = held[1]
            else:
                entry = None if first["e_start_s"] is None else [first[f"e_{f}"] for f in _FIELDS]
            table, last = table_of(first, t, x, y, entry)
            held = (own, last)
            return table.to_batches()

        for batch in batches:
            codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in [*group, ordered.CHUNK]]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in codes:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            columns = [batch.column(c).to_numpy() for c in ("time_seconds", "px", "py")]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                head = batch.slice(low, 1).to_pylist()[0]
                if first is not None and any(head[k] != first[k] for k in [*group, ordered.CHUNK]):
                    yield from close()
                    first, parts = None, []
                if first is None:
                    first = head
                parts.append([c[low:high] for c in columns])
        if first is not None:
            yield from close()

    dealt = spread(frames, group).sortWithinPartitions(*group, ordered.CHUNK, "frame_idx")
    return dealt.mapInArrow(fold, schema)


def _expected_entries(pieces: DataFrame, by: list[str], radius: float | None) -> DataFrame:
    """Per chunk, the open segment its predecessor hands over, given what is known so far.

    A quiet chunk (one piece that began at its own first row, or came in and never broke)
    hands on what the last non-quiet chunk left, as long as every point of the chunks in
    between lies within ``radius`` of that anchor.
    """
    keys = [*by, ordered.CHUNK]
    chunks = pieces.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_pieces"),
        F.max(F.when(F.col("open"), F.struct(*_FIELDS))).alias("_exit"),
        *[F.max(c).alias(c) for c in ("e_start_s", "low_x", "high_x", "low_y", "high_y",
                                      "n_chunk", "sx_chunk", "sy_chunk", "last_s")],
        (F.max("radius") if radius is None else F.lit(radius)).alias("_radius"),
    )
    order = Window.partitionBy(*by).orderBy(ordered.CHUNK)
    begin, here = Window.unboundedPreceding, Window.currentRow
    chunks = chunks.withColumn("_nr", F.row_number().over(order))
    loud = (F.col("_pieces") > 1) | (F.col("_nr") == 1)
    chunks = chunks.withColumn("_run", F.sum(F.when(loud, 1).otherwise(0)).over(order.rowsBetween(begin, here)))
    inside = Window.partitionBy(*by, "_run").orderBy(ordered.CHUNK)
    quiet = F.col("_nr") > F.first("_nr").over(inside.rowsBetween(begin, here))
    sofar = inside.rowsBetween(begin, here)
    chunks = chunks.select(
        "*",
        F.first("_exit").over(sofar).alias("_source"),
        quiet.alias("_quiet"),
    )

    def over_quiet(agg, col):
        return agg(F.when(F.col("_quiet"), F.col(col))).over(sofar)

    far_x = F.greatest(F.abs(over_quiet(F.min, "low_x") - F.col("_source.anchor_x")),
                       F.abs(over_quiet(F.max, "high_x") - F.col("_source.anchor_x")))
    far_y = F.greatest(F.abs(over_quiet(F.min, "low_y") - F.col("_source.anchor_y")),
                       F.abs(over_quiet(F.max, "high_y") - F.col("_source.anchor_y")))
    reach = F.sqrt(far_x * far_x + far_y * far_y)
    crossed = F.struct(
        F.col("_source.start_s").alias("start_s"),
        F.col("_source.anchor_x").alias("anchor_x"),
        F.col("_source.anchor_y").alias("anchor_y"),
        F.col("last_s").alias("end_s"),
        (F.col("_source.n") + over_quiet(F.sum, "n_chunk")).alias("n"),
        (F.col("_source.sum_x") + over_quiet(F.sum, "sx_chunk")).alias("sum_x"),
        (F.col("_source.sum_y") + over_quiet(F.sum, "sy_chunk")).alias("sum_y"),
    )
    through = F.col("_quiet") & (reach <= F.col("_radius"))
    chunks = chunks.withColumn("_hand", F.when(through, crossed).otherwise(F.col("_exit")))
    return chunks.select(*keys, "e_start_s", F.lag("_hand").over(order).alias("_entry"))


def anchored_segments(
    frames: DataFrame,
    by: Sequence[str] = ("session_id",),
    radius: float = 0.05,
    gap: float = 0.2,
    size: int = 65_536,
    parameters: DataFrame | None = None,
) -> DataFrame:
    """All segments of the anchored fold, before any duration filter.

    A segment is anchored at its first point. A point farther than ``radius`` closes it
    unless the step from the previous sample lasts at most ``gap``; then it stays inside. ``parameters`` has a row
    of ``radius`` and ``gap`` for each session: then every session is cut by its own, and sessions without a row
    have no segments.
    """
    by = list(by)
    keys = [*by, ordered.CHUNK]
    group = [*by, _BLOCK]
    base = frames.select(*by, "frame_idx", "time_seconds", "px", "py").withColumn(
        ordered.CHUNK, ordered.bucket(F.col("frame_idx"), size)
    )
    if parameters is not None:
        own = [F.col(c).cast("double").alias(c) for c in ("radius", "gap")]
        base, radius, gap = base.join(parameters.select(*by, *own), by), None, None
    entry = [F.lit(None).cast("long" if f == "n" else "double").alias(f"e_{f}") for f in _FIELDS]
    span = 1
    pieces = cut(_run(base.withColumn(_BLOCK, F.col(ordered.CHUNK)).select("*", *entry), by, radius, gap))
    while True:
        expected = _expected_entries(pieces, by, radius)
        changed = expected.where(~F.col("_entry.start_s").eqNullSafe(F.col("e_start_s")))
        span *= 2
        block = F.floor(F.col(ordered.CHUNK) / span).cast("long")
        # from the first wrong entry of a block on, all its chunks are folded in one go
        redo = cut(
            changed.withColumn(_BLOCK, block)
            .groupBy(*group)
            .agg(F.min(ordered.CHUNK).alias("_from"), F.min_by("_entry", ordered.CHUNK).alias("_entry"))
        )
        if redo.isEmpty():
            break
        handed = [
            F.when(F.col(ordered.CHUNK) == F.col("_from"), F.col(f"_entry.{f}")).alias(f"e_{f}") for f in _FIELDS
        ]
        rows = base.withColumn(_BLOCK, block).join(redo, group).where(F.col(ordered.CHUNK) >= F.col("_from"))
        again = _run(rows.select(*base.columns, _BLOCK, *handed), by, radius, gap)
        stay = pieces.withColumn(_BLOCK, block).join(redo.select(*group, "_from"), group, "left")
        stay = stay.where(F.col("_from").isNull() | (F.col(ordered.CHUNK) < F.col("_from"))).select(*pieces.columns)
        pieces = cut(stay.unionByName(again))
    last = pieces.groupBy(*by).agg(F.max(ordered.CHUNK).alias("_last"))
    done = pieces.join(last, by).where(~F.col("open") | (F.col(ordered.CHUNK) == F.col("_last")))
    return done.select(
        *by,
        "start_s",
        "end_s",
        (F.col("end_s") - F.col("start_s")).alias("duration"),
        (F.col("sum_x") / F.col("n")).alias("center_x"),
        (F.col("sum_y") / F.col("n")).alias("center_y"),
        "n",
    )


def fixations(
    frames: DataFrame,
    by: Sequence[str] = ("session_id",),
    radius: float = 0.05,
    min_duration: float = 0.5,
    gap: float = 0.2,
    size: int = 65_536,
    parameters: DataFrame | None = None,
) -> DataFrame:
    """Anchored segments of at least ``min_duration`` seconds; ``parameters`` (radius, gap, min_duration) are a session's own."""
    cut_ = anchored_segments(frames, by, radius, gap, size, parameters)
    if parameters is None:
        return cut_.where(F.col("duration") >= min_duration)
    least = parameters.select(*by, F.col("min_duration").cast("double").alias("_least"))
    return cut_.join(least, list(by)).where(F.col("duration") >= F.col("_least")).drop("_least")


#: Radius (a share of the width, or pixels), least duration and gap in seconds, by data set.
FIXATION_PARAMETERS = {
    "egtea": (0.15, 2.0, 0.01), "ego4d": (0.088, 2.0, 0.01), "egoexo": ("96 px", 2.0, 0.01), "holoassist": ("96 px", 2.0, 0.01),
}


def fixation_parameters(source: str, width: int) -> dict[str, float]:
    """Arguments of ``fixations`` for recordings of a data set with images ``width`` pixels wide."""
    radius, duration, gap = FIXATION_PARAMETERS[source.lower()]
    share = float(radius.split()[0]) / width if isinstance(radius, str) else radius
    return {"radius": share, "min_duration": duration, "gap": gap}


def source_parameters(recordings: DataFrame, source: str, width: int) -> DataFrame:
    """``recordings`` with radius, min_duration and gap of their data set (column ``source``); unknown ones are left out."""
    rows = [F.struct(F.lit(s).alias("_s"), *[F.lit(float(v)).alias(k) for k, v in fixation_parameters(s, width).items()]) for s in FIXATION_PARAMETERS]
    own = F.get(F.filter(F.array(*rows), lambda r: r["_s"] == F.lower(F.col(source))), F.lit(0))
    found = recordings.withColumn("_own", own).where(F.col("_own").isNotNull())
    return found.select(*recordings.columns, "_own.radius", "_own.min_duration", "_own.gap")


def _scores_high(hists: list, threshold: float) -> bool:
    """Whether all consecutive histograms correlate at least ``threshold``; true below two readable ones."""
    readable = [np.asarray(h, dtype=float) for h in hists if h is not None]
    for a, b in zip(readable, readable[1:]):
        da, db = a - a.mean(), b - b.mean()
        norm = np.sqrt((da * da).sum() * (db * db).sum())
        if norm > 0 and (da * db).sum() / norm < threshold:
            return False
    return True


def _dedup_chunk(rows: pd.DataFrame, features: pd.DataFrame, fps: float, threshold: float, samples: int) -> list[bool]:
    """Which episodes of a chunk are kept. ``e_similar`` compares them with the entering episode."""
    frames = dict(zip(features["frame_idx"], features["hist"]))
    start, end = rows["start_s"].to_numpy(), rows["end_s"].to_numpy()
    named = rows["object"].notna().to_numpy()
    entering = rows["e_similar"].to_numpy() if not pd.isna(rows["e_pos"].iloc[0]) else None
    kept, anchor = [], None
    for j in range(len(rows)):
        if anchor is None:
            similar = entering is not None and bool(entering[j])
        elif named[anchor] and named[j]:
            at = np.floor(np.linspace(start[anchor], end[j], samples) * fps).astype(int)
            similar = _scores_high([frames.get(f) for f in at], threshold)
        else:
            similar = False
        kept.append(not similar)
        if not similar:
            anchor = j
    return kept


def drop_consecutive_similar(
    episodes: DataFrame,
    features: DataFrame,
    fps: float,
    by: Sequence[str] = ("session_id",),
    threshold: float = 0.70,
    width: float = 60.0,
    samples: int = 5,
) -> DataFrame:
    """Keep an episode and drop the following ones while they look like it.

    Two named episodes look alike when the histograms of ``samples`` frames between the kept
    one's start and the other's end correlate neighbour by neighbour. Episodes are folded in
    chunks of ``width`` seconds next to the frames of their time range; what a chunk is
    handed from the chunk before is compared by joins, one row per episode, and corrected in
    rounds as in ``anchored_segments``. ``episodes`` carry a unique ``pos`` per session.
    """
    by = list(by)
    keys = [*by, ordered.CHUNK]
    fields = ["pos", "start_s", "end_s", "object"]
    base = episodes.select(*by, *fields).withColumn(ordered.CHUNK, ordered.bucket(F.col("start_s"), width))
    spans = base.groupBy(*keys).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    stamped = features.select(
        *by, "frame_idx", "hist", F.col("frame_idx").cast("double").alias("start_s"),
        F.col("frame_idx").cast("double").alias("end_s"),
    )
    reach = spans.select(
        *keys, F.floor(F.col("start_s") * fps).cast("double").alias("start_s"),
        F.floor(F.col("end_s") * fps).cast("double").alias("end_s"),
    )
    near = joins.overlap_join(reach, stamped, by, width=width * fps).select(
        *keys, F.col("match.frame_idx").alias("frame_idx"), F.col("match.hist").alias("hist")
    )
    schema = T.StructType(
        [base.schema[k] for k in keys]
        + [base.schema["pos"]]
        + list(T._parse_datatype_string("kept boolean, e_pos long").fields)
    )

    def run(chunk_rows: DataFrame) -> DataFrame:
        def fold(pdf: pd.DataFrame, frame_rows: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf):
                return pd.DataFrame(columns=schema.fieldNames())
            pdf = pdf.sort_values("pos").reset_index(drop=True)
            pdf["kept"] = _dedup_chunk(pdf, frame_rows, fps, threshold, samples)
            return pdf[schema.fieldNames()]

        wanted = near.join(chunk_rows.select(*keys).distinct(), keys, "left_semi")
        rows, seen = spread(chunk_rows, keys), spread(wanted, keys)
        return rows.groupBy(*keys).cogroup(seen.groupBy(*keys)).applyInPandas(fold, schema)

    fresh = base.withColumn("e_pos", F.lit(None).cast("long")).withColumn("e_similar", F.lit(None).cast("boolean"))
    marks = cut(run(fresh))
    while True:
        ends = marks.groupBy(*keys).agg(
            F.max(F.when(F.col("kept"), F.col("pos"))).alias("_last"), F.max("e_pos").alias("e_pos")
        )
        order = Window.partitionBy(*by).orderBy(ordered.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        expected = ends.select(*keys, "e_pos", F.last("_last", ignorenulls=True).over(order).alias("_entry"))
        changed = expected.where(~F.col("_entry").eqNullSafe(F.col("e_pos"))).select(
            *keys, F.col("_entry").cast("long").alias("e_pos")
        )
        if changed.isEmpty():
            break
        kept_rows = base.select(*by, F.col("pos").alias("e_pos"), F.struct("start_s", "object").alias("_a"))
        again = base.join(changed, keys).join(kept_rows, [*by, "e_pos"])
        points = segments.sample_times(F.col("_a.start_s"), F.col("end_s"), F.lit(samples))
        probes = again.select(*by, "pos", F.posexplode(points).alias("sample", "_t")).select(
            *by, "pos", "sample", frame_index(F.col("_t"), fps).alias("frame_idx")
        )
        scores = segments.adjacent_similarity(probes, features, by, "pos")
        scored = again.join(scores, [*by, "pos"], "left")
        unread = F.coalesce(F.col("n_readable"), F.lit(0)) < 2
        alike = F.col("object").isNotNull() & F.col("_a.object").isNotNull() & (
            unread | (F.col("min_score") >= threshold)
        )
        redo = scored.select(*keys, *fields, "e_pos", F.coalesce(alike, F.lit(False)).alias("e_similar"))
        marks = cut(marks.join(changed.select(*keys), keys, "left_anti").unionByName(run(redo)))
    return episodes.join(marks.where("kept").select(*by, "pos"), [*by, "pos"], "left_semi")

"""Per-frame gaze: sample typing, per-frame averaging, dense frames, trails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanflow.functions.geometry import clamp
from scanflow.functions.timecode import clock_ms, frame_index
from scanflow.operators import ordered

# Codes of a frame's gaze.
GAZE_LABELS = ["untracked", "fixation", "saccade", "unknown", "truncated"]
UNTRACKED, FIXATION, SACCADE, UNKNOWN, TRUNCATED = range(5)

SAMPLES_PER_CHUNK = 65_536
FRAMES_PER_TILE = 65_536


def gaze_label(code: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in GAZE_LABELS]), code)


def with_frame_time(df: DataFrame, fps: float) -> DataFrame:
    """Seconds, milliseconds and clock text of a frame number."""
    seconds = F.col("frame_idx") / F.lit(float(fps))
    return (
        df.withColumn("time_seconds", seconds)
        .withColumn("time_ms", F.col("time_seconds") * 1000)
        .withColumn("timestamp", clock_ms(F.col("time_seconds")))
    )


def clamp_normalized(df: DataFrame, width: int, height: int) -> DataFrame:
    """Pixel coordinates cut to the image and scaled to 0-1, with an out-of-range flag."""
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    return df.select(
        "*",
        (clamp(F.col("x"), 0, width - 1) / F.lit(float(width))).alias("px"),
        (clamp(F.col("y"), 0, height - 1) / F.lit(float(height))).alias("py"),
        (~inside).alias("outside"),
    )


def typed_range(gaze_type: Column, outside: Column, keep_truncated: bool = False) -> Column:
    """Vendor gaze keeps its type outside the image unless ``keep_truncated``."""
    return F.when(outside, F.lit(TRUNCATED)).otherwise(gaze_type) if keep_truncated else gaze_type


def confidence_type(x: Column, y: Column, confidence: Column) -> Column:
    unit = x.between(0, 1) & y.between(0, 1)
    return (
        F.when(x.isNull() | y.isNull(), UNTRACKED)
        .when(~unit, TRUNCATED)
        .when(confidence >= 0.9, FIXATION)
        .when(confidence >= 0.5, SACCADE)
        .otherwise(UNKNOWN)
    )


def validity_type(x: Column, y: Column, valid: Column, inside: Column) -> Column:
    return (
        F.when(F.coalesce(~valid, F.lit(True)) | x.isNull() | y.isNull(), UNTRACKED)
        .when(~inside, TRUNCATED)
        .otherwise(FIXATION)
    )


def in_frame(u: Column, v: Column, width: Column, height: Column) -> Column:
    return F.coalesce((u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def frame_count(last_time: Column, fps: float) -> Column:
    return frame_index(last_time, fps) + 1


def drop_late(samples: DataFrame, by: Sequence[str], seq: str, t: str, fps: float) -> DataFrame:
    """Samples within the frames that the last sample of a session (by ``seq``) reaches."""
    ends = samples.groupBy(*by).agg(frame_count(F.max_by(t, seq), fps).alias("_frames"))
    return samples.join(ends, list(by)).where(frame_index(F.col(t), fps) < F.col("_frames")).drop("_frames")


def frame_average(
    samples: DataFrame, by: Sequence[str], seq: str, values: Sequence[str], last: str | None = None
) -> DataFrame:
    """Running half-and-half average ``v = (v + x) / 2`` of a frame's samples in arrival order.

    The fold has a closed form: of n samples, number i weighs 2^-(n-i+1), the first 2^-(n-1).
    Samples with a null value do not count. ``last`` names the column taken from the last sample.
    """
    by = list(by)
    known = samples
    for value in values:
        known = known.where(F.col(value).isNotNull())
    placed = ordered.scan(
        known,
        by,
        [seq],
        ordered.bucket(F.col(seq), SAMPLES_PER_CHUNK),
        _i=ordered.row_number(),
        _n=ordered.total(F.lit(1)),
    )
    weight = F.pow(F.lit(2.0), -F.least(F.col("_n") - F.col("_i") + 1, F.col("_n") - 1))
    aggs = [F.sum(F.col(v) * weight).alias(v) for v in values] + [F.count(F.lit(1)).alias("n")]
    if last is not None:
        aggs.append(F.max_by(last, seq).alias(last))
    return placed.groupBy(*by).agg(*aggs)


def densify(frames: DataFrame, by: Sequence[str], fill: dict, step: int = FRAMES_PER_TILE) -> DataFrame:
    """Every frame from 0 to the last one of a session; missing ones take ``fill``.

    Frame numbers are generated block by block, so a long session is spread over tasks.
    """
    by = list(by)
    blocks = (
        frames.groupBy(*by)
        .agg(F.max("frame_idx").alias("_last"))
        .select(*by, "_last", F.explode(F.sequence(F.lit(0), F.floor(F.col("_last") / step).cast("long"))).alias("_b"))
        .repartition(*[F.col(c) for c in by], "_b")
    )
    low = F.col("_b") * step
    every = blocks.select(
        *by,
        F.explode(F.sequence(low, F.least(low + (step - 1), F.col("_last")))).alias("frame_idx"),
    )
    out = every.join(frames, [*by, "frame_idx"], "left")
    return out.select(
        *by,
        "frame_idx",
        *[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c)
          for c in frames.columns if c not in (*by, "frame_idx")],
    )


def validity_share(frames: DataFrame, by: Sequence[str]) -> DataFrame:
    good = F.col("valid") & F.col("u").isNotNull()
    return frames.groupBy(*by).agg(
        F.count_if(good).alias("n_valid"),
        F.count(F.lit(1)).alias("n_frames"),
        F.avg(F.when(good, 1.0).otherwise(0.0)).alias("share"),
    )


def trail(points: DataFrame, by: Sequence[str], pos: str, length: int = 30, size: int = FRAMES_PER_TILE) -> DataFrame:
    """The last ``length`` points up to and including each one, oldest first.

    ``points`` are the tracked samples numbered densely by ``pos``.
    """
    tiled = ordered.tiles(points, pos, size, before=length - 1)
    window = ordered.tile_window(by, pos).rowsBetween(-(length - 1), Window.currentRow)
    return ordered.home(tiled.withColumn("trail", F.collect_list(F.struct("px", "py")).over(window)))

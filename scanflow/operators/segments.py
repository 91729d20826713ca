"""Movement islands, segment statistics and segment filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanflow.functions.geometry import distance, pearson
from scanflow.functions.timecode import frame_index
from scanflow.operators import ordered


def segment_stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min("time_seconds").alias("start_s"),
        F.max("time_seconds").alias("end_s"),
        (F.max("time_seconds") - F.min("time_seconds")).alias("duration"),
        F.avg("px").alias("center_x"),
        F.avg("py").alias("center_y"),
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.max("px") - F.min("px"), F.max("py") - F.min("py")).alias("dispersion"),
    )


def movements(
    frames: DataFrame,
    by: Sequence[str] = ("session_id",),
    velocity: float = 0.05,
    min_duration: float = 0.05,
    dispersion: float = 0.03,
    size: int = 65_536,
) -> DataFrame:
    """Runs of fast samples, kept when long and wide enough.

    ``frames`` hold dense frame numbers. The step speed needs one earlier row, which the
    tile halo supplies; a run is then named by the slow frame before it, carried over tiles.
    """
    by = list(by)
    tiled = ordered.tiles(frames.select(*by, "frame_idx", "time_seconds", "px", "py"), "frame_idx", size, before=1)
    window = Window.partitionBy(*by, ordered.TILE).orderBy("frame_idx")
    earlier = {c: F.lag(c).over(window) for c in ("time_seconds", "px", "py")}
    dt = F.col("time_seconds") - earlier["time_seconds"]
    step = distance(F.col("px"), F.col("py"), earlier["px"], earlier["py"])
    moving = F.coalesce((dt > 0) & (step / F.when(dt > 0, dt) > F.lit(velocity)), F.lit(False))
    marked = ordered.home(tiled.withColumn("_fast", moving))
    runs = ordered.islands(
        marked, by, ["frame_idx"], ordered.bucket(F.col("frame_idx"), size), ~F.col("_fast"), F.col("frame_idx")
    )
    stats = segment_stats(runs.where("_fast"), [*by, "island"])
    return stats.where((F.col("duration") >= min_duration) & (F.col("dispersion") > dispersion)).drop("island")


def confusions(frames: DataFrame, by: Sequence[str] = ("session_id",), size: int = 65_536) -> DataFrame:
    """Sustained movement: low speed bound, at least 2.5 s."""
    return movements(frames, by, velocity=0.01, min_duration=2.5, dispersion=0.1, size=size)


def min_duration(segments: DataFrame, seconds: float = 2.5) -> DataFrame:
    if "duration" not in segments.columns:
        segments = segments.withColumn("duration", F.col("end_s") - F.col("start_s"))
    return segments.where(F.col("duration") >= seconds)


def require_valid_interval(segments: DataFrame, *needed: str) -> DataFrame:
    return segments.dropna(subset=["start_s", "end_s", *needed])


def normalize_columns(segments: DataFrame, by: Sequence[str], names: dict[str, str], chunk_seconds: float) -> DataFrame:
    """Standard time names from their alternatives, and a 0-based id per session when absent."""
    for standard, other in names.items():
        if standard not in segments.columns and other in segments.columns:
            segments = segments.withColumn(standard, F.col(other))
    if "fixation_id" not in segments.columns:
        segments = ordered.numbered(
            segments, by, ["start_s", "end_s"], ordered.bucket(F.col("start_s"), chunk_seconds), name="fixation_id"
        )
    return segments


def valid_frame_range(segments: DataFrame, fps: float, total: Column) -> DataFrame:
    """Frame range of a segment inside a video of ``total`` frames; empty ranges are dropped."""
    out = segments.withColumn("start_frame", frame_index(F.col("start_s"), fps)).where(F.col("start_frame") < total)
    out = out.withColumn("end_frame", F.least(frame_index(F.col("end_s"), fps), total))
    return out.where(F.col("start_frame") < F.col("end_frame"))


def sample_times(start: Column, end: Column, n: Column) -> Column:
    """``n`` evenly spaced times, both ends included."""
    count = n.cast("int")
    step = F.when(count > 1, (end - start) / F.when(count > 1, count - 1)).otherwise(F.lit(0.0))
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.when((i == count - 1) & (count > 1), end).otherwise(start + i * step),
    )


def sampled_frames(segments: DataFrame, keys: Sequence[str], fps: float, n: Column) -> DataFrame:
    """One row per sample point of a segment with its frame number."""
    return segments.select(
        *keys, F.posexplode(sample_times(F.col("start_s"), F.col("end_s"), n)).alias("sample", "_t")
    ).select(*keys, "sample", frame_index(F.col("_t"), fps).alias("frame_idx"))


def dark_share(
    segments: DataFrame, features: DataFrame, by: Sequence[str], key: str, fps: float, threshold: float = 10.0
) -> DataFrame:
    """Segments with a ``dark`` flag: three of five sampled frames under ``threshold``."""
    by = list(by)
    times = sample_times(F.col("start_s"), F.col("end_s"), F.lit(5))
    samples = segments.select(*by, key, F.struct(*segments.columns).alias("_segment"), F.explode(times).alias("_t")).select(
        *by, key, "_segment", frame_index(F.col("_t"), fps).alias("frame_idx")
    )
    lit = samples.join(features.select(*by, "frame_idx", "mean_luma"), [*by, "frame_idx"], "left")
    counted = lit.groupBy(*by, key).agg(
        F.first("_segment").alias("_segment"), (F.count_if(F.col("mean_luma") < threshold) >= 3).alias("dark")
    )
    return counted.select("_segment.*", "dark")


def adjacent_similarity(
    samples: DataFrame, features: DataFrame, by: Sequence[str], key: str, chunk: int = 1024
) -> DataFrame:
    """Correlation of consecutive readable samples of a segment: count, min, mean."""
    by = list(by)
    readable = samples.join(features.select(*by, "frame_idx", "hist"), [*by, "frame_idx"])
    paired = ordered.scan(
        readable.select(*by, key, "sample", "hist"),
        [*by, key],
        ["sample"],
        ordered.bucket(F.col("sample"), chunk),
        _before=ordered.last_value(F.struct("hist")),
    )
    score = F.when(F.col("_before").isNotNull(), pearson(F.col("_before.hist"), F.col("hist")))
    return (
        paired.select(*by, key, score.alias("_score"))
        .groupBy(*by, key)
        .agg(
            F.count(F.lit(1)).alias("n_readable"),
            F.min("_score").alias("min_score"),
            F.avg("_score").alias("mean_score"),
        )
    )


def scene_consistency(
    segments: DataFrame,
    features: DataFrame,
    by: Sequence[str],
    key: str,
    fps: float,
    threshold: float = 0.9,
    min_seconds: float = 1.5,
    dark_threshold: float = 10.0,
    chunk: int = 1024,
) -> DataFrame:
    """Segments with ``reason`` (too_short, black_scene, passed, scene_change) and ``kept``.

    One pass: a segment becomes its sample points (five for darkness, two a second for likeness, none when too
    short), which meet the features once, are compared with the readable point before them and folded back.
    Segments without a duration go. ``key`` is unique within ``by``.
    """
    by = list(by)
    timed = segments.withColumn("duration", F.col("end_s") - F.col("start_s")).where(F.col("duration").isNotNull())
    columns = timed.columns

    def points(scene: bool, n: Column) -> Column:
        times = sample_times(F.col("start_s"), F.col("end_s"), n)
        return F.transform(times, lambda t, i: F.struct(F.lit(scene).alias("scene"), i.alias("sample"), t.alias("t")))

    many = F.greatest(F.lit(5), F.floor(F.col("duration") * 2).cast("int"))
    probes = F.when(F.col("duration") >= min_seconds, F.concat(points(False, F.lit(5)), points(True, many)))
    flat = timed.select(*by, key, F.struct(*columns).alias("_segment"), F.explode_outer(probes).alias("_p")).select(
        *by, key, "_segment", F.col("_p.scene").alias("_scene"), F.col("_p.sample").alias("_sample"),
        frame_index(F.col("_p.t"), fps).alias("frame_idx"),
    )
    seen = features.select(*by, "frame_idx", "mean_luma", F.struct("hist").alias("_seen"))
    scene = F.coalesce(F.col("_scene"), F.lit(False))
    met = flat.join(seen, [*by, "frame_idx"], "left").select(
        *by, key, "_segment", scene.alias("_scene"), F.coalesce("_sample", F.lit(0)).alias("_sample"),
        (~scene & (F.col("mean_luma") < dark_threshold)).alias("_dark"), F.when(scene, F.col("_seen")).alias("_seen"),
    )
    paired = ordered.scan(
        met,
        [*by, key],
        ["_scene", "_sample"],
        F.when(F.col("_scene"), ordered.bucket(F.col("_sample"), chunk)).otherwise(F.lit(0).cast("long")),
        _before=ordered.last_value(F.col("_seen")),
    )
    both = F.col("_seen").isNotNull() & F.col("_before").isNotNull()
    score = F.when(both, pearson(F.col("_before.hist"), F.col("_seen.hist")))
    folded = (
        paired.select(*by, key, "_segment", "_dark", F.col("_seen").isNotNull().alias("_read"), score.alias("_score"))
        .groupBy(*by, key)
        .agg(
            F.first("_segment").alias("_segment"),
            (F.count_if("_dark") >= 3).alias("_dark"),
            (F.count_if("_read") < 2).alias("_unread"),
            F.min("_score").alias("min_score"),
            F.avg("_score").alias("mean_score"),
        )
        .select("_segment.*", "_dark", "_unread", "min_score", "mean_score")
    )
    reason = (
        F.when(F.col("duration") < min_seconds, "too_short")
        .when(F.col("_dark"), "black_scene")
        .when(F.col("_unread") | (F.col("min_score") >= threshold), "passed")
        .otherwise("scene_change")
    )

    def value(name: str) -> Column:
        whole = (F.col("reason") == "too_short") | F.col("_unread")
        return F.when(F.col("reason") == "black_scene", 0.0).when(whole, 1.0).otherwise(F.col(name)).alias(name)

    out = folded.withColumn("reason", reason)
    kept = F.col("reason").isin("too_short", "passed").alias("kept")
    return out.select(*columns, "reason", value("min_score"), value("mean_score"), kept)

"""Gaze rays to image points, frame by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanflow.functions import geometry, timecode
from scanflow.operators import frames, joins


def project_gaze(
    cameras: DataFrame,
    rays: DataFrame,
    poses: DataFrame,
    fps: float,
    reach: float = 0.5,
    skip_invalid: bool = False,
    chunk_ticks: float = 6_000_000_000,
    time_scale: int = 1,
    seq: str | None = None,
    block: int = 65_536,
) -> DataFrame:
    """2-D gaze per video frame.

    Each frame takes the pose and the ray nearest to its tick. ``cameras`` has one row per
    session; it is joined without a hint, since its size follows the number of sessions.
    Frame numbers are generated in blocks so that a long video is spread over tasks.
    """
    numbers = (
        cameras.select(
            "session_id",
            "start_tick",
            "n_frames",
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_frames") - 1) / block))).alias("_b"),
        )
        .repartition("session_id", "_b")
        .select(
            "session_id",
            "start_tick",
            F.explode(
                F.sequence(F.col("_b") * block, F.least(F.col("_b") * block + (block - 1), F.col("n_frames") - 1))
            ).alias("frame_idx"),
        )
    )
    step = timecode.frame_tick(F.lit(0).cast("long"), F.col("frame_idx"), fps) * F.lit(time_scale)
    video = numbers.select("session_id", "frame_idx", (F.col("start_tick") + step).alias("tick"))
    posed = joins.nearest_join(video, poses, ["session_id"], "tick", chunk_ticks, seq)
    posed = posed.select("session_id", "frame_idx", "tick", F.col("sample.pose").alias("pose"))
    aimed = joins.nearest_join(posed, rays, ["session_id"], "tick", chunk_ticks, seq)
    ray = {c: F.col(f"sample.{c}") for c in ("ox", "oy", "oz", "dx", "dy", "dz")}
    direction = geometry.unit(ray["dx"], ray["dy"], ray["dz"])
    aimed = aimed.select(
        "session_id",
        "frame_idx",
        "pose",
        F.coalesce(F.col("sample.valid"), F.lit(False)).alias("valid"),
        *[
            geometry.ray_point(ray[o], d, reach).alias(n)
            for o, d, n in zip(("ox", "oy", "oz"), direction, ("wx", "wy", "wz"))
        ],
    )
    cam = geometry.camera_point(F.col("pose"), F.col("wx"), F.col("wy"), F.col("wz"))
    lens = cameras.select("session_id", "fx", "fy", "cx", "cy", "width", "height")
    seen = aimed.withColumn("_c", cam).join(lens, "session_id")
    u = geometry.pinhole(F.col("_c")[0], F.col("_c")[2], F.col("fx"), F.col("cx"))
    v = geometry.pinhole(F.col("_c")[1], F.col("_c")[2], F.col("fy"), F.col("cy"))
    if skip_invalid:
        u, v = F.when(F.col("valid"), u), F.when(F.col("valid"), v)
    points = seen.withColumn("u", u).withColumn("v", v)
    return points.select(
        "session_id",
        "frame_idx",
        (F.col("frame_idx") / F.lit(float(fps))).alias("timestamp_sec"),
        "u",
        "v",
        "valid",
        frames.in_frame(F.col("u"), F.col("v"), F.col("width"), F.col("height")).alias("in_frame"),
    )

"""Interval chains: episodes, merged intervals, appearances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanflow.functions.geometry import distance
from scanflow.operators import ordered


def episode_members(
    segments: DataFrame,
    by: Sequence[str] = ("session_id",),
    space: float | None = 50.0,
    time: float = 2.0,
    chunk: float = 600.0,
    tie: Sequence[str] = ("end_s",),
) -> DataFrame:
    """Segments labelled with their episode.

    A segment joins the episode of the previous one when its centre is closer than
    ``space`` and it starts less than ``time`` after that segment's end (the previous
    row's end, not the running maximum). ``episode`` is the start of the first member,
    ``nr`` the member's 0-based place in the session.
    """
    by = list(by)
    order = ["start_s", *tie]
    cut = ordered.bucket(F.col("start_s"), chunk)
    fields = ["end_s"] + (["center_x", "center_y"] if space is not None else [])
    rows = ordered.scan(
        segments, by, order, cut, _p=ordered.last_value(F.struct(*fields)), nr=ordered.row_number()
    ).withColumn("nr", F.col("nr") - 1)
    together = F.col("start_s") - F.col("_p.end_s") < F.lit(time)
    if space is not None:
        near = distance(F.col("_p.center_x"), F.col("_p.center_y"), F.col("center_x"), F.col("center_y"))
        together = together & (near < F.lit(space))
    breaks = ~F.coalesce(together, F.lit(False))
    return ordered.islands(rows, by, order, cut, breaks, F.col("nr"), name="episode").drop("_p")


def episode_bounds(members: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """One row per episode: span and number of members."""
    return members.groupBy(*by, "episode").agg(
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        (F.max("end_s") - F.min("start_s")).alias("duration"),
        F.count(F.lit(1)).alias("n_members"),
    )


def member_lists(
    members: DataFrame, by: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Nested form for file output: one row per episode with ordered lists of member values.

    A list holds a whole episode. Members as rows (``members`` itself) are the form for further work.
    """
    nested = members.groupBy(*by, "episode").agg(F.array_sort(F.collect_list(F.struct("nr", *cols))).alias("_m"))
    return nested.select(*by, "episode", *[F.col(f"_m.{c}").alias(c) for c in cols])


def merge_intervals(
    intervals: DataFrame, by: Sequence[str], gap: float = 10.0, chunk: float = 600.0
) -> DataFrame:
    """Intervals united while the next start is at most ``gap`` past the running end."""
    by = list(by)
    cut = ordered.bucket(F.col("start_s"), chunk)
    order = ["start_s", "end_s"]
    rows = ordered.scan(
        intervals.select(*by, "start_s", "end_s"), by, order, cut, _reach=ordered.running_max(F.col("end_s"))
    )
    breaks = F.coalesce(F.col("start_s") - F.col("_reach") > F.lit(gap), F.lit(True))
    labelled = ordered.islands(rows, by, order, cut, breaks, F.col("start_s"), name="_from")
    return labelled.groupBy(*by, "_from").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("n_merged")
    ).drop("_from")


def appearances(entries: DataFrame, side: str, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Flat (object, interval) rows of one side (``fov`` or ``outside``) of a timeline."""
    return entries.select(*by, F.explode(side).alias("object"), "start_s", "end_s")


def longest_per_object(episodes: DataFrame, by: Sequence[str], name: str, pos: Sequence[str]) -> DataFrame:
    """The longest episode of each object; equal lengths take the first by ``pos``."""
    known = episodes.where(F.col("duration").isNotNull() & F.col(name).isNotNull())
    rank = F.struct((-F.col("duration")).alias("d"), *[F.col(p).alias(f"p{i}") for i, p in enumerate(pos)])
    rest = [c for c in episodes.columns if c not in (*by, name)]
    best = known.groupBy(*by, name).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
    return best.select(*by, name, "_b.*")


#: Seconds around a first appearance at which an alert is tested.
ALERT_OFFSETS = (-20, -10, 0, 10, 20)


def alert_points(first: Column, question: Column, offsets: Sequence[float] = ALERT_OFFSETS, horizon: float = 300.0) -> Column:
    """Evaluation times around a first appearance that lie in [question, question + horizon]."""
    times = F.array(*[first + F.lit(float(o)) for o in offsets])
    return F.filter(times, lambda t: (t >= question) & (t <= question + F.lit(horizon)))

"""Live alerts on subscribed objects."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stream_alerts(sightings: DataFrame, targets: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Alert when a viewed object is subscribed for its session.

    ``sightings`` streams (session_id, at, object); ``targets`` is a static table of
    (session_id, object). Repeats within the watermark delay are dropped.
    """
    watched = sightings.withWatermark("at", delay).join(targets, ["session_id", "object"])
    return watched.dropDuplicatesWithinWatermark(["session_id", "object"])

"""Object/action timelines: merging, neighbours, lookback, running views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanflow.operators import ordered

ENTRIES_PER_TILE = 4096


def scanpath(episodes: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Episodes as object entries: lower-case names in view (gazed one first) and outside.

    Episodes with equal bounds share an entry; their names are merged in ``pos`` order.
    """
    by = list(by)

    def named(arr: Column, side: int) -> Column:
        return F.transform(
            arr, lambda o, i: F.struct(F.lit(side).alias("side"), i.alias("i"), F.lower(o).alias("object"))
        )

    gazed = F.when(F.col("object").isNotNull(), F.array("object")).otherwise(F.array().cast("array<string>"))
    names = F.concat(named(F.concat(gazed, F.col("cropped")), 0), named(F.col("outside"), 1))
    flat = episodes.select(*by, "start_s", "end_s", "pos", F.explode_outer(names).alias("x"))
    once = flat.groupBy(*by, "start_s", "end_s", "x.side", "x.object").agg(
        F.min(F.struct("pos", F.col("x.i"))).alias("at")
    )

    def side(value: int) -> Column:
        picked = F.collect_list(F.when(F.col("side") == value, F.struct("at", "object")))
        return F.transform(F.array_sort(picked), lambda s: s["object"])

    return once.groupBy(*by, "start_s", "end_s").agg(side(0).alias("fov"), side(1).alias("outside"))


def timeline_merge(objects: DataFrame, actions: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """One entry per (start, end): object entries win over an action with the same bounds.

    Object entries with equal bounds become one with the names of all, in the order of their lists; of
    several actions with equal bounds the first by ``pos`` stays.
    """
    by = list(by)
    both = objects.select(*by, "start_s", "end_s", F.struct("fov", "outside").alias("_objects")).unionByName(
        actions.select(*by, "start_s", "end_s", F.struct("pos", "action").alias("_action")), allowMissingColumns=True
    )
    merged = both.groupBy(*by, "start_s", "end_s").agg(
        F.sort_array(F.collect_list("_objects")).alias("_objects"),
        F.min("_action").alias("_action"),
    )
    empty = F.array().cast("array<string>")
    is_object = F.size("_objects") > 0

    def names(side: str) -> Column:
        return F.array_distinct(F.flatten(F.transform("_objects", lambda o: F.coalesce(o[side], empty))))

    return merged.select(
        *by,
        "start_s",
        "end_s",
        F.when(is_object, "objects").otherwise("action").alias("kind"),
        names("fov").alias("fov"),
        names("outside").alias("outside"),
        F.when(~is_object, F.col("_action.action")).alias("action"),
    )


def with_position(entries: DataFrame, by: Sequence[str] = ("session_id",), chunk: float = 600.0) -> DataFrame:
    """0-based place of an entry in its session by (start, end)."""
    return ordered.numbered(entries, by, ["start_s", "end_s"], ordered.bucket(F.col("start_s"), chunk))


def neighbours(
    entries: DataFrame,
    cols: Sequence[str],
    before: int = 0,
    after: int = 0,
    by: Sequence[str] = ("session_id",),
    size: int = ENTRIES_PER_TILE,
) -> DataFrame:
    """Add ``prev1..`` / ``next1..`` structs of the entries around each positioned entry."""
    tiled = ordered.tiles(entries, "pos", size, before=before, after=after)
    window = Window.partitionBy(*by, ordered.TILE).orderBy("pos")
    row = F.struct(*cols)
    added = [F.lag(row, i).over(window).alias(f"prev{i}") for i in range(1, before + 1)]
    added += [F.lead(row, i).over(window).alias(f"next{i}") for i in range(1, after + 1)]
    return ordered.home(tiled.select("*", *added))


def lookback(
    entries: DataFrame, n: int = 3, by: Sequence[str] = ("session_id",), size: int = ENTRIES_PER_TILE
) -> DataFrame:
    """Names in view over the last ``n`` entries (actions count as entries), first mention first.

    Adds ``context`` and ``context_starts``, the start of the entry that first mentions each name.
    """
    tiled = ordered.tiles(entries, "pos", size, before=n - 1)
    window = Window.partitionBy(*by, ordered.TILE).orderBy("pos").rowsBetween(-(n - 1), Window.currentRow)
    named = F.transform("fov", lambda o: F.struct(o.alias("o"), F.col("start_s").alias("s")))
    seen = ordered.home(tiled.withColumn("_named", named).withColumn("_seen", F.flatten(F.collect_list("_named").over(window))))
    first = F.filter("_seen", lambda m, i: F.array_position(F.col("_seen.o"), m["o"]) == i + 1)
    return (
        seen.withColumn("_first", first)
        .withColumn("context", F.col("_first.o"))
        .withColumn("context_starts", F.col("_first.s"))
        .drop("_named", "_seen", "_first")
    )


def last_n(arr: Column, n: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - (n - 1), F.lit(1)), F.lit(n))


def gazed_so_far(
    entries: DataFrame, summary: DataFrame, by: Sequence[str] = ("session_id",), chunk: float = 600.0
) -> DataFrame:
    """Add ``n_gazed``: distinct names in view in entries that start no later than this one.

    A name counts from its first gaze on, so the running set is a prefix of the session's
    names in first-gaze order; its size stands for it (see ``gaze_order``).
    """
    by = list(by)
    marks = summary.where("gazed").select(
        *by, F.col("first_gaze").alias("_at"), F.lit(0).alias("_side"), F.lit(1).alias("_one")
    )
    held = entries.select(
        *by, F.col("start_s").alias("_at"), F.lit(1).alias("_side"),
        F.struct(*[c for c in entries.columns if c not in by]).alias("_e"),
    )
    counted = ordered.scan(
        marks.unionByName(held, allowMissingColumns=True),
        by,
        ["_at", "_side"],
        ordered.bucket(F.col("_at"), chunk),
        n_gazed=ordered.running_sum(F.coalesce(F.col("_one"), F.lit(0))),
    )
    return counted.where(F.col("_side") == 1).select(*by, "_e.*", "n_gazed")


def gaze_order(summary: DataFrame, by: Sequence[str] = ("session_id",), chunk: float = 600.0) -> DataFrame:
    """Gazed names with their 0-based place in first-gaze order."""
    return ordered.numbered(
        summary.where("gazed"), by, ["first_gaze", "object"], ordered.bucket(F.col("first_gaze"), chunk), name="rank"
    )


def occurrence_number(rows: DataFrame, key: str, order: str, width: float = 65_536) -> DataFrame:
    """Suffix ``_0, _1, ...`` on repeated ids in ``order``."""
    placed = ordered.numbered(rows, [key], [order], ordered.bucket(F.col(order), width), name="_o")
    return placed.withColumn("unique_id", F.concat_ws("_", F.col(key), F.col("_o"))).drop("_o")

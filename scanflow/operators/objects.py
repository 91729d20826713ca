"""Object vocabulary: frequencies, representative names, ordered distinct, set relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_mode(rows: DataFrame, keys: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """Most frequent non-blank name per key, first seen on a tie, with the payload of its first row.

    Counting is a partial aggregate per (key, name); only distinct names meet per key.
    """
    keys = list(keys)
    stamp = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in rows.columns if c not in (*keys, name, *order)]
    counted = (
        rows.where(F.col(name).isNotNull() & (F.col(name) != ""))
        .groupBy(*keys, name)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(stamp).alias("_first"),
            *([F.min_by(F.struct(*rest), stamp).alias("_payload")] if rest else []),
        )
    )
    rank = F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f"))
    payload = [F.col(name), F.col("_n").alias("n_votes")] + ([F.col("_payload")] if rest else [])
    best = counted.groupBy(*keys).agg(F.min_by(F.struct(*payload), rank).alias("_b"))
    out = best.select(*keys, "_b.*")
    return out.select(*keys, name, "n_votes", "_payload.*") if rest else out


def ordered_distinct(rows: DataFrame, keys: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """First occurrence of each name per key: one flat row per name with its order columns."""
    keys = list(keys)
    stamp = F.struct(*[F.col(o).alias(o) for o in order])
    rest = [c for c in rows.columns if c not in (*keys, name, *order)]
    aggs = [F.min(stamp).alias("_f")] + ([F.min_by(F.struct(*rest), stamp).alias("_p")] if rest else [])
    first = rows.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(*aggs)
    return first.select(*keys, name, "_f.*", *(["_p.*"] if rest else []))


def object_pool(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Distinct trimmed lower-case names per session."""
    clean = F.lower(F.trim(F.col(name)))
    return rows.select(*by, clean.alias("object")).where(F.col("object") != "").distinct()


def frequency(rows: DataFrame, by: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """Mentions per name with the first mention as tie-break."""
    stamp = F.struct(*order)
    return rows.groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"), F.min(stamp).alias("first_seen"))


def top_objects(counted: DataFrame, k: int = 20) -> DataFrame:
    return counted.orderBy(F.desc("n"), "first_seen").limit(k)


def frequency_summary(counted: DataFrame) -> DataFrame:
    return counted.agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.sum("n").alias("n_mentions"),
        F.count_if(F.col("n") == 1).alias("n_single"),
    )


def count_rows(rows: DataFrame, by: str) -> DataFrame:
    """Rows per session and, with a null session, overall."""
    return rows.rollup(by).agg(F.count(F.lit(1)).alias("n_rows"))


def episode_fields() -> dict[str, Column]:
    """The names of each field of an episode, as arrays."""
    return {"representative": F.array("object"), "cropped": F.col("cropped"), "outside": F.col("outside")}


def trimmed(names: Column) -> Column:
    """The names of an array without outer blanks; empty and null ones go, a null array is empty."""
    return F.coalesce(F.filter(F.transform(names, F.trim), lambda o: o != ""), F.array().cast("array<string>"))


def fields_of_objects(episodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct trimmed names of each episode field as flat (field, object) rows."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), names.alias("names")) for f, names in episode_fields().items()])
    flat = episodes.select(*by, F.explode(cells).alias("c")).select(
        *by, F.col("c.field").alias("field"), F.explode("c.names").alias("object")
    )
    return flat.select(*by, "field", F.trim("object").alias("object")).where(F.col("object") != "").distinct()


def gaze_summary(entries: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per object of a session: whether it was ever in view or outside, first gaze, last gaze end."""
    names = F.concat(
        F.transform("fov", lambda o: F.struct(o.alias("object"), F.lit(True).alias("seen"))),
        F.transform("outside", lambda o: F.struct(o.alias("object"), F.lit(False).alias("seen"))),
    )
    flat = entries.select(*by, "start_s", "end_s", F.explode(names).alias("x")).select(
        *by, "start_s", "end_s", "x.object", "x.seen"
    )
    return flat.groupBy(*by, "object").agg(
        F.max("seen").alias("gazed"),
        F.max(~F.col("seen")).alias("was_outside"),
        F.min(F.when(F.col("seen"), F.col("start_s"))).alias("first_gaze"),
        F.max(F.when(F.col("seen"), F.col("end_s"))).alias("last_gaze_end"),
    )


def new_objects(now: Column, later: Column) -> Column:
    """Names of ``later`` that are not in ``now``, in their order."""
    return F.filter(later, lambda o: ~F.array_contains(now, o))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def has_identical_neighbours(groups: Column) -> Column:
    """Whether two neighbouring groups hold the same names."""
    n = F.size(groups)
    pairs = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.exists(pairs, lambda i: same_set(F.get(groups, i), F.get(groups, i + 1)))


def option_overlap(options: Column, names: Column) -> Column:
    lower = F.transform(names, F.lower)
    return F.arrays_overlap(F.transform(options, F.lower), lower)

"""Nearest, overlap, forward as-of, prefix and positional joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanflow.operators import ordered
from scanflow.session import cut


def _stack(
    probes: DataFrame, samples: DataFrame, by: Sequence[str], at: str, probes_first: bool, seq: str | None
) -> DataFrame:
    """Both sides in one ordered stream: the payload column of the other side is null."""
    by = list(by)
    tie = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
    left = probes.select(
        *by, F.col(at).alias("_at"), F.lit(0 if probes_first else 2).alias("_side"),
        F.lit(0).cast("long").alias("_seq"), F.struct(*probes.columns).alias("_probe"),
    )
    right = samples.select(
        *by, F.col(at).alias("_at"), F.lit(1).alias("_side"), tie.alias("_seq"),
        F.struct(*samples.columns).alias("_sample"),
    )
    return left.unionByName(right, allowMissingColumns=True)


def nearest_join(
    probes: DataFrame, samples: DataFrame, by: Sequence[str], at: str, chunk: float, seq: str | None = None
) -> DataFrame:
    """Each probe with the closest sample by ``at``; equal distances take the earlier one.

    Adds ``sample``, the matched row as a struct (null when the session has no samples).
    """
    stream = _stack(probes, samples, by, at, True, seq)
    found = ordered.scan(
        stream,
        by,
        ["_at", "_side", "_seq"],
        ordered.bucket(F.col("_at"), chunk),
        _prev=ordered.last_value(F.col("_sample")),
        _next=ordered.next_value(F.col("_sample")),
    ).where(F.col("_side") == 0)
    ahead = F.abs(F.col(f"_next.{at}") - F.col("_at"))
    behind = F.abs(F.col("_at") - F.col(f"_prev.{at}"))
    pick = F.when(F.col("_prev").isNull() | (ahead < behind), F.col("_next")).otherwise(F.col("_prev"))
    return found.select("_probe.*", pick.alias("sample"))


def overlap_join(
    segments: DataFrame, intervals: DataFrame, by: Sequence[str], width: float, key: str | None = None,
    levels: int = 1, factor: int = 32,
) -> DataFrame:
    """Closed-interval overlaps of ``start_s``..``end_s``, one row per pair.

    Both sides are cut into time buckets, which join the key, so a long session is spread
    over tasks. A pair is emitted only in the bucket where the later of both starts lies.
    Interval columns come back as the struct ``match``. With ``key``, the column that
    identifies a segment within ``by``, segments without a match stay with a null match.

    For intervals of unknown length see ``sweep_join``. Where some are far longer than ``width``, ``levels`` above 1 keeps their copies few: a level's
    buckets are ``factor`` times as wide as the level's below, an interval lives on the first level where it
    spans two buckets at most, and a pair meets on the higher of both levels.
    """
    by = list(by)

    def buckets(df: DataFrame, payload: str) -> DataFrame:
        length = (F.col("end_s") - F.col("start_s")) / F.lit(float(width))
        own = sum((F.when(length > float(factor**k), 1).otherwise(0) for k in range(levels - 1)), F.lit(0))
        placed = df.where(F.col("end_s") >= F.col("start_s")).select(
            *by,
            F.struct(*df.columns).alias(payload),
            own.alias(f"{payload}_own"),
            F.explode(F.sequence(own, F.lit(levels - 1))).alias("_level"),
        )
        wide = F.lit(float(width)) * F.pow(F.lit(float(factor)), F.col("_level"))
        low, high = (F.floor(F.col(f"{payload}.{c}") / wide).cast("long") for c in ("start_s", "end_s"))
        return placed.withColumn(f"{payload}_low", low).withColumn("_bucket", F.explode(F.sequence(low, high)))

    left, right = buckets(segments, "_l"), buckets(intervals, "_r")
    pairs = left.join(right, [*by, "_level", "_bucket"]).where(
        (F.col("_l.end_s") >= F.col("_r.start_s"))
        & (F.col("_l.start_s") <= F.col("_r.end_s"))
        & (F.col("_level") == F.greatest("_l_own", "_r_own"))
        & (F.col("_bucket") == F.greatest("_l_low", "_r_low"))
    )
    matched = pairs.select("_l.*", F.col("_r").alias("match"))
    if key is None:
        return matched
    matched = cut(matched)
    alone = segments.join(matched.select(*by, key).distinct(), [*by, key], "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


_SIDES = ("_l", "_r")


def _sweep(pairs_at_once: int):
    """Pairs of overlapping rows of each group (``_uid``, ``_block``); rows come in the order of their place.

    A row meets the later rows of the other side that start before it ends: a range of them, since they are
    sorted by start. Later rows are those that begin in the group's chunk (``_own``); rows of block 0 and rows
    carried in from earlier chunks are the earlier ones.
    """

    def pairs(group: pa.Table) -> Iterator[pa.RecordBatch]:
        side, place = group["_side"].to_numpy(), group[ordered.PLACE].to_numpy()
        start, end = group["start_s"].to_numpy(), group["end_s"].to_numpy()
        own = group["_own"].to_numpy(zero_copy_only=False)
        early = ~own | (group["_block"].to_numpy() == 0)
        for one in (0, 1):
            first = np.flatnonzero(early & (side == one))
            later = np.flatnonzero(own & (side == 1 - one))
            low = np.searchsorted(place[later], place[first], side="right")
            count = np.maximum(np.searchsorted(start[later], end[first], side="right") - low, 0)
            some = count > 0
            first, low, count = first[some], low[some], count[some]
            upto = np.cumsum(count)
            total = int(upto[-1]) if len(upto) else 0
            for at in range(0, total, pairs_at_once):
                nr = np.arange(at, min(total, at + pairs_at_once))
                row = np.searchsorted(upto, nr, side="right")
                other = later[low[row] + nr - (upto[row] - count[row])]
                both = (first[row], other) if one == 0 else (other, first[row])
                yield pa.RecordBatch.from_arrays(
                    [group[c].combine_chunks().take(pa.array(at_)) for c, at_ in zip(_SIDES, both)], names=list(_SIDES)
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            uid, block = batch.column("_uid").to_numpy(), batch.column("_block").to_numpy()
            change = np.flatnonzero((np.diff(uid) != 0) | (np.diff(block) != 0)) + 1
            cuts = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                key = (uid[a], block[a])
                if held and key != now:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def sweep_join(
    segments: DataFrame, intervals: DataFrame, by: Sequence[str], key: str | None = None, bits: int = 12, pairs_at_once: int = 32_768
) -> DataFrame:
    """Closed-interval overlaps as ``overlap_join`` gives them, for intervals of any length and density.

    Both sides are sorted together by start and cut into chunks of at most ``2**bits`` rows. A pair belongs to the chunk of
    its later row; an interval that ends beyond its chunk is carried into each chunk it crosses, one row
    each. Inside a chunk a sweep finds the pairs without comparing others. Where more rows are carried than a chunk holds, they are dealt over blocks,
    each with the chunk's own rows. Intervals without start or end, or that end before they start, overlap nothing.
    """
    by = list(by)

    def side(df: DataFrame, nr: int) -> DataFrame:
        return df.where(F.col("end_s") >= F.col("start_s")).select(
            F.struct(*by).alias("_key"), F.col("start_s").cast("double"), F.col("end_s").cast("double"), F.lit(nr).alias("_side"),
            F.struct(*df.columns).alias(_SIDES[nr]),
        )

    rows = ordered.placed(side(segments, 0).unionByName(side(intervals, 1), allowMissingColumns=True), ["_key", "start_s"], bits)
    along = Window.partitionBy("_key").orderBy(ordered.CHUNK)
    chunks = cut(
        rows.groupBy("_key", ordered.CHUNK)
        .agg(F.min("start_s").alias("_from"))
        .select("*", F.row_number().over(along).alias("_nr"), F.lead("_from").over(along).alias("_next"))
        .withColumn("_uid", F.monotonically_increasing_id())
    )
    own = rows.join(chunks, ["_key", ordered.CHUNK]).select(*rows.drop(ordered.CHUNK).columns, "_nr", "_next", "_uid")
    # how far an interval reaches: the last chunk that begins no later than its end
    crossing = own.where(F.col("end_s") >= F.col("_next")).drop("_next", "_uid")
    marks = crossing.select("_key", F.col("end_s").alias("_at"), F.lit(1).alias("_after"), F.struct(*crossing.columns).alias("_row")).unionByName(
        chunks.select("_key", F.col("_from").alias("_at"), F.lit(0).alias("_after"), F.col("_nr").alias("_begun")), allowMissingColumns=True
    )
    stream = ordered.placed(marks, ["_key", "_at", "_after"], 16, chunk="_part").drop(ordered.PLACE)
    reached = ordered.scan(
        stream, ["_key"], ["_at", "_after"], F.col("_part"), _last=ordered.running_max(F.col("_begun"), inclusive=True)
    ).where("_after = 1")
    carried = cut(
        reached.select("_row.*", F.explode(F.sequence(F.col("_row._nr") + 1, F.col("_last"))).alias("_to"))
        .withColumn("_nr", F.col("_to")).drop("_to").join(chunks.select("_key", "_nr", "_uid"), ["_key", "_nr"])
    )
    blocks = carried.groupBy("_uid").agg(F.ceil(F.count(F.lit(1)) / F.lit(1 << bits)).cast("int").alias("_blocks"))
    fields = ["_uid", "_block", ordered.PLACE, "_side", "start_s", "end_s", "_own", *_SIDES]
    dealt = carried.join(blocks, "_uid").withColumns(
        {"_block": F.pmod(F.xxhash64(ordered.PLACE), F.col("_blocks")).cast("int"), "_own": F.lit(False)}
    )
    many = F.coalesce(F.col("_blocks"), F.lit(1))
    kept = own.join(blocks, "_uid", "left").withColumns(
        {"_block": F.explode(F.sequence(F.lit(0), many - 1)), "_own": F.lit(True)}
    )
    met = kept.select(*fields).unionByName(dealt.select(*fields)).repartition("_uid", "_block").sortWithinPartitions("_uid", "_block", ordered.PLACE)
    schema = T.StructType([met.schema[c] for c in _SIDES])
    pairs = met.mapInArrow(_sweep(pairs_at_once), schema).select("_l.*", F.col("_r").alias("match"))
    if key is None:
        return pairs
    matched = cut(pairs)
    alone = segments.join(matched.select(*by, key).distinct(), [*by, key], "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def next_after(
    probes: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    at: str,
    chunk: float,
    low: float,
    high: float,
    seq: str | None = None,
) -> DataFrame:
    """First event whose ``at`` lies in [probe + low, probe + high], as the struct ``event``."""
    shifted = probes.withColumn("_from", F.col(at)).withColumn(at, F.col(at) + F.lit(low))
    stream = _stack(shifted, events, by, at, True, seq)
    found = ordered.scan(
        stream,
        by,
        ["_at", "_side", "_seq"],
        ordered.bucket(F.col("_at"), chunk),
        _next=ordered.next_value(F.col("_sample")),
    ).where(F.col("_side") == 0)
    gap = F.col(f"_next.{at}") - F.col("_probe._from")
    keep = [F.col("_probe._from").alias(at) if c == at else F.col(f"_probe.{c}").alias(c) for c in probes.columns]
    return found.select(*keep, F.when(gap <= high, F.col("_next")).alias("event"))


def point_in_intervals(
    points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, chunk: float
) -> DataFrame:
    """Points with ``covered``: some interval of the same key holds the point, ends included."""
    starts = intervals.withColumn(at, F.col("start_s"))
    stream = _stack(points, starts, by, at, False, None)
    found = ordered.scan(
        stream,
        by,
        ["_at", "_side"],
        ordered.bucket(F.col("_at"), chunk),
        _reach=ordered.running_max(F.col("_sample.end_s")),
    ).where(F.col("_side") == 2)
    return found.select("_probe.*", F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False)).alias("covered"))


def window_totals(
    requests: DataFrame,
    samples: DataFrame,
    by: Sequence[str],
    key: str,
    low: Column,
    high: Column,
    value: str,
    chunk: float,
) -> DataFrame:
    """Count and sum of the samples inside each request's window ``[low, high]``.

    A request turns into two probes whose running totals are subtracted, so a prefix
    window costs two rows however long the prefix is. Totals are decimals, so nothing is lost when large
    values outside a window cancel out; values have up to 12 decimal places and 26 digits before them.
    """
    by = list(by)
    exact = "decimal(38,12)"
    probes = requests.select(
        *by,
        key,
        F.explode(
            F.array(
                F.struct(low.cast("double").alias("_at"), F.lit(-1).alias("_sign")),
                F.struct(high.cast("double").alias("_at"), F.lit(1).alias("_sign")),
            )
        ).alias("_p"),
    ).select(*by, key, F.col("_p._at").alias("_at"), F.col("_p._sign").alias("_sign"))
    # the lower probe sorts before samples at its time, the upper one after them
    stream = probes.withColumn("_side", F.col("_sign")).unionByName(
        samples.select(
            *by, F.col("t").cast("double").alias("_at"), F.lit(0).alias("_side"), F.col(value).cast(exact).alias("_v"),
            F.lit(1).alias("_one"),
        ),
        allowMissingColumns=True,
    )
    totals = ordered.scan(
        stream,
        by,
        ["_at", "_side"],
        ordered.bucket(F.col("_at"), chunk),
        _n=ordered.running_sum(F.coalesce(F.col("_one"), F.lit(0))),
        _s=ordered.running_sum(F.coalesce(F.col("_v"), F.lit(0).cast(exact))),
    ).where(F.col("_side") != 0)
    return totals.groupBy(*by, key).agg(
        F.sum(F.col("_n") * F.col("_sign")).alias("n_visible"),
        F.sum(F.when(F.col("_sign") > 0, F.col("_s")).otherwise(-F.col("_s"))).cast("double").alias("sum_visible"),
    )


def equi_join_last(left: DataFrame, right: DataFrame, key: str, seq: str) -> DataFrame:
    """Inner join where the last right row of a key wins and null matches null."""
    others = [c for c in right.columns if c not in (key, seq)]
    last = right.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*others), seq).alias("_row"))
    return left.join(last, F.col(key).eqNullSafe(F.col("_key"))).select(*left.columns, "_row.*")


def zip_positions(items: DataFrame, left: str, right: str, keep: Sequence[str]) -> DataFrame:
    """Elements of two arrays of a row paired by position, cut to the shorter array; no shuffle."""
    n = F.least(F.size(left), F.size(right))
    cut = [F.slice(c, 1, n).alias(c) for c in (left, right)]
    whole = items.where((F.size(left) > 0) & (F.size(right) > 0)).select(*keep, *cut)
    return whole.select(*keep, F.posexplode(F.arrays_zip(left, right)).alias("pos", "_pair")).select(
        *keep, "pos", F.col(f"_pair.{left}").alias(left), F.col(f"_pair.{right}").alias(right)
    )


def attach_results(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results written back to their requests with a status."""
    fields = [c for c in results.columns if c != key]
    out = requests.join(results.withColumn("_hit", F.lit(True)), key, "left")
    status = F.when(F.col("_hit").isNull(), "missing").when(F.col("error").isNotNull(), "error").otherwise("success")
    return out.select(*requests.columns, *fields, status.alias("status"))

"""Exact clustering of integer vectors around moving centroids, with drift bounds from plane geometry.

Vectors are written once per *anchor*: cluster, exact squared distance to it (``own``) and lower bounds of the distances to all
centroids (``low``, rounded down to floats). Later rounds read that table and test each vector against the centroids as they are now:

* the own centroid is at most its drift farther away;
* another centroid can have come nearer by its full drift, but only for a vector that lies in its direction. All vectors of a cluster lie in
  a sphere around the cluster's centroid at the anchor (radius: the largest ``own``). In the plane through the sphere's centre, the old
  and the new place of another centroid, the drift path is cut into pieces, and on each piece the approach is at most the
  piece's length times the cosine of the least angle between the path and the cone around the sphere. The sum bounds the
  loss of the lower bound; it is below the full drift, and negative when the centroid moves away (``approach``).

A vector whose bounds leave its cluster certain is not compared; one that is not gets its exact own distance, and if that leaves
doubt, all distances. Only vectors that left their anchor's cluster change the sums, so a round gives one small row
of differences per task and cluster. When more than ``RESCAN`` of the vectors had to be scanned, the next round writes a new anchor and
the old one is removed. Bounds only save work: distances, ties (the smaller number wins) and means (exact floors) are integers.

The driver holds the centroids, ``k`` rows, and collects ``k`` sums per round.

Rows: vectors that are null, of another length, or hold a null or a non-finite component are left out. Components beyond
``LIMIT`` in the scaled integers are taken as ``LIMIT``, so that squares fit a long. Of equal hashes (repeated ids) the
smaller vector comes first as a start; null ids come last. With fewer vectors than ``k`` there are fewer centroids; without vectors there are no rows.
Inertias beyond a long are null. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanflow.session import cut, discard, stage_path

DIMS = 64
K = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
RESCAN = 0.5
PIECES = 16
LIMIT = 1 << 27
STEP = 4096
NOWHERE = (1 << 63) - 1
#: Room for rounding in comparisons of square roots.
SLACK = 1e-9


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Components as integers, ``floor(scale * x)``."""
    most = F.lit(float(LIMIT))

    def one(x: Column) -> Column:
        return F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(scale)), -most), most)).cast("int")

    return F.transform(vector, one)


def usable(vector: Column, dims: int = DIMS) -> Column:
    def odd(x: Column) -> Column:
        value = F.abs(x.cast("double"))
        return value.isNull() | F.isnan(value) | (value == F.lit(float("inf")))

    return F.coalesce((F.size(vector) == dims) & ~F.exists(vector, odd), F.lit(False))


def starts(points: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of least hash of seed and id, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = points.select(mark.alias("mark"), "x").orderBy(F.col("mark").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centre, or to a centre each."""
    gap = x - centre
    return np.einsum("ij,ij->i", gap, gap)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([squared(x, c) for c in centres], axis=1)


def below(away: np.ndarray) -> np.ndarray:
    """Square roots as floats that are never too large."""
    return np.nextafter(np.sqrt(away.astype(float)).astype(np.float32), np.float32(-1))


def approach(old: np.ndarray, new: np.ndarray, radius: np.ndarray, pieces: int = PIECES) -> np.ndarray:
    """[i, j]: how much nearer centre j can have come to any point in the sphere around old centre i."""
    old, new = old.astype(float), new.astype(float)
    path = new - old
    drift = np.sqrt((path * path).sum(axis=1))
    unit = path / np.where(drift > 0, drift, 1)[:, None]
    between = old[:, None, :] - old[None, :, :]
    along = np.einsum("ijd,jd->ij", between, unit)
    aside = np.sqrt(np.maximum((between * between).sum(axis=2) - along * along, 0))
    total = np.zeros_like(along)
    for piece in range(pieces):
        begin, end = drift * piece / pieces, drift * (piece + 1) / pieces
        nearest = np.hypot(along - np.clip(along, begin[None, :], end[None, :]), aside)
        angle = np.arctan2(aside, along - begin[None, :])
        outside = nearest > radius[:, None] * (1 + SLACK)
        cone = np.arcsin(np.where(outside, radius[:, None] / np.where(outside, nearest, 1), 0))
        total += (end - begin)[None, :] * np.where(outside, np.cos(np.maximum(angle - cone, 0)), 1.0)
    return np.minimum(total, drift[None, :]) + SLACK * drift[None, :]


class Bounds:
    """What an anchor's vectors can rely on after the centres have moved."""

    def __init__(self, old: np.ndarray, new: np.ndarray, radius: np.ndarray):
        k = len(old)
        gap = (new - old).astype(float)
        self.now = new
        self.away = np.sqrt((gap * gap).sum(axis=1))
        self.loss = approach(old, new, radius)
        self.loss[np.arange(k), np.arange(k)] = -np.inf

    def settle(self, x: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Cluster of every vector now (the nearest centre, of equals the smaller number), and which were compared with all."""
        cluster, own, room = _numbers(part, "cluster"), _numbers(part, "own"), 1 + SLACK
        low = part.column("low").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(float)
        least = (low - self.loss[cluster]).min(axis=1) / room - SLACK
        most = (np.sqrt(own.astype(float)) + self.away[cluster]) * room + SLACK
        doubt = np.flatnonzero(~(most < least))
        exact = np.sqrt(squared(x[doubt], self.now[cluster[doubt]]).astype(float)) * room + SLACK
        doubt = doubt[~(exact < least[doubt])]
        out = cluster.copy()
        if len(doubt):
            out[doubt] = distances(x[doubt], self.now).argmin(axis=1)
        scanned = np.zeros(len(x), dtype=bool)
        scanned[doubt] = True
        return out, scanned


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, STEP):
        yield batch.slice(first, STEP)


def _anchored(centres: np.ndarray):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                away = distances(_matrix(part.column("x"), centres.shape[1]), centres)
                low = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(away) + 1, dtype=np.int32) * len(centres)), pa.array(below(away).reshape(-1))
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("x"), pa.array(away.argmin(axis=1).astype(np.int32)), pa.array(away.min(axis=1)), low],
                    names=["id", "x", "cluster", "own", "low"],
                )

    return place


def _add(total: np.ndarray, cluster: np.ndarray, x: np.ndarray, sign: int) -> None:
    for c in np.unique(cluster):
        total[c] += sign * x[cluster == c].sum(axis=0)


_SUMS = "cluster int, rows long, total array<long>, reach long, scanned long"


def _sums_of(k: int, dims: int):
    """Rows, sums and largest distance per cluster of an anchor."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, reach = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for part in _slices(batch):
                x, cluster = _matrix(part.column("x"), dims), _numbers(part, "cluster")
                _add(total, cluster, x, 1)
                np.maximum.at(reach, cluster, _numbers(part, "own"))
                rows += np.bincount(cluster, minlength=k)
        yield _sum_rows(rows, total, reach, np.zeros(k, np.int64))

    return add


def _changes_of(bounds: Bounds, k: int, dims: int):
    """What the moved vectors change in rows and sums of the clusters, and how many vectors were scanned."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, scans = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for part in _slices(batch):
                x, was = _matrix(part.column("x"), dims), _numbers(part, "cluster")
                now, scanned = bounds.settle(x, part)
                moved = np.flatnonzero(now != was)
                _add(total, now[moved], x[moved], 1)
                _add(total, was[moved], x[moved], -1)
                rows += np.bincount(now, minlength=k) - np.bincount(was, minlength=k)
                scans += np.bincount(was[scanned], minlength=k)
        yield _sum_rows(rows, total, np.zeros(k, np.int64), scans)

    return add


def _sum_rows(rows: np.ndarray, total: np.ndarray, reach: np.ndarray, scans: np.ndarray) -> pa.RecordBatch:
    k, dims = total.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * dims), pa.array(total.reshape(-1)))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(k, dtype=np.int32)), pa.array(rows), lists, pa.array(reach), pa.array(scans)],
        names=["cluster", "rows", "total", "reach", "scanned"],
    )


def _gather(partial: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    sums = F.array(*[F.sum(F.col("total")[i]) for i in range(dims)])
    found = partial.groupBy("cluster").agg(
        F.sum("rows").alias("rows"), sums.alias("total"), F.max("reach").alias("reach"), F.sum("scanned").alias("scanned")
    )
    rows, total, reach, scanned = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
    for r in found.collect():
        rows[r["cluster"]], total[r["cluster"]], reach[r["cluster"]] = r["rows"], r["total"], r["reach"]
        scanned += r["scanned"]
    return rows, total, reach, scanned


def _means(centres: np.ndarray, rows: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Exact floors; an empty cluster's centre stays."""
    return np.where(rows[:, None] > 0, total // np.maximum(rows, 1)[:, None], centres)


class Anchor:
    """The vectors with their state at the centres of one round, as a written table."""

    def __init__(self, points: DataFrame, centres: np.ndarray, id_type: str):
        spark = points.sparkSession
        self.path = stage_path(spark)
        self.centres = centres
        k, dims = centres.shape
        schema = f"id {id_type}, x array<int>, cluster int, own long, low array<float>"
        points.select("id", "x").mapInArrow(_anchored(centres), schema).write.parquet(self.path)
        self.table = spark.read.schema(schema).parquet(self.path)
        partial = self.table.select("x", "cluster", "own").mapInArrow(_sums_of(k, dims), _SUMS)
        self.rows, self.total, reach, _ = _gather(partial, k, dims)
        self.radius = np.sqrt(reach.astype(float))

    def moved(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows and sums of the clusters of ``centres``, and the share of vectors that were scanned."""
        k, dims = centres.shape
        bounds = Bounds(self.centres, centres, self.radius)
        partial = self.table.drop("id").mapInArrow(_changes_of(bounds, k, dims), _SUMS)
        rows, total, _, scanned = _gather(partial, k, dims)
        return self.rows + rows, self.total + total, scanned / max(1, int(self.rows.sum()))

    def assigned(self, centres: np.ndarray, id_type: str) -> DataFrame:
        """id, cluster and exact squared distance of every vector."""
        bounds = Bounds(self.centres, centres, self.radius)
        dims = centres.shape[1]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _slices(batch):
                    x = _matrix(part.column("x"), dims)
                    now, _ = bounds.settle(x, part)
                    away = squared(x, bounds.now[now])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), pa.array(now.astype(np.int32)), pa.array(away)], names=["id", "cluster", "distance"]
                    )

        return self.table.mapInArrow(place, f"id {id_type}, cluster int, distance long")


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS,
    rescan: float = RESCAN,
) -> tuple[DataFrame, np.ndarray, list[float]]:
    """The clusters of all usable vectors (id, cluster, distance), the last centres, and the share scanned in each round.

    A share of 1 marks a round that wrote an anchor.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("raw")).where(usable(F.col("raw"), dims))
    points = kept.select("id", scaled(F.col("raw")).alias("x"))
    id_type = points.schema["id"].dataType.simpleString()
    centres = starts(points, k)
    if not len(centres):
        return points.limit(0).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centres, []
    anchor, shares, source, stale = None, [], points, True
    for _ in range(rounds):
        if stale:
            before, anchor = anchor, Anchor(source, centres, id_type)
            source = anchor.table
            if before is not None:
                discard(spark, before.path)
            rows, total, stale = anchor.rows, anchor.total, False
            shares.append(1.0)
        else:
            rows, total, share = anchor.moved(centres)
            shares.append(share)
            stale = share > rescan
        centres = _means(centres, rows, total)
    return anchor.assigned(centres, id_type), centres, shares


def clustered(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    found, centres, _ = cluster(vectors, vec_id, vector, k, rounds, dims)
    placed = cut(found)
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    inertia = {r["cluster"]: int(r["inertia"]) for r in sums}
    whole = sum(inertia.values())

    def fit(value: int) -> int | None:
        return value if value <= NOWHERE else None

    lines = [
        (i, fit(inertia.get(i, 0)), fit(whole), hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest())
        for i, c in enumerate(centres)
    ]
    per = vectors.sparkSession.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(per), "cluster").select(
        F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

"""Connected components of a large graph, as tables.

Alternating large-star and small-star steps (Kiveris et al.) turn every component into a star around its least
vertex. A step is a minimum per vertex and a join; no vertex' neighbours are gathered in one place, and a
vertex with a large share of all edges is pre-aggregated and its join side can be split. Edges are written
to the shared folder between steps; the driver sees two numbers per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanflow.session import cut


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex moves to the least vertex around it."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours move to the least of them. ``edges`` point to smaller vertices."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``u`` and ``root`` (the least vertex it can reach) of every vertex with an edge to another vertex.

    Vertices are longs; null ends and loops are left out, repeated edges count once.
    """
    a, b = F.col(left), F.col(right)
    now = cut(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        now = cut(_small_star(_large_star(now).distinct()).distinct())
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select("u", F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())

"""Overlaps of intervals of any length against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from scanflow.operators import joins, ordered

LEFT = "s long, id long, start_s double, end_s double"
RIGHT = "s long, name string, start_s double, end_s double"


def plain(left, right):
    return sorted(
        (a[1], b[1]) for a in left for b in right
        if a[0] == b[0] and None not in (*a[2:], *b[2:]) and a[2] <= a[3] and b[2] <= b[3] and a[3] >= b[2] and a[2] <= b[3]
    )


def make(seed, n, long_share):
    rng = random.Random(seed)

    def one(nr, name):
        start = rng.choice([rng.uniform(0, 100), float(rng.randrange(0, 100, 5))])
        length = rng.uniform(0, 90) if rng.random() < long_share else rng.choice([0.0, rng.uniform(0, 2)])
        return (rng.choice([1, 1, 1, 2, 3]), name(nr), start, start + length)

    return [one(i, int) for i in range(n)], [one(i, str) for i in range(n)]


@pytest.mark.parametrize("bits,share", [(2, 0.3), (4, 0.0), (4, 0.9), (12, 0.3)])
def test_sweep_finds_all_overlaps(spark, bits, share):
    left, right = make(bits, 160, share)
    left += [(1, 900, 0.0, 500.0), (1, 901, None, 5.0), (1, 902, 6.0, 5.0), (9, 903, 0.0, 1.0)]
    right += [(1, "all", -5.0, 1000.0), (2, "none", 3.0, None), (8, "other", 0.0, 1.0)]
    a, b = spark.createDataFrame(left, LEFT).repartition(5), spark.createDataFrame(right, RIGHT).repartition(3)
    got = joins.sweep_join(a, b, ["s"], bits=bits, pairs_at_once=50).collect()
    assert sorted((r.id, r.match.name) for r in got) == plain(left, right)
    outer = joins.sweep_join(a, b, ["s"], key="id", bits=bits).collect()
    with_match = {p[0] for p in plain(left, right)}
    assert sorted(r.id for r in outer if r.match is None) == sorted(i[1] for i in left if i[1] not in with_match)
    assert sorted((r.id, r.match.name) for r in outer if r.match is not None) == plain(left, right)


def test_equal_intervals_in_great_number(spark):
    left = [(1, i, 5.0, 60.0) for i in range(100)] + [(1, 500 + i, float(i), float(i)) for i in range(80)]
    right = [(1, f"r{i}", 5.0, 6.0) for i in range(50)] + [(1, f"q{i}", 50.0 + i, 51.0 + i) for i in range(20)]
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    got = joins.sweep_join(a, b, ["s"], bits=3).collect()
    assert sorted((r.id, r.match.name) for r in got) == plain(left, right)
    assert joins.sweep_join(a.limit(0), b, ["s"]).collect() == []


def test_a_long_interval_is_one_row_per_chunk(spark, monkeypatch):
    """One interval over a whole session, among a thousand short ones."""
    n, bits, seen = 1000, 5, []
    left = [(1, 1, 0.0, 1e9)]
    right = [(1, str(i), 10.0 * i, 10.0 * i + 1) for i in range(n)]
    real = joins.cut
    monkeypatch.setattr(joins, "cut", lambda df: seen.append(real(df)) or seen[-1])
    out = joins.sweep_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["s"], bits=bits)
    assert out.count() == n
    chunks, carried = (next(t for t in seen if c in t.columns) for c in ("_next", "_side"))
    assert carried.count() == chunks.count() - 1
    assert chunks.count() <= (n + 1) / (1 << bits) + 10


def test_places_grow_along_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003 % 50).alias("v"), "id")
    rows = ordered.placed(df, ["v"], bits=4).orderBy(ordered.PLACE).collect()
    assert [r.v for r in rows] == sorted(r.v for r in rows) and len({r[ordered.PLACE] for r in rows}) == 5000
    sizes = {}
    for r in rows:
        sizes[r[ordered.CHUNK]] = sizes.get(r[ordered.CHUNK], 0) + 1
    assert max(sizes.values()) <= 16

"""Chunked scans and tiles against plain windows over whole sessions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scanflow.operators import joins, ordered
from scanflow.operators.quantiles import exact_quantiles


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def data(spark):
    n = F.col("id")
    return spark.range(400).select(
        (F.hash(n) % 3).alias("s"), (F.pmod(F.hash(n, F.lit(1)), F.lit(97))).alias("t"), n,
        F.when(n % 7 == 0, n).alias("v"),
    ).cache()


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_scan_equals_whole_window(data, width):
    w = Window.partitionBy("s").orderBy("t", "id")
    first, here, last = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing
    plain = data.select(
        "*",
        F.row_number().over(w).cast("long").alias("n"),
        F.sum("t").over(w.rowsBetween(first, here)).alias("sum"),
        F.coalesce(F.sum("t").over(w.rowsBetween(first, -1)), F.lit(0)).alias("before"),
        F.max("v").over(w.rowsBetween(first, -1)).alias("top"),
        F.lag("id").over(w).alias("lag"),
        F.lead("id").over(w).alias("lead"),
        F.last("v", True).over(w.rowsBetween(first, here)).alias("seen"),
        F.first("v", True).over(w.rowsBetween(1, last)).alias("coming"),
        F.count(F.lit(1)).over(Window.partitionBy("s")).alias("all"),
    )
    got = ordered.scan(
        data, ["s"], ["t", "id"], ordered.bucket(F.col("t"), width),
        n=ordered.row_number(),
        sum=ordered.running_sum(F.col("t")),
        before=ordered.running_sum(F.col("t"), inclusive=False),
        top=ordered.running_max(F.col("v")),
        lag=ordered.last_value(F.col("id")),
        lead=ordered.next_value(F.col("id")),
        seen=ordered.last_value(F.col("v"), inclusive=True),
        coming=ordered.next_value(F.col("v")),
        all=ordered.total(F.lit(1)),
    )
    assert rows(got, "s", "t", "id") == rows(plain, "s", "t", "id")


@pytest.mark.parametrize("size", [3, 10, 1000])
def test_tiles_equal_whole_window(data, size):
    placed = ordered.numbered(data, ["s"], ["t", "id"], ordered.bucket(F.col("t"), 10))
    tiled = ordered.tiles(placed, "pos", size, before=2, after=1)
    w = Window.partitionBy("s", ordered.TILE).orderBy("pos")
    got = ordered.home(
        tiled.withColumn("m", F.collect_list("id").over(w.rowsBetween(-2, 1)))
    )
    whole = Window.partitionBy("s").orderBy("pos").rowsBetween(-2, 1)
    assert rows(got, "s", "pos") == rows(placed.withColumn("m", F.collect_list("id").over(whole)), "s", "pos")


def test_halo_wider_than_tile_is_refused(data):
    with pytest.raises(ValueError):
        ordered.tiles(data, "t", 2, before=3)


def test_quantiles_equal_percentile(data):
    want = data.groupBy("s").agg(
        F.percentile("t", 0.5).alias("m"), F.percentile("t", 0.95).alias("p")
    )
    got = exact_quantiles(data, ["s"], "t", {"m": 0.5, "p": 0.95}, width=7)
    for a, b in zip(rows(got, "s"), rows(want, "s")):
        assert a == pytest.approx(b)


@pytest.mark.parametrize("width", [1.0, 7.0, 1e6])
def test_overlap_equals_cross_check(spark, width):
    n = F.col("id")
    a = spark.range(60).select((n % 2).alias("s"), n.alias("a"), (n * 3.0).alias("start_s"), (n * 3.0 + n % 11).alias("end_s"))
    b = spark.range(40).select((n % 2).alias("s"), n.alias("b"), (n * 5.0).alias("start_s"), (n * 5.0 + n % 7 * 4).alias("end_s"))
    got = joins.overlap_join(a, b, ["s"], width, key="a").select("a", F.col("match.b").alias("b"))
    want = a.alias("l").join(
        b.alias("r"),
        (F.col("l.s") == F.col("r.s")) & (F.col("l.end_s") >= F.col("r.start_s")) & (F.col("l.start_s") <= F.col("r.end_s")),
        "left",
    ).select("a", "b")
    assert rows(got, "a", "b") == rows(want, "a", "b")


def test_null_sessions_are_numbered_like_any_other(spark):
    rows = [(s, i) for s in (None, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "session_id long, t long")
    got = ordered.numbered(df, ["session_id"], ["t"], ordered.bucket(F.col("t"), 2.0)).collect()
    assert sorted((r.session_id or 0, r.t, r.pos) for r in got) == [(s, i, i) for s in (0, 1) for i in range(6)]


def test_draws_reach_nearly_every_subset(spark):
    from scanflow.operators import draws

    names = spark.createDataFrame([(1, f"n{i}") for i in range(12)], "session_id long, object string")
    items = spark.range(2000).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("pos"))
    pool = draws.ranked_pool(names, ["session_id"], "t")
    got = draws.draw_from_pool(items, pool, ["session_id"], ["session_id", "pos"], 3, "t").collect()
    assert len(got) == 2000 and all(len(set(r.drawn)) == 3 for r in got)
    assert len({tuple(sorted(r.drawn)) for r in got}) >= 200
    few = draws.draw_from_pool(items.limit(50), pool, ["session_id"], ["session_id", "pos"], 20, "t", exclude=F.array(F.lit("n3"))).collect()
    assert all(sorted(r.drawn) == sorted(f"n{i}" for i in range(12) if i != 3) for r in few)


def test_window_totals_keep_small_values_between_large_ones(spark):
    samples = spark.createDataFrame([(1, 0.0, 1e17), (1, 1.0, 0.25), (1, 2.0, 0.5)], "session_id long, t double, v double")
    asked = spark.createDataFrame([(1, 7, 0.5, 3.0)], "session_id long, id long, low double, high double")
    (row,) = joins.window_totals(asked, samples, ["session_id"], "id", F.col("low"), F.col("high"), "v", chunk=1.0).collect()
    assert (row.n_visible, row.sum_visible) == (2, 0.75)


def test_object_entries_with_equal_bounds_keep_all_names(spark):
    from scanflow.operators import timeline

    objects = spark.createDataFrame(
        [(1, 0.0, 1.0, ["b"], ["y"]), (1, 0.0, 1.0, ["a"], ["x", "y"])],
        "session_id long, start_s double, end_s double, fov array<string>, outside array<string>",
    )
    actions = spark.createDataFrame([], "session_id long, start_s double, end_s double, pos long, action string")
    (row,) = timeline.timeline_merge(objects, actions).collect()
    assert (row.fov, row.outside) == (["a", "b"], ["x", "y"])


@pytest.mark.parametrize("levels", [1, 3])
def test_overlaps_of_short_and_very_long_intervals(spark, levels):
    import random

    rng = random.Random(2)

    def some(n):
        rows = []
        for i in range(n):
            a = rng.uniform(0, 2000)
            rows.append((1, i, a, a + rng.choice([0.0, 0.5, 3.0, 70.0, 1500.0])))
        return rows

    a, b = some(60), some(60)
    schema = "session_id long, id long, start_s double, end_s double"
    got = joins.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["session_id"], width=1.0, levels=levels, factor=8)
    want = {(x[1], y[1]) for x in a for y in b if x[3] >= y[2] and x[2] <= y[3]}
    pairs = [(r.id, r.match.id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def file_scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_chained_scans_read_their_input_once(spark, tmp_path):
    spark.range(3000).selectExpr("id % 3 AS s", "id * 7 % 1009 AS t", "id").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    want, counts = df, []
    for k in range(4):
        w = Window.partitionBy("s").orderBy("t", "id")
        before = F.coalesce(F.sum("id" if k == 0 else f"r{k - 1}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        want = want.withColumn(f"r{k}", before % 1000)
        name = "id" if k == 0 else f"r{k - 1}"
        df = ordered.scan(df, ["s"], ["t", "id"], ordered.bucket(F.col("t"), 50), x=ordered.running_sum(F.col(name), inclusive=False))
        df = df.withColumn(f"r{k}", F.col("x") % 1000).drop("x")
        counts.append(file_scans(df))
    assert counts == [2, 2, 2, 2]
    assert rows(df, "id") == rows(want, "id")


def test_scene_consistency_reads_each_side_once(spark, sf_dir):
    from scanflow.plans import registered

    for name, most in (("scene_consistency", 4), ("projected_gaze", 4), ("episodes", 4)):
        assert file_scans(registered.QUERIES[name](spark, sf_dir)) <= most


def test_alert_questions_read_entries_once_for_spans_and_once_for_labels(spark, sf_dir):
    from scanflow.plans import registered

    for name, most in (("ask_alert_gaze", 3), ("ask_alert_appear", 4)):
        assert file_scans(registered.QUERIES[name](spark, sf_dir)) <= most

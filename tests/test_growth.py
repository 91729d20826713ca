"""Steps that must not gather one key's rows, repeat work, or explode what fits one row."""

import pandas as pd
from pyspark.sql import functions as F

from scanflow.operators import draws, ordered
from scanflow.plans import questions, registered, requests, scoring
from scanflow.sources import readers


def _plan(df, part="analyzed"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_scan_of_short_and_long_sessions_agree(spark, monkeypatch):
    rows = [(s, t, i) for s in (1, 2, None) for i, t in enumerate([None, None, 0, 1, 1, 7, 20, 21, 90])]
    df = spark.createDataFrame([r for r in rows if not (r[0] == 2 and r[2] % 2)], "s int, t int, i int")

    def scanned():
        out = ordered.scan(
            df, ["s"], ["t", "i"], ordered.bucket(F.col("t"), 5), number=ordered.row_number(), upto=ordered.running_sum(F.col("i")),
            prev=ordered.last_value(F.col("i")), later=ordered.next_value(F.col("i")), top=ordered.running_max(F.col("i")),
            every=ordered.total(F.col("i")),
        )
        return sorted(map(tuple, out.collect()), key=repr)

    whole = scanned()
    monkeypatch.setattr(ordered, "SESSION_ROWS", 2)
    assert scanned() == whole
    assert [r[3] for r in sorted((r for r in whole if r[0] == 1), key=lambda r: r[2])] == list(range(1, 10))
    # rows without a time have no chunk: they neither see later ones nor have a total
    assert {r[8] for r in whole if r[1] is None} == {None}
    assert {r[8] for r in whole if r[0] == 1 and r[1] is not None} == {36}


def test_draws_from_small_and_large_pools_agree(spark, monkeypatch):
    names = spark.createDataFrame([(s, f"n{i}") for s in (1, 2, 3) for i in range(4 * s)], "s int, object string")
    items = spark.createDataFrame([(s, p, [f"n{p % 5}"]) for s in (1, 2, 3, 4, None) for p in range(9)], "s int, p int, own array<string>")
    pool = draws.ranked_pool(names, ["s"], "seed")

    def drawn(**more):
        out = draws.draw_from_pool(items, pool, ["s"], ["s", "p"], 3, "seed", exclude=F.col("own"), **more)
        return sorted(map(repr, out.collect()))

    whole, kept = drawn(), drawn(keep_unmatched=True)
    assert len(whole) == 27 and len(kept) == 45
    monkeypatch.setattr(draws, "POOL_ROWS", 6)
    assert drawn() == whole and drawn(keep_unmatched=True) == kept
    monkeypatch.setattr(draws, "POOL_ROWS", 0)
    assert drawn() == whole


def test_packed_pools_have_the_ranks_of_ranked_pools(spark, monkeypatch):
    rows = [(s, [f"n{i}", f"n{i + 1}"], [f"n{i}"] if i % 4 == 1 else None) for s in (1, 2, None) for i in range(5 * (s or 1))]
    rows += [(3, [None, "n1"], []), (3, ["n1"], None), (4, [], None), (5, ["n1"], ["n1"]), (6, None, ["n2"])]
    lists = spark.createDataFrame(rows, "s int, ins array<string>, outs array<string>")
    items = spark.createDataFrame([(s, p, [f"n{p % 5}"]) for s in (1, 2, 3, 4, 5, 6, None) for p in range(9)], "s int, p int, own array<string>")
    flat = lists.select("s", F.explode("ins").alias("object"))
    left = flat.join(lists.select("s", F.explode("outs").alias("object")).distinct(), ["s", "object"], "left_anti")

    def drawn(pool):
        out = [draws.draw_from_pool(items, pool, ["s"], ["s", "p"], 3, "seed", exclude=F.col("own"), keep_unmatched=k) for k in (False, True)]
        return [sorted(map(repr, o.collect())) for o in out]

    for names, without in ((flat, None), (left, F.col("outs"))):
        whole = draws.ranked_pool(names, ["s"], "seed")
        sizes = sorted((r.s, r.n) for r in whole.dropna(subset=["s"]).groupBy("s").agg(F.max("n_pool").alias("n")).collect())
        want = drawn(whole)
        for session_rows, pool_rows in ((1 << 16, 256), (1 << 16, 4), (4, 256), (4, 4), (0, 0)):
            monkeypatch.setattr(ordered, "SESSION_ROWS", session_rows)
            monkeypatch.setattr(draws, "POOL_ROWS", pool_rows)
            pool = draws.packed_pool(lists, ["s"], "seed", F.col("ins"), without)
            assert sorted(tuple(r) for r in pool.sizes().collect()) == sizes
            assert drawn(pool) == want
        monkeypatch.undo()


def test_transitions_of_small_and_large_pools_agree(spark, monkeypatch):
    rows = [(s, i, "objects", [f"n{s * i % 7}", f"n{i % 5}x"], [], float(i), i + 1.0) for s in (1, 2, 3) for i in range(6 * s)]
    schema = "session_id int, pos long, kind string, fov array<string>, outside array<string>, start_s double, end_s double"
    entries = spark.createDataFrame(rows, schema)

    def asked():
        return sorted(map(repr, questions.transition_pattern(entries).collect()))

    whole = asked()
    assert whole
    monkeypatch.setattr(draws, "POOL_ROWS", 6)
    assert asked() == whole
    monkeypatch.setattr(ordered, "SESSION_ROWS", 5)
    assert asked() == whole


def test_questions_per_task_makes_its_timeline_once(spark, sf_dir, monkeypatch):
    from scanflow.plans import standins

    made, make = [], standins.timeline
    monkeypatch.setattr(standins, "timeline", lambda *a: made.append(a) or make(*a))
    monkeypatch.setattr(draws.ordered, "scan", _counted(draws.ordered.scan, scans := []))
    registered.QUERIES["questions_per_task"](spark, sf_dir)
    assert len(made) == 1
    assert len(scans) < 8  # the pools of short sessions are not scanned


def _counted(fn, calls):
    return lambda *a, **b: calls.append(fn) or fn(*a, **b)


def test_frequent_values_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(requests, "VALUE_ROWS", 100, raising=False)
    df = spark.range(0, 4000, 1, 4).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("v"), F.col("id") % 7)).alias("a"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = requests.rewrite_distinct(df, "a", lambda s: s.map(lambda v: v and f"<{v}>"), "b")
        found = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(found) == 4000 and all(r.b == (r.a and f"<{r.a}>") for r in found)
    assert pd.Series([r.task for r in found]).value_counts().max() < 2500


def test_filters_build_their_questions_once(spark, sf_dir):
    for name in ("filter_transition", "filter_scene_recall"):
        assert "Aggregate [" not in _plan(registered.QUERIES[name](spark, sf_dir))


def test_result_items_are_not_moved_by_file(spark):
    items = spark.createDataFrame([], f"model string, task string, {readers.QUESTION_SCHEMA}")
    assert "strategy=broadcast" in _plan(scoring.score_results(items))


def test_lines_after_a_blank_one_are_found_without_a_second_reading(spark, tmp_path):
    path = tmp_path / "rec" / "Video"
    path.mkdir(parents=True)
    row = "\t".join(["0.0", "{}"] + ["1"] * 16)
    (path / "pose.txt").write_text("\n".join([row.format(1), row.format(2), " ", row.format(3), "", row.format(4)]))
    out = readers.read_poses(spark, str(tmp_path / "*" / "Video" / "*.txt"))
    assert sorted(r.tick for r in out.collect()) == [1, 2]
    assert _plan(out).count("Join ") == 1


def test_line_items_meet_their_order_as_names(spark, sf_dir):
    from scanflow.plans import standins

    plan = _plan(standins.timeline(spark, sf_dir), "optimizedPlan")
    assert "Aggregate [l_orderkey" in plan

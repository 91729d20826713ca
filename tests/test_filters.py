"""Filter rules, scores and user functions on hand-made rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanflow.plans import filters as G
from scanflow.plans import requests as R
from scanflow.plans import scoring


def reasons(df, key="k"):
    return {r[key]: r.reason for r in df.collect()}


def test_next_action_gaps(spark):
    rows = [(g, "00:10", f"{(10 + g) // 60:02d}:{(10 + g) % 60:02d}", ["cup"], "Cut onion", ["A. x"]) for g in (3, 4, 60, 61)]
    rows += [(100, "00:10", "00:20", ["sink", "table"], "Cut", ["A. x"]), (101, "00:10", "00:20", ["onion"], "Cut onion", ["A. x"])]
    schema = "k long, time_stamp string, actual_action_time string, context_objects array<string>, answer_action string, options array<string>"
    out = G.next_action(spark.createDataFrame(rows, schema))
    assert reasons(out) == {
        3: "gap_too_short", 4: None, 60: None, 61: "gap_too_long", 100: "generic_context", 101: "context_in_answer",
    }
    kept, dropped = G.split(out)
    assert kept.count() + dropped.count() == len(rows)
    assert {r.k: r.response_time for r in kept.collect()}[4] == "[00:10 - 00:19]"


def test_identify_plurals(spark):
    rows = [
        (1, "cup", ["A. cup", "B. cups", "C. pan", "D. pot"], "A"),
        (2, "pan", ["A. cup", "B. cups", "C. Pan", "D. pot", "E. jar"], "C"),
        (3, "cups", ["A. cup", "B. cups", "C. pan", "D. pot", "E. jar"], "B"),
        (4, "Hand_Towel", ["A. x", "B. y", "C. z", "D. w"], "A"),
        (5, "lid", ["A. Tea_Cup", "B. y", "C. z", "D. w"], "A"),
    ]
    out = G.identify(spark.createDataFrame(rows, "k long, object string, options array<string>, answer string"))
    assert reasons(out) == {1: "similar_options", 2: None, 3: "similar_options", 4: "human_object", 5: None}
    got = {r.k: r for r in out.collect()}
    assert got[2].options == ["A. cup", "B. pan", "C. pot", "D. jar"] and got[2].answer == "B"
    assert got[5].options[0] == "A. tea cup"


def test_clip_rules(spark):
    rows = [(1, ["A. x"], "A", "lid", [0.0, 0.0]), (2, ["A. x"], "A", "lid", [0.0, 3.0])]
    items = spark.createDataFrame(rows, "k long, options array<string>, answer string, object string, clip array<double>")
    assert reasons(G.identify(items)) == {1: "zero_duration", 2: None}
    recall = items.withColumn("gazed_objects", F.array(F.lit("X")))
    assert reasons(G.scene_recall(recall.drop("object"))) == {1: "short_clip", 2: "short_clip"}
    longer = recall.withColumn("clip", F.array(F.lit(0.0), F.lit(9.0)))
    assert reasons(G.scene_recall(longer)) == {1: "gazed_in_options", 2: "gazed_in_options"}


def test_attribute_repair(spark):
    rows = [
        (1, "tea_cup", "color", ["A. red", "B. pink", "C. blue", "D. green"]),
        (2, "tea_cup", "size", ["A. red", "B. pink", "C. blue", "D. green"]),
        (3, "finger", "color", ["A. red", "B. pink", "C. blue", "D. green"]),
        (4, "cup", "color", ["A. red", "B. pink", "C. blue", "D. green"]),
        (5, "cup", "color", ["A. red", "B. pink", "C. blue", "D. green"]),
    ]
    items = spark.createDataFrame(rows, "k long, object_name string, attribute_type string, options array<string>")
    verdicts = spark.createDataFrame(
        [(1, "pink", "teal", True), (4, "pink", None, False), (5, "pink", "blue", True)],
        "k long, second string, replacement string, frames_read boolean",
    )
    out = G.attribute(items, verdicts, ["k"])
    assert reasons(out) == {1: None, 2: "subjective_type", 3: "human_object", 4: "frames_missing", 5: None}
    got = {r.k: r.options for r in out.collect()}
    assert got[1][1] == "B. teal" and got[5][1] == "B. pink"  # a hint already among the options is not used


def test_group_repair(spark):
    rows = [
        (1, ["A. cup", "B. tea_cup", "C. pan", "D. pot"], "cup", ["jar"]),
        (2, ["A. fork", "B. lid", "C. spoon", "D. hand mixer"], "lid", ["jar"]),
        (3, ["A. fork", "B. lid", "C. spoon", "D. whisk"], "lid", ["jar"]),
    ]
    items = spark.createDataFrame(rows, "k long, options array<string>, answer_object string, object_group array<string>")
    out = {r.k: r for r in G.next_after_group(items, ["k"]).collect()}
    assert out[2].reason == "human_object"
    assert out[3].options == rows[2][1] and out[3].n_fixed == 0
    fixed = [o[3:] for o in out[1].options]
    assert out[1].n_fixed == 1 and fixed[0] == "cup" and fixed[1] not in ("tea cup", "pan", "pot", "jar")
    hints = spark.createDataFrame([(1, 0, "ladle")], "k long, nr int, replacement string")
    out = {r.k: r for r in G.next_after_group(items, ["k"], hints).collect()}
    assert out[1].options[1] == "B. ladle"


def test_alert_verdicts(spark):
    rows = [(1, [("00:05", 0), ("00:15", 1), ("00:25", 0)])]
    items = spark.createDataFrame(rows, "k long, test_info array<struct<realtime:string,type:int>>")
    verdicts = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "k long, point int, verdict int")
    (row,) = G.alert_gaze(items, verdicts, ["k"]).collect()
    assert [t.type for t in row.test_info] == [1, 1, 0]
    assert (row.n_changed, row.n_skipped) == (1, 1)


def test_transition_rules(spark):
    rows = [(1, [["a"], ["a"]]), (2, [["a"]]), (3, [["a"], ["b"]]), (4, [["a"], ["b"], ["c"]])]
    items = spark.createDataFrame(rows, "k long, correct_sequence array<array<string>>")
    verdicts = spark.createDataFrame([(4, 0)], "k long, verdict int")
    assert reasons(G.transition(items, verdicts, ["k"])) == {
        1: "identical_neighbours", 2: "short_sequence", 3: None, 4: "verdict_invalid",
    }


def test_apply_verdicts(spark):
    items = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "k long, answer string")
    verdicts = spark.createDataFrame([(1, 0, None), (2, 1, "D")], "k long, verdict int, relabel string")
    out = G.apply_verdicts(items, verdicts, ["k"], label="answer")
    assert reasons(out) == {1: "verdict_invalid", 2: None, 3: None}
    assert {r.k: r.answer for r in out.collect()} == {1: "A", 2: "D", 3: "C"}


def test_alert_scores(spark):
    rows = [(1, "Yes."), (0, "unknown"), (0, "yes"), (None, "yes")]
    points = spark.createDataFrame(rows, "type int, response string").withColumn("g", F.lit(1))
    (loose,) = scoring.score_alert(points, ["g"]).collect()
    (strict,) = scoring.score_alert(points, ["g"], strict=True).collect()
    assert (loose.n_correct, loose.n_total) == (2, 3) and strict.n_correct == 1
    assert (loose.precision, loose.recall) == (0.5, 1.0)


def test_latency(spark):
    df = spark.createDataFrame([("t", float(s)) for s in (1, 2, 4, 10)] + [("u", 3.0)], "task string, seconds double")
    got = {r.task: r for r in scoring.score_latency(df, "task").collect()}
    t = got["t"]
    assert (t.mean, t["median"], t["std"], t.p95, t.p99) == pytest.approx((4.25, 3, 4.031129, 9.1, 9.82))
    assert got["u"]["std"] == 0 and got["overall"].n == 5


def test_user_function_errors_stay_in_their_row(spark):
    def model(batch):
        if (batch["k"] == 2).any():
            raise ValueError("no answer")
        return pd.DataFrame({"text": ["yes"] * len(batch), "seconds": 1})

    out = R.predict(spark.range(5).select(F.col("id").alias("k")).coalesce(1), model, ["k"]).collect()
    assert {r.k: (r.text, r.error) for r in out} == {
        k: (None, "no answer") if k == 2 else ("yes", None) for k in range(5)
    }


def test_alert_requests_skip_answered(spark):
    rows = [("q", [("00:05", 0, None), ("00:15", 1, "Yes")])]
    items = spark.createDataFrame(rows, "question string, test_info array<struct<realtime:string,type:int,response:string>>")
    (row,) = R.alert_requests(items).collect()
    assert (row.point, row.window_end) == (0, 5)


def test_routes(spark):
    items = spark.createDataFrame([("a", [["x"], ["y"]])], "item_key string, correct_sequence array<array<string>>")
    flat = G.run_filters({"object_transition.json": items, "never_gazed.json": items}, {"past_transition_pattern": G.transition})
    assert [tuple(r) for r in flat.collect()] == [("object_transition.json", "past_transition_pattern", "a", None)]
    with pytest.raises(ValueError):
        G.run_filters({"never_gazed.json": items}, {})


def test_never_gazed_prefix_pool(spark):
    from scanflow.plans import questions as Q

    rows = [(1, i, float(10 * i), 10.0 * i + 5, "objects", [n], []) for i, n in enumerate("abcdef")]
    schema = "session_id long, pos long, start_s double, end_s double, kind string, fov array<string>, outside array<string>"
    entries = spark.createDataFrame(rows, schema)
    assert Q.never_gazed(entries).count() == 0  # every name is in view at some time
    got = {r.pos: r.answer_object for r in Q.never_gazed(entries, prefix_pool=True).collect()}
    assert sorted(got) == [2, 3, 4]
    assert all(got[p] in "abcdef"[p + 1:] for p in got)

"""Readers and writers on small hand-made files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanflow.sources import readers, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def header(mark_line):
    lines = [f"## line {i}" for i in range(34)]
    lines[mark_line] = "## Number of Samples: 4"
    return lines


def test_gaze_text_versions(spark, tmp_path):
    one = header(9) + [
        "0\tSMP\t1\t10.5\t20.5\t0\tFixation", "1\tSMP\t1\t11.5\t21.5\t0\tSaccade", "2\tSMP\t1\t12.5\t22.5\t1\tBlink",
    ]
    two = header(10) + [" ".join(["0"] * 5 + ["7.5", "8.5"] + ["0"] * 17 + ["00:00:01:02", "Fixation"])]
    write(tmp_path / "g" / "one.txt", "\n".join(one) + "\n")
    write(tmp_path / "g" / "two.txt", "\n".join(two) + "\n")
    got = readers.read_gaze_text(spark, str(tmp_path / "g")).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.x, r.y, r.frame_idx, r.gaze_type) for r in got] == [
        ("one", 10.5, 20.5, 0, 1), ("one", 11.5, 21.5, 0, 2), ("one", 12.5, 22.5, 1, 3), ("two", 7.5, 8.5, 26, 1),
    ]


def test_gaze_text_unknown_shape_is_an_error(spark, tmp_path):
    write(tmp_path / "bad.txt", "\n".join(header(9) + ["1 2 3"]) + "\n")
    with pytest.raises(Exception, match="unsupported number of fields"):
        readers.read_gaze_text(spark, str(tmp_path / "bad.txt")).collect()


def test_line_numbers_survive_file_splits(spark, tmp_path):
    path = write(tmp_path / "long.txt", "".join(f"row {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = readers.numbered_lines(spark, path)
        assert lines.rdd.getNumPartitions() >= 1
        assert lines.where(F.col("value") != F.concat(F.lit("row "), F.col("line").cast("string"))).count() == 0
        assert lines.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gaze_csv_2d_array(spark, tmp_path):
    write(tmp_path / "c" / "s1.csv", "canonical_timestamp_s,norm_pos_x,norm_pos_y,confidence\n0.1,0.2,0.3,0.95\n0.2,,0.3,0.1\n")
    got = readers.read_gaze_csv(spark, str(tmp_path / "c")).orderBy("t").collect()
    assert [(r.session_id, r.t, r.x, r.confidence) for r in got] == [("s1", 0.1, 0.2, 0.95), ("s1", 0.2, None, 0.1)]
    write(
        tmp_path / "d" / "s2.csv",
        "frame_idx,timestamp_sec,u,v,valid,in_frame\n0,0.0,448,252,True,True\n1,0.04,,,False,False\n2,0.08,900,9,True,False\n",
    )
    got = readers.read_gaze_2d(spark, str(tmp_path / "d"), 896, 504).orderBy("frame_idx").collect()
    assert [(r.px, r.py, r.gaze_type) for r in got] == [(0.5, 0.5, 1), (0.5, 0.5, 0), (900 / 896, 9 / 504, 4)]
    np.save(tmp_path / "s3.npy", np.array([[0.1, 0.2, 1], [1.5, 0.2, 1], [0.3, 0.4, 0]]))
    got = readers.read_gaze_array(spark, str(tmp_path / "s3.npy"), task_bytes=150).orderBy("frame_idx").collect()
    assert [(r.session_id, r.px, r.gaze_type) for r in got] == [("s3", 0.1, 1), ("s3", 1.0, 4), ("s3", 0.3, 0)]


def test_sync_files(spark, tmp_path):
    eye = "\t".join(str(float(i == j)) for i in range(4) for j in range(4))
    write(tmp_path / "r1" / "Video" / "Pose_sync.txt", f"0.0\t100\t{eye}\n0.1\t200\t{eye}\n\n0.2\t300\t{eye}\n")
    write(tmp_path / "r1" / "Eyes" / "Eyes_sync.txt", "0.0\t100\t0\t0\t0\t1\t0.1\t-0.2\t1\n0.1\t210\t0\t0\t0\t1\t0\t0\t0\n")
    write(tmp_path / "r1" / "Video" / "Intrinsics.txt", "\t".join("500 0 448 0 500 252 0 0 1 896 504".split()) + "\n")
    write(tmp_path / "r1" / "Video" / "VideoMp4Timing.txt", "\n100\n\n900\n")
    root = str(tmp_path)
    poses = readers.read_poses(spark, f"{root}/*/Video/Pose_sync.txt")
    rays = readers.read_rays(spark, f"{root}/*/Eyes/Eyes_sync.txt")
    lens = readers.read_intrinsics(spark, f"{root}/*/Video/Intrinsics.txt")
    timing = readers.read_video_timing(spark, f"{root}/*/Video/VideoMp4Timing.txt")
    assert sorted(r.tick for r in poses.collect()) == [100, 200]  # nothing after the blank line
    assert sorted((r.tick, r.valid) for r in rays.collect()) == [(100, True), (210, False)]
    assert tuple(timing.collect()[0]) == ("r1", 100, 900)
    cameras = lens.join(timing, "session_id").withColumn("n_frames", F.lit(3))

    from scanflow.plans.projection import project_gaze

    got = project_gaze(cameras, rays, poses, fps=24.0).orderBy("frame_idx").collect()
    assert (got[0].u, got[0].v) == pytest.approx((398, 352))
    assert [r.valid for r in got] == [True, False, False]
    skipped = project_gaze(cameras, rays, poses, fps=24.0, skip_invalid=True).orderBy("frame_idx").collect()
    assert [r.u is None for r in skipped] == [False, True, True]


def test_annotations(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        "Clip ID;Clip Prefix;Video Session;Starting Time (ms);Ending Time (ms);Action Label;Verb;Noun\n"
        "1; p; S1; 1500; 2500; Take cup ; take; cup\n",
    )
    (row,) = readers.read_actions_csv(spark, path).collect()
    assert (row.session_id, row.start_s, row.end_s, row.action) == ("S1", 1.5, 2.5, "Take cup")
    path = write(tmp_path / "n.csv", 'session_id,start_s,end_s,narration,scene\na,0,1,"cut, slowly",kitchen\nb,0,1,run,lab\n')
    schema = "session_id string, start_s double, end_s double, narration string, scene string"
    assert [r.text for r in readers.read_fine_annotations(spark, path, schema, scene="kitchen").collect()] == ["cut, slowly"]
    wanted = spark.createDataFrame([("b",)], "session_id string")
    assert [r.text for r in readers.read_fine_annotations(spark, path, schema, sessions=wanted).collect()] == ["run"]
    path = write(tmp_path / "s9.json", json.dumps([{"start": 1, "end": 2, "textAttribute_en": "cut"}, {"textAttribute_en": " "}]))
    assert [tuple(r) for r in readers.read_annotation_json(spark, path).collect()] == [("s9", 1, 2, "cut")]
    events = [
        {"label": "Fine grained action", "start": 1, "end": 2, "attributes": {"Verb": "cut", "Noun": "onion"}},
        {"label": "Fine grained action", "start": 3, "end": 4, "attributes": {"Verb": "cut", "Noun": "none"}},
        {"label": "Narration", "start": 0, "end": 9, "attributes": {}},
    ]
    path = write(tmp_path / "nested.json", json.dumps([{"video_name": "v", "events": events}]))
    got = readers.read_nested_annotations(spark, path).orderBy("pos").collect()
    assert [(r.action, r.both) for r in got] == [("cut onion", True), ("cut", False)]


def test_tolerant_and_union(spark, tmp_path):
    write(tmp_path / "x" / "v1" / "v1_fix.csv", 'id,name\n1,"a, b"\nbad,row,extra\n2, c\n')
    write(tmp_path / "x" / "v2" / "v2_fix.csv", "id,name\n")
    got = readers.union_session_files(spark, str(tmp_path / "x/*/*_none.csv"), str(tmp_path / "x/*/*_fix.csv"), "id long, name string")
    assert sorted((r.id, r.name, r.session_name) for r in got.collect()) == [(1, "a, b", "v1"), (2, "c", "v1")]


def test_questions_and_results(spark, tmp_path):
    item = {
        "response_time": "[00:01 - 00:02]", "video_path": "v.mp4",
        "questions": [{"question": "q", "answer": "B", "options": ["A. x", "B. y"]}, {"question": "r", "answer": "A"}],
        "model_predictions": [{"model_prediction": "b."}],
    }
    path = write(tmp_path / "M" / "results" / "past_scene_recall_output.json", json.dumps([item]))
    flat = readers.flat_questions(readers.read_questions(spark, path)).orderBy("nr").collect()
    assert [(r.video, r.question, r.nr) for r in flat] == [("v.mp4", "q", 0), ("v.mp4", "r", 1)]
    results = readers.read_results(spark, str(tmp_path), ["M", "Absent"])

    from scanflow.plans import scoring

    pairs = results.select(
        "model", "task", F.monotonically_increasing_id().alias("item"),
        F.transform("questions", lambda q: q["answer"]).alias("answers"),
        F.transform("model_predictions", lambda p: p["model_prediction"]).alias("replies"),
    )
    scores = scoring.score_result_items(pairs, ["model", "task"], "item")
    (score,) = scores.collect()
    assert (score.model, score.task, score.n_correct, score.n_total) == ("M_results", "past_scene_recall", 1, 1)
    grid = scoring.result_grid(results.select("model").distinct(), scores, scoring.TASK_NAMES)
    texts = {r.task: r.accuracy_text for r in grid.collect()}
    assert texts["past_scene_recall"] == "100.00" and texts["proactive_gaze_triggered_alert"] == "N/A"
    assert len(texts) == 10


def test_prediction_chunks_and_latency(spark, tmp_path):
    for i in range(2):
        write(tmp_path / "p" / f"2_{i}.json", json.dumps({"id": "v", "pred": f"yes {i}"}) + "\n")
    assert readers.read_prediction_chunks(spark, str(tmp_path / "p"), 2).count() == 2
    path = write(tmp_path / "Visual_output.json", json.dumps([{"a": ["yes", 1.5]}, {"b": ["no", 2]}]))
    got = readers.read_latency_map(spark, path).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("Visual", "a", "yes", 1.5), ("Visual", "b", "no", 2.0)]


def test_sinks(spark, tmp_path):
    df = spark.range(10).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("v"))
    sinks.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10
    path = str(tmp_path / "inc")
    for part in (df.where("v < 5"), df, df):
        sinks.write_incremental(part, path, ["v"])
    assert sinks.read_incremental(spark, path).count() == 10
    sinks.replace_partitions(df.where("session_id = 1").limit(1), str(tmp_path / "t"), ["session_id"])
    counts = {r.session_id: r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("session_id").count().collect()}
    assert counts == {0: 4, 1: 1, 2: 3}
    sinks.write_summary(df.groupBy("session_id").count(), str(tmp_path / "sum"))
    assert "written_at" in spark.read.json(str(tmp_path / "sum")).columns
    sinks.write_report({"all": df}, str(tmp_path / "rep"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rep/all")).count() == 10


def test_csv_columns_go_by_name_and_no_row_is_lost(spark, tmp_path):
    root = tmp_path / "by-name"
    write(root / "a" / "f.csv", "id,name,score\n1,x,0.5\n2,y\n3,z,bad\n")
    write(root / "b" / "f.csv", 'name,id,score\n"p, q",4,1.5\n\n r,5,2\n')
    write(root / "c" / "f.csv", "score,id,extra,name\n3,6,e,s\n1,7,e,t,too,many\n")
    write(root / "d" / "f.csv", "id,name\n8,u\n9,\n10,w,\n")
    write(root / "e" / "f.csv", "id,name,score\n")
    read = readers.union_session_files(spark, f"{root}/*/f.csv", None, "id long, name string, score double")
    rows = sorted((r.id, r.name, r.score, r.session_name) for r in read.collect())
    assert rows == [
        (1, "x", 0.5, "a"), (2, "y", None, "a"), (3, "z", None, "a"), (4, "p, q", 1.5, "b"), (5, "r", 2.0, "b"),
        (6, "s", 3.0, "c"), (8, "u", None, "d"), (9, None, None, "d"),
    ]
    assert read.count() == len(rows) == read.select("score").count()
    drops = {r.file.split("/")[-2]: r.dropped for r in readers.csv_drops(spark, f"{root}/*/f.csv").collect()}
    assert drops == {"c": 1, "d": 1}


def test_gaze_csvs_take_columns_by_name(spark, tmp_path):
    path = write(tmp_path / "s.csv", "confidence,extra,norm_pos_y,norm_pos_x,canonical_timestamp_s\n0.9,1,0.3,0.2,0.1\n")
    assert [tuple(r) for r in readers.read_gaze_csv(spark, path).collect()] == [("s", 0.1, 0.2, 0.3, 0.9)]
    path = write(tmp_path / "t.csv", "u,v,frame_idx,in_frame,valid\n448,252,7,True,True\n")
    (row,) = readers.read_gaze_2d(spark, path, 896, 504).collect()
    assert (row.frame_idx, row.px, row.gaze_type) == (7, 0.5, 1)


def test_results_are_routed_by_their_questions(spark, tmp_path):
    from scanflow.plans import scoring

    points = [{"realtime": "00:10", "type": 1, "response": "Yes."}, {"realtime": "00:20", "type": 0, "response": None}]
    alert = [{"video": "a", "questions": [{"question": "q", "test_info": points}]}]
    choice = [{"video": "a", "questions": [{"answer": "B"}, {"answer": "A"}], "model_predictions": [{"model_prediction": "b."}, {"model_prediction": "C"}]}]
    write(tmp_path / "M" / "results" / "proactive_gaze_triggered_alert_output.json", json.dumps(alert, indent=1))
    write(tmp_path / "M" / "results" / "past_scene_recall_output.json" / "part-0.json", json.dumps(choice[0]) + "\n" + json.dumps(choice[0]) + "\n")
    scores = scoring.score_results(readers.read_results(spark, str(tmp_path), ["M"]))
    got = {r.task: (r.n_correct, r.n_total) for r in scores.collect()}
    assert got == {"proactive_gaze_triggered_alert": (1, 2), "past_scene_recall": (2, 4)}


def test_items_know_their_recording(spark):
    rows = spark.createDataFrame([(7, "past_never_gazed", "[00:00 - 00:09]", "q", "00:01", "A", ["A. x"])], "session_id long, task string, response_time string, question string, time_stamp string, answer string, options array<string>")
    (item,) = sinks.question_items(rows, video="v/{}.mp4", category="kitchen").collect()
    assert (item.video, item.video_categories, item.questions[0].required_ability) == ("v/7.mp4", "kitchen", "scanpath_reasoning")


def test_clip_rule_fires_on_read_questions(spark, tmp_path):
    from scanflow.plans import filters

    item = {"video": "v", "questions": [{"task_type": "t", "options": ["A. x"], "gazed_objects": [], "input_video_clip": [1.0, 3.0]}]}
    path = write(tmp_path / "q.json", json.dumps([item]))
    flat = readers.flat_questions(readers.read_questions(spark, path))
    assert [r.reason for r in filters.scene_recall(flat).collect()] == ["short_clip"]


def test_arrays_are_read_by_ranges(spark, tmp_path):
    from scanflow.sources import arrays

    rng = np.random.default_rng(0)
    wide, small = rng.random((1000, 3)), rng.random((5, 2)).astype(np.float32)
    np.save(tmp_path / "wide.npy", wide)
    np.save(tmp_path / "turned.npy", np.asfortranarray(wide))
    np.save(tmp_path / "line.npy", np.arange(7, dtype=np.int16))
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    np.save(tmp_path / "small.npy", small)
    df = arrays.read_arrays(spark, str(tmp_path), ["x", "y", "z"], task_bytes=1000)
    assert df.rdd.getNumPartitions() > 40  # no array is one task's work
    got = {}
    for r in df.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.row] = (r.x, r.y, r.z)
    assert sorted(got) == ["line.npy", "small.npy", "turned.npy", "wide.npy"]
    for name in ("wide.npy", "turned.npy"):
        assert [got[name][i] for i in range(1000)] == [tuple(v) for v in wide]
    assert [got["line.npy"][i][0] for i in range(7)] == list(range(7)) and np.isnan(got["line.npy"][0][1])
    assert [got["small.npy"][i][:2] for i in range(5)] == [tuple(map(float, v)) for v in small]
    file = next(r.file for r in df.select("file").distinct().collect() if "wide" in r.file)
    part = df.where((F.col("file") == file) & (F.col("row") >= 990) & (F.col("row") < 993))
    assert part.rdd.getNumPartitions() < 40
    assert sorted(r.row for r in part.collect()) == [990, 991, 992]
    assert "PostScanFilter" not in part._jdf.queryExecution().executedPlan().toString()


def test_array_ranges_cover_every_byte_once():
    from scanflow.sources import arrays

    files = [("a", 10), ("b", 0), ("c", 250), ("d", 3), ("e", 100)]
    for size in (1, 7, 100, 1000):
        tasks = arrays.planned(files, size)
        assert all(sum(h - l for _, l, h in t) <= size for t in tasks)
        seen = [(p, b) for t in tasks for p, l, h in t for b in range(l, h)]
        assert sorted(seen) == sorted((p, b) for p, n in files for b in range(n))


def test_arrays_written_twice_by_attempts_appear_once(spark, tmp_path):
    from scanflow.sources import arrays

    rows = spark.range(300).selectExpr("concat('s', id % 3, '/a.npy') AS f", "id", "id * 2.0 AS v", "CASE WHEN id > 290 THEN null ELSE 1.0 END AS w")
    arrays.write_arrays(rows, str(tmp_path), "f", "id", ["v", "w"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s0", "s1", "s2"]  # nothing aside is left
    whole = np.load(tmp_path / "s1" / "a.npy")
    assert whole[:, 0].tolist() == [2.0 * i for i in range(1, 300, 3)] and np.isnan(whole[-1, 1])
    writer = arrays.ArrayWriter({"path": str(tmp_path)})
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"file": ["n.npy"], "row": [0], "v": [1.0]})
    lost, done = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([done])
    assert len(lost.files) == 1 and np.load(tmp_path / "n.npy").tolist() == [[1.0]]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]

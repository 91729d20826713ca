"""Column functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from scanflow.functions import geometry as G
from scanflow.functions import text as X
from scanflow.functions import timecode as C
from scanflow.operators import draws, intervals, joins, objects, segments
from scanflow.plans import requests as R


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0])


def lit(v):
    return F.lit(v)


def strings(*values):
    return F.array(*[F.lit(v) for v in values])


def test_clock(spark):
    assert one(
        spark, C.mmss(lit(3725.9)), C.clock_ms(lit(3725.25)), C.clock_short(lit(2.5)), C.clock_short(lit(3.5)),
        C.clock_short(lit(3600.0)), C.clock_rounded(lit(-3.0), clamp=True),
    ) == ("62:05", "01:02:05.250", "00:02", "00:04", "01:00:00", "00:00:00")
    assert one(
        spark, C.parse_clock(lit("01:05")), C.parse_clock(lit("1:00:05")), C.parse_clock(lit("7")),
        C.parse_clock(lit("7.5"), "number"),
    ) == (65, 3605, 0, 7.5)
    low, high = C.range_bounds(lit("[01:10 - 01:13]"))
    bad, _ = C.range_bounds(lit("[01:10-01:13]"))
    assert one(spark, low, high, bad, C.truth_span(lit("[01:10 - 01:13]")), C.truth_span(lit("soon"))) == (
        70, 73, None, "70-83", None,
    )
    a, b = C.span_bounds(lit("01:23-88"))
    assert one(spark, a, b, C.frame_code(lit("00:01:02:03"))) == (83, 88, 62 * 24 + 3)
    assert one(spark, C.frame_tick(lit(100).cast("long"), lit(30).cast("long"), 30.0)) == (100 + 10_000_000,)


def test_geometry(spark):
    pose = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])
    point = G.camera_point(pose, lit(0.5), lit(0.05), lit(-0.1))
    df = spark.range(1).select(point.alias("c"))
    u = G.pinhole(F.col("c")[0], F.col("c")[2], lit(500.0), lit(448.0))
    v = G.pinhole(F.col("c")[1], F.col("c")[2], lit(500.0), lit(252.0))
    assert tuple(df.select(u, v).collect()[0]) == pytest.approx((398, 352))
    assert one(spark, G.pinhole(lit(1.0), lit(-1.0), lit(500.0), lit(0.0))) == (None,)
    angle = G.hfov(lit(896), lit(500.0))
    got = one(spark, angle, G.fov_radius(lit(896), angle), G.fov_radius(lit(896), G.hfov(lit(896), lit(None))))
    assert got == (pytest.approx(83.7207, abs=1e-4), 139, 129)
    assert one(spark, *G.unit(lit(0.0), lit(0.0), lit(0.0))) == (0, 0, 0)


def test_words(spark):
    assert one(spark, *[X.is_human(lit(w)) for w in ("handle", "surface", "plate")]) == (True, True, False)
    pairs = [("red cup", "red pan"), ("cup", "tea cup"), ("big red cup", "red cup lid")]
    assert one(spark, *[X.similar_names(lit(a), lit(b)) for a, b in pairs]) == (False, True, True)
    replies = ["answer: b", "A. spoon", "I think a cat", "zzz", None]
    assert one(spark, *[X.answer_letter(lit(r).cast("string")) for r in replies]) == ("B", "A", "A", "ZZZ", "")
    assert one(spark, X.option_value(lit("A. tea. cup")), X.option_value(lit("cup")), X.option_letter(lit("A. x"))) == (
        "tea. cup", "cup", "A",
    )
    assert one(spark, X.is_generic_context(strings("sink", "gas_stove")), X.is_generic_context(strings("sink", "cup"))) == (
        True, False,
    )
    assert one(spark, X.context_leaks(strings("tea_cup-1", "onion2"), lit("Cut the onion")), X.context_leaks(strings("cup"), lit("Cut the cup"))) == (True, False)
    assert one(spark, X.is_ambiguous(lit("Bags")), X.is_ambiguous(lit("bag of rice"))) == (True, False)
    assert one(spark, X.light_norm(lit("  ﬁne　 tea ")), X.light_norm(lit(None).cast("string"))) == ("fine tea", "")
    assert one(spark, X.needs_polish(strings("x" * 101)), X.needs_polish(strings("x" * 100 + ".")), X.needs_polish(strings("x" * 201 + "."))) == (True, False, True)
    assert one(spark, X.distinct_ci(strings(" Cup", "cup", "", "Pan "))) == (["Cup", "Pan"],)
    assert one(spark, X.seq_text(F.array(strings("a", "b"), strings("c")))) == ("{a,b}>{c}",)
    assert one(spark, X.yes_no(lit("Yes.")), X.yes_no(lit("Well, no")), X.yes_no(lit("maybe"))) == (1, 0, -1)
    assert one(spark, X.task_from_name(lit("past_non_fixated_object_identification.json")), X.task_from_name(lit("x"))) == ("present_ident", None)
    assert one(spark, X.stem(lit("/a/b.c/d.json")), X.gaze_video_path(lit("/x/videos/1.mp4"))) == ("d", "/x/gaze_visualization/1.mp4")
    assert one(spark, X.object_or_caption(lit(""), lit("a cup")), X.object_or_caption(lit(None).cast("string"), lit(""))) == ("a cup", "")


def test_literals(spark):
    schema = "object_identity string, detailed_caption string"
    texts = [
        '{"object_identity": "cup", "detailed_caption": "a cup"}',
        "{'object_identity': 'cup', 'detailed_caption': None}",
        "{'object_identity': \"cook's cup\", 'detailed_caption': 'x'}",
        "not a literal",
        "{'object_identity': 'None', \"detailed_caption\": None}",
        "{'object_identity': ('a' 'b'), 'detailed_caption': 'True',}",
        "{'more': [True, None, False, 'x', True], 'object_identity': \"it's None, 'True'\", 'detailed_caption': ''}",
    ]
    got = one(spark, *[X.parse_literal(lit(t), schema) for t in texts])
    assert tuple(got[0]) == ("cup", "a cup")
    assert tuple(got[1]) == ("cup", None)
    assert tuple(got[2]) == ("cook's cup", "x")
    assert got[3] is None or tuple(got[3]) == (None, None)
    assert [tuple(g) for g in got[4:]] == [("None", None), ("ab", "True"), ("it's None, 'True'", "")]


def test_literals_as_json_equal_the_language(spark):
    import ast
    import json
    import random

    from scanflow.functions.literals import literal_as_json

    rng = random.Random(7)

    def string():
        body = "".join(rng.choice(["a", "né", " ", "{", "]", ",", ":", '"', "#", "\\\\", "\\n", "\\t", "\\x41", "\\u00e9", "\\U0001F600",
                                   "\\101", "\\d", "\\'", "None", "\t"]) for _ in range(rng.randrange(6)))
        return rng.choice(["'%s'", "'" * 3 + "%s" + "'" * 3, "u'%s'"]) % body if '"' in body or rng.random() < 0.6 else f'"{body}"'

    def value(depth=0):
        kind = rng.randrange(9 if depth < 3 else 5)
        if kind == 0:
            return string()
        if kind == 1:
            return rng.choice(["0", "12", "-3", "+4", "1.5", ".5", "5.", "1e3", "2E-2", "1_000", "0x1F", "0o17", "0b101", "-0.25", "- 7"])
        if kind == 2:
            return rng.choice(["None", "True", "False"])
        if kind == 3:
            return string() + " " + string()
        if kind == 4:
            return f"({value(4)})"
        inner = [value(depth + 1) for _ in range(rng.randrange(4))]
        tail = rng.choice(["", "", ",", " , "]) if inner else ""
        if kind == 5:
            return "(" + ", ".join(inner) + ("," if inner else "") + ")"
        if kind < 7:
            return "[" + rng.choice([",", ", ", " ,\n"]).join(inner) + tail + "]"
        return "{" + ", ".join(f"{rng.choice([string(), '2', 'True', 'None', '2.5'])}: {v}" for v in inner) + tail + "}"

    texts = [value() for _ in range(600)]
    broken = [t[:-1] for t in texts[:60]] + [t + "]" for t in texts[:20]] + [t + " 1" for t in texts[:20]]
    broken += ["{1, 2}", "b'x'", "1+2", "1 2", "[,]", "[1,,2]", "{'a' 1}", "{'a': 1, 2}", "[1)", "(1", "", " ", "x", "None1", "--", "'a", "1j", "{'a':}", "[1 2]", "'\\x4'", "5 - 3", "(,)"]

    def known(text):
        try:
            return json.loads(json.dumps(ast.literal_eval(text.strip(" \t"))))
        except (ValueError, SyntaxError, TypeError, MemoryError):
            return "broken"

    df = spark.createDataFrame([(t,) for t in texts + broken], "t string")
    plan = df.select(literal_as_json(F.col("t")).alias("j"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    for text, row in zip(texts + broken, plan.collect()):
        try:
            got = "broken" if row.j is None else json.loads(row.j)
        except ValueError:
            got = "broken"
        assert got == known(text), (text, row.j)


def test_scores(spark):
    with pytest.raises(ValueError):
        X.weighted_score(lit(1.0), lit(1.0), 0.5, 0.6)
    assert one(spark, X.in_window(lit(8.0), lit(2.0), lit(5.0)), X.in_window(lit(8.1), lit(2.0), lit(5.0))) == (True, False)
    with pytest.raises(ValueError):
        X.text_score(lit("a"), lit("b"), "other")


def test_prompts(spark):
    four = strings("cup", "pan", "pot", "jar")
    text, listed, none = one(
        spark, R.choice_prompt(lit("What?"), four), R.choice_prompt(lit("What?"), strings("A. yes", "B. no")),
        R.choice_prompt(lit("What?"), F.array().cast("array<string>")),
    )
    assert text.startswith("\nQuestion: What?\nOptions:\nA. cup\nB. pan\nC. pot\nD. jar\nAnswer the question")
    assert text.endswith("correct option.\n\nThe best option is:")
    assert listed == "Question: What?\nOptions:\nA. yes\nB. no\n\nThe best option is:"
    assert none.endswith("\n\nAnswer:")


def test_alert_points(spark):
    got = one(spark, intervals.alert_points(lit(15.0), lit(0.0)), intervals.alert_points(lit(295.0), lit(0.0)))
    assert got == ([5, 15, 25, 35], [275, 285, 295])


def test_interval_chains(spark):
    rows = [(1, 0.0, 10.0), (1, 1.0, 2.0), (1, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "session_id long, start_s double, end_s double")
    members = intervals.episode_members(df, space=None, time=2.0, chunk=2.0).orderBy("start_s").collect()
    assert [r.episode for r in members] == [0, 0, 2]
    rows = [(1, 0.0, 10.0), (1, 1.0, 2.0), (1, 15.0, 16.0), (1, 27.0, 28.0)]
    df = spark.createDataFrame(rows, "session_id long, start_s double, end_s double")
    merged = intervals.merge_intervals(df, ["session_id"], chunk=4.0).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s) for r in merged] == [(0, 16), (27, 28)]


def test_mode_and_longest(spark):
    rows = [(1, i, n) for i, n in enumerate(["b", "a", "", "a", "b"])]
    df = spark.createDataFrame(rows, "ep long, i long, object string")
    assert [r.object for r in objects.ordered_mode(df, ["ep"], "object", ["i"]).collect()] == ["b"]
    rows = [(1, "cup", 2.0, 0), (1, "cup", 5.0, 1), (1, "pan", 5.0, 2), (1, "pan", 5.0, 3)]
    df = spark.createDataFrame(rows, "session_id long, object string, duration double, pos long")
    got = intervals.longest_per_object(df, ["session_id"], "object", ["pos"]).orderBy("object").collect()
    assert [(r.object, r.duration, r.pos) for r in got] == [("cup", 5, 1), ("pan", 5, 2)]


def test_time_joins(spark):
    probes = spark.createDataFrame([(1, t) for t in (5, 15, 16, 30)], "s long, t long")
    samples = spark.createDataFrame([(1, 10), (1, 20)], "s long, t long")
    got = joins.nearest_join(probes, samples, ["s"], "t", chunk=4).orderBy("t").collect()
    assert [r["sample"].t for r in got] == [10, 10, 20, 20]
    segs = spark.createDataFrame([(1, 0, 0.0, 5.0)], "s long, id long, start_s double, end_s double")
    acts = spark.createDataFrame([(1, 0, 5.0, 6.0), (1, 1, 5.1, 6.0), (1, 2, -1.0, 0.0)], "s long, pos long, start_s double, end_s double")
    got = joins.overlap_join(segs, acts, ["s"], 2.0, key="id").orderBy("match.pos").collect()
    assert [r.match.pos for r in got] == [0, 2]
    ends = spark.createDataFrame([(1, 10.0)], "s long, t double")
    later = spark.createDataFrame([(1, 11.0), (1, 12.0), (1, 131.0)], "s long, t double")
    (hit,) = joins.next_after(ends, later, ["s"], "t", 5.0, 2.0, 120.0).collect()
    (miss,) = joins.next_after(ends, later.where("t <> 12"), ["s"], "t", 5.0, 2.0, 120.0).collect()
    assert hit.event.t == 12 and miss.event is None and hit.t == 10


def test_null_keys_match(spark):
    left = spark.createDataFrame([(None, "x"), (1, "y")], "k long, a string")
    right = spark.createDataFrame([(None, 1, "p"), (None, 2, "q"), (2, 1, "r")], "k long, seq long, b string")
    got = joins.equi_join_last(left, right, "k", "seq").collect()
    assert [(r.k, r.a, r.b) for r in got] == [(None, "x", "q")]


def test_average_closed_form(spark):
    from scanflow.operators.frames import frame_average

    rows = [(1, 0, i, x) for i, x in enumerate([0.2, 0.4, 0.8])] + [(1, 1, 0, 0.5), (1, 0, 9, None)]
    df = spark.createDataFrame(rows, "s long, frame_idx long, seq long, x double")
    got = {r.frame_idx: r.x for r in frame_average(df, ["s", "frame_idx"], "seq", ["x"]).collect()}
    assert got == pytest.approx({0: 0.55, 1: 0.5})


def test_draws(spark):
    sizes = [F.lit(n) for n in (1, 2, 3, 10)]
    got = one(spark, *[draws.draw_ranks(s, 3, "seed", lit(1)) for s in sizes])
    assert [len({r for r in g if r is not None}) for g in got] == [1, 2, 3, 3]
    assert all(0 <= r < n for g, n in zip(got, (1, 2, 3, 10)) for r in g if r is not None)
    df = draws.with_options(spark.range(1), lit("cup"), strings("pan", "pot", "jar"), "s", F.col("id"))
    row = df.collect()[0]
    assert row.options["ABCD".index(row.answer)] == f"{row.answer}. cup"
    assert sorted(o[3:] for o in row.options) == ["cup", "jar", "pan", "pot"]


def test_sample_times(spark):
    got = one(spark, segments.sample_times(lit(1.0), lit(3.0), lit(5)), segments.sample_times(lit(1.0), lit(3.0), lit(1)))
    assert got == ([1, 1.5, 2, 2.5, 3], [1])


def test_groups(spark):
    same = F.array(strings("a", "b"), strings("b", "a"))
    other = F.array(strings("a"), strings("b"), strings("a"))
    assert one(spark, objects.has_identical_neighbours(same), objects.has_identical_neighbours(other), objects.has_identical_neighbours(F.array(strings("a")))) == (True, False, False)


def test_python_sees_only_the_rows_that_need_it(spark, monkeypatch):
    def refuse(s):
        if s.notna().any():
            raise ValueError("a plain text reached Python")
        return s

    strict = F.pandas_udf(lambda s: refuse(s), "string")
    monkeypatch.setattr(X, "nfkc", strict)
    df = spark.createDataFrame([("plain  text",)], "t string")
    assert df.select(X.light_norm(F.col("t"))).collect()[0][0] == "plain text"


def test_a_pose_without_inverse_gives_null(spark):
    flat = F.array(*[F.lit(0.0)] * 16)
    assert one(spark, G.camera_point(flat, F.lit(1.0), F.lit(1.0), F.lit(1.0))) == (None,)

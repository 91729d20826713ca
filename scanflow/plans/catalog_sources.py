"""Registered round trips through files, streaming runs and the histogram dedup.

Each one writes data that Spark derives from the tables, in the exchange format of a
reader, and reads it back.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from scanflow.functions.timecode import frame_index
from scanflow.operators import folds, frames
from scanflow.plans import questions as Q
from scanflow.plans import requests as R
from scanflow.plans import scoring
from scanflow.plans import sqltext as T
from scanflow.plans import standins as S
from scanflow.plans.catalog import query, r4, r6
from scanflow.plans.catalog_gaze import _WALK
from scanflow.plans.catalog_questions import RECALL_CTES, merged_entries
from scanflow.plans.catalog_readers import lines_by_part as _lines
from scanflow.session import cut
from scanflow.sources import readers, sinks
from scanflow.streaming.alerts import stream_alerts
from scanflow.streaming.fixations import stream_fixations
from scanflow.streaming.runs import run_to_end, scratch


@query(
    "gaze_csv_frames",
    S.with_views("clicks")
    + """, s AS (SELECT event_id // 1000 AS part, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS i,
      event_id, event_id % 1000 / 100.0::DOUBLE AS t, CASE WHEN event_type = 'error' THEN NULL ELSE value / 500.0 END AS x,
      k / 100.0::DOUBLE AS y, 1 - k / 100.0::DOUBLE AS c FROM clicks),
    f AS (SELECT part, CAST(floor(t * 24) AS BIGINT) AS frame_idx, event_id, x, y, c FROM s WHERE x IS NOT NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY part, frame_idx ORDER BY event_id) AS i,
      count(*) OVER (PARTITION BY part, frame_idx) AS n FROM f)
    SELECT part, frame_idx, r6(sum(x * pow(2.0, -least(n - i + 1, n - 1)))) AS x,
    r6(sum(y * pow(2.0, -least(n - i + 1, n - 1)))) AS y, max(n) AS n, CASE WHEN arg_max(c, event_id) >= 0.9 THEN 1
      WHEN arg_max(c, event_id) >= 0.5 THEN 2 ELSE 3 END AS gaze_type FROM p GROUP BY 1, 2""",
)
def gaze_csv_frames(spark, sf):
    path = scratch(spark, "gaze-csv")
    e = F.col("event_id")
    rows = S.clicks(spark, sf).select(
        F.floor(e / 1000).alias("part"),
        ((e % 1000) / 100).alias("canonical_timestamp_s"),
        F.when(F.col("event_type") != "error", F.col("value") / 500).alias("norm_pos_x"),
        (F.col("k") / 100).alias("norm_pos_y"),
        (F.lit(1) - F.col("k") / 100).alias("confidence"),
    )
    sinks.write_table(rows, path, ["part"], fmt="csv")
    # each part is a recording: its folder names it
    read = readers.read_gaze_csv(spark, f"{path}/*/*.csv", session=r"part=(\d+)/")
    samples = read.select(
        F.col("session_id").cast("long").alias("part"),
        F.round(F.col("t") * 100).cast("long").alias("seq"),
        frame_index(F.col("t"), 24.0).alias("frame_idx"),
        "x",
        "y",
        "confidence",
    )
    out = frames.frame_average(samples, ["part", "frame_idx"], "seq", ["x", "y"], last="confidence")
    kind = frames.confidence_type(F.lit(0.5), F.lit(0.5), F.col("confidence"))
    return out.select("part", "frame_idx", r6("x"), r6("y"), "n", kind.alias("gaze_type"))


@query(
    "actions_file",
    S.with_views("order_actions")
    + """SELECT CAST(session_id AS VARCHAR) AS session_id, r6(start_s) AS start_s, r6(end_s) AS end_s, action
    FROM order_actions""",
)
def actions_file(spark, sf):
    path = scratch(spark, "actions")
    rows = S.order_actions(spark, sf)
    blank = F.lit(" x")
    rows.select(
        F.col("pos").alias("Clip ID"),
        blank.alias("Clip Prefix"),
        F.concat(F.lit(" "), F.col("session_id").cast("string")).alias("Video Session"),
        F.concat(F.lit(" "), (F.col("start_s") * 1000).cast("string")).alias("Starting Time (ms)"),
        (F.col("end_s") * 1000).alias("Ending Time (ms)"),
        F.concat(F.lit(" "), "action").alias("Action Label"),
        blank.alias("Verb Label"),
        blank.alias("Noun Label(s)"),
    ).write.option("header", "true").option("sep", ";").option("ignoreLeadingWhiteSpace", "false").csv(path)
    return readers.read_actions_csv(spark, path).select("session_id", r6("start_s"), r6("end_s"), "action")


@query(
    "question_files",
    S.with_views("merged_pos", **RECALL_CTES)
    + f"""SELECT session_id, 'orders' AS video_categories, 'episodic_memory' AS required_ability,
    'past_scene_reconstruction' AS task_type, {T.mmss('start_s')} AS time_stamp, truth AS answer_object,
    {T.answer('mixed', 'truth')} AS answer FROM mx""",
)
def question_files(spark, sf):
    path = scratch(spark, "questions")
    made = Q.scene_recall(merged_entries(spark, sf))
    sinks.write_questions(sinks.question_items(made, ["answer_object"], video="clips/{}.mp4", category="orders"), path)
    flat = readers.flat_questions(readers.read_questions(spark, path))
    return flat.select(
        F.regexp_extract("video", r"clips/(-?\d+)\.mp4$", 1).cast("long").alias("session_id"), "video_categories",
        "required_ability", "task_type", "time_stamp", "answer_object", "answer",
    )


@query(
    "session_files",
    S.with_views("episodes")
    + """SELECT 'shard=' || CAST(session_id % 8 AS VARCHAR) AS session_name, count(*) AS n, CAST(sum(session_id) AS BIGINT)
    AS sessions, r6(sum(duration)) AS seconds FROM episodes GROUP BY 1""",
)
def session_files(spark, sf):
    path = scratch(spark, "sessions")
    rows = S.episodes(spark, sf).select("session_id", "start_s", "duration", (F.col("session_id") % 8).alias("shard"))
    sinks.write_table(rows, path, ["shard"], fmt="csv")
    schema = "session_id long, start_s double, duration double"
    read = readers.union_session_files(spark, f"{path}/*/*.nothing", f"{path}/*/*.csv", schema)
    return read.groupBy("session_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("session_id").alias("sessions"), r6(F.sum("duration"), "seconds")
    )


@query(
    "incremental_table",
    "SELECT o_orderkey, o_orderpriority FROM orders",
)
def incremental_table(spark, sf):
    """Half the rows, then all rows, then the same run again and all rows once more: every key is there once."""
    path = scratch(spark, "incremental")
    rows = S.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    sinks.write_incremental(rows.where(F.col("o_orderkey") % 2 == 0), path, ["o_orderkey"])
    for run in ("all", "all", "again"):
        sinks.write_incremental(rows, path, ["o_orderkey"], run)
    return sinks.read_incremental(spark, path)


@query(
    "latency_files",
    S.with_views("predictions")
    + """SELECT o.task AS task, count(*) AS n, r4(avg(seconds)) AS mean, r4(quantile_cont(seconds, 0.5)) AS median
    FROM (SELECT 'T' || substr(task, 1, 1) AS task, seconds FROM predictions
      UNION ALL SELECT 'overall', seconds FROM predictions) o GROUP BY 1""",
)
def latency_files(spark, sf):
    path = scratch(spark, "latency")
    pair = F.array(F.to_json(F.struct("reply")), F.col("seconds").cast("string"))
    entries = S.predictions(spark, sf).select(
        F.concat(F.lit("T"), F.substring("task", 1, 1)).alias("task"),
        F.to_json(F.array(F.create_map(F.col("item_id").cast("string"), pair))).alias("value"),
    )
    entries.write.partitionBy("task").text(path)
    replies = readers.read_latency_map(spark, path, task=r"task=([^/]+)/", lines=True).select("task", "seconds")
    out = scoring.score_latency(replies, "task")
    return out.select("task", "n", r4("mean"), r4("median"))


@query(
    "annotated_segments",
    S.with_views("short_segments")
    + """SELECT session_id, segment, CASE WHEN segment % 4 = 3 THEN NULL ELSE 'item ' || CAST(segment % 3 AS VARCHAR) END
    AS object_identity, CASE WHEN segment % 4 = 3 THEN 'error' ELSE 'success' END AS status FROM short_segments""",
)
def annotated_segments(spark, sf):
    def stub(batch: pd.DataFrame) -> pd.Series:
        def one(segment):
            body = json.dumps({"object_identity": f"item {segment % 3}", "detailed_caption": "seen"})
            return "no answer" if segment % 4 == 3 else f"```json\n{body}\n```"

        return batch["segment"].map(one)

    asked = S.short_segments(spark, sf).select("session_id", "segment")
    out = R.annotate(asked, stub, ["session_id", "segment"], "object_identity string, detailed_caption string")
    status = F.when(F.col("error").isNull(), "success").otherwise("error")
    return out.select("session_id", "segment", F.col("annotation.object_identity").alias("object_identity"), status.alias("status"))


_EPS = """, n AS (SELECT session_id, max(frame_idx) AS m FROM frame_features GROUP BY 1),
    ep AS (SELECT session_id, CAST(p AS BIGINT) AS pos, 0.5::DOUBLE * p AS start_s, 0.5::DOUBLE * p + 0.5 AS end_s,
      CASE WHEN p % 5 <> 4 THEN 'thing' END AS object FROM (SELECT session_id, unnest(range(0, m // 4)) AS p FROM n)),
    pr AS (SELECT a.session_id, a.pos AS i, b.pos AS j, a.start_s AS s, b.end_s AS e,
      a.object IS NOT NULL AND b.object IS NOT NULL AS named FROM ep a JOIN ep b ON b.session_id = a.session_id
      AND b.pos > a.pos),
    sm AS (SELECT p.*, k FROM pr p CROSS JOIN (SELECT unnest(range(0, 5)) AS k) WHERE named),
    hs AS (SELECT x.session_id, i, j, k, f.hist, lag(f.hist) OVER (PARTITION BY x.session_id, i, j ORDER BY k) AS prev
      FROM sm x JOIN frame_features f ON f.session_id = x.session_id AND f.frame_idx = CAST(floor(
        (CASE WHEN k = 4 THEN e ELSE s + k * ((e - s) / 4) END) * 8) AS BIGINT)),
    un AS (SELECT session_id, i, j, k, unnest(prev) AS a, unnest(hist) AS b FROM hs WHERE prev IS NOT NULL),
    co AS (SELECT session_id, i, j, k, corr(a::DOUBLE, b::DOUBLE) AS c FROM un GROUP BY 1, 2, 3, 4),
    lo AS (SELECT session_id, i, j, min(c) AS c FROM co GROUP BY 1, 2, 3),
    diff AS (SELECT p.session_id, p.i, min(p.j) AS j FROM pr p LEFT JOIN lo USING (session_id, i, j)
      WHERE NOT named OR c < -0.15 GROUP BY 1, 2),
    walk AS (SELECT session_id, 0::BIGINT AS pos FROM n WHERE m // 4 > 0 UNION ALL
      SELECT w.session_id, d.j FROM walk w JOIN diff d ON d.session_id = w.session_id AND d.i = w.pos)
    """


@query("distinct_episodes", S.with_views("frame_features") + _EPS + "SELECT session_id, pos FROM walk")
def distinct_episodes(spark, sf):
    features = cut(S.frame_features(spark, sf))
    counts = features.groupBy("session_id").agg(F.max("frame_idx").alias("m"))
    places = counts.select(
        "session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 4) - 1)).alias("pos")
    )
    episodes = places.select(
        "session_id", "pos", (F.col("pos") * 0.5).alias("start_s"), (F.col("pos") * 0.5 + 0.5).alias("end_s"),
        F.when(F.col("pos") % 5 != 4, F.lit("thing")).alias("object"),
    )
    out = folds.drop_consecutive_similar(episodes, features, fps=8.0, threshold=-0.15, width=60.0)
    return out.select("session_id", "pos")


@query(
    "stream_fixations",
    S.with_views("gaze")
    + _WALK
    + """SELECT session_id, r6(start_s) AS start_s, r6(end_s) AS end_s, r6(cx) AS center_x,
    r6(cy) AS center_y, n FROM st WHERE end_s - start_s >= 0.12""",
)
def stream_fixations_query(spark, sf):
    """The frames as a stream of many files, out of order inside a slice, then a marker far ahead that ends every session."""
    path = scratch(spark, "gaze-stream")
    # recordings start a day after the epoch: a sample at the watermark's initial 0 would be late
    at = F.timestamp_micros(F.round(F.col("time_seconds") * 1e6).cast("long") + 86_400_000_000)
    live = cut(S.gaze(spark, sf).select("session_id", at.alias("at"), "time_seconds", "px", "py"))
    # slices keep their arrival order by modification time; a trigger may take files of two slices, so the
    # watermark stays two slices behind
    slices, files = 4, 4
    width = max(1, -(-int(live.agg(F.ceil(F.max("time_seconds"))).first()[0] or 1) // slices))
    for nr in range(slices):
        own = live.where(F.floor(F.col("time_seconds") / width) == nr) if nr < slices - 1 else live.where(F.col("time_seconds") >= nr * width)
        own.repartition(files).write.mode("append").parquet(f"{path}/nr={nr}")
    marker = spark.range(1).select(
        F.lit(-1).cast("long").alias("session_id"), F.timestamp_seconds(F.lit(10_000_000)).alias("at"),
        F.lit(1e7).alias("time_seconds"), F.lit(0.0).alias("px"), F.lit(0.0).alias("py"),
    )
    marker.write.mode("append").parquet(f"{path}/nr={slices}")
    source = spark.readStream.schema(live.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")
    out = run_to_end(
        stream_fixations(source, f"{2 * width} seconds", radius=0.5, min_duration=0.12, gap=0.01, idle_ms=60_000), "fixations"
    )
    return out.where(F.col("session_id") >= 0).select(
        "session_id", r6("start_s"), r6("end_s"), r6("center_x"), r6("center_y"), "n"
    )


@query(
    "stream_alerts",
    S.with_views("sightings")
    + """SELECT DISTINCT session_id, object FROM sightings WHERE in_fov AND object LIKE 'red%'""",
)
def stream_alerts_query(spark, sf):
    path = scratch(spark, "sightings")
    at = F.timestamp_seconds(F.col("start_s"))
    seen = S.sightings(spark, sf).where("in_fov").select("session_id", at.alias("at"), "object")
    seen.write.parquet(path)
    wanted = S.sightings(spark, sf).where(F.col("object").startswith("red"))
    targets = wanted.select("session_id", "object").distinct()
    source = spark.readStream.schema(seen.schema).parquet(path)
    return run_to_end(stream_alerts(source, targets, "3000 seconds"), "alerts").select("session_id", "object").distinct()


@query(
    "mixed_session_files",
    S.with_views("episodes")
    + """SELECT session_id % 4 AS shard, session_id AS id, CASE WHEN session_id % 4 <> 2 THEN duration END AS seconds,
    CASE session_id % 4 WHEN 0 THEN 'n' || CAST(session_id AS VARCHAR) WHEN 1 THEN 'a, b' WHEN 2 THEN NULL ELSE 'x' END AS name
    FROM episodes""",
)
def mixed_session_files(spark, sf):
    """Files that order, add and lack columns, with short lines, bad numbers and lines that are too long."""
    path = scratch(spark, "mixed-sessions")
    e = S.episodes(spark, sf).select("session_id", F.col("duration").cast("string").alias("d"), (F.col("session_id") % 4).alias("shard"))
    i = F.col("session_id").cast("string")
    line = (
        F.when(F.col("shard") == 0, F.concat_ws(",", i, F.concat(F.lit("n"), i), "d"))
        .when(F.col("shard") == 1, F.concat_ws(",", "d", F.lit('"a, b"'), F.lit("z"), i))
        .when(F.col("shard") == 2, F.concat_ws(",", i, F.lit("bad")))
        .otherwise(F.concat_ws(",", F.lit("x"), i, "d"))
    )
    heads = {0: "id,name,seconds", 1: "seconds,name,more,id", 2: "id,seconds,name", 3: "name,id,seconds"}
    rows = e.select("shard", F.lit(1).alias("nr"), line.alias("value"))
    extra = [(s, 0, h) for s, h in heads.items()] + [(s, 2, "1,2,3,4,5,6") for s in heads] + [(s, 3, "") for s in heads]
    whole = rows.unionByName(spark.createDataFrame(extra, "shard long, nr int, value string"))
    whole.repartition("shard").sortWithinPartitions("shard", "nr").drop("nr").write.partitionBy("shard").text(path)
    read = readers.union_session_files(spark, f"{path}/*/*.txt", None, "id long, name string, seconds double")
    shard = F.regexp_extract("session_name", r"(\d+)$", 1).cast("long")
    return read.select(shard.alias("shard"), "id", "name", "seconds")


@query(
    "quoted_line_files",
    S.with_views("clicks")
    + """SELECT event_id // 2000 AS part, event_id, CASE event_id % 4 WHEN 0 THEN event_type || chr(10) || 'says "' || CAST(k AS VARCHAR) || ', no"'
      WHEN 1 THEN event_type || ', twice' || chr(10) || chr(10) || 'broken' WHEN 2 THEN 'a "' || event_type || '" inside' ELSE event_type END AS note,
      CASE WHEN event_id % 3 <> 0 THEN r6(value) END AS value FROM clicks""",
)
def quoted_line_files(spark, sf):
    """Records over several lines with separators and doubled quotes, in files that order their columns in two ways."""
    path = scratch(spark, "quoted-lines")
    e, kind = F.col("event_id"), F.col("event_type")
    says = F.concat(F.lit('"'), kind, F.lit('\nsays ""'), F.col("k").cast("string"), F.lit(', no"""'))
    note = (
        F.when(e % 4 == 0, says)
        .when(e % 4 == 1, F.concat(F.lit(' "'), kind, F.lit(', twice\n\nbroken"')))
        .when(e % 4 == 2, F.concat(F.lit('a "'), kind, F.lit('" inside')))
        .otherwise(kind)
    )
    number = F.when(e % 3 != 0, F.col("value").cast("string")).otherwise("none")
    rows = S.clicks(spark, sf).withColumn("part", F.floor(e / 2000)).withColumn("nr", e)
    one = F.concat_ws(",", e.cast("string"), note, number)
    two = F.concat_ws(", ", note, number, e.cast("string"), F.lit("more"))
    for odd, line, head in ((0, one, "event_id,note,value"), (1, two, "note,value,event_id,other")):
        _lines(rows.where(F.col("part") % 2 == odd).withColumn("value", line), f"{path}/{odd}", [(-1, head)])
    read = readers.union_session_files(spark, f"{path}/*/*/*.txt", None, "event_id long, note string, value double")
    part = F.regexp_extract("session_name", r"(\d+)$", 1).cast("long")
    return read.select(part.alias("part"), "event_id", "note", r6("value"))


@query(
    "result_chain",
    S.with_views("merged_pos", **RECALL_CTES)
    + f""", kept AS (SELECT {T.answer('mixed', 'truth')} AS answer FROM mx),
    t AS (SELECT unnest({list(scoring.TASK_NAMES)}) AS task)
    SELECT 'echo_results' AS model, task, CASE WHEN task = 'past_scene_recall' THEN (SELECT count(*) FROM kept) ELSE 0 END AS n_total,
    CASE WHEN task = 'past_scene_recall' THEN (SELECT count(*) FROM kept WHERE answer = 'B') ELSE 0 END AS n_correct
    FROM t WHERE task NOT LIKE 'proactive%'""",
)
def result_chain(spark, sf):
    """Questions written, read, answered, written as results, read, routed to their score, and put into the grid."""
    path = scratch(spark, "chain")
    entries = merged_entries(spark, sf)
    recall = sinks.question_items(Q.scene_recall(entries), ["answer_object"], video="clips/{}.mp4")
    sinks.write_questions(recall, f"{path}/questions")
    items = readers.read_questions(spark, f"{path}/questions/*/*.json")
    reply = F.struct(F.lit("B. the second").alias("model_prediction"))
    answered = items.withColumn("model_predictions", F.array(reply)).withColumn("task", F.lit("past_scene_recall"))
    alerts = sinks.question_items(Q.alert_gaze(entries), ["test_info"], video="clips/{}.mp4").withColumn(
        "questions",
        F.transform("questions", lambda q: q.withField(
            "test_info", F.transform(q["test_info"], lambda p: p.withField("response", F.lit("yes"))))),
    )
    sinks.write_results(answered, path, "echo", ["past_scene_recall"])
    sinks.write_results(alerts.withColumn("task", F.lit("proactive_gaze_triggered_alert")), path, "echo", ["proactive_gaze_triggered_alert"])
    results = readers.read_results(spark, path, ["echo", "absent"])
    grid = scoring.result_grid(results.select("model").distinct(), scoring.score_results(results), scoring.TASK_NAMES)
    return grid.where(~F.col("task").startswith("proactive")).select("model", "task", "n_total", "n_correct")


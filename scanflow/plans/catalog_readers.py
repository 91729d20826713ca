"""Registered readers: files that Spark derives from the tables, in each exchange format, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanflow.operators import frames
from scanflow.plans import standins as S
from scanflow.plans.catalog import query, r6
from scanflow.sources import arrays, readers, sinks
from scanflow.streaming.runs import scratch

FILE = r"part=(-?\d+)/"


def lines_by_part(rows: DataFrame, path: str, head: list[tuple] = ()) -> None:
    """Text files, one folder per ``part``: lines in the order of ``nr``, ``head`` lines (nr, value) on top."""
    whole = rows.select("part", "nr", "value")
    if head:
        lines = F.array(*[F.struct(F.lit(n).cast("long").alias("nr"), F.lit(v).alias("value")) for n, v in head])
        whole = whole.unionByName(rows.select("part").distinct().select("part", F.inline(lines)))
    whole.repartition("part").sortWithinPartitions("part", "nr").drop("nr").write.partitionBy("part").text(path)


_LABELS = {"click": "Fixation", "view": "Saccade"}


def _label(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for p in _LABELS.items() for v in p])[kind], F.lit("Blink"))


@query(
    "gaze_text_files",
    S.with_views("clicks")
    + """SELECT CAST(event_id // 1000 AS VARCHAR) AS session_id,
    33 + row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS seq, r6(value) AS x, r6(k) AS y,
    event_id % 500 AS frame_idx, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS gaze_type FROM clicks""",
)
def gaze_text_files(spark, sf):
    """Vendor text of both versions: odd recordings are of the second."""
    path = scratch(spark, "gaze-text")
    e = S.clicks(spark, sf).withColumn("part", F.floor(F.col("event_id") / 1000)).withColumn("f", F.col("event_id") % 500)
    code = F.format_string("00:00:%02d:%02d", F.floor(F.col("f") / 24), F.col("f") % 24)
    label, x, y = _label(F.col("event_type")), F.col("value").cast("string"), F.col("k").cast("string")
    one = F.concat_ws("\t", F.lit("0"), F.lit("SMP"), F.lit("1"), x, y, F.col("f").cast("string"), label)
    two = F.concat_ws(" ", F.lit("0 0 0 0 0"), x, y, F.lit(" ".join("0" * 17)), code, label)
    odd = F.col("part") % 2 == 1
    rows = e.select("part", F.col("event_id").alias("nr"), F.when(odd, two).otherwise(one).alias("value"))
    mark = "## Number of Samples: 9"
    heads = {v: [(i - 100, mark if i == at else f"## line {i}") for i in range(34)] for v, at in ((0, 9), (1, 12))}
    for version, head in heads.items():
        lines_by_part(rows.where(F.col("part") % 2 == version), f"{path}/v{version}", head)
    out = readers.read_gaze_text(spark, f"{path}/*/*/*.txt", session=FILE)
    return out.select("session_id", "seq", r6("x"), r6("y"), "frame_idx", "gaze_type")


@query(
    "gaze_2d_files",
    S.with_views("clicks")
    + """SELECT CAST(event_id // 1000 AS VARCHAR) AS session_id, event_id AS frame_idx,
    r6(CASE WHEN event_type = 'error' THEN 0.5 ELSE value / 500 END) AS px,
    r6(CASE WHEN event_type = 'error' THEN 0.5 ELSE k / 100 END) AS py,
    CASE WHEN event_type = 'error' OR event_type = 'signup' THEN 0 WHEN value >= 500 THEN 4 ELSE 1 END AS gaze_type FROM clicks""",
)
def gaze_2d_files(spark, sf):
    path = scratch(spark, "gaze-2d")
    known = F.col("event_type") != "error"
    rows = S.clicks(spark, sf).select(
        F.floor(F.col("event_id") / 1000).alias("part"),
        (F.col("value") < 500).alias("in_frame"),
        F.when(known, F.col("value")).alias("u"),
        F.lit("kept aside").alias("more"),
        F.when(known, F.col("k")).alias("v"),
        F.col("event_id").alias("frame_idx"),
        (F.col("event_type") != "signup").alias("valid"),
        (F.col("event_id") / 24.0).alias("timestamp_sec"),
    )
    sinks.write_table(rows, path, ["part"], fmt="csv")
    out = readers.read_gaze_2d(spark, f"{path}/*/*.csv", 500, 100, session=FILE)
    return out.select("session_id", "frame_idx", r6("px"), r6("py"), "gaze_type")


@query(
    "sync_files",
    S.with_views("clicks")
    + """, t AS (SELECT event_id, k, value, event_id // 1000 AS part FROM clicks)
    SELECT CAST(part AS VARCHAR) AS session_id, event_id AS tick, r6(value) AS first, k % 2 = 1 AS valid, 896 AS width,
    min(event_id) OVER (PARTITION BY part) AS start_tick FROM t""",
)
def sync_files(spark, sf):
    """Poses, rays, lens and timing of recordings of a thousand samples; lines after a blank one do not count."""
    path = scratch(spark, "sync")
    e = S.clicks(spark, sf).withColumn("part", F.floor(F.col("event_id") / 1000)).withColumn("nr", F.col("event_id"))
    tick = F.col("event_id").cast("string")
    zeros = F.lit("\t".join(["0.5"] * 15))
    poses = F.concat_ws("\t", F.lit("0.0"), tick, F.col("value").cast("string"), zeros)
    rays = F.concat_ws("\t", F.lit("0.0"), tick, F.lit("\t".join(["0.1"] * 6)), (F.col("k") % 2).cast("string"))
    tail = [(1 << 60, ""), ((1 << 60) + 1, "\t".join(["9"] * 18))]
    lines_by_part(e.withColumn("value", poses), f"{path}/pose", tail)
    lines_by_part(e.withColumn("value", rays), f"{path}/eyes", tail)
    bounds = e.groupBy("part").agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    ticks = F.array(F.lit(""), F.col("low").cast("string"), F.col("high").cast("string"))
    lines_by_part(bounds.select("part", F.posexplode(ticks).alias("nr", "value")), f"{path}/timing")
    lens = F.lit("\t".join("500 0 448 0 500 252 0 0 1 896 504".split()))
    lines_by_part(bounds.select("part", F.lit(0).alias("nr"), lens.alias("value")), f"{path}/lens")
    files = {n: f"{path}/{n}/*/*.txt" for n in ("pose", "eyes", "timing", "lens")}
    first = readers.read_poses(spark, files["pose"], FILE).select("session_id", "tick", F.get("pose", F.lit(0)).alias("first"))
    look = readers.read_rays(spark, files["eyes"], FILE).select("session_id", "tick", "valid")
    lens = readers.read_intrinsics(spark, files["lens"], FILE).select("session_id", "width")
    timing = readers.read_video_timing(spark, files["timing"], FILE).select("session_id", "start_tick")
    return first.join(look, ["session_id", "tick"]).join(lens, "session_id").join(timing, "session_id").withColumn("first", r6("first"))


@query(
    "gaze_array_files",
    S.with_views("clicks")
    + """, t AS (SELECT event_id // 5000 AS part, event_id % 5000 AS frame_idx, CASE WHEN event_type = 'error' THEN NULL ELSE value / 300 END AS x,
      k / 80.0::DOUBLE AS y, event_type <> 'signup' AS valid FROM clicks)
    SELECT CAST(part AS VARCHAR) AS session_id, frame_idx, CASE WHEN x IS NOT NULL THEN r6(least(x, 1)) END AS px, r6(least(y, 1)) AS py,
    CASE WHEN NOT valid THEN 0 WHEN x IS NULL OR x > 1 OR y > 1 THEN 4 ELSE 1 END AS gaze_type FROM t""",
)
def gaze_array_files(spark, sf):
    """Recordings of five arrays of a thousand frames each, read back by ranges that cut through the arrays."""
    path = scratch(spark, "gaze-arrays")
    part, frame = F.floor(F.col("event_id") / 5000), F.col("event_id") % 5000
    rows = S.clicks(spark, sf).select(
        F.format_string("r%d/%d.npy", part, F.floor(frame / 1000) * 1000).alias("file"), "event_id",
        F.when(F.col("event_type") != "error", F.col("value") / 300).alias("x"), (F.col("k") / 80).alias("y"),
        (F.col("event_type") != "signup").cast("double").alias("valid"),
    )
    arrays.write_arrays(rows, path, "file", "event_id", ["x", "y", "valid"])
    out = readers.read_gaze_array(spark, f"{path}/*/*.npy", session=r"/r(\d+)/", task_bytes=1 << 16, first=r"(\d+)\.npy$")
    return out.select("session_id", "frame_idx", r6("px"), r6("py"), "gaze_type")


@query(
    "annotation_files",
    S.with_views("order_actions")
    + """SELECT CAST(session_id // 100 AS VARCHAR) AS session_id, r6(start_s) AS start_s, r6(end_s) AS end_s, action
    FROM order_actions WHERE pos % 5 <> 0""",
)
def annotation_files(spark, sf):
    """A JSON array per recording; every fifth label is blank and goes."""
    path = scratch(spark, "annotations")
    rows = S.order_actions(spark, sf)
    label = F.when(F.col("pos") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "action"))
    entry = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), label.alias("textAttribute_en"))
    # a hundred sessions a file: files grow in number, not in size
    whole = rows.groupBy(F.floor(F.col("session_id") / 100).alias("part")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    lines_by_part(whole.withColumn("nr", F.lit(0)), path)
    out = readers.read_annotation_json(spark, f"{path}/*/*.txt", session=FILE)
    return out.select("session_id", r6("start_s"), r6("end_s"), "action")


@query(
    "nested_annotation_files",
    S.with_views("order_actions")
    + """SELECT 'v' || CAST(session_id AS VARCHAR) AS session_id, r6(start_s) AS start_s,
    CASE WHEN pos % 3 = 0 THEN 'do' ELSE 'do ' || action END AS action, pos % 3 <> 0 AS "both" FROM order_actions WHERE pos % 4 <> 1""",
)
def nested_annotation_files(spark, sf):
    path = scratch(spark, "nested")
    kind = F.when(F.col("pos") % 4 == 1, "Narration").otherwise("Fine grained action")
    noun = F.when(F.col("pos") % 3 == 0, "none").otherwise(F.col("action"))
    event = F.struct(
        kind.alias("label"), F.col("start_s").alias("start"), F.col("end_s").alias("end"),
        F.struct(F.lit("do").alias("Verb"), noun.alias("Noun")).alias("attributes"),
    )
    name = F.concat(F.lit("v"), F.col("session_id").cast("string"))
    S.order_actions(spark, sf).groupBy(name.alias("video_name")).agg(F.collect_list(event).alias("events")).write.json(path)
    return readers.read_nested_annotations(spark, path).select("session_id", r6("start_s"), "action", "both")


@query(
    "fine_annotation_files",
    S.with_views("order_actions")
    + """SELECT CAST(session_id AS VARCHAR) AS session_id, r6(start_s) AS start_s, r6(end_s) AS end_s, action || ', slowly' AS text
    FROM order_actions WHERE session_id % 2 = 0""",
)
def fine_annotation_files(spark, sf):
    """Columns stand in another order than the reader names them."""
    path = scratch(spark, "fine")
    rows = S.order_actions(spark, sf)
    scene = F.when(F.col("session_id") % 2 == 0, "kitchen").otherwise("lab")
    rows.select(
        scene.alias("scene"), F.concat("action", F.lit(", slowly")).alias("narration"), "end_s",
        F.col("session_id").cast("string"), F.lit("x").alias("more"), "start_s", (F.col("pos") % 3).alias("part"),
    ).write.option("header", "true").partitionBy("part").csv(path)
    wanted = rows.where("session_id % 2 = 0").select(F.col("session_id").cast("string")).distinct()
    schema = "session_id string, start_s double, end_s double, narration string, scene string"
    out = readers.read_fine_annotations(spark, f"{path}/*/*.csv", schema, scene="kitchen", sessions=wanted)
    return out.select("session_id", r6("start_s"), r6("end_s"), "text")


@query(
    "prediction_chunk_files",
    S.with_views("predictions")
    + "SELECT CAST(item_id AS VARCHAR) AS id, reply AS pred FROM predictions",
)
def prediction_chunk_files(spark, sf):
    path = scratch(spark, "chunks")
    rows = S.predictions(spark, sf).select(F.col("item_id").cast("string").alias("id"), F.col("reply").alias("pred"))
    for nr in range(3):
        rows.where(F.pmod(F.crc32(F.col("id")), F.lit(3)) == nr).write.json(f"{path}/3_{nr}.json")
    return readers.read_prediction_chunks(spark, path, 3).select("id", "pred")


@query(
    "report_files",
    "SELECT 'orders' AS name, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL "
    "SELECT 'lines', l_returnflag, count(*) FROM lineitem GROUP BY 2",
)
def report_files(spark, sf):
    path = scratch(spark, "report")
    orders = S.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key")).count()
    lines = S.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("key")).count()
    sinks.write_report({"orders": orders, "lines": lines}, path)
    read = spark.read.option("header", "true").schema("key string, n long")
    parts = [read.csv(f"{path}/{n}").select(F.lit(n).alias("name"), "key", "n") for n in ("orders", "lines")]
    return parts[0].unionByName(parts[1])


@query(
    "late_samples_dropped",
    S.with_views("gaze_clock")
    + """, s AS (SELECT session_id, event_id, t - min(t) OVER (PARTITION BY session_id) AS t FROM gaze_clock),
    e AS (SELECT session_id, CAST(floor(arg_max(t, event_id) * 0.01) AS BIGINT) + 1 AS n FROM s GROUP BY 1)
    SELECT session_id, event_id FROM s JOIN e USING (session_id) WHERE CAST(floor(t * 0.01) AS BIGINT) < n""",
)
def late_samples_dropped(spark, sf):
    """Frames of 100 s; the last sample written ends the recording."""
    clock = S.gaze_clock(spark, sf)
    begin = clock.groupBy("session_id").agg(F.min("t").alias("_t0"))
    rows = clock.join(begin, "session_id").select("session_id", "event_id", (F.col("t") - F.col("_t0")).alias("t"))
    return frames.drop_late(rows, ["session_id"], "event_id", "t", 0.01).select("session_id", "event_id")

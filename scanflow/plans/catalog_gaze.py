"""Registered queries over gaze frames: typing, averaging, segments, joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanflow.functions import geometry, text, timecode
from scanflow.operators import folds, frames, intervals, joins, ordered, segments
from scanflow.plans import standins as S
from scanflow.plans.catalog import query, r4, r6
from scanflow.session import cut




@query(
    "gaze_frame_clock",
    S.with_views("gaze")
    + """SELECT session_id, frame_idx, r6(time_seconds) AS time_seconds,
    r6(time_seconds * 1000) AS time_ms,
    printf('%02d:%02d:%02d.%03d', CAST(floor(time_seconds / 3600) AS BIGINT),
      CAST(floor((time_seconds % 3600) / 60) AS BIGINT), CAST(floor(time_seconds % 60) AS BIGINT),
      CAST(floor((time_seconds % 1) * 1000) AS BIGINT)) AS "timestamp",
    CASE gaze_type WHEN 0 THEN 'untracked' WHEN 1 THEN 'fixation' WHEN 2 THEN 'saccade' WHEN 3 THEN 'unknown'
      ELSE 'truncated' END AS label,
    CAST(floor(time_seconds * 24.46) AS BIGINT) AS frame_at_other_rate FROM gaze""",
)
def gaze_frame_clock(spark, sf):
    df = frames.with_frame_time(S.gaze(spark, sf), S.FPS)
    return df.select(
        "session_id",
        "frame_idx",
        r6("time_seconds"),
        r6("time_ms"),
        "timestamp",
        frames.gaze_label(F.col("gaze_type")).alias("label"),
        timecode.frame_index(F.col("time_seconds"), 24.46).alias("frame_at_other_rate"),
    )


@query(
    "gaze_clamped",
    S.with_views("clicks")
    + """SELECT event_id, r6(least(greatest(value * 12 - 100, 0), 1279) / 1280.0) AS px,
    r6(least(greatest(k * 12 - 100, 0), 959) / 960.0) AS py,
    CASE WHEN value * 12 - 100 < 0 OR value * 12 - 100 > 1279 OR k * 12 - 100 < 0 OR k * 12 - 100 > 959
      THEN 4 ELSE 1 END AS strict_type, 1 AS vendor_type FROM clicks""",
)
def gaze_clamped(spark, sf):
    pixels = S.clicks(spark, sf).select(
        "event_id",
        (F.col("value") * 12 - 100).alias("x"),
        (F.col("k") * 12 - 100).cast("double").alias("y"),
        F.lit(frames.FIXATION).alias("t"),
    )
    df = frames.clamp_normalized(pixels, 1280, 960)
    return df.select(
        "event_id",
        r6("px"),
        r6("py"),
        frames.typed_range(F.col("t"), F.col("outside"), keep_truncated=True).alias("strict_type"),
        frames.typed_range(F.col("t"), F.col("outside")).alias("vendor_type"),
    )


@query(
    "gaze_types",
    S.with_views("gaze")
    + """, t AS (SELECT session_id, frame_idx, CASE WHEN k = 0 THEN NULL ELSE px * 2 END AS x, py * 1.05 AS y,
      1 - py AS confidence, gaze_type <> 0 AS valid FROM gaze)
    SELECT session_id, frame_idx,
    CASE WHEN x IS NULL THEN 0 WHEN x < 0 OR x > 1 OR y < 0 OR y > 1 THEN 4 WHEN confidence >= 0.9 THEN 1
      WHEN confidence >= 0.5 THEN 2 ELSE 3 END AS by_confidence,
    CASE WHEN NOT valid OR x IS NULL THEN 0
      WHEN NOT (x * 896 >= 0 AND x * 896 < 896 AND y * 504 >= 0 AND y * 504 < 504) THEN 4 ELSE 1 END AS by_validity,
    r6(coalesce(x, 0.5)) AS px FROM t""",
)
def gaze_types(spark, sf):
    x = F.when(F.col("k") != 0, F.col("px") * 2)
    y, confidence = F.col("py") * 1.05, F.lit(1) - F.col("py")
    inside = frames.in_frame(x * 896, y * 504, F.lit(896), F.lit(504))
    return S.gaze(spark, sf).select(
        "session_id",
        "frame_idx",
        frames.confidence_type(x, y, confidence).alias("by_confidence"),
        frames.validity_type(x, y, F.col("gaze_type") != 0, inside).alias("by_validity"),
        r6(F.coalesce(x, F.lit(0.5)), "px"),
    )


@query(
    "frame_average",
    S.with_views("clicks")
    + """, s AS (SELECT session_id, us // 432000000000 AS frame_idx, us, event_id, value, k, event_type
      FROM clicks WHERE event_type <> 'error'),
    p AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY session_id, frame_idx) AS n FROM s
      WINDOW w AS (PARTITION BY session_id, frame_idx ORDER BY event_id))
    SELECT session_id, CAST(frame_idx AS BIGINT) AS frame_idx,
    r6(sum(value * pow(2.0, -least(n - i + 1, n - 1)))) AS px,
    r6(sum(k * pow(2.0, -least(n - i + 1, n - 1)))) AS py,
    max(n) AS n, arg_max(event_type, event_id) AS event_type FROM p GROUP BY 1, 2""",
)
def frame_average(spark, sf):
    samples = S.clicks(spark, sf).select(
        "session_id",
        F.floor(F.col("us") / F.lit(432_000_000_000)).cast("long").alias("frame_idx"),
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("px"),
        F.col("k").cast("double").alias("py"),
        "event_type",
    )
    out = frames.frame_average(samples, ["session_id", "frame_idx"], "event_id", ["px", "py"], last="event_type")
    return out.select("session_id", "frame_idx", r6("px"), r6("py"), "n", "event_type")


@query(
    "dense_frames",
    S.with_views("gaze")
    + """, g AS (SELECT session_id, frame_idx, px, py, gaze_type FROM gaze WHERE event_type <> 'error'),
    n AS (SELECT session_id, max(frame_idx) AS m FROM g GROUP BY 1),
    e AS (SELECT session_id, unnest(range(0, m + 1)) AS frame_idx FROM n)
    SELECT e.session_id, e.frame_idx, r6(coalesce(px, 0)) AS px, r6(coalesce(py, 0)) AS py,
    coalesce(gaze_type, 0) AS gaze_type FROM e LEFT JOIN g USING (session_id, frame_idx)""",
)
def dense_frames(spark, sf):
    sparse = S.gaze(spark, sf).where(F.col("event_type") != "error").select("session_id", "frame_idx", "px", "py", "gaze_type")
    out = frames.densify(sparse, ["session_id"], {"px": 0.0, "py": 0.0, "gaze_type": 0})
    return out.select("session_id", "frame_idx", r6("px"), r6("py"), "gaze_type")


@query(
    "tracked_trail",
    S.with_views("gaze")
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_idx) - 1 AS pos
      FROM gaze WHERE gaze_type <> 0)
    SELECT session_id, frame_idx, count(*) OVER w AS n_trail, r6(first_value(px) OVER w) AS oldest_px,
    r6(sum(py) OVER w) AS sum_py FROM p
    WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
)
def tracked_trail(spark, sf):
    points = ordered.numbered(
        S.gaze(spark, sf).where(F.col("gaze_type") != 0),
        ["session_id"],
        ["frame_idx"],
        ordered.bucket(F.col("frame_idx"), S.FRAMES_PER_CHUNK),
    )
    out = frames.trail(points, ["session_id"], "pos", 30)
    return out.select(
        "session_id",
        "frame_idx",
        F.size("trail").cast("long").alias("n_trail"),
        r6(F.col("trail")[0]["px"], "oldest_px"),
        r6(F.aggregate("trail", F.lit(0.0), lambda a, p: a + p["py"]), "sum_py"),
    )


_WALK = """, nxt AS (SELECT g.session_id, g.frame_idx AS a, min(h.frame_idx) AS b FROM gaze g JOIN gaze h
      ON h.session_id = g.session_id AND h.frame_idx > g.frame_idx
      AND sqrt((g.px - h.px) * (g.px - h.px) + (g.py - h.py) * (g.py - h.py)) > 0.5 GROUP BY 1, 2),
    walk AS (
      SELECT session_id, 0::BIGINT AS a FROM gaze WHERE frame_idx = 0
      UNION ALL
      SELECT w.session_id, n.b FROM walk w JOIN nxt n ON n.session_id = w.session_id AND n.a = w.a),
    seg AS (SELECT session_id, a, coalesce(lead(a) OVER (PARTITION BY session_id ORDER BY a), 1000000000) AS b
      FROM walk),
    st AS (SELECT s.session_id, s.a, min(time_seconds) AS start_s, max(time_seconds) AS end_s, avg(px) AS cx,
      avg(py) AS cy, count(*) AS n FROM seg s JOIN gaze g ON g.session_id = s.session_id
      AND g.frame_idx >= s.a AND g.frame_idx < s.b GROUP BY 1, 2)
    """


@query(
    "fixations",
    S.with_views("gaze")
    + _WALK
    + """SELECT session_id, r6(start_s) AS start_s, r6(end_s) AS end_s, r6(cx) AS center_x,
    r6(cy) AS center_y, n FROM st WHERE end_s - start_s >= 0.12""",
)
def fixations(spark, sf):
    out = folds.fixations(stored(spark, sf), radius=0.5, min_duration=0.12, gap=0.01, size=S.FRAMES_PER_CHUNK)
    return out.select("session_id", r6("start_s"), r6("end_s"), r6("center_x"), r6("center_y"), "n")


@query(
    "fixations_in_chunks",
    S.with_views("gaze")
    + _WALK
    + """SELECT session_id, count(*) AS n_segments, sum(n) AS n_frames, r6(max(end_s - start_s)) AS longest
    FROM st GROUP BY 1""",
)
def fixations_in_chunks(spark, sf):
    out = folds.anchored_segments(stored(spark, sf), radius=0.5, gap=0.01, size=48)
    return out.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.sum("n").alias("n_frames"),
        r6(F.max("duration"), "longest"),
    )


#: The walk with each recording's own radius.
_WALK_BY_SOURCE = _WALK.replace("> 0.5", "> CASE g.session_id % 5 WHEN 0 THEN 0.15 WHEN 1 THEN 0.088 ELSE 96.0::DOUBLE / 448 END").replace(
    "FROM gaze WHERE frame_idx = 0", "FROM gaze WHERE frame_idx = 0 AND session_id % 5 <> 4"
)


@query(
    "fixations_by_source",
    S.with_views("gaze")
    + _WALK_BY_SOURCE
    + """SELECT session_id, r6(start_s) AS start_s, r6(end_s) AS end_s, r6(cx) AS center_x, r6(cy) AS center_y, n FROM st""",
)
def fixations_by_source(spark, sf):
    """Every recording cut with the radius of its data set, for images 448 pixels wide; one in five is of none."""
    gaze = stored(spark, sf)
    names = F.array(*[F.lit(s) for s in ("egtea", "Ego4D", "egoexo", "holoassist", "other")])
    recordings = gaze.select("session_id").distinct().withColumn("source", F.get(names, F.col("session_id") % 5))
    own = folds.source_parameters(recordings, "source", 448)
    out = folds.anchored_segments(gaze, parameters=own)
    return out.select("session_id", r6("start_s"), r6("end_s"), r6("center_x"), r6("center_y"), "n")


def _move_sql(v, d, disp):
    return f""", s AS (SELECT *, lag(px) OVER w AS qx, lag(py) OVER w AS qy, lag(time_seconds) OVER w AS qt FROM gaze
      WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx)),
    f AS (SELECT *, coalesce(sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) / (time_seconds - qt) > {v}, false)
      AS fast FROM s),
    r AS (SELECT *, sum(CASE WHEN fast THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY frame_idx) AS g
      FROM f),
    m AS (SELECT session_id, g, min(time_seconds) AS start_s, max(time_seconds) AS end_s, avg(px) AS cx, avg(py) AS cy,
      count(*) AS n, greatest(max(px) - min(px), max(py) - min(py)) AS dispersion FROM r WHERE fast GROUP BY 1, 2),
    kept AS (SELECT * FROM m WHERE end_s - start_s >= {d} AND dispersion > {disp})
    """


def stored(spark, sf):
    """The stand-in frames as a stored table: runs and folds read them more than once."""
    return cut(S.gaze(spark, sf))


_SEG_COLS = """session_id, r6(start_s) AS start_s, r6(end_s) AS end_s, r6(cx) AS center_x,
    r6(cy) AS center_y, n, r6(dispersion) AS dispersion"""


def _segment_columns(df):
    return df.select(
        "session_id", r6("start_s"), r6("end_s"), r6("center_x"), r6("center_y"), "n", r6("dispersion")
    )


@query("movements", S.with_views("gaze") + _move_sql(8, 0.15, 0.5) + f"SELECT {_SEG_COLS} FROM kept")
def movements(spark, sf):
    return _segment_columns(
        segments.movements(stored(spark, sf), velocity=8, min_duration=0.15, dispersion=0.5, size=S.FRAMES_PER_CHUNK)
    )


@query("confusions", S.with_views("gaze") + _move_sql(0.01, 2.5, 0.1) + f"SELECT {_SEG_COLS} FROM kept")
def confusions(spark, sf):
    return _segment_columns(segments.confusions(stored(spark, sf), size=S.FRAMES_PER_CHUNK))


@query(
    "movement_actions",
    S.with_views("gaze", "actions")
    + _move_sql(8, 0.15, 0.5)
    + """SELECT k.session_id, r6(k.start_s) AS start_s, r6(k.end_s) AS end_s, a.pos, a.text
    FROM kept k LEFT JOIN actions a ON a.session_id = k.session_id AND NOT (k.end_s < a.start_s OR k.start_s > a.end_s)""",
)
def movement_actions(spark, sf):
    frames_table = stored(spark, sf)
    moved = segments.movements(
        frames_table, velocity=8, min_duration=0.15, dispersion=0.5, size=S.FRAMES_PER_CHUNK
    ).select("session_id", "start_s", "end_s")
    out = joins.overlap_join(moved, S.purchases(frames_table), ["session_id"], width=60.0, key="start_s")
    return out.select(
        "session_id", r6("start_s"), r6("end_s"), F.col("match.pos").alias("pos"), F.col("match.text").alias("text")
    )


@query(
    "overlap_captions",
    S.with_views("short_segments", "actions")
    + """SELECT s.session_id, s.segment, count(a.pos) AS n_actions,
    coalesce(string_agg(a.text, '; ' ORDER BY a.pos), '') AS captions
    FROM short_segments s LEFT JOIN actions a ON a.session_id = s.session_id
      AND NOT (s.end_s < a.start_s OR s.start_s > a.end_s) GROUP BY 1, 2""",
)
def overlap_captions(spark, sf):
    gaze = stored(spark, sf)
    pairs = joins.overlap_join(S.segments_of(gaze), S.purchases(gaze), ["session_id"], width=60.0, key="segment")
    labels = F.array_sort(F.collect_list(F.struct("match.pos", "match.text")))
    return pairs.groupBy("session_id", "segment").agg(
        F.count("match.pos").alias("n_actions"),
        F.array_join(F.transform(labels, lambda s: s["text"]), "; ").alias("captions"),
    )


@query(
    "overlap_any_length",
    S.with_views("gaze", "short_segments", "actions")
    + """, spans AS (SELECT session_id, segment, start_s, end_s FROM short_segments UNION ALL
      SELECT session_id, -1, min(time_seconds), max(time_seconds) FROM gaze GROUP BY 1)
    SELECT s.session_id, s.segment, count(a.pos) AS n_actions, min(a.text) AS first_text FROM spans s LEFT JOIN actions a
      ON a.session_id = s.session_id AND NOT (s.end_s < a.start_s OR s.start_s > a.end_s) GROUP BY 1, 2""",
)
def overlap_any_length(spark, sf):
    """Short segments, and one as long as its session, with the actions they overlap."""
    gaze = stored(spark, sf)
    spans = S.segments_of(gaze).unionByName(
        gaze.groupBy("session_id").agg(
            F.lit(-1).cast("long").alias("segment"), F.min("time_seconds").alias("start_s"), F.max("time_seconds").alias("end_s")
        )
    )
    pairs = joins.sweep_join(spans, S.purchases(gaze), ["session_id"], key="segment")
    return pairs.groupBy("session_id", "segment").agg(
        F.count("match.pos").alias("n_actions"), F.min("match.text").alias("first_text")
    )


_NEAR = """, probe AS (SELECT session_id, event_id, t FROM gaze_clock WHERE event_type = 'view'),
    smp AS (SELECT session_id, event_id AS sid, t AS st FROM gaze_clock WHERE event_type <> 'view'),
    before AS (SELECT p.session_id, p.event_id, arg_max(s.sid, (s.st, s.sid)) AS bid, max(s.st) AS bt FROM probe p
      JOIN smp s ON s.session_id = p.session_id AND s.st < p.t GROUP BY 1, 2),
    after AS (SELECT p.session_id, p.event_id, arg_min(s.sid, (s.st, s.sid)) AS aid, min(s.st) AS at_ FROM probe p
      JOIN smp s ON s.session_id = p.session_id AND s.st >= p.t GROUP BY 1, 2)
    """


@query(
    "nearest_event",
    S.with_views("gaze_clock")
    + _NEAR
    + """SELECT p.session_id, p.event_id, CASE WHEN bid IS NULL OR at_ - p.t < p.t - bt THEN aid ELSE bid END AS near_id
    FROM probe p LEFT JOIN before USING (session_id, event_id) LEFT JOIN after USING (session_id, event_id)""",
)
def nearest_event(spark, sf):
    clock = S.gaze_clock(spark, sf).select("session_id", "event_id", "event_type", "t")
    probes = clock.where(F.col("event_type") == "view").select("session_id", "event_id", "t")
    samples = clock.where(F.col("event_type") != "view").select("session_id", "event_id", "t")
    out = joins.nearest_join(probes, samples, ["session_id"], "t", chunk=60.0, seq="event_id")
    return out.select("session_id", "event_id", F.col("sample.event_id").alias("near_id"))


@query(
    "next_purchase",
    S.with_views("gaze_clock")
    + """, p AS (SELECT session_id, event_id, t FROM gaze_clock WHERE event_type = 'click'),
    a AS (SELECT session_id, event_id AS aid, t AS at_ FROM gaze_clock WHERE event_type = 'purchase'),
    m AS (SELECT p.session_id, p.event_id, arg_min(aid, (at_, aid)) AS next_id, min(at_) - p.t AS gap FROM p JOIN a
      ON a.session_id = p.session_id AND at_ >= p.t + 7200.0::DOUBLE GROUP BY 1, 2, p.t)
    SELECT p.session_id, p.event_id, CASE WHEN gap <= 432000 THEN next_id END AS next_id
    FROM p LEFT JOIN m USING (session_id, event_id)""",
)
def next_purchase(spark, sf):
    clock = S.gaze_clock(spark, sf).select("session_id", "event_id", "event_type", "t")
    probes = clock.where(F.col("event_type") == "click").select("session_id", "event_id", "t")
    buys = clock.where(F.col("event_type") == "purchase").select("session_id", "event_id", "t")
    out = joins.next_after(
        probes, buys, ["session_id"], "t", chunk=60.0, low=7200.0, high=432_000.0, seq="event_id"
    )
    return out.select("session_id", "event_id", F.col("event.event_id").alias("next_id"))


@query(
    "points_in_intervals",
    S.with_views("gaze", "actions")
    + """SELECT g.session_id, g.frame_idx, EXISTS (SELECT 1 FROM actions a WHERE a.session_id = g.session_id
      AND a.start_s <= g.time_seconds AND g.time_seconds <= a.end_s) AS covered FROM gaze g""",
)
def points_in_intervals(spark, sf):
    points = S.gaze(spark, sf).select("session_id", "frame_idx", F.col("time_seconds").alias("t"))
    out = joins.point_in_intervals(points, S.actions(spark, sf), ["session_id"], "t", chunk=600.0)
    return out.select("session_id", "frame_idx", "covered")


def _context_sql(low):
    return (
        S.with_views("gaze_clock")
        + f""", q AS (SELECT session_id, event_id, t FROM gaze_clock WHERE event_type = 'signup')
    SELECT q.session_id, q.event_id, count(g.event_id) AS n_visible, r4(coalesce(sum(g.value), 0)) AS sum_visible
    FROM q LEFT JOIN gaze_clock g ON g.session_id = q.session_id AND g.t <= q.t AND g.t >= {low} GROUP BY 1, 2"""
    )


def _context(spark, sf, low):
    clock = S.gaze_clock(spark, sf).select("session_id", "event_id", "event_type", "t", "value")
    asked = clock.where(F.col("event_type") == "signup").select("session_id", "event_id", "t")
    out = joins.window_totals(
        asked, clock, ["session_id"], "event_id", low, F.col("t"), "value", chunk=60.0
    )
    return out.select("session_id", "event_id", "n_visible", r4("sum_visible"))


@query("context_past", _context_sql("0"))
def context_past(spark, sf):
    return _context(spark, sf, F.lit(0.0))


@query("context_present", _context_sql("greatest(q.t - 432000, 0)"))
def context_present(spark, sf):
    return _context(spark, sf, F.greatest(F.col("t") - 432_000, F.lit(0.0)))


@query(
    "projected_gaze",
    S.with_views("clicks")
    + """, cam AS (SELECT session_id, min(us) AS start_us, count(*) AS n_frames FROM clicks GROUP BY 1),
    fr AS (SELECT session_id, f AS frame_idx,
        (start_us - 1704067200000000) * 10 + (CAST(f AS HUGEINT) * 50 * 10000000) // 1223 * 432000 AS t
      FROM (SELECT *, unnest(range(0, n_frames)) AS f FROM cam)),
    ray AS (SELECT session_id, event_id, (us - 1704067200000000) * 10 AS st, value / 500 AS vx, k / 100.0::DOUBLE AS vy,
      event_type <> 'error' AS valid FROM clicks),
    b AS (SELECT fr.session_id, frame_idx, arg_max(event_id, (st, event_id)) AS bid, max(st) AS bt FROM fr JOIN ray r
      ON r.session_id = fr.session_id AND st < t GROUP BY 1, 2),
    a AS (SELECT fr.session_id, frame_idx, arg_min(event_id, (st, event_id)) AS aid, min(st) AS at_ FROM fr JOIN ray r
      ON r.session_id = fr.session_id AND st >= t GROUP BY 1, 2),
    m AS (SELECT fr.session_id, fr.frame_idx, CASE WHEN bid IS NULL OR abs(at_ - t) < abs(t - bt) THEN aid ELSE bid END
      AS rid FROM fr LEFT JOIN b USING (session_id, frame_idx) LEFT JOIN a USING (session_id, frame_idx)),
    d AS (SELECT m.session_id, m.frame_idx, valid, 0.05 * (event_id % 3) AS ox, vx - 0.3 AS x, vy - 0.5 AS y,
      0.5 - vx AS z, sqrt((vx - 0.3) * (vx - 0.3) + (vy - 0.5) * (vy - 0.5) + (0.5 - vx) * (0.5 - vx)) AS nn
      FROM m JOIN ray ON ray.event_id = m.rid),
    u AS (SELECT session_id, frame_idx, valid, ox + x / CASE WHEN nn = 0 THEN 1 ELSE nn END * 0.5 AS wx,
      y / CASE WHEN nn = 0 THEN 1 ELSE nn END * 0.5 AS wy, z / CASE WHEN nn = 0 THEN 1 ELSE nn END * 0.5 AS wz FROM d),
    c AS (SELECT session_id, frame_idx, valid, -wy AS cx, -wz AS cy, wx - 0.1 AS cz FROM u),
    p AS (SELECT session_id, frame_idx, valid, CASE WHEN cz > 0 THEN cx / cz * 500 + 448 END AS u,
      CASE WHEN cz > 0 THEN cy / cz * 500 + 252 END AS v FROM c)
    SELECT session_id, frame_idx, r4(u) AS u, r4(v) AS v, valid,
    coalesce(u >= 0 AND u < 896 AND v >= 0 AND v < 504, false) AS in_frame FROM p""",
)
def projected_gaze(spark, sf):
    from scanflow.plans.projection import project_gaze

    clicks = S.clicks(spark, sf).withColumn("tick", (F.col("us") - 1_704_067_200_000_000) * 10)
    rays = clicks.select(
        "session_id",
        "tick",
        "event_id",
        (F.lit(0.05) * (F.col("event_id") % 3)).alias("ox"),
        F.lit(0.0).alias("oy"),
        F.lit(0.0).alias("oz"),
        (F.col("value") / 500 - 0.3).alias("dx"),
        (F.col("k") / 100 - 0.5).alias("dy"),
        (F.lit(0.5) - F.col("value") / 500).alias("dz"),
        (F.col("event_type") != "error").alias("valid"),
    )
    shifted = [1.0, 0, 0, 0.1, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
    poses = clicks.select(
        "session_id", "tick", "event_id", F.array(*[F.lit(float(v)) for v in shifted]).alias("pose")
    )
    cameras = clicks.groupBy("session_id").agg(
        F.min("tick").alias("start_tick"), F.count(F.lit(1)).alias("n_frames")
    ).select(
        "*",
        *[F.lit(float(v)).alias(c) for c, v in (("fx", 500), ("fy", 500), ("cx", 448), ("cy", 252))],
        F.lit(896).alias("width"),
        F.lit(504).alias("height"),
    )
    # the stand-in clock runs 432000 times slower than the camera, so frames are days apart
    out = project_gaze(cameras, rays, poses, 24.46, chunk_ticks=600_000_000, time_scale=432_000, seq="event_id")
    return out.select("session_id", "frame_idx", r4("u"), r4("v"), "valid", "in_frame")


@query(
    "tracked_share",
    S.with_views("gaze")
    + """SELECT session_id, count(*) FILTER (WHERE gaze_type <> 0 AND k <> 0) AS n_valid, count(*) AS n_frames,
    r6(avg(CASE WHEN gaze_type <> 0 AND k <> 0 THEN 1.0 ELSE 0.0 END)) AS share FROM gaze GROUP BY 1""",
)
def tracked_share(spark, sf):
    df = S.gaze(spark, sf).select(
        "session_id", (F.col("gaze_type") != 0).alias("valid"), F.when(F.col("k") != 0, F.col("px")).alias("u")
    )
    return frames.validity_share(df, ["session_id"]).select("session_id", "n_valid", "n_frames", r6("share"))


@query(
    "crop_boxes",
    S.with_views("gaze")
    + """, p AS (SELECT *, 800 + k AS w, CASE WHEN k % 7 = 0 THEN NULL ELSE 500.0 + k END AS fx FROM gaze),
    a AS (SELECT *, coalesce(degrees(2 * atan(w / (2 * fx))), 90) AS angle FROM p),
    r AS (SELECT *, CAST(floor(13.0 * w / angle) AS BIGINT) AS radius, CAST(floor(px * w) AS BIGINT) AS cx,
      CAST(floor(py * 504) AS BIGINT) AS cy FROM a)
    SELECT session_id, frame_idx, r6(angle) AS angle, radius, greatest(0, cx - radius) AS "left",
    greatest(0, cy - radius) AS top, least(w, cx + radius) AS "right", least(504, cy + radius) AS bottom FROM r""",
)
def crop_boxes(spark, sf):
    width = (F.lit(800) + F.col("k")).cast("long")
    angle = geometry.hfov(width, F.when(F.col("k") % 7 != 0, F.lit(500.0) + F.col("k")))
    df = S.gaze(spark, sf).withColumn("angle", angle).withColumn("radius", geometry.fov_radius(width, F.col("angle")))
    box = geometry.crop_box(F.col("px"), F.col("py"), width, F.lit(504).cast("long"), F.col("radius"))
    return df.withColumn("box", box).select("session_id", "frame_idx", r6("angle"), "radius", "box.*")


@query(
    "action_captions",
    S.with_views("clicks")
    + """, a AS (SELECT event_id, CASE k % 3 WHEN 0 THEN 'none' WHEN 1 THEN '' ELSE event_type END AS verb,
      CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN NULL ELSE 'cup ' || CAST(k AS VARCHAR) END AS noun FROM clicks)
    SELECT event_id, nullif(concat_ws(' ', nullif(nullif(verb, ''), 'none'), nullif(nullif(noun, ''), 'none')), '')
    AS caption FROM a""",
)
def action_captions(spark, sf):
    k = F.col("k")
    verb = F.when(k % 3 == 0, "none").when(k % 3 == 1, "").otherwise(F.col("event_type"))
    noun = F.when(k % 4 == 0, "none").when(k % 4 != 1, F.concat(F.lit("cup "), k.cast("string")))
    return S.clicks(spark, sf).select("event_id", text.caption_from_attributes(verb, noun).alias("caption"))


_FEATURE_SEGMENTS = """, n AS (SELECT session_id, max(frame_idx) AS m FROM frame_features GROUP BY 1),
    seg AS (SELECT session_id, CAST(s AS BIGINT) AS segment, 2.0::DOUBLE * s AS start_s,
      2.0::DOUBLE * s + 1 + s % 3 AS end_s FROM (SELECT session_id, unnest(range(0, m // 16 + 1)) AS s FROM n))
    """


def _feature_segments(features):
    numbers = features.groupBy("session_id").agg(F.max("frame_idx").alias("m")).select(
        "session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 16))).alias("segment")
    )
    return numbers.select(
        "session_id",
        "segment",
        (F.col("segment") * 2.0).alias("start_s"),
        (F.col("segment") * 2.0 + 1 + F.col("segment") % 3).alias("end_s"),
    )


_CONSISTENCY = (
    _FEATURE_SEGMENTS
    + """, d5 AS (SELECT *, unnest(range(0, 5)) AS i FROM seg WHERE end_s - start_s >= 1.5),
    dk AS (SELECT d.session_id, d.segment, count(*) FILTER (WHERE mean_luma < 10) >= 3 AS dark FROM d5 d
      JOIN frame_features f ON f.session_id = d.session_id AND f.frame_idx = CAST(floor(
        (CASE WHEN i = 4 THEN end_s ELSE start_s + i * ((end_s - start_s) / 4) END) * 8) AS BIGINT) GROUP BY 1, 2),
    pts AS (SELECT *, greatest(5, CAST(floor((end_s - start_s) * 2) AS INTEGER)) AS np FROM seg
      WHERE end_s - start_s >= 1.5),
    smp AS (SELECT *, unnest(range(0, np)) AS i FROM pts),
    h AS (SELECT s.session_id, s.segment, s.i, f.hist, lag(f.hist) OVER (PARTITION BY s.session_id, s.segment
      ORDER BY s.i) AS prev FROM smp s JOIN frame_features f ON f.session_id = s.session_id
      AND f.frame_idx = CAST(floor((CASE WHEN i = np - 1 THEN end_s ELSE start_s + i * ((end_s - start_s) / (np - 1))
        END) * 8) AS BIGINT)),
    pr AS (SELECT session_id, segment, i, unnest(prev) AS a, unnest(hist) AS b FROM h WHERE prev IS NOT NULL),
    co AS (SELECT session_id, segment, i, CASE WHEN var_pop(a::DOUBLE) = 0 OR var_pop(b::DOUBLE) = 0 THEN 1
      ELSE corr(a::DOUBLE, b::DOUBLE) END AS c FROM pr GROUP BY 1, 2, 3),
    sc AS (SELECT session_id, segment, min(c) AS min_score, avg(c) AS mean_score FROM co GROUP BY 1, 2),
    res AS (SELECT s.session_id, s.segment, CASE WHEN end_s - start_s < 1.5 THEN 'too_short' WHEN dark THEN 'black_scene'
      WHEN sc.min_score IS NULL OR sc.min_score >= -0.2 THEN 'passed' ELSE 'scene_change' END AS reason,
      sc.min_score, sc.mean_score FROM seg s LEFT JOIN dk USING (session_id, segment)
      LEFT JOIN sc USING (session_id, segment))
    """
)


@query(
    "scene_consistency",
    S.with_views("frame_features")
    + _CONSISTENCY
    + """SELECT session_id, segment, reason, reason IN ('too_short', 'passed') AS kept,
    r6(CASE reason WHEN 'too_short' THEN 1 WHEN 'black_scene' THEN 0 ELSE coalesce(min_score, 1) END) AS min_score,
    r6(CASE reason WHEN 'too_short' THEN 1 WHEN 'black_scene' THEN 0 ELSE coalesce(mean_score, 1) END)
      AS mean_score FROM res""",
)
def scene_consistency(spark, sf):
    features = S.frame_features(spark, sf)
    out = segments.scene_consistency(
        _feature_segments(features), features, ["session_id"], "segment", fps=8.0, threshold=-0.2
    )
    return out.select("session_id", "segment", "reason", "kept", r6("min_score"), r6("mean_score"))


@query(
    "dark_segments",
    S.with_views("frame_features")
    + _FEATURE_SEGMENTS
    + """, d5 AS (SELECT *, unnest(range(0, 5)) AS i FROM seg),
    dk AS (SELECT d.session_id, d.segment, count(*) FILTER (WHERE mean_luma < 10) >= 3 AS dark FROM d5 d
      LEFT JOIN frame_features f ON f.session_id = d.session_id AND f.frame_idx = CAST(floor(
        (CASE WHEN i = 4 THEN end_s ELSE start_s + i * ((end_s - start_s) / 4) END) * 8) AS BIGINT) GROUP BY 1, 2)
    SELECT session_id, segment, dark FROM dk""",
)
def dark_segments(spark, sf):
    features = S.frame_features(spark, sf)
    out = segments.dark_share(_feature_segments(features), features, ["session_id"], "segment", fps=8.0)
    return out.select("session_id", "segment", "dark")


@query(
    "frame_similarity",
    S.with_views("frame_features")
    + """, h AS (SELECT session_id, frame_idx, hist, lag(hist) OVER (PARTITION BY session_id ORDER BY frame_idx) AS prev
      FROM frame_features),
    p AS (SELECT session_id, frame_idx, unnest(prev) AS a, unnest(hist) AS b FROM h WHERE prev IS NOT NULL),
    c AS (SELECT session_id, frame_idx, corr(a::DOUBLE, b::DOUBLE) AS c FROM p GROUP BY 1, 2)
    SELECT session_id, count(*) + 1 AS n_readable, r6(min(c)) AS min_score, r6(avg(c)) AS mean_score
    FROM c GROUP BY 1""",
)
def frame_similarity(spark, sf):
    features = S.frame_features(spark, sf)
    samples = features.select(
        "session_id", F.lit(0).alias("whole"), F.col("frame_idx").alias("sample"), "frame_idx"
    )
    out = segments.adjacent_similarity(samples, features, ["session_id"], "whole")
    return out.select("session_id", "n_readable", r6("min_score"), r6("mean_score"))


@query(
    "sample_points",
    S.with_views("short_segments")
    + """, s AS (SELECT *, unnest(range(0, 5)) AS i FROM short_segments)
    SELECT session_id, segment, string_agg(CAST(CAST(floor(
      (CASE WHEN i = 4 THEN end_s ELSE start_s + i * ((end_s - start_s) / 4) END) * 24) AS BIGINT) AS VARCHAR), ','
      ORDER BY i) AS frames FROM s GROUP BY 1, 2""",
)
def sample_points(spark, sf):
    times = segments.sample_times(F.col("start_s"), F.col("end_s"), F.lit(5))
    at = F.transform(times, lambda t: timecode.frame_index(t, 24.0).cast("string"))
    return S.short_segments(spark, sf).select("session_id", "segment", F.array_join(at, ",").alias("frames"))


@query(
    "framed_segments",
    S.with_views("short_segments")
    + """, f AS (SELECT session_id, segment, CAST(floor(start_s * 24) AS BIGINT) AS start_frame,
      least(CAST(floor(end_s * 24) AS BIGINT), 50) AS end_frame FROM short_segments)
    SELECT * FROM f WHERE start_frame < 50 AND start_frame < end_frame""",
)
def framed_segments(spark, sf):
    out = segments.valid_frame_range(S.short_segments(spark, sf), 24.0, F.lit(50).cast("long"))
    return out.select("session_id", "segment", "start_frame", "end_frame")


@query(
    "long_segments",
    S.with_views("gaze")
    + """, s AS (SELECT session_id, CAST(frame_idx // 6 AS BIGINT) AS segment, min(time_seconds) AS a,
      max(time_seconds) AS b FROM gaze GROUP BY 1, 2)
    SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY a, b) - 1 AS fixation_id,
    r6(a) AS start_s, r6(b - a) AS duration FROM s WHERE b - a >= 0.2 AND segment % 5 <> 1""",
)
def long_segments(spark, sf):
    segment = F.floor(F.col("frame_idx") / 6).cast("long")
    raw = S.gaze(spark, sf).groupBy("session_id", segment.alias("segment")).agg(
        F.min("time_seconds").alias("start_time"), F.max("time_seconds").alias("end_time")
    )
    raw = raw.withColumn("start_time", F.when(F.col("segment") % 5 != 1, F.col("start_time")))
    named = raw.withColumn("start_s", F.col("start_time")).withColumn("end_s", F.col("end_time"))
    kept = segments.min_duration(segments.require_valid_interval(named), 0.2).drop("start_s", "end_s")
    out = segments.normalize_columns(
        kept, ["session_id"], {"start_s": "start_time", "end_s": "end_time"}, chunk_seconds=600.0
    )
    return out.select("session_id", "fixation_id", r6("start_s"), r6("duration"))


@query(
    "context_alert",
    S.with_views("gaze_clock")
    + """, q AS (SELECT session_id, event_id * 5 + i AS point_id, t + (i - 2) * 36000 AS t FROM (SELECT session_id, event_id, t,
      unnest(range(0, 5)) AS i FROM gaze_clock WHERE event_type = 'error'))
    SELECT q.session_id, q.point_id, count(g.event_id) AS n_visible, r4(coalesce(sum(g.value), 0)) AS sum_visible
    FROM q LEFT JOIN gaze_clock g ON g.session_id = q.session_id AND g.t >= 0 AND g.t <= q.t GROUP BY 1, 2""",
)
def context_alert(spark, sf):
    clock = S.gaze_clock(spark, sf).select("session_id", "event_id", "event_type", "t", "value")
    asked = clock.where(F.col("event_type") == "error").select(
        "session_id", "event_id", F.posexplode(intervals.alert_points(F.col("t"), F.lit(0.0), _HOURS, 1e18)).alias("i", "t")
    )
    points = asked.select("session_id", (F.col("event_id") * 5 + F.col("i")).alias("point_id"), "t")
    out = joins.window_totals(points, clock, ["session_id"], "point_id", F.lit(0.0), F.col("t"), "value", chunk=60.0)
    return out.select("session_id", "point_id", "n_visible", r4("sum_visible"))


_HOURS = (-72_000, -36_000, 0, 36_000, 72_000)

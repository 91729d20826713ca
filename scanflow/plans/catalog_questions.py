"""Registered question builders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanflow.functions import text
from scanflow.operators import timeline
from scanflow.plans import questions as Q
from scanflow.plans import sqltext as T
from scanflow.plans import standins as S
from scanflow.plans.catalog import ORACLES, query
from scanflow.session import cut

ID = ["session_id", "pos"]


def merged_entries(spark, sf, seen: DataFrame | None = None) -> DataFrame:
    """Stand-in timeline of objects and actions, positioned; ``seen`` is the timeline of objects where it is made already.

    A builder reads its entries several times, so they are a stage of their own: written
    once to the shared folder and read back.
    """
    both = timeline.timeline_merge(S.timeline(spark, sf) if seen is None else seen, S.order_actions(spark, sf))
    return cut(timeline.with_position(both, chunk=S.DAY))


def positioned_episodes(spark, sf, seen: DataFrame | None = None) -> DataFrame:
    return cut(timeline.with_position(S.episodes(spark, sf, seen), chunk=S.DAY))


POS_EPISODES = """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_s, end_s) - 1 AS pos FROM episodes"""


def joined(df: DataFrame, *arrays: str, sep: str = " / ") -> DataFrame:
    """Arrays as text, so both engines compare plain strings."""
    for name in arrays:
        df = df.withColumn(name, F.array_join(name, sep))
    return df


def _text(sql: str, sep: str = " / ") -> str:
    return f"array_to_string({sql}, '{sep}')"


_MIX = "mixed"


def _finish(cols: str, source: str, truth: str = "truth") -> str:
    return f"""SELECT {cols}, {T.answer(_MIX, truth)} AS answer, {_text(T.options(_MIX))} AS options FROM {source}"""


ALL_NAMES = "SELECT session_id, unnest(list_concat(fov, outside)) AS object FROM merged WHERE kind = 'objects'"

NEXT_GROUP_CTES = {
    "nx": """SELECT *, lead(kind) OVER w AS nkind, lead(fov) OVER w AS nfov, lead(start_s) OVER w AS next_s,
        lead(end_s) OVER w AS next_end_s FROM merged_pos WINDOW w AS (PARTITION BY session_id ORDER BY pos)""",
    "cand": """SELECT session_id, pos, fov, start_s, end_s, next_s, next_end_s,
        list_filter(nfov, lambda x: NOT list_contains(fov, x))[1] AS truth
        FROM nx WHERE kind = 'objects' AND nkind = 'objects' AND len(fov) > 0""",
    "items": "SELECT * FROM cand WHERE truth IS NOT NULL",
    "names": ALL_NAMES,
    "pool": T.pool("names", "next"),
    "dr": T.drawn("items", "pool", 3, "next", "list_append(i.fov, i.truth)", ID),
    "mx": f"""SELECT *, {T.md5_order("list_concat([truth], drawn)", "next-mix", "session_id", "pos")} AS mixed
        FROM dr WHERE len(drawn) = 3""",
}


@query(
    "ask_next_after_group",
    S.with_views("merged_pos", **NEXT_GROUP_CTES)
    + _finish(
        f"""session_id, pos, {T.range_text('greatest(start_s - 2, 0)', 'next_end_s + 2')} AS response_time,
        'What object does the user gaze at next after looking at the {{' || array_to_string(fov, ', ') || '}}?' AS question,
        {T.mmss('next_s')} AS time_stamp, truth AS answer_object""",
        "mx",
    ),
)
def ask_next_after_group(spark, sf):
    out = joined(Q.next_after_group(merged_entries(spark, sf)), "options")
    return out.select(*ID, "response_time", "question", "time_stamp", "answer_object", "answer", "options")


NEVER_CTES = {
    "flat": """SELECT session_id, start_s, end_s, unnest(fov) AS object, true AS seen FROM merged_pos WHERE kind = 'objects'
        UNION ALL SELECT session_id, start_s, end_s, unnest(outside), false FROM merged_pos WHERE kind = 'objects'""",
    "summ": """SELECT session_id, object, bool_or(seen) AS gazed, min(start_s) FILTER (WHERE seen) AS first_gaze,
        max(end_s) FILTER (WHERE seen) AS last_gaze_end FROM flat GROUP BY 1, 2""",
    "never": "SELECT session_id, object FROM summ WHERE NOT gazed",
    "pool": T.pool("never", "never"),
    "gord": """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_gaze, object) - 1 AS "rank"
        FROM summ WHERE gazed""",
    "cnt": """SELECT e.session_id, e.pos, e.start_s, count(s.object) AS m FROM merged_pos e JOIN summ s
        ON s.session_id = e.session_id AND s.gazed AND s.first_gaze <= e.start_s WHERE e.kind = 'objects' AND e.pos >= 2
        GROUP BY 1, 2, 3""",
    "ready": """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS nr FROM cnt
        WHERE m >= 3 AND session_id IN (SELECT session_id FROM pool)""",
    "items": "SELECT session_id, pos, start_s, m FROM ready WHERE nr <= 3",
    "dr": T.drawn("items", "pool", 1, "never", "[]::VARCHAR[]", ID),
}
_G = T.draw_ranks("m", 3, "gazed", "session_id", "pos")
NEVER_CTES |= {
    "rk": " UNION ALL ".join(
        f'SELECT session_id, pos, {i} AS i, {r} AS "rank" FROM dr' for i, r in enumerate(_G)
    ),
    "wr": """SELECT rk.session_id, rk.pos, list(g.object ORDER BY rk.i) AS wrong, min(first_gaze) AS from_s,
        max(last_gaze_end) AS to_s FROM rk JOIN gord g ON g.session_id = rk.session_id AND g."rank" = rk."rank"
        GROUP BY 1, 2""",
    "mx": f"""SELECT dr.*, dr.drawn[1] AS truth, from_s, to_s,
        {T.md5_order("list_concat([dr.drawn[1]], wrong)", "never-mix", "dr.session_id", "dr.pos")} AS mixed
        FROM dr JOIN wr USING (session_id, pos)""",
}


@query(
    "ask_never_gazed",
    S.with_views("merged_pos", **NEVER_CTES)
    + _finish(
        f"""session_id, pos, {T.range_text('greatest(from_s - 2, 0)', 'to_s + 2')} AS response_time,
        'Among {{' || array_to_string(mixed, ', ') || '}}, which did the user never gaze at?' AS question,
        {T.mmss('start_s')} AS time_stamp, truth AS answer_object""",
        "mx",
    ),
)
def ask_never_gazed(spark, sf):
    out = joined(Q.never_gazed(merged_entries(spark, sf), chunk=S.DAY), "options")
    return out.select(*ID, "response_time", "question", "time_stamp", "answer_object", "answer", "options")


def _transition_ctes() -> dict[str, str]:
    fakes = []
    for g in range(6):
        for j, r in enumerate(T.draw_ranks("n", 2, f"fake{g}-", "session_id", "draw")):
            fakes.append(f'SELECT session_id, draw, {g} AS g, {j} AS j, {r} AS "rank" FROM sized')
    grp = [
        f"'{{' || string_agg(p.object, ',' ORDER BY f.j) FILTER (WHERE g = {g}) || '}}'" for g in range(6)
    ]
    seq = "array_to_string(list_transform({0}, lambda g: '{{' || array_to_string(g, ',') || '}}'), '>')"
    return {
        "tr": """SELECT session_id, pos, start_s, [fov, f1, f2] AS groups, stop_s FROM (
            SELECT *, lead(kind) OVER w AS k1, lead(kind, 2) OVER w AS k2, lead(fov) OVER w AS f1,
            lead(fov, 2) OVER w AS f2, lead(start_s, 2) OVER w AS stop_s FROM merged_pos
            WINDOW w AS (PARTITION BY session_id ORDER BY pos))
            WHERE kind = 'objects' AND k1 = 'objects' AND k2 = 'objects' AND len(fov) > 0 AND len(f1) > 0 AND len(f2) > 0""",
        "sz": "SELECT session_id, count(*) AS n_entries FROM merged_pos GROUP BY 1",
        "st": f"""SELECT session_id, draw, {T.hash60('transition', 'session_id', 'draw')} % (n_entries - 2) AS pos
            FROM (SELECT *, unnest(range(0, 5)) AS draw FROM sz WHERE n_entries >= 3)""",
        "items": "SELECT st.session_id, draw, pos, groups, start_s, stop_s FROM st JOIN tr USING (session_id, pos)",
        "names": "SELECT session_id, unnest(fov) AS object FROM merged_pos",
        "pool": T.pool("names", "transition"),
        "sized": """SELECT items.*, n FROM items JOIN (SELECT session_id, max(n_pool) AS n FROM pool GROUP BY 1)
            USING (session_id)""",
        "fk": " UNION ALL ".join(fakes),
        "wr": f"""SELECT f.session_id, f.draw, concat_ws('>', {grp[0]}, {grp[1]}, {grp[2]}) AS w1,
            concat_ws('>', {grp[3]}, {grp[4]}, {grp[5]}) AS w2 FROM fk f JOIN pool p
            ON p.session_id = f.session_id AND p."rank" = f."rank" GROUP BY 1, 2""",
        "sh": f"""SELECT items.*, w1, w2, list_transform([[1,2,3],[1,3,2],[2,1,3],[2,3,1],[3,1,2],[3,2,1]][
            CAST({T.hash60('order', 'items.session_id', 'items.draw')} % 6 + 1 AS INTEGER)], lambda i: groups[i]) AS shuffled
            FROM items JOIN wr USING (session_id, draw)""",
        "tx": f"SELECT *, {seq.format('groups')} AS truth, {seq.format('shuffled')} AS w0 FROM sh",
        "mx": f"""SELECT *, {T.md5_order('[truth, w0, w1, w2]', 'transition-mix', 'session_id', 'draw')} AS mixed FROM tx
            WHERE shuffled <> groups AND w1 <> truth AND w2 <> truth AND w1 <> w0 AND w2 <> w0 AND w2 <> w1""",
    }


TRANSITION_CTES = _transition_ctes()


@query(
    "ask_transition_pattern",
    S.with_views("merged_pos", **TRANSITION_CTES)
    + _finish(
        f"session_id, pos, draw, {T.range_text('start_s', 'stop_s')} AS response_time, {T.mmss('stop_s')} AS time_stamp",
        "mx",
    ),
)
def ask_transition_pattern(spark, sf):
    out = joined(Q.transition_pattern(merged_entries(spark, sf)), "options")
    return out.select(*ID, F.col("draw").cast("long").alias("draw"), "response_time", "time_stamp", "answer", "options")


RECALL_CTES = {
    "names": "SELECT session_id, unnest(outside) AS object FROM merged_pos",
    "pool": T.pool("names", "recall"),
    "ready": """SELECT e.*, row_number() OVER (PARTITION BY e.session_id ORDER BY pos) AS nr FROM merged_pos e
        JOIN (SELECT session_id, max(n_pool) AS n FROM pool GROUP BY 1) s USING (session_id)
        WHERE kind = 'objects' AND len(fov) > 0 AND len(outside) >= 3 AND n >= 4 AND n > len(outside)""",
    "items": "SELECT session_id, pos, fov, outside, start_s FROM ready WHERE nr <= 3",
    "dr": T.drawn("items", "pool", 1, "recall", "i.outside", ID),
    "tx": f"""SELECT *, drawn[1] AS truth,
        {T.md5_order('outside', 'visible', 'session_id', 'pos')}[1:3] AS wrong FROM dr""",
    "mx": f"SELECT *, {T.md5_order('list_concat([truth], wrong)', 'recall-mix', 'session_id', 'pos')} AS mixed FROM tx",
}


@query(
    "ask_scene_recall",
    S.with_views("merged_pos", **RECALL_CTES)
    + _finish(
        f"""session_id, pos, {T.range_text('greatest(start_s - 5, 0)', 'start_s + 5')} AS response_time,
        'When the user was gazing at the {{' || array_to_string(fov, ', ')
          || '}}, which background object was NOT visible?' AS question,
        {T.mmss('start_s')} AS time_stamp, truth AS answer_object, array_to_string(outside, ' / ') AS background_objects""",
        "mx",
    ),
)
def ask_scene_recall(spark, sf):
    out = joined(Q.scene_recall(merged_entries(spark, sf)), "options", "background_objects")
    return out.select(
        *ID, "response_time", "question", "time_stamp", "answer_object", "background_objects", "answer", "options"
    )


_FALLBACK = "[" + ", ".join(f"'{w}'" for w in text.FALLBACK_OBJECTS) + "]"
EASY_CTES = {
    "pe": POS_EPISODES,
    "ff": """SELECT session_id, lower(trim(object)) AS object, false AS near FROM pe
        UNION ALL SELECT session_id, lower(trim(unnest(cropped))), true FROM pe
        UNION ALL SELECT session_id, lower(trim(unnest(outside))), false FROM pe""",
    "usable": "SELECT session_id, object FROM ff GROUP BY 1, 2 HAVING NOT bool_or(near)",
    "pool": T.pool("usable", "identify"),
    "dr": T.drawn("pe", "pool", 3, "identify", "[lower(i.object)]", ID, keep=True),
    "sp": f"""SELECT *, list_filter({_FALLBACK}, lambda w: w <> lower(object) AND NOT list_contains(drawn, w)) AS spare
        FROM dr""",
    "wr": f"""SELECT *, list_concat(drawn, {T.md5_order('spare', 'fallback', 'session_id', 'pos')})[1:3] AS wrong FROM sp""",
    "mx": f"""SELECT *, {T.md5_order('list_concat([object], wrong)', 'identify-mix', 'session_id', 'pos')} AS mixed
        FROM wr""",
}
_IDENT = f"""session_id, pos, '[' || {T.clock_short('start_s')} || ' - ' || {T.clock_short('end_s')} || ']' AS response_time,
    {T.clock_short('start_s')} AS time_stamp, object"""


@query("ask_identify_easy", S.with_views("episodes", **EASY_CTES) + _finish(_IDENT, "mx", "object"))
def ask_identify_easy(spark, sf):
    out = joined(Q.identify_easy(positioned_episodes(spark, sf)), "options")
    return out.select(*ID, "response_time", "time_stamp", "object", "answer", "options")


HARD_CTES = {
    "pe": POS_EPISODES,
    "ot": """SELECT *, list_filter(outside, lambda o: lower(o) <> lower(object)) AS others FROM pe""",
    "mx": f"""SELECT *, {T.md5_order(
        "list_concat([object], " + T.md5_order('others', 'hard', 'session_id', 'pos') + "[1:3])",
        'hard-mix', 'session_id', 'pos')} AS mixed FROM ot WHERE len(others) >= 3""",
}


@query("ask_identify_hard", S.with_views("episodes", **HARD_CTES) + _finish(_IDENT, "mx", "object"))
def ask_identify_hard(spark, sf):
    out = joined(Q.identify_hard(positioned_episodes(spark, sf)), "options")
    return out.select(*ID, "response_time", "time_stamp", "object", "answer", "options")


def annotated_parts(spark, sf) -> DataFrame:
    """Parts as annotator output; some rows are incomplete."""
    color = F.substring_index("p_name", " ", 1)
    pool = F.array(*[F.lit(c) for c in ("red", "pink", "blue", "dark blue", "green")])
    kind = F.when(F.col("p_size") % 5 == 0, "usage").when(F.col("p_size") % 7 == 0, "").otherwise(" Color ")
    return S.table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_name").alias("object"),
        F.col("p_size").cast("double").alias("start_s"),
        (F.col("p_size") * 90.5).alias("end_s"),
        kind.alias("attribute_type"),
        F.lit("What color is it? ").alias("question"),
        F.when(F.col("p_partkey") % 11 != 0, color).otherwise("").alias("answer"),
        F.slice(F.filter(pool, lambda c: c != color), 1, 3).alias("distractors"),
    )


_PARTS = """SELECT p_partkey, p_name AS object, CAST(p_size AS DOUBLE) AS start_s, p_size * 90.5::DOUBLE AS end_s,
    CASE WHEN p_size % 5 = 0 THEN 'usage' WHEN p_size % 7 = 0 THEN '' ELSE 'color' END AS attribute_type,
    CASE WHEN p_partkey % 11 <> 0 THEN split_part(p_name, ' ', 1) ELSE '' END AS truth,
    list_filter(['red', 'pink', 'blue', 'dark blue', 'green'], lambda c: c <> split_part(p_name, ' ', 1))[1:3]
      AS distractors FROM part"""
ATTRIBUTE_CTES = {
    "ann": _PARTS,
    "mx": f"""SELECT *, {T.md5_order('list_concat([truth], distractors)', 'attribute', 'p_partkey')} AS mixed FROM ann
        WHERE attribute_type <> '' AND truth <> ''""",
}


@query(
    "ask_attribute",
    S.with_views(**ATTRIBUTE_CTES)
    + _finish(
        f"""p_partkey, '[' || {T.clock_short('start_s')} || ' - ' || {T.clock_short('end_s')} || ']' AS response_time,
        'What color is it?' AS question, attribute_type, object AS object_name""",
        "mx",
    ),
)
def ask_attribute(spark, sf):
    out = joined(Q.attribute_questions(annotated_parts(spark, sf), "p_partkey"), "options")
    return out.select("p_partkey", "response_time", "question", "attribute_type", "object_name", "answer", "options")


ACTION_CTES = {
    "acts": "SELECT * FROM merged_pos WHERE kind = 'action'",
    "names": "SELECT session_id, action AS object FROM acts",
    "pool": T.pool("names", "action"),
    "ok": """SELECT session_id FROM acts GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT action) >= 4""",
    "lk": """SELECT *, list(fov) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l3
        FROM merged_pos""",
    "ct": """SELECT *, list_filter(flatten(l3), lambda x, i: list_position(flatten(l3), x) = i) AS context FROM lk
        WHERE kind = 'objects' AND session_id IN (SELECT session_id FROM ok)""",
    "nx": """SELECT c.session_id, c.pos, c.end_s, c.context, arg_min(a.action, a.pos) AS truth, min(a.start_s) AS action_s
        FROM ct c JOIN acts a ON a.session_id = c.session_id AND a.start_s >= c.end_s + 2 AND a.start_s <= c.end_s + 120
        WHERE len(c.context) > 0 GROUP BY 1, 2, 3, 4""",
    "rc": "SELECT *, context[greatest(len(context) - 2, 1):] AS recent FROM nx",
    "fs": """SELECT *, row_number() OVER (PARTITION BY session_id, array_to_string(recent, ' → ') ORDER BY pos) AS nr
        FROM rc""",
    "items": "SELECT session_id, pos, end_s, truth, action_s, recent FROM fs WHERE nr = 1",
    "dr": T.drawn("items", "pool", 3, "action", "[i.truth]", ID),
    "bd": "SELECT session_id, min(start_s) AS first_s, max(end_s) AS last_s FROM merged_pos GROUP BY 1",
    "mx": f"""SELECT dr.*, first_s, last_s,
        {T.md5_order('list_concat([truth], drawn)', 'action-mix', 'session_id', 'pos')} AS mixed
        FROM dr JOIN bd USING (session_id) WHERE len(drawn) = 3""",
}


@query(
    "ask_next_action",
    S.with_views("merged_pos", **ACTION_CTES)
    + _finish(
        f"""session_id, pos, {T.range_text('first_s', 'last_s')} AS response_time,
        'Based on the recent fixation pattern (' || array_to_string(recent, ' → ')
          || '), what action will the user do next?' AS question,
        {T.mmss('end_s')} AS time_stamp, truth AS answer_action, {T.mmss('action_s')} AS actual_action_time""",
        "mx",
    ),
)
def ask_next_action(spark, sf):
    out = joined(Q.next_action(merged_entries(spark, sf), chunk=S.DAY), "options")
    return out.select(
        *ID, "response_time", "question", "time_stamp", "answer_action", "actual_action_time", "answer", "options"
    )


def kitchen_entries(spark, sf, seen: DataFrame | None = None) -> DataFrame:
    """Timeline with some names turned into fixtures, so the fixture rule has something to drop."""
    base = S.timeline(spark, sf) if seen is None else seen

    def renamed(col):
        return F.transform(col, lambda o: F.regexp_replace(o, "anvil", "cabinet"))

    return base.select(
        "session_id", "start_s", "end_s", renamed("fov").alias("fov"), renamed("outside").alias("outside")
    )


_KIT = """SELECT session_id, start_s, end_s, replace(unnest(fov), 'anvil', 'cabinet') AS object, true AS seen FROM timeline
    UNION ALL SELECT session_id, start_s, end_s, replace(unnest(outside), 'anvil', 'cabinet'), false FROM timeline"""
ALERT_CTES = {
    "kit": _KIT,
    "sp": """SELECT session_id, seen, object, min(start_s) AS first_s FROM kit WHERE object NOT LIKE '%cabinet%'
        GROUP BY 1, 2, 3""",
    "target": f"""SELECT session_id, arg_min(object, {T.digest('alert', 'session_id', 'object')}) AS object,
        arg_min(first_s, {T.digest('alert', 'session_id', 'object')}) AS first_s FROM sp WHERE seen GROUP BY 1""",
    "q0": "SELECT session_id, min(start_s) AS question_s FROM kit GROUP BY 1",
}


def _alert_sql(targets: str, seen: str, wording: str) -> str:
    extra = dict(ALERT_CTES)
    extra["tg"] = targets
    extra["pt"] = """SELECT tg.session_id, object, first_s, question_s, o, first_s + o AS p FROM tg JOIN q0 USING (session_id)
        CROSS JOIN (SELECT unnest([-20.0, -10.0, 0.0, 10.0, 20.0]::DOUBLE[]) AS o)
        WHERE first_s + o >= question_s AND first_s + o <= question_s + 300"""
    extra["lb"] = f"""SELECT pt.session_id, pt.object, first_s, question_s, o, p, max(CASE WHEN k.start_s <= p AND p <= k.end_s
        THEN 1 ELSE 0 END) AS type FROM pt JOIN kit k ON k.session_id = pt.session_id AND k.object = pt.object
        AND k.seen = {seen} GROUP BY 1, 2, 3, 4, 5, 6"""
    return (
        S.with_views("timeline", **extra)
        + f"""SELECT session_id, object AS target_object,
        '[' || {T.mmss('any_value(question_s)')} || ' - ' || {T.mmss('max(p)')} || ']' AS response_time,
        {wording} AS question, {T.mmss('any_value(question_s)')} AS time_stamp,
        {T.mmss('any_value(first_s)')} AS first_appearance,
        string_agg({T.mmss('p')} || '=' || CAST(type AS VARCHAR), ' ' ORDER BY o) AS tests FROM lb GROUP BY 1, 2"""
    )


def _alert_columns(df: DataFrame) -> DataFrame:
    tests = F.transform("test_info", lambda t: F.concat(t["realtime"], F.lit("="), t["type"].cast("string")))
    return df.select(
        "session_id", "target_object", "response_time", "question", "time_stamp", "first_appearance",
        F.array_join(tests, " ").alias("tests"),
    )


@query(
    "ask_alert_gaze",
    _alert_sql(
        "SELECT * FROM target", "true", "'Monitor my gaze and alert me when I gaze on the <' || object || '>.'"
    ),
)
def ask_alert_gaze(spark, sf, seen: DataFrame | None = None):
    return _alert_columns(Q.alert_gaze(kitchen_entries(spark, sf, seen)))


_HARD_TARGETS = """SELECT session_id, object, first_s FROM sp WHERE NOT seen
    AND (session_id, object) NOT IN (SELECT (session_id, object) FROM target)"""


@query(
    "ask_alert_appear",
    _alert_sql(
        _HARD_TARGETS, "false", "'Watch the scene and alert me when the <' || object || '> first appears.'"
    ),
)
def ask_alert_appear(spark, sf):
    return _alert_columns(Q.alert_appear(kitchen_entries(spark, sf)))


def _gap_merge_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_merged FROM (
        SELECT *, sum(CASE WHEN reach IS NULL OR start_s - reach > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}
          ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS g FROM (
          SELECT *, max(end_s) OVER (PARTITION BY {keys} ORDER BY start_s, end_s
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source})) GROUP BY {keys}, g"""


@query(
    "alert_intervals",
    S.with_views(
        "timeline",
        **ALERT_CTES,
        ap="""SELECT k.session_id, k.object, k.start_s, k.end_s FROM kit k JOIN target t
          ON t.session_id = k.session_id AND t.object = k.object WHERE k.seen""",
    )
    + _gap_merge_sql("ap", "session_id, object"),
)
def alert_intervals(spark, sf):
    entries = cut(kitchen_entries(spark, sf))
    return Q.alert_intervals(entries, Q.alert_target(entries), "fov", chunk=S.DAY)


@query(
    "ask_next_action_natural",
    S.with_views(
        "merged_pos",
        told="SELECT * REPLACE ('The user will ' || action AS action) FROM merged_pos",
        **{k: v.replace("merged_pos", "told") for k, v in ACTION_CTES.items()},
    )
    + _finish("session_id, pos, truth AS answer_action", "mx"),
)
def ask_next_action_natural(spark, sf):
    made = Q.next_action(merged_entries(spark, sf), natural=lambda s: s.map(lambda a: a and f"The user will {a}"), chunk=S.DAY)
    return joined(made, "options").select(*ID, "answer_action", "answer", "options")


@query(
    "ask_alert_with_intervals",
    "SELECT session_id, object AS target_object, string_agg(printf('%02d:%02d-%02d:%02d', CAST(floor(start_s / 60) AS BIGINT), "
    "CAST(floor(start_s % 60) AS BIGINT), CAST(floor(end_s / 60) AS BIGINT), CAST(floor(end_s % 60) AS BIGINT)), ' ' "
    "ORDER BY start_s) AS spans FROM (" + ORACLES["alert_intervals"] + ") GROUP BY 1, 2",
)
def ask_alert_with_intervals(spark, sf):
    entries = cut(kitchen_entries(spark, sf))
    asked = Q.alert_target(entries).select("session_id", F.col("object").alias("target_object"))
    told = Q.with_intervals(asked, entries, "fov", chunk=S.DAY)
    each = F.transform("fixation_intervals", lambda s: F.concat(s["start"], F.lit("-"), s["end"]))
    return told.select("session_id", "target_object", F.array_join(each, " ").alias("spans"))

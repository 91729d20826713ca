"""Registered question filters, over the questions that the builders make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanflow.functions import text
from scanflow.plans import filters as G
from scanflow.plans import questions as Q
from scanflow.plans import sqltext as T
from scanflow.plans import standins as S
from scanflow.plans.catalog import ORACLES, QUERIES, query
from scanflow.session import cut
from scanflow.plans.catalog_questions import (
    ACTION_CTES,
    ALERT_CTES,
    EASY_CTES,
    NEXT_GROUP_CTES,
    RECALL_CTES,
    TRANSITION_CTES,
    _HARD_TARGETS,
    annotated_parts,
    kitchen_entries,
    merged_entries,
    positioned_episodes,
)

ID = ["session_id", "pos"]


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_HUMAN = "|".join(text.HUMAN_WORDS)
_GENERIC = "|".join(text.GENERIC_WORDS)

ACTION_RULES = {
    **ACTION_CTES,
    "gp": "SELECT *, CAST(floor(action_s) AS BIGINT) - CAST(floor(end_s) AS BIGINT) AS gap FROM mx",
    "fl": f"""SELECT *, CASE WHEN gap <= 3 THEN 'gap_too_short' WHEN gap > 60 THEN 'gap_too_long'
        WHEN len(list_filter(recent, lambda o: NOT regexp_matches(lower(o), '{_GENERIC}'))) = 0 THEN 'generic_context'
        WHEN len(list_filter(flatten(list_transform(recent, lambda o: string_split(lower(o), ' '))),
          lambda w: len(w) > 3 AND contains(truth, w))) > 0 THEN 'context_in_answer' END AS reason FROM gp""",
}


def action_items(spark, sf) -> DataFrame:
    return Q.next_action(merged_entries(spark, sf), chunk=S.DAY)


@query(
    "filter_next_action",
    S.with_views("merged_pos", **ACTION_RULES)
    + f"""SELECT session_id, pos, reason, {T.range_text('floor(end_s)', 'floor(action_s) + 5')} AS response_time,
    false AS needs_polish FROM fl""",
)
def filter_next_action(spark, sf):
    return G.next_action(action_items(spark, sf)).select(*ID, "reason", "response_time", "needs_polish")


@query(
    "filter_next_action_counts",
    S.with_views("merged_pos", **ACTION_RULES)
    + "SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n FROM fl GROUP BY 1",
)
def filter_next_action_counts(spark, sf):
    return G.drop_counts(G.next_action(action_items(spark, sf)))


_AMBIGUOUS = _list(text.AMBIGUOUS_WORDS + [w + "s" for w in text.AMBIGUOUS_WORDS])


@query(
    "filter_alert_appear",
    S.with_views("timeline", **ALERT_CTES, tg=_HARD_TARGETS)
    + f""", n AS (SELECT session_id, object, CASE WHEN object LIKE '%rod' THEN 'Tools' WHEN object LIKE '%ring' THEN 'Box'
      ELSE object END AS target_object FROM tg JOIN q0 USING (session_id)
      WHERE len(list_filter([-20.0, -10.0, 0.0, 10.0, 20.0]::DOUBLE[], lambda o: first_s + o >= question_s
        AND first_s + o <= question_s + 300)) > 0)
    SELECT session_id, target_object, count(*) AS n, CASE WHEN list_contains({_AMBIGUOUS}, lower(target_object))
    THEN 'ambiguous_object' END AS reason FROM n GROUP BY 1, 2""",
)
def filter_alert_appear(spark, sf):
    name = F.col("target_object")
    made = Q.alert_appear(kitchen_entries(spark, sf)).withColumn(
        "target_object", F.when(name.endswith("rod"), "Tools").when(name.endswith("ring"), "Box").otherwise(name)
    )
    out = G.alert_appear(made)
    return out.groupBy("session_id", "target_object", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_alert_gaze",
    S.with_views(
        "timeline",
        **ALERT_CTES,
        pt="""SELECT t.session_id, object, o, first_s + o AS p, row_number() OVER (PARTITION BY t.session_id ORDER BY o) - 1
          AS point FROM target t JOIN q0 USING (session_id)
          CROSS JOIN (SELECT unnest([-20.0, -10.0, 0.0, 10.0, 20.0]::DOUBLE[]) AS o)
          WHERE first_s + o >= question_s AND first_s + o <= question_s + 300""",
        lb="""SELECT pt.session_id, point, max(CASE WHEN k.start_s <= p AND p <= k.end_s THEN 1 ELSE 0 END) AS type FROM pt
          JOIN kit k ON k.session_id = pt.session_id AND k.object = pt.object AND k.seen GROUP BY 1, 2""",
        vd="SELECT *, CASE (session_id + point) % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 END AS v FROM lb",
    )
    + """SELECT session_id, string_agg(CAST(CASE WHEN type = 0 AND v = 1 THEN 1 ELSE type END AS VARCHAR), ','
      ORDER BY point) AS types, count(*) FILTER (WHERE type = 0 AND v = 1) AS n_changed,
    count(*) FILTER (WHERE type = 0 AND (v IS NULL OR v < 0)) AS n_skipped FROM vd GROUP BY 1""",
)
def filter_alert_gaze(spark, sf):
    items = Q.alert_gaze(kitchen_entries(spark, sf))
    points = items.select("session_id", F.posexplode("test_info").alias("point", "t"))
    turn = (F.col("session_id") + F.col("point")) % 4
    verdicts = points.where(turn < 3).select(
        "session_id", "point", F.when(turn == 0, 1).when(turn == 1, 0).otherwise(-1).alias("verdict")
    )
    out = G.alert_gaze(items, verdicts, ["session_id"])
    types = F.transform("test_info", lambda t: t["type"].cast("string"))
    return out.select("session_id", F.array_join(types, ",").alias("types"), "n_changed", "n_skipped")


_SWAP = [
    ("gizmo", "Cup"), ("gear", "cups"), ("rod", "Left_Hand"), ("ring", "onion"), ("bolt", "Onions"),
    ("(red|hot|cold) widget", "Tomato"), ("widget", "counter"), ("anvil", "Countertop"), ("plate", "tomatoes"),
]


def _swapped(col):
    for word, name in _SWAP:
        col = F.regexp_replace(col, f"{'' if word[0] == '(' else '[a-z]+ '}{word}$", name)
    return col


def _swap_sql(x: str) -> str:
    for word, name in _SWAP:
        first = "" if word[0] == "(" else "[a-z]+ "
        x = f"regexp_replace({x}, '{first}{word}$', '{name.lower().replace('_', ' ')}')"
    return x


# Fixed values, written out a second time so that the twin does not follow the code.
_PLURALS = _list("countertop tomatoes onions peppers knives plates bowls spoons forks cups".split())
_SINGULARS = _list("counter tomato onion pepper knife plate bowl spoon fork cup".split())
IDENTIFY_RULES = {
    **EASY_CTES,
    "tx": f"""SELECT session_id, pos, {_swap_sql('object')} AS object, list_position(mixed, object) AS at_,
        list_transform(mixed, lambda o: {_swap_sql('o')}) AS texts FROM mx""",
    "ex": f"""SELECT *, list_filter(texts, lambda v: list_contains({_PLURALS}, v)
        AND list_contains(texts, {_SINGULARS}[list_position({_PLURALS}, v)])) AS extra FROM tx""",
    "lf": """SELECT *, list_filter(texts, lambda v: NOT list_contains(extra, v)) AS kept FROM ex""",
    "fl": f"""SELECT *, CASE WHEN regexp_matches(object, '{_HUMAN}') THEN 'human_object' WHEN len(extra) > 0
        AND (len(kept) < 4 OR list_contains(extra, texts[at_])) THEN 'similar_options' END AS reason FROM lf""",
}


@query(
    "filter_identify",
    S.with_views("episodes", **IDENTIFY_RULES)
    + f"""SELECT session_id, pos, object, reason, array_to_string({T.options('texts')}, ' / ') AS options,
    chr(CAST(64 + at_ AS INTEGER)) AS answer FROM fl""",
)
def filter_identify(spark, sf):
    made = Q.identify_easy(positioned_episodes(spark, sf))
    dressed = made.withColumn("object", _swapped(F.col("object"))).withColumn(
        "options", F.transform("options", _swapped)
    )
    out = G.identify(dressed)
    return out.select(*ID, "object", "reason", F.array_join("options", " / ").alias("options"), "answer")


_SHORT = "regexp_replace({0}, '(hot|cold) ', '')"
_NW = "list_filter(list_distinct(string_split({0}, ' ')), lambda w: NOT list_contains(" + _list(text.STOP_WORDS) + ", w))"
_MODS = _list(text.MODIFIER_WORDS)
GROUP_RULES = {
    **NEXT_GROUP_CTES,
    "tx": f"""SELECT session_id, pos, {_SHORT.format('truth')} AS truth,
        list_transform(fov, lambda o: {_SHORT.format('o')}) AS grp,
        list_transform(mixed, lambda o: {_SHORT.format('o')}) AS texts FROM mx""",
    "hm": f"""SELECT *, CASE WHEN len(list_filter(texts, lambda t: regexp_matches(t, '{_HUMAN}'))) > 0 THEN 'human_object'
        END AS reason FROM tx""",
    "ij": """SELECT *, unnest([[1,2],[1,3],[1,4],[2,3],[2,4],[3,4]]) AS ij FROM hm WHERE reason IS NULL""",
    "wv": f"""SELECT *, texts[ij[1]] AS a, texts[ij[2]] AS b, {_NW.format('texts[ij[1]]')} AS wa,
        {_NW.format('texts[ij[2]]')} AS wb FROM ij""",
    "cl": f"""SELECT session_id, pos, list(ij ORDER BY ij) AS pairs FROM wv WHERE len(list_intersect(wa, wb)) > 0
        AND (a = b OR contains(a, b) OR contains(b, a) OR (
          len(list_filter(list_intersect(wa, wb), lambda w: NOT list_contains({_MODS}, w))) > 0
          AND len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) >= 0.5)) GROUP BY 1, 2""",
    "gn": """SELECT 0 AS session_id, unnest(list_concat(texts, grp, [truth])) AS object FROM tx""",
    "gp": T.pool("gn", "repair"),
    "gi": """SELECT 0 AS session_id, session_id AS sid, pos, texts, grp, truth, pairs FROM hm JOIN cl USING (session_id, pos)""",
    "gs": T.drawn("gi", "gp", "len(i.pairs)", "repair", "list_distinct(list_concat(i.texts, i.grp, [i.truth]))", ["sid", "pos"]),
    "fold": """SELECT sid, pos, truth, pairs, drawn, texts AS original, texts, 0::BIGINT AS nr, 0::BIGINT AS n_fixed FROM gs
        UNION ALL SELECT sid, pos, truth, pairs, drawn, original,
          CASE WHEN new IS NULL THEN texts ELSE list_transform(texts, lambda t, i: CASE WHEN i = at_ THEN new ELSE t END) END,
          nr + 1, n_fixed + CASE WHEN new IS NULL THEN 0 ELSE 1 END
        FROM (SELECT *, CASE WHEN truth = original[pairs[nr + 1][2]] AND truth <> original[pairs[nr + 1][1]]
            THEN pairs[nr + 1][1] ELSE pairs[nr + 1][2] END AS at_,
          list_filter(drawn, lambda s: NOT list_contains(texts, s))[1] AS new FROM fold WHERE nr < len(pairs))""",
    "done": "SELECT sid AS session_id, pos, texts, n_fixed FROM fold WHERE nr = len(pairs)",
}


def group_items(spark, sf) -> DataFrame:
    """Questions with shortened names, so that some options are too close, and underscores."""

    def shorter(col):
        return F.regexp_replace(col, "(hot|cold) ", "")

    made = Q.next_after_group(merged_entries(spark, sf))
    return cut(
        made.withColumn("answer_object", F.replace(shorter(F.col("answer_object")), F.lit(" "), F.lit("_")))
        .withColumn("options", F.transform("options", shorter))
        .withColumn("object_group", F.transform("object_group", shorter))
    )


@query(
    "filter_next_after_group",
    S.with_views("merged_pos", **GROUP_RULES)
    + f"""SELECT hm.session_id, hm.pos, reason, truth AS answer_object, coalesce(n_fixed, 0) AS n_fixed,
    array_to_string(list_transform(coalesce(done.texts, hm.texts), lambda o, i: chr(CAST(64 + i AS INTEGER)) || '. ' || o),
      ' / ') AS options FROM hm LEFT JOIN done USING (session_id, pos)""",
)
def filter_next_after_group(spark, sf):
    out = G.next_after_group(group_items(spark, sf), ID)
    return out.select(
        *ID, "reason", "answer_object", F.col("n_fixed").cast("long").alias("n_fixed"),
        F.array_join("options", " / ").alias("options"),
    )


@query(
    "filter_scene_recall",
    S.with_views("merged_pos", **RECALL_CTES)
    + """, fl AS (SELECT session_id, pos, CASE WHEN pos % 9 < 1 THEN 'short_clip' WHEN list_has_any(fov, mixed)
      THEN 'gazed_in_options' WHEN (session_id + pos) % 5 = 0 THEN 'verdict_invalid' END AS reason FROM mx)
    SELECT * FROM fl""",
)
def filter_scene_recall(spark, sf):
    made = Q.scene_recall(merged_entries(spark, sf)).withColumn(
        "clip", F.array(F.lit(0.0), F.when(F.col("pos") % 9 < 1, F.lit(4.0)).otherwise(F.lit(30.0)))
    )
    made = cut(made)  # read as questions and for the verdicts
    verdicts = made.select(*ID, F.when((F.col("session_id") + F.col("pos")) % 5 == 0, 0).otherwise(1).alias("verdict"))
    return G.scene_recall(made, verdicts, ID).select(*ID, "reason")


@query(
    "filter_transition",
    S.with_views("merged_pos", **TRANSITION_CTES)
    + """SELECT session_id, pos, draw, CASE WHEN list_sort(groups[1]) = list_sort(groups[2])
      OR list_sort(groups[2]) = list_sort(groups[3]) THEN 'identical_neighbours'
      WHEN (session_id + draw) % 5 = 0 THEN 'verdict_invalid' END AS reason FROM mx""",
)
def filter_transition(spark, sf):
    made = cut(Q.transition_pattern(merged_entries(spark, sf)))  # read as questions and for the verdicts
    key = ["session_id", "draw"]
    verdicts = made.select(*key, F.when((F.col("session_id") + F.col("draw")) % 5 == 0, 0).otherwise(1).alias("verdict"))
    out = G.transition(made, verdicts, key)
    return out.select(*ID, F.col("draw").cast("long").alias("draw"), "reason")


_PAIR_SQL = ", ".join(
    f"{{'a': '{a}', 'b': '{b}'}}" for a, b in text.CONFUSING_PAIRS["color"]
)


def _attribute_sql() -> str:
    letters = T.options("mixed")
    return f"""WITH ann AS (SELECT p_partkey, p_name, p_size, CASE WHEN p_size % 5 = 0 THEN 'usage' ELSE 'color' END AS kind,
      split_part(p_name, ' ', 1) AS truth, list_filter(['red', 'pink', 'blue', 'dark blue', 'green'],
        lambda c: c <> split_part(p_name, ' ', 1))[1:3] AS distractors FROM part WHERE p_partkey % 11 <> 0
        AND NOT (p_size % 5 <> 0 AND p_size % 7 = 0)),
    mx AS (SELECT *, {T.md5_order('list_concat([truth], distractors)', 'attribute', 'p_partkey')} AS mixed FROM ann),
    fl AS (SELECT *, CASE WHEN p_name LIKE '%ring' THEN 'human_object' WHEN kind = 'usage' THEN 'subjective_type' END
      AS reason, list_filter([{_PAIR_SQL}], lambda p: list_contains(mixed, p.a) AND list_contains(mixed, p.b)) AS pairs
      FROM mx)
    SELECT p_partkey, CASE WHEN reason IS NULL AND len(pairs) > 0 AND p_size % 3 = 0 THEN 'frames_missing' ELSE reason END
      AS reason, CASE WHEN reason IS NULL THEN len(pairs) ELSE 0 END AS n_confusing,
    array_to_string({letters.replace("'. ' || o", "'. ' || CASE WHEN reason IS NULL AND p_size % 3 = 1 AND o = 'pink' AND list_contains(mixed, 'red') THEN 'teal' ELSE o END")}, ' / ') AS options FROM fl"""


@query("filter_attribute", _attribute_sql())
def filter_attribute(spark, sf):
    parts = annotated_parts(spark, sf)
    made = Q.attribute_questions(parts, "p_partkey").withColumn(
        "object_name", F.regexp_replace(F.upper("object_name"), " RING$", "_Finger")
    )
    size = F.col("p_size")
    verdicts = S.table(spark, sf, "part").select(
        "p_partkey",
        F.lit("pink").alias("second"),
        F.when(size % 3 == 1, "teal").alias("replacement"),
        (size % 3 != 0).alias("frames_read"),
    )
    out = G.attribute(made, verdicts, ["p_partkey"])
    return out.select(
        "p_partkey", "reason", F.size("confusing").cast("long").alias("n_confusing"),
        F.array_join("options", " / ").alias("options"),
    )


@query(
    "filter_summary",
    S.with_views("merged_pos", **RECALL_CTES)
    + """, r AS (SELECT 'scene_recall.json' AS file, 'past_scene_reconstruction' AS task,
        CASE WHEN list_has_any(fov, mixed) THEN 'gazed_in_options' END AS reason FROM mx)
    SELECT file, task, coalesce(reason, 'kept') AS outcome, count(*) AS n FROM r GROUP BY 1, 2, 3""",
)
def filter_summary(spark, sf):
    made = Q.scene_recall(merged_entries(spark, sf)).withColumn("item_key", F.concat_ws("-", *ID))
    registry = {"past_scene_reconstruction": G.scene_recall}
    flat = G.run_filters({"scene_recall.json": made, "never_gazed.json": made}, registry)
    return G.drop_counts(flat, ["file", "task"])


@query(
    "drop_log",
    S.with_views("merged_pos", **RECALL_CTES)
    + "SELECT session_id, pos, 'gazed_in_options' AS reason FROM mx WHERE list_has_any(fov, mixed)",
)
def drop_log(spark, sf):
    return G.drop_log(G.scene_recall(Q.scene_recall(merged_entries(spark, sf))), ID)


@query(
    "questions_per_task",
    "SELECT 'past_scene_reconstruction' AS task, count(*) AS n FROM (" + ORACLES["ask_scene_recall"]
    + ") UNION ALL SELECT 'past_next_after_group', count(*) FROM (" + ORACLES["ask_next_after_group"]
    + ") UNION ALL SELECT 'past_transition_pattern', count(*) FROM (" + ORACLES["ask_transition_pattern"]
    + ") UNION ALL SELECT 'past_never_gazed', count(*) FROM (" + ORACLES["ask_never_gazed"]
    + ") UNION ALL SELECT 'present_ident_easy', count(*) FROM (" + ORACLES["ask_identify_easy"]
    + ") UNION ALL SELECT 'future_action', count(*) FROM (" + ORACLES["ask_next_action"]
    + ") UNION ALL SELECT 'future_remind_easy', count(*) FROM (" + ORACLES["ask_alert_gaze"] + ")",
)
def questions_per_task(spark, sf):
    """Every builder whose input is a timeline or its episodes, which are made once for all."""
    seen = cut(S.timeline(spark, sf))
    entries = merged_entries(spark, sf, seen)
    made = [Q.scene_recall(entries), Q.next_after_group(entries), Q.transition_pattern(entries), Q.never_gazed(entries, chunk=S.DAY)]
    made += [Q.identify_easy(positioned_episodes(spark, sf, seen)), Q.next_action(entries, chunk=S.DAY)]
    made += [QUERIES["ask_alert_gaze"](spark, sf, seen).withColumn("task", F.lit("future_remind_easy"))]
    tasks = reduce(DataFrame.unionByName, (m.select("task") for m in made))
    return tasks.groupBy("task").agg(F.count(F.lit(1)).alias("n"))

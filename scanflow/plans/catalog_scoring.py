"""Registered scoring queries and model requests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from scanflow.functions import text, timecode
from scanflow.operators import joins
from scanflow.plans import questions as Q
from scanflow.plans import requests as R
from scanflow.plans import scoring
from scanflow.plans import sqltext as T
from scanflow.plans import standins as S
from scanflow.plans.catalog import query, r4, r6
from scanflow.plans.catalog_questions import ALERT_CTES, RECALL_CTES, kitchen_entries, merged_entries

_LETTER = """CASE WHEN regexp_extract(upper(trim(coalesce({0}, ''))), '\\b([ABCD])\\b', 1) <> ''
    THEN regexp_extract(upper(trim(coalesce({0}, ''))), '\\b([ABCD])\\b', 1) ELSE upper(trim(coalesce({0}, ''))) END"""
_SCORED = f"""SELECT *, {_LETTER.format('truth')} AS want, {_LETTER.format('reply')} AS got FROM predictions"""


@query(
    "score_choice",
    S.with_views("predictions", sc=_SCORED)
    + """SELECT model, task, count(*) FILTER (WHERE want <> '' AND want = got) AS n_correct,
    count(*) FILTER (WHERE want <> '') AS n_total,
    r6(count(*) FILTER (WHERE want <> '' AND want = got) * 100.0 / count(*) FILTER (WHERE want <> '')) AS accuracy
    FROM sc GROUP BY 1, 2""",
)
def score_choice(spark, sf):
    out = scoring.score_choice(S.predictions(spark, sf), ["model", "task"])
    return out.select("model", "task", "n_correct", "n_total", r6("accuracy"))


@query(
    "answer_letters",
    S.with_views("predictions", sc=_SCORED) + "SELECT item_id, want, got FROM sc",
)
def answer_letters(spark, sf):
    return S.predictions(spark, sf).select(
        "item_id", text.answer_letter(F.col("truth")).alias("want"), text.answer_letter(F.col("reply")).alias("got")
    )


@query(
    "score_positions",
    """WITH q AS (SELECT o_orderkey // 8 AS item, row_number() OVER (PARTITION BY o_orderkey // 8 ORDER BY o_orderkey)
        AS pos, substr('ABCD', CAST(o_orderkey % 4 + 1 AS INTEGER), 1) AS a FROM orders),
    p AS (SELECT o_orderkey // 8 AS item, row_number() OVER (PARTITION BY o_orderkey // 8 ORDER BY o_orderkey)
        AS pos, substr('ABCD', CAST(o_custkey % 4 + 1 AS INTEGER), 1) AS r FROM orders WHERE o_orderkey % 8 <> 2)
    SELECT item % 5 AS grp, count(*) FILTER (WHERE a = r) AS n_correct, count(*) AS n_total,
    r6(count(*) FILTER (WHERE a = r) * 100.0 / count(*)) AS accuracy FROM q JOIN p USING (item, pos) GROUP BY 1""",
)
def score_positions(spark, sf):
    letters = F.lit("ABCD")
    rows = S.table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 8).alias("item"),
        "o_orderkey",
        F.substring(letters, (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1)).alias("a"),
        F.substring(letters, (F.col("o_custkey") % 4 + 1).cast("int"), F.lit(1)).alias("r"),
        (F.col("o_orderkey") % 8 != 2).alias("replied"),
    )

    def listed(keep, col):
        got = F.array_sort(F.collect_list(F.when(keep, F.struct("o_orderkey", col))))
        return F.transform(got, lambda s: s[col])

    items = rows.groupBy("item").agg(
        listed(F.lit(True), "a").alias("answers"), listed(F.col("replied"), "r").alias("replies")
    )
    out = scoring.score_result_items(items.withColumn("grp", F.col("item") % 5), ["grp"], "item")
    return out.select("grp", "n_correct", "n_total", r6("accuracy"))


_ALERTS = """SELECT o_orderkey % 7 AS grp, CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE CAST(o_orderkey % 2 AS INTEGER) END
    AS type, CASE o_custkey % 5 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'unknown' WHEN 2 THEN 'no' WHEN 3 THEN ' yes, it is' END
    AS response FROM orders"""


def alert_points(spark, sf):
    kind = F.col("o_custkey") % 5
    return S.table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 7).alias("grp"),
        F.when(F.col("o_orderkey") % 10 != 9, (F.col("o_orderkey") % 2).cast("int")).alias("type"),
        F.when(kind == 0, "Yes.").when(kind == 1, "unknown").when(kind == 2, "no").when(kind == 3, " yes, it is")
        .alias("response"),
    )


@query(
    "score_alert",
    f"""WITH p AS (SELECT *, upper(coalesce(response, '')) AS up FROM ({_ALERTS}) WHERE type IS NOT NULL),
    c AS (SELECT grp, count(*) FILTER (WHERE contains(up, CASE WHEN type = 1 THEN 'YES' ELSE 'NO' END)) AS n_correct,
      count(*) AS n_total, count(*) FILTER (WHERE type = 1 AND contains(up, 'YES')) AS tp,
      count(*) FILTER (WHERE type = 0 AND contains(up, 'YES')) AS fp,
      count(*) FILTER (WHERE type = 1 AND NOT contains(up, 'YES')) AS fn FROM p GROUP BY 1)
    SELECT grp, n_correct, n_total, r6(n_correct * 100.0 / n_total) AS accuracy, r6(tp / (tp + fp)) AS "precision",
    r6(tp / (tp + fn)) AS recall, r6(2 * tp / (2 * tp + fp + fn)) AS f1 FROM c""",
)
def score_alert(spark, sf):
    out = scoring.score_alert(alert_points(spark, sf), ["grp"])
    return out.select("grp", "n_correct", "n_total", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


@query(
    "score_timing",
    S.with_views("predictions")
    + """, t AS (SELECT *, seconds BETWEEN window_start AND window_end + 3 AS ok,
      abs(seconds - (window_start + window_end) / 2) AS err FROM predictions)
    SELECT task, count(*) AS n, count(*) FILTER (WHERE ok) AS n_on_time,
    r6(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)) AS accuracy, r6(avg(seconds)) AS mean_seconds,
    r6(stddev_pop(seconds)) AS std_seconds, r6(avg(err)) AS mean_error, r6(stddev_pop(err)) AS std_error
    FROM t GROUP BY ROLLUP (task)""",
)
def score_timing(spark, sf):
    out = scoring.score_timing(S.predictions(spark, sf), "task")
    stats = ["accuracy", "mean_seconds", "std_seconds", "mean_error", "std_error"]
    return out.select("task", "n", "n_on_time", *[r6(c) for c in stats])


@query(
    "score_latency",
    S.with_views("predictions")
    + """, b AS (SELECT task, seconds FROM predictions UNION ALL SELECT 'overall', seconds FROM predictions)
    SELECT task, count(*) AS n, r4(avg(seconds)) AS mean, r4(coalesce(stddev_samp(seconds), 0)) AS std,
    r4(min(seconds)) AS min, r4(max(seconds)) AS max, r4(quantile_cont(seconds, 0.5)) AS median,
    r4(quantile_cont(seconds, 0.95)) AS p95, r4(quantile_cont(seconds, 0.99)) AS p99 FROM b GROUP BY 1""",
)
def score_latency(spark, sf):
    out = scoring.score_latency(S.predictions(spark, sf), "task")
    return out.select("task", "n", *[r4(c) for c in ("mean", "std", "min", "max", "median", "p95", "p99")])


@query(
    "score_overall",
    S.with_views("predictions")
    + """, q AS (SELECT nullif(item_id // 3, 5) AS id, arg_max(CASE WHEN upper(substr(reply, 1, 1)) = truth AND truth <> ''
        THEN 1.0 ELSE 0.0 END, item_id) AS text_score FROM predictions WHERE reply IS NOT NULL GROUP BY 1),
    t AS (SELECT nullif(item_id // 3, 5) AS id, task, CASE WHEN seconds BETWEEN window_start AND window_end + 3 THEN 1.0
        ELSE 0.0 END AS tm FROM predictions),
    b AS (SELECT task, tm::DOUBLE AS tm, text_score::DOUBLE AS tx, (tm * 0.5 + text_score * 0.5)::DOUBLE AS ov FROM t
      JOIN q ON t.id IS NOT DISTINCT FROM q.id)
    SELECT task, count(*) AS n, r6(avg(tm)) AS timing_mean, r6(stddev_pop(tm)) AS timing_std, r6(avg(tx)) AS text_mean,
    r6(stddev_pop(tx)) AS text_std, r6(avg(ov)) AS overall_mean, r6(stddev_pop(ov)) AS overall_std
    FROM b GROUP BY ROLLUP (task)""",
)
def score_overall(spark, sf):
    key = F.floor(F.col("item_id") / 3)
    rows = scoring.timed(S.predictions(spark, sf)).withColumn("id", F.when(key != 5, key))
    quality = rows.where(F.col("reply").isNotNull()).select(
        "id",
        "item_id",
        text.text_score(F.col("reply"), F.col("truth"), "first_char").alias("text_score"),
    )
    out = scoring.score_overall(rows.select("id", "task", "on_time"), quality, "id", "item_id", "task")
    stats = [f"{c}_{s}" for c in ("timing", "text", "overall") for s in ("mean", "std")]
    return out.select("task", "n", *[r6(c) for c in stats])


@query(
    "text_scores",
    S.with_views("predictions")
    + """SELECT item_id, CASE WHEN lower(trim(reply)) = lower(trim(truth)) THEN 1.0::DOUBLE ELSE 0 END AS exact,
    CASE WHEN contains(lower(reply), lower(truth)) THEN 1.0::DOUBLE ELSE 0 END AS inside,
    CASE WHEN reply <> '' AND truth <> '' AND lower(substr(trim(reply), 1, 1)) = lower(substr(trim(truth), 1, 1))
      THEN 1.0::DOUBLE ELSE 0 END AS first, CASE WHEN reply IS NULL THEN -1 WHEN lower(reply) LIKE 'yes%' THEN 1
      WHEN lower(reply) LIKE 'no%' THEN 0 WHEN contains(lower(reply), 'yes') THEN 1 WHEN contains(lower(reply), 'no')
      THEN 0 ELSE -1 END AS yes_no FROM predictions""",
)
def text_scores(spark, sf):
    p, t = F.col("reply"), F.col("truth")
    return S.predictions(spark, sf).select(
        "item_id",
        text.text_score(p, t, "exact_match").alias("exact"),
        text.text_score(p, t, "contains").alias("inside"),
        text.text_score(p, t, "first_char").alias("first"),
        text.yes_no(p).alias("yes_no"),
    )


_HIST = ", ".join(
    f"count(*) FILTER (WHERE says = '{w}' AND score = {s}) AS {w}_{s}" for w in ("yes", "no") for s in range(6)
)


@query(
    "score_judge",
    S.with_views("judged")
    + f""", s AS (SELECT *, CASE WHEN contains(lower(pred), 'yes') THEN 'yes' WHEN contains(lower(pred), 'no') THEN 'no' END
      AS says FROM judged),
    g AS (SELECT 'total' AS grp, says, score FROM s UNION ALL SELECT a_type, says, score FROM s
      UNION ALL SELECT substr(a_type, 1, 1), says, score FROM s)
    SELECT grp, count(*) AS n, count(*) FILTER (WHERE says = 'yes') AS n_yes, count(*) FILTER (WHERE says = 'no') AS n_no,
    r6(avg(CASE WHEN says = 'yes' THEN 1.0 ELSE 0.0 END)) AS accuracy, r6(avg(score)) AS mean_score, {_HIST}
    FROM g GROUP BY 1""",
)
def score_judge(spark, sf):
    out = scoring.score_judge(S.judged(spark, sf), by_letter=True)
    hist = [f"{w}_{s}" for w in ("yes", "no") for s in range(6)]
    return out.select("grp", "n", "n_yes", "n_no", r6("accuracy"), r6("mean_score"), *hist)


_PRIORITIES = {
    "1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "Open", "5-LOW": "Low", "6-NONE": "None",
}
_GRID = f"""SELECT m.model, t.task, t.name AS task_name, accuracy, CASE WHEN accuracy IS NULL THEN 'N/A' ELSE
    printf('%.2f', accuracy) END AS accuracy_text, coalesce(n_correct, 0) AS n_correct, coalesce(n_total, 0) AS n_total
    FROM (SELECT DISTINCT model FROM predictions) m CROSS JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _PRIORITIES.items())}) t(task, name)
    LEFT JOIN sco ON sco.model = m.model AND sco.task = t.task"""
_GRID_CTES = {
    "sc": _SCORED,
    "sco": """SELECT model, task, count(*) FILTER (WHERE want <> '' AND want = got) AS n_correct,
        count(*) FILTER (WHERE want <> '') AS n_total, count(*) FILTER (WHERE want <> '' AND want = got) * 100.0
        / count(*) FILTER (WHERE want <> '') AS accuracy FROM sc GROUP BY 1, 2""",
    "grid": _GRID,
}


def _grid(spark, sf):
    rows = S.predictions(spark, sf)
    scores = scoring.score_choice(rows, ["model", "task"])
    return scoring.result_grid(rows.select("model").distinct(), scores, _PRIORITIES)


@query(
    "leaderboard",
    S.with_views("predictions", **_GRID_CTES)
    + "SELECT model, task, task_name, r6(accuracy) AS accuracy, n_correct, n_total, accuracy IS NULL AS missing FROM grid",
)
def leaderboard(spark, sf):
    return _grid(spark, sf).select(
        "model", "task", "task_name", r6("accuracy"), "n_correct", "n_total",
        (F.col("accuracy_text") == "N/A").alias("missing"),
    )


@query(
    "leaderboard_pivot",
    S.with_views("predictions", **_GRID_CTES)
    + "SELECT model, "
    + ", ".join(f"r6(max(accuracy) FILTER (WHERE task = '{t}')) AS \"{n}\"" for t, n in _PRIORITIES.items())
    + " FROM grid GROUP BY 1",
)
def leaderboard_pivot(spark, sf):
    out = scoring.pivot_summary(_grid(spark, sf), _PRIORITIES)
    return out.select("model", *[r6(t, n) for t, n in _PRIORITIES.items()])


@query(
    "leaderboard_average",
    S.with_views("predictions", **_GRID_CTES) + "SELECT model, r6(coalesce(avg(accuracy), 0)) AS average FROM grid GROUP BY 1",
)
def leaderboard_average(spark, sf):
    return scoring.macro_average(_grid(spark, sf)).select("model", r6("average"))


_PROMPT = (
    "chr(10) || 'Question: ' || question || chr(10) || 'Options:' || chr(10) || array_to_string(opts, chr(10)) || chr(10) || '"
    + R.FOUR_OPTION_RULE + "' || chr(10) || chr(10) || 'The best option is:'"
)


@query(
    "choice_requests",
    S.with_views("merged_pos", **RECALL_CTES)
    + f""", o AS (SELECT *, {T.options('mixed')} AS opts, floor(start_s) AS at_,
      'When the user was gazing at the {{' || array_to_string(fov, ', ') || '}}, which background object was NOT visible?'
      AS question FROM mx)
    SELECT session_id, pos, {_PROMPT} AS prompt, greatest(at_ - 60, 0) AS window_start, at_ AS window_end,
    r6(at_ + 0.1) AS question_time FROM o""",
)
def choice_requests(spark, sf):
    made = Q.scene_recall(merged_entries(spark, sf))
    out = R.choice_requests(made, past=False)
    return out.select("session_id", "pos", "prompt", "window_start", "window_end", r6("question_time"))


def _sql_text(value: str) -> str:
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return " || chr(10) || ".join(parts)


@query(
    "alert_requests",
    S.with_views("timeline", **ALERT_CTES)
    + f""", pt AS (SELECT session_id, object, first_s + o AS p, row_number() OVER (PARTITION BY session_id ORDER BY o) - 1
        AS point FROM target JOIN q0 USING (session_id)
        CROSS JOIN (SELECT unnest([-20.0, -10.0, 0.0, 10.0, 20.0]::DOUBLE[]) AS o)
        WHERE first_s + o >= question_s AND first_s + o <= question_s + 300)
    SELECT session_id, object AS target_object, CAST(point AS INTEGER) AS point, 0.0::DOUBLE AS window_start,
    floor(p) AS window_end, {_sql_text(R.ALERT_HEAD)} || 'Monitor my gaze and alert me when I gaze on the <' || object || '>.'
      || {_sql_text(R.ALERT_TAIL)} AS prompt FROM pt""",
)
def alert_requests(spark, sf):
    out = R.alert_requests(Q.alert_gaze(kitchen_entries(spark, sf)))
    return out.select("session_id", "target_object", "point", "window_start", "window_end", "prompt")


def stub_model(batch: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a user's model: replies with a letter taken from the prompt's length."""
    size = batch["prompt"].str.len()
    return pd.DataFrame({"text": size.mod(4).map(lambda i: "ABCD"[i]), "seconds": size / 100.0})


@query(
    "stub_predictions",
    S.with_views("merged_pos", **RECALL_CTES)
    + f""", o AS (SELECT *, {T.options('mixed')} AS opts,
      'When the user was gazing at the {{' || array_to_string(fov, ', ') || '}}, which background object was NOT visible?'
      AS question FROM mx),
    p AS (SELECT session_id, pos, length({_PROMPT}) AS n FROM o)
    SELECT session_id, pos, substr('ABCD', CAST(n % 4 + 1 AS INTEGER), 1) AS text, r6(n / 100.0) AS seconds, true AS fine
    FROM p""",
)
def stub_predictions(spark, sf):
    made = R.choice_requests(Q.scene_recall(merged_entries(spark, sf)), past=False)
    out = R.predict(made.select("session_id", "pos", "prompt"), stub_model, ["session_id", "pos"])
    return out.select("session_id", "pos", "text", r6("seconds"), F.col("error").isNull().alias("fine"))


def stub_sentence(values: pd.Series) -> pd.Series:
    return values.str.capitalize() + "."


@query(
    "natural_actions",
    S.with_views("order_actions")
    + "SELECT session_id, pos, upper(substr(action, 1, 1)) || substr(action, 2) || '.' AS sentence FROM order_actions",
)
def natural_actions(spark, sf):
    out = R.rewrite_distinct(S.order_actions(spark, sf), "action", stub_sentence, "sentence")
    return out.select("session_id", "pos", "sentence")


@query(
    "attached_results",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority END AS label,
    CASE o_orderkey % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'error' ELSE 'missing' END AS status FROM orders""",
)
def attached_results(spark, sf):
    orders = S.table(spark, sf, "orders")
    part = F.col("o_orderkey") % 3
    results = orders.where(part < 2).select(
        "o_orderkey", F.when(part == 0, F.col("o_orderpriority")).alias("label"), F.when(part == 1, "failed").alias("error")
    )
    return joins.attach_results(orders.select("o_orderkey"), results, "o_orderkey").select("o_orderkey", "label", "status")


@query(
    "clock_text",
    f"""WITH s AS (SELECT o_orderkey, o_totalprice / 100 AS s FROM orders),
    r AS (SELECT *, {T.range_text('s', 's + 65')} AS span FROM s)
    SELECT o_orderkey, {T.mmss('s')} AS short, {T.clock_short('s')} AS rounded, span,
    CAST(floor(floor(s / 60) * 60 + floor(s % 60)) AS DOUBLE) AS low,
    CAST(CAST(floor(s / 60) * 60 + floor(s % 60) AS BIGINT) AS VARCHAR) || '-'
      || CAST(CAST(floor((s + 65) / 60) * 60 + floor((s + 65) % 60) AS BIGINT) + 10 AS VARCHAR) AS truth FROM r""",
)
def clock_text(spark, sf):
    s = F.col("o_totalprice") / 100
    df = S.table(spark, sf, "orders").select("o_orderkey", s.alias("s"))
    df = df.withColumn("span", timecode.range_text(F.col("s"), F.col("s") + 65))
    low, _ = timecode.range_bounds(F.col("span"))
    return df.select(
        "o_orderkey",
        timecode.mmss(F.col("s")).alias("short"),
        timecode.clock_short(F.col("s")).alias("rounded"),
        "span",
        low.alias("low"),
        timecode.truth_span(F.col("span")).alias("truth"),
    )


@query(
    "frame_codes",
    """SELECT event_id, CAST((event_id // 3600 * 3600 + event_id % 3600 // 60 * 60 + event_id % 60) * 24 + event_id % 24
      AS BIGINT) AS frame, CAST(1000 + (CAST(event_id AS HUGEINT) * 50 * 10000000) // 1223 AS BIGINT) AS tick,
    'task_' || CAST(event_id % 3 AS VARCHAR) AS stem,
    CASE event_id % 3 WHEN 0 THEN 'present_ident' WHEN 1 THEN 'future_action' END AS task FROM events""",
)
def frame_codes(spark, sf):
    e = F.col("event_id")
    code = F.format_string(
        "%02d:%02d:%02d:%02d", F.floor(e / 3600), F.floor(F.pmod(e, F.lit(3600)) / 60), F.pmod(e, F.lit(60)), F.pmod(e, F.lit(24))
    )
    path = F.concat(F.lit("/data/videos/task_"), (e % 3).cast("string"), F.lit(".json"))
    name = F.when(e % 3 == 0, "non_fixated_Identification.json").when(e % 3 == 1, "action_prediction").otherwise("other")
    return S.table(spark, sf, "events").select(
        "event_id",
        timecode.frame_code(code).alias("frame"),
        timecode.frame_tick(F.lit(1000).cast("long"), e, 24.46).alias("tick"),
        text.stem(text.gaze_video_path(path)).alias("stem"),
        text.task_from_name(name).alias("task"),
    )


@query(
    "normal_names",
    """SELECT doc_id, lang, length(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS n_plain,
    regexp_matches(lower(text), 'hand|hands|finger|fingers|arm|arms|foot|feet|leg|legs|body|face|head|person') AS human,
    md5(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS digest FROM documents""",
)
def normal_names(spark, sf):
    plain = S.table(spark, sf, "documents")
    clean = text.light_norm(F.col("text"))
    return plain.select(
        "doc_id", "lang", F.length(clean).cast("long").alias("n_plain"), text.is_human(F.col("text")).alias("human"),
        F.md5(clean).alias("digest"),
    )


@query(
    "normal_names_unicode",
    """SELECT doc_id, trim(regexp_replace(nfc_normalize(lang || ' ' || source), '\\s+', ' ', 'g')) || ' fit 12 km' AS name,
    CAST(regexp_matches(lower(source), 'hand|arm|face|head') AS BOOLEAN) AS human FROM documents""",
)
def normal_names_unicode(spark, sf):
    return S.table(spark, sf, "documents").select(
        "doc_id",
        # compatibility forms: a ligature, wide digits, an ideographic space, a squared unit
        text.light_norm(F.concat(F.concat_ws("  ", "lang", "source"), F.lit(" \ufb01t\u3000\uff11\uff12 \u339e "))).alias("name"),
        text.any_word(F.col("source"), ["hand", "arm", "face", "head"]).alias("human"),
    )


@query(
    "parsed_literals",
    """SELECT event_id, event_type AS object_identity, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'a ' || event_type END
    AS detailed_caption, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(event_id % 7 AS BIGINT) END AS n FROM events
    WHERE event_id % 5 < 5""",
)
def parsed_literals(spark, sf):
    e = F.col("event_id")
    caption = F.when(e % 3 == 0, "None").otherwise(F.concat(F.lit("'a "), "event_type", F.lit("'")))
    number = F.when(e % 5 == 4, "None").otherwise((e % 7).cast("string"))
    literal = F.concat(
        F.lit("{'object_identity': '"), "event_type", F.lit("', 'detailed_caption': "), caption, F.lit(", 'n': "), number, F.lit("}")
    )
    schema = "object_identity string, detailed_caption string, n long"
    return S.table(spark, sf, "events").select("event_id", text.parse_literal(literal, schema).alias("v")).select(
        "event_id", "v.*"
    )


@query(
    "fenced_replies",
    """SELECT event_id, event_type AS answer, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END AS id FROM events
    WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 4 = 3""",
)
def fenced_replies(spark, sf):
    e = F.col("event_id")
    body = F.when(e % 4 == 0, F.to_json(F.struct(F.col("event_type").alias("answer")))).otherwise(
        F.to_json(F.struct(F.col("event_type").alias("answer"), e.alias("id")))
    )
    reply = F.when(e % 4 == 3, F.lit("sorry")).when(e % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    parsed = text.fenced_json(reply, "answer string, id long")
    return S.table(spark, sf, "events").select("event_id", parsed.alias("v")).select("event_id", "v.*")


@query(
    "verdicts_applied",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'verdict_invalid' END AS reason,
    CASE WHEN o_orderkey % 4 IN (0, 1) AND o_orderkey % 3 = 0 THEN 'fixed' ELSE o_orderstatus END AS answer FROM orders""",
)
def verdicts_applied(spark, sf):
    from scanflow.plans.filters import apply_verdicts

    orders = S.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("answer"))
    turn = F.col("o_orderkey") % 4
    verdicts = orders.where(turn < 2).select(
        "o_orderkey",
        F.when(turn == 0, 0).otherwise(1).alias("verdict"),
        F.when(F.col("o_orderkey") % 3 == 0, "fixed").alias("relabel"),
    )
    return apply_verdicts(orders, verdicts, ["o_orderkey"], label="answer").select("o_orderkey", "reason", "answer")


@query(
    "span_windows",
    """SELECT item_id, low, high, seconds BETWEEN low AND high + 3 AS on_time FROM (SELECT o_orderkey AS item_id,
      o_totalprice / 10000.0::DOUBLE AS seconds, CAST(o_orderkey % 30 AS DOUBLE) AS low,
      CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 30 + 5 ELSE 60 + o_orderkey % 30 END AS DOUBLE) AS high
      FROM orders)""",
)
def span_windows(spark, sf):
    k = F.col("item_id") % 30
    end = F.when(F.col("item_id") % 2 == 0, (k + 5).cast("string")).otherwise(F.format_string("01:%02d", k))
    df = S.predictions(spark, sf).withColumn("span", F.concat(k.cast("string"), F.lit("-"), end))
    low, high = timecode.span_bounds(F.col("span"))
    df = df.withColumn("low", low).withColumn("high", high)
    return df.select(
        "item_id", "low", "high", text.in_window(F.col("seconds"), F.col("low"), F.col("high")).alias("on_time")
    )


@query(
    "object_labels",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'a ' || p_type WHEN p_size % 3 = 1 AND p_size % 2 = 0 THEN ''
    WHEN p_size % 3 = 1 THEN 'a ' || p_type ELSE p_name END AS label, lower(replace(p_type || '_' || p_brand, '_', ' '))
    AS name FROM part""",
)
def object_labels(spark, sf):
    size = F.col("p_size")
    identity = F.when(size % 3 == 1, "").when(size % 3 == 2, F.col("p_name"))
    caption = F.when((size % 3 == 1) & (size % 2 == 0), F.lit(None)).otherwise(F.concat(F.lit("a "), "p_type"))
    return S.table(spark, sf, "part").select(
        "p_partkey",
        text.object_or_caption(identity, caption).alias("label"),
        text.norm_name(F.concat_ws("_", "p_type", "p_brand")).alias("name"),
    )


@query(
    "polish_flags",
    """SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda o: length(o) > 200
    OR (length(o) > 100 AND NOT regexp_matches(trim(o), '[.!?,;]$')))) > 0 AS needs_polish FROM documents""",
)
def polish_flags(spark, sf):
    """Lines of documents as options: many are long, some of them without an end mark."""
    return S.table(spark, sf, "documents").select("doc_id", text.needs_polish(F.split("text", "\n")).alias("needs_polish"))

"""Registered queries over timelines: episodes, vocabularies, neighbours, set relations, sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanflow.functions import text
from scanflow.operators import draws, intervals, objects, ordered, timeline
from scanflow.plans import filters as G
from scanflow.plans import questions as Q
from scanflow.plans import sqltext as T
from scanflow.plans import standins as S
from scanflow.plans.catalog import query, r6
from scanflow.plans.catalog_questions import RECALL_CTES, _gap_merge_sql, merged_entries
from scanflow.session import cut

BY = ["session_id"]


def _joined(name: str, alias: str | None = None, sep: str = ",") -> Column:
    return F.array_join(name, sep).alias(alias or name)


@query(
    "timeline_merged",
    S.with_views("merged_pos")
    + """SELECT session_id, pos, start_s, end_s, kind, array_to_string(fov, ',') AS fov,
    array_to_string(outside, ',') AS outside, action FROM merged_pos""",
)
def timeline_merged(spark, sf):
    both = timeline.timeline_merge(S.timeline(spark, sf), S.order_actions(spark, sf))
    out = timeline.with_position(both, chunk=S.DAY)
    return out.select("session_id", "pos", "start_s", "end_s", "kind", _joined("fov"), _joined("outside"), "action")


@query(
    "scanpath",
    S.with_views("episodes")
    + """SELECT session_id, start_s, end_s, array_to_string(list_concat([object], list_filter(cropped,
      lambda c: c <> object)), ',') AS fov, array_to_string(outside, ',') AS outside FROM episodes""",
)
def scanpath(spark, sf):
    spelled = S.episodes(spark, sf).withColumn("pos", F.col("start_s")).withColumn("object", F.upper("object"))
    out = timeline.scanpath(spelled)
    return out.select("session_id", "start_s", "end_s", _joined("fov"), _joined("outside"))


_EPISODE_CTES = {
    "seg": """SELECT session_id, start_s, end_s, fov, outside, len(fov) * 0.3::DOUBLE AS center_x,
        len(outside) * 0.2::DOUBLE AS center_y FROM timeline""",
    "lg": """SELECT *, row_number() OVER w - 1 AS nr, lag(end_s) OVER w AS pe, lag(center_x) OVER w AS px,
        lag(center_y) OVER w AS py FROM seg WINDOW w AS (PARTITION BY session_id ORDER BY start_s, end_s)""",
    "br": """SELECT *, CASE WHEN pe IS NOT NULL AND start_s - pe < 60 AND sqrt((px - center_x) * (px - center_x)
        + (py - center_y) * (py - center_y)) < 0.9 THEN NULL ELSE nr END AS b FROM lg""",
    "mem": """SELECT *, max(b) OVER (PARTITION BY session_id ORDER BY nr) AS episode FROM br""",
}


def stored(spark, sf):
    """The stand-in timeline as a stored table: operators with several scans read it more than once."""
    return cut(S.timeline(spark, sf))


def stored_entries(spark, sf):
    return cut(timeline.with_position(S.timeline(spark, sf), chunk=S.DAY))


def _members(spark, sf):
    segments = stored(spark, sf).select(
        "*", (F.size("fov") * 0.3).alias("center_x"), (F.size("outside") * 0.2).alias("center_y")
    )
    return intervals.episode_members(segments, space=0.9, time=60.0, chunk=S.DAY)


@query(
    "episodes",
    S.with_views("timeline", **_EPISODE_CTES)
    + """SELECT session_id, episode, min(start_s) AS start_s, max(end_s) AS end_s, max(end_s) - min(start_s) AS duration,
    count(*) AS n_members FROM mem GROUP BY 1, 2""",
)
def episodes(spark, sf):
    return intervals.episode_bounds(_members(spark, sf))


@query(
    "episode_lists",
    S.with_views("timeline", **_EPISODE_CTES)
    + """SELECT session_id, episode,
    string_agg(CAST(nr AS VARCHAR), ',' ORDER BY nr) AS fixation_ids,
    string_agg(CAST(CAST(start_s AS BIGINT) AS VARCHAR), ',' ORDER BY nr) AS starts FROM mem GROUP BY 1, 2""",
)
def episode_lists(spark, sf):
    whole = _members(spark, sf).withColumn("begun", F.col("start_s").cast("long").cast("string"))
    out = intervals.member_lists(whole.withColumn("id", F.col("nr").cast("string")), BY, ["id", "begun"])
    return out.select("session_id", "episode", _joined("id", "fixation_ids"), _joined("begun", "starts"))


@query(
    "episode_objects",
    S.with_views("timeline", **_EPISODE_CTES)
    + """, x AS (SELECT session_id, episode, nr, i, fov[i] AS object FROM (SELECT *, unnest(range(1, len(fov) + 1)) AS i
      FROM mem)),
    c AS (SELECT session_id, episode, object, count(*) AS n_votes, min((nr, i)) AS f FROM x GROUP BY 1, 2, 3)
    SELECT session_id, episode, object, n_votes, f[1] AS first_nr FROM (SELECT *, row_number() OVER (
      PARTITION BY session_id, episode ORDER BY n_votes DESC, f) AS r FROM c) WHERE r = 1""",
)
def episode_objects(spark, sf):
    rows = _members(spark, sf).select(
        "session_id", "episode", "nr", F.posexplode("fov").alias("i", "object"), F.col("nr").alias("first_nr")
    )
    return objects.ordered_mode(rows, [*BY, "episode"], "object", ["nr", "i"])


@query(
    "episode_unique_objects",
    S.with_views("timeline", **_EPISODE_CTES)
    + """, x AS (SELECT session_id, episode, nr, i, outside[i] AS object FROM (SELECT *,
      unnest(range(1, len(outside) + 1)) AS i FROM mem))
    SELECT session_id, episode, object, min((nr, i))[1] AS nr, CAST(min((nr, i))[2] - 1 AS INTEGER) AS i
    FROM x GROUP BY 1, 2, 3""",
)
def episode_unique_objects(spark, sf):
    rows = _members(spark, sf).select("session_id", "episode", "nr", F.posexplode("outside").alias("i", "object"))
    return objects.ordered_distinct(rows, [*BY, "episode"], "object", ["nr", "i"])


@query(
    "object_pools",
    S.with_views("sightings") + "SELECT DISTINCT session_id, lower(trim(object)) AS object FROM sightings",
)
def object_pools(spark, sf):
    shouted = S.sightings(spark, sf).withColumn("object", F.concat(F.lit(" "), F.upper("object")))
    return objects.object_pool(shouted, BY, "object")


@query(
    "object_frequency",
    S.with_views("sightings")
    + """, c AS (SELECT session_id, object, count(*) AS n, min((start_s, end_s)) AS f FROM sightings GROUP BY 1, 2)
    SELECT session_id, object, n, n = 1 AS single, f[1] AS first_s FROM c""",
)
def object_frequency(spark, sf):
    out = objects.frequency(S.sightings(spark, sf), BY, "object", ["start_s", "end_s"])
    return out.select(
        "session_id", "object", "n", (F.col("n") == 1).alias("single"), F.col("first_seen.start_s").alias("first_s")
    )


@query(
    "top_objects",
    """WITH c AS (SELECT p_name AS object, count(*) AS n, min(l_orderkey) AS first_key FROM lineitem
      JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT object, n, first_key FROM c ORDER BY n DESC, first_key, object
    LIMIT 20""",
)
def top_objects(spark, sf):
    named = S.table(spark, sf, "lineitem").join(S.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counted = objects.frequency(named.withColumn("object", F.col("p_name")), [], "object", ["l_orderkey", "object"])
    return objects.top_objects(counted).select("object", "n", F.col("first_seen.l_orderkey").alias("first_key"))


@query(
    "frequency_totals",
    S.with_views("sightings")
    + """, c AS (SELECT session_id, object, count(*) AS n FROM sightings GROUP BY 1, 2)
    SELECT count(*) AS n_unique, CAST(sum(n) AS BIGINT) AS n_mentions, count(*) FILTER (WHERE n = 1) AS n_single FROM c""",
)
def frequency_totals(spark, sf):
    return objects.frequency_summary(objects.frequency(S.sightings(spark, sf), BY, "object", ["start_s"]))


@query(
    "entries_per_session",
    S.with_views("timeline") + "SELECT session_id, count(*) AS n_rows FROM timeline GROUP BY ROLLUP (session_id)",
)
def entries_per_session(spark, sf):
    return objects.count_rows(S.timeline(spark, sf), "session_id")


@query(
    "field_objects",
    S.with_views("episodes")
    + """, f AS (SELECT session_id, 'representative' AS field, object FROM episodes
      UNION ALL SELECT session_id, 'cropped', unnest(cropped) FROM episodes
      UNION ALL SELECT session_id, 'outside', unnest(outside) FROM episodes)
    SELECT DISTINCT session_id, field, trim(object) AS object FROM f""",
)
def field_objects(spark, sf):
    return objects.fields_of_objects(S.episodes(spark, sf), BY)


@query(
    "merged_appearances",
    S.with_views("timeline", ap="SELECT session_id, unnest(outside) AS object, start_s, end_s FROM timeline")
    + _gap_merge_sql("ap", "session_id, object"),
)
def merged_appearances(spark, sf):
    seen = intervals.appearances(stored(spark, sf), "outside")
    return intervals.merge_intervals(seen, [*BY, "object"], gap=10.0, chunk=S.DAY)


@query("session_coverage", S.with_views("timeline") + _gap_merge_sql("timeline", "session_id"))
def session_coverage(spark, sf):
    return intervals.merge_intervals(stored(spark, sf), BY, gap=10.0, chunk=S.DAY)


@query(
    "longest_per_object",
    S.with_views("episodes")
    + """SELECT session_id, object, start_s, duration FROM (SELECT *, row_number() OVER (PARTITION BY session_id, object
      ORDER BY duration DESC, start_s) AS r FROM episodes) WHERE r = 1""",
)
def longest_per_object(spark, sf):
    rows = S.episodes(spark, sf).select("session_id", "object", "start_s", "duration")
    return intervals.longest_per_object(rows, BY, "object", ["start_s"])


@query(
    "next_new_objects",
    S.with_views("merged_pos")
    + """, n AS (SELECT *, lead(kind) OVER w AS nk, lead(fov) OVER w AS nf FROM merged_pos
      WINDOW w AS (PARTITION BY session_id ORDER BY pos))
    SELECT session_id, pos, array_to_string(list_filter(nf, lambda x: NOT list_contains(fov, x)), ',') AS fresh FROM n
    WHERE kind = 'objects' AND nk = 'objects'""",
)
def next_new_objects(spark, sf):
    near = timeline.neighbours(merged_entries(spark, sf), ["kind", "fov"], after=1)
    pairs = near.where((F.col("kind") == "objects") & (F.col("next1.kind") == "objects"))
    fresh = objects.new_objects(F.col("fov"), F.col("next1.fov"))
    return pairs.select("session_id", "pos", F.array_join(fresh, ",").alias("fresh"))


@query(
    "gaze_triples",
    S.with_views("entries")
    + """, t AS (SELECT *, lead(fov) OVER w AS f1, lead(fov, 2) OVER w AS f2 FROM entries
      WINDOW w AS (PARTITION BY session_id ORDER BY pos))
    SELECT session_id, pos, '{' || array_to_string(fov, ',') || '}>{' || array_to_string(f1, ',') || '}>{'
      || array_to_string(f2, ',') || '}' AS seq, fov = f1 OR f1 = f2 AS repeats FROM t
    WHERE len(fov) > 0 AND len(f1) > 0 AND len(f2) > 0""",
)
def gaze_triples(spark, sf):
    placed = stored_entries(spark, sf)
    near = timeline.neighbours(placed, ["fov"], after=2)
    full = near.where((F.size("fov") > 0) & (F.size("next1.fov") > 0) & (F.size("next2.fov") > 0))
    groups = F.array("fov", "next1.fov", "next2.fov")
    return full.select(
        "session_id", "pos", text.seq_text(groups).alias("seq"), objects.has_identical_neighbours(groups).alias("repeats")
    )


@query(
    "recent_context",
    S.with_views("merged_pos")
    + """, l AS (SELECT *, flatten(list(fov) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 2 PRECEDING
      AND CURRENT ROW)) AS f FROM merged_pos),
    c AS (SELECT *, list_filter(f, lambda x, i: list_position(f, x) = i) AS context FROM l)
    SELECT session_id, pos, array_to_string(context[greatest(len(context) - 2, 1):], ',') AS recent FROM c""",
)
def recent_context(spark, sf):
    out = timeline.lookback(merged_entries(spark, sf), 3)
    recent = timeline.last_n(F.col("context"), 3)
    return out.select("session_id", "pos", F.array_join(recent, ",").alias("recent"))


_SUMMARY = {
    "sm": """SELECT session_id, object, bool_or(in_fov) AS gazed, bool_or(NOT in_fov) AS was_outside,
      min(start_s) FILTER (WHERE in_fov) AS first_gaze, max(end_s) FILTER (WHERE in_fov) AS last_gaze_end
      FROM sightings GROUP BY 1, 2"""
}


@query(
    "gaze_summary",
    S.with_views("sightings", **_SUMMARY) + "SELECT * FROM sm",
)
def gaze_summary(spark, sf):
    return objects.gaze_summary(S.timeline(spark, sf))


@query(
    "scene_minus_gazed",
    S.with_views("sightings", **_SUMMARY) + "SELECT session_id, object FROM sm WHERE NOT gazed",
)
def scene_minus_gazed(spark, sf):
    return objects.gaze_summary(S.timeline(spark, sf)).where(~F.col("gazed")).select("session_id", "object")


@query(
    "gazed_so_far",
    S.with_views("entries", "sightings", **_SUMMARY)
    + """SELECT e.session_id, e.pos, count(s.object) AS n_gazed FROM entries e LEFT JOIN sm s
    ON s.session_id = e.session_id AND s.gazed AND s.first_gaze <= e.start_s GROUP BY 1, 2""",
)
def gazed_so_far(spark, sf):
    placed = stored_entries(spark, sf)
    out = timeline.gazed_so_far(placed.select("session_id", "pos", "start_s"), objects.gaze_summary(placed), chunk=S.DAY)
    return out.select("session_id", "pos", "n_gazed")


@query(
    "gaze_order",
    S.with_views("sightings", **_SUMMARY)
    + """SELECT session_id, object, first_gaze, row_number() OVER (PARTITION BY session_id ORDER BY first_gaze, object) - 1
    AS "rank" FROM sm WHERE gazed""",
)
def gaze_order(spark, sf):
    out = timeline.gaze_order(objects.gaze_summary(S.timeline(spark, sf)), chunk=S.DAY)
    return out.select("session_id", "object", "first_gaze", "rank")


@query(
    "not_visible_now",
    S.with_views("entries", al="SELECT session_id, count(DISTINCT o) AS n FROM (SELECT session_id, unnest(outside) AS o FROM timeline) GROUP BY 1")
    + """SELECT e.session_id, e.pos, n - len(outside) AS n_hidden, list_has_any(fov, outside) AS seen_twice
    FROM entries e JOIN al USING (session_id)""",
)
def not_visible_now(spark, sf):
    placed = stored_entries(spark, sf)
    every = placed.select("session_id", F.explode("outside").alias("o")).distinct().groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    # names outside now are a subset of the session's, so the difference needs only its size
    return placed.join(every, BY).select(
        "session_id",
        "pos",
        (F.col("n") - F.size("outside")).alias("n_hidden"),
        objects.option_overlap(F.col("fov"), F.col("outside")).alias("seen_twice"),
    )


@query(
    "distinct_names",
    S.with_views("sightings")
    + """, x AS (SELECT session_id, start_s, end_s, CASE WHEN in_fov THEN upper(object) ELSE object END AS o
      FROM sightings),
    l AS (SELECT session_id, start_s, end_s, list_sort(list(DISTINCT o)) AS names FROM x GROUP BY 1, 2, 3)
    SELECT session_id, start_s, end_s, array_to_string(list_filter(names, lambda n, i: list_position(
      list_transform(names, lambda m: lower(m)), lower(n)) = i), ',') AS names FROM l""",
)
def distinct_names(spark, sf):
    spelled = F.when(F.col("in_fov"), F.upper("object")).otherwise(F.col("object"))
    padded = F.array_append(F.array_sort(F.collect_set(spelled)), F.lit("  "))
    out = S.sightings(spark, sf).groupBy("session_id", "start_s", "end_s").agg(padded.alias("names"))
    return out.select("session_id", "start_s", "end_s", F.array_join(text.distinct_ci(F.col("names")), ",").alias("names"))


@query(
    "first_three_entries",
    S.with_views("entries") + "SELECT session_id, pos, start_s FROM entries WHERE pos < 3",
)
def first_three_entries(spark, sf):
    rows = S.timeline(spark, sf).select("session_id", "start_s", "end_s")
    placed = timeline.with_position(rows, chunk=S.DAY)
    return draws.first_per_group(placed, BY, ["pos"], 3).select("session_id", "pos", "start_s")


@query(
    "sampled_per_task",
    f"""SELECT task, item_id FROM (SELECT o_orderpriority AS task, o_orderkey AS item_id, row_number() OVER (
      PARTITION BY o_orderpriority ORDER BY {T.digest('review', 'o_orderkey')}, o_orderkey) AS r FROM orders)
    WHERE r <= 50""",
)
def sampled_per_task(spark, sf):
    rows = S.predictions(spark, sf).select("task", "item_id")
    return draws.sample_per_group(rows, ["task"], 50, "review", "item_id")


@query(
    "sampled_starts",
    S.with_views("timeline")
    + f""", n AS (SELECT session_id, count(*) AS n_entries, unnest(range(0, 5)) AS draw FROM timeline GROUP BY 1
      HAVING count(*) >= 3)
    SELECT session_id, draw, {T.hash60('starts', 'session_id', 'draw')} % (n_entries - 2) AS pos FROM n""",
)
def sampled_starts(spark, sf):
    sizes = S.timeline(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_entries"))
    out = draws.sampled_starts(sizes, BY, 3, 5, "starts")
    return out.select("session_id", F.col("draw").cast("long").alias("draw"), "pos")


@query(
    "work_chunks",
    """SELECT o_orderkey AS item_id, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1)
      / ceil((count(*) OVER ()) / 7.0::DOUBLE)) AS BIGINT) AS chunk FROM orders""",
)
def work_chunks(spark, sf):
    rows = S.predictions(spark, sf).select(F.lit("all").alias("of"), "item_id")
    out = draws.contiguous_chunks(rows, ["of"], ["item_id"], ordered.bucket(F.col("item_id"), 65_536), 7)
    return out.select("item_id", "chunk")


@query(
    "occurrence_ids",
    """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) - 1 AS nr, k FROM (
      SELECT l_orderkey, CAST(l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS BIGINT) AS k FROM lineitem)""",
)
def occurrence_ids(spark, sf):
    rows = S.table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("k")
    )
    out = timeline.occurrence_number(rows, "l_orderkey", "k", width=1e9)
    return out.select("l_orderkey", F.substring_index("unique_id", "_", -1).cast("long").alias("nr"), "k")


@query(
    "wrong_option_draws",
    S.with_views(
        "entries",
        names="SELECT session_id, unnest(list_concat(fov, outside)) AS object FROM timeline",
        pool=T.pool("names", "demo"),
        it="SELECT session_id, pos, fov FROM entries",
        dr=T.drawn("it", "pool", 3, "demo", "i.fov", ["session_id", "pos"], keep=True),
    )
    + "SELECT session_id, pos, array_to_string(drawn, ',') AS drawn FROM dr",
)
def wrong_option_draws(spark, sf):
    placed = stored_entries(spark, sf)
    names = placed.select("session_id", F.explode(F.concat("fov", "outside")).alias("object"))
    pool = draws.ranked_pool(names, BY, "demo")
    out = draws.draw_from_pool(
        placed.select("session_id", "pos", "fov"), pool, BY, ["session_id", "pos"], 3, "demo",
        exclude=F.col("fov"), keep_unmatched=True,
    )
    return out.select("session_id", "pos", _joined("drawn"))


_NW = "list_filter(list_distinct(string_split(lower({0}), ' ')), lambda w: w NOT IN ('the','a','an','of','in','on','at','and','or'))"
_SHARED = "list_intersect(wa, wb)"
_MODS = "[" + ", ".join(f"'{w}'" for w in text.MODIFIER_WORDS) + "]"


@query(
    "similar_name_pairs",
    S.with_views("merged_pos", **RECALL_CTES)
    + f""", i AS (SELECT session_id, pos, mixed AS names, unnest([1, 2, 3]) AS i FROM mx),
    j AS (SELECT *, unnest(range(i + 1, 5)) AS j FROM i),
    p AS (SELECT session_id, pos, i, j, names[i] AS a, names[j] AS b, {_NW.format('names[i]')} AS wa,
      {_NW.format('names[j]')} AS wb FROM j),
    s AS (SELECT *, CASE WHEN len({_SHARED}) = 0 THEN false WHEN a = b OR contains(a, b) OR contains(b, a) THEN true
      WHEN len(list_filter({_SHARED}, lambda w: NOT list_contains({_MODS}, w))) = 0 THEN false
      ELSE len({_SHARED}) * 1.0 / len(list_distinct(list_concat(wa, wb))) >= 0.5 END AS close FROM p)
    SELECT session_id, pos, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, a, b,
    r6(len({_SHARED}) * 1.0::DOUBLE / len(list_distinct(list_concat(wa, wb)))) AS overlap, close FROM s""",
)
def similar_name_pairs(spark, sf):
    """The six option pairs of each question."""
    asked = Q.scene_recall(merged_entries(spark, sf))
    names = asked.select("session_id", "pos", G.values(F.col("options")).alias("names"))
    left = names.select("*", F.posexplode("names").alias("i", "a"))
    rest = F.transform(F.col("names"), lambda n, j: F.struct(j.alias("j"), n.alias("b")))
    pairs = left.select("*", F.explode(F.filter(rest, lambda s: s["j"] > F.col("i"))).alias("o")).select(
        "session_id", "pos", "i", "o.j", "a", "o.b"
    )
    return pairs.select(
        "*",
        r6(text.word_overlap(F.col("a"), F.col("b")), "overlap"),
        text.similar_names(F.col("a"), F.col("b")).alias("close"),
    )


@query(
    "annotated_sessions",
    """SELECT o_custkey, o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
      AND l_returnflag = 'R') THEN 'annotated' ELSE 'open' END AS state FROM orders""",
)
def annotated_sessions(spark, sf):
    orders = S.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    done = S.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    kept = orders.join(done, "o_orderkey", "left_semi").withColumn("state", F.lit("annotated"))
    missing = orders.join(done, "o_orderkey", "left_anti").withColumn("state", F.lit("open"))
    return kept.unionByName(missing)

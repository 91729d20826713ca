"""Questions derived from a timeline, as one flat row per question.

``entries`` are timeline rows with ``pos`` (see ``operators.timeline``). All draws are
decided by md5 of the item key, so reruns and repartitioning give the same questions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanflow.functions import text
from scanflow.functions.timecode import clock_short, mmss, range_text
from scanflow.operators import draws, intervals, joins, objects, segments, timeline
from scanflow.plans.requests import rewrite_distinct
from scanflow.session import cut

BY = ["session_id"]
KEY = ["session_id", "pos"]


def _names(arr: str | Column) -> Column:
    return F.array_join(arr, ", ")


def _not_before_zero(seconds: Column) -> Column:
    return F.greatest(seconds, F.lit(0.0))


def next_after_group(entries: DataFrame, size: int = timeline.ENTRIES_PER_TILE) -> DataFrame:
    """Which new name comes into view right after a group of names."""
    pairs = timeline.neighbours(
        entries.select(*KEY, "kind", "fov", "start_s", "end_s"), ["kind", "fov", "start_s", "end_s"], after=1, size=size
    )
    fresh = objects.new_objects(F.col("fov"), F.col("next1.fov"))
    candidates = (
        pairs.where((F.col("kind") == "objects") & (F.col("next1.kind") == "objects") & (F.size("fov") > 0))
        .withColumn("truth", F.get(fresh, 0))
        .where(F.col("truth").isNotNull())
        .select(
            *KEY, "fov", "truth", "start_s", "end_s",
            F.col("next1.start_s").alias("next_s"), F.col("next1.end_s").alias("next_end_s"),
        )
    )
    pool = draws.packed_pool(entries, BY, "next", F.array_union("fov", "outside"))
    banned = F.array_append("fov", F.col("truth"))
    drawn = draws.draw_from_pool(candidates, pool, BY, KEY, 3, "next", exclude=banned).where(F.size("drawn") == 3)
    asked = draws.with_options(drawn, F.col("truth"), F.col("drawn"), "next-mix", *[F.col(k) for k in KEY])
    group = F.concat(F.lit("{"), _names("fov"), F.lit("}"))
    return asked.select(
        *KEY,
        F.lit("past_next_after_group").alias("task"),
        range_text(_not_before_zero(F.col("start_s") - 2), F.col("next_end_s") + 2).alias("response_time"),
        F.concat(F.lit("What object does the user gaze at next after looking at the "), group, F.lit("?")).alias("question"),
        mmss(F.col("next_s")).alias("time_stamp"),
        "answer",
        "options",
        F.col("truth").alias("answer_object"),
        F.col("fov").alias("object_group"),
        F.concat(F.lit("("), mmss(F.col("start_s")), F.lit(", "), mmss(F.col("end_s")), F.lit(")")).alias("group_time"),
    )


def never_gazed(entries: DataFrame, chunk: float = 600.0, per_session: int = 3, prefix_pool: bool = False) -> DataFrame:
    """Which of four names was never in view; wrong options were in view by then.

    The truth comes from names never in view in the whole session. With ``prefix_pool`` it
    may also be a name first in view after the question.
    """
    looked = entries.where(F.col("kind") == "objects")
    summary = cut(objects.gaze_summary(looked))  # read by the pool, the prefix count and the order
    counted = timeline.gazed_so_far(looked.select(*KEY, "start_s"), summary, chunk=chunk)
    ready = counted.where((F.col("pos") >= 2) & (F.col("n_gazed") >= 3))
    if prefix_pool:
        pool = draws.packed_pool(summary, BY, "never", F.array("object"))
    else:
        pool = draws.packed_pool(summary.where(~F.col("gazed")), BY, "never", F.array("object"))
        ready = ready.join(pool.sizes(), BY, "left_semi")
    if prefix_pool:
        items = _unseen_truth(ready, summary, pool, chunk, per_session)
    else:
        chosen = draws.first_per_group(ready, BY, ["pos"], per_session)
        items = draws.draw_from_pool(chosen, pool, BY, KEY, 1, "never").withColumn("truth", F.get("drawn", 0)).drop("drawn")
    ranks = draws.draw_ranks(F.col("n_gazed"), 3, "gazed", *[F.col(k) for k in KEY])
    probes = items.select("*", F.posexplode(ranks).alias("_i", "rank"))
    order = timeline.gaze_order(summary, chunk=chunk).select(*BY, "rank", "object", "first_gaze", "last_gaze_end")
    filled = (
        probes.join(order, [*BY, "rank"])
        .groupBy(*KEY)
        .agg(
            *[F.first(c).alias(c) for c in ("start_s", "truth")],
            F.transform(F.array_sort(F.collect_list(F.struct("_i", "object"))), lambda s: s["object"]).alias("wrong"),
            F.min("first_gaze").alias("from_s"),
            F.max("last_gaze_end").alias("to_s"),
        )
    )
    asked = draws.with_options(filled, F.col("truth"), F.col("wrong"), "never-mix", *[F.col(k) for k in KEY])
    choices = F.transform("options", text.option_value)
    return asked.select(
        *KEY,
        F.lit("past_never_gazed").alias("task"),
        range_text(_not_before_zero(F.col("from_s") - 2), F.col("to_s") + 2).alias("response_time"),
        F.concat(F.lit("Among {"), _names(choices), F.lit("}, which did the user never gaze at?")).alias("question"),
        mmss(F.col("start_s")).alias("time_stamp"),
        "answer",
        "options",
        F.col("truth").alias("answer_object"),
    )


def _unseen_truth(ready: DataFrame, summary: DataFrame, pool: draws.Pool, chunk: float, per_session: int) -> DataFrame:
    """Truth from names not in view up to the question: ranks past the gazed prefix."""
    order = summary.withColumn("_first", F.coalesce("first_gaze", F.lit(1e18)))
    ranked = draws.ordered.numbered(
        order, BY, ["_first", "object"], F.least(draws.ordered.bucket(F.col("_first"), chunk), F.lit(2**60)), name="rank"
    ).select(*BY, "rank", F.col("object").alias("truth"))
    open_items = ready.join(pool.sizes(), BY).where(F.col("_n") > F.col("n_gazed"))
    chosen = draws.first_per_group(open_items, BY, ["pos"], per_session)
    pick = F.pmod(draws.hash60("unseen", *[F.col(k) for k in KEY]), F.col("_n") - F.col("n_gazed"))
    return chosen.withColumn("rank", F.col("n_gazed") + pick).join(ranked, [*BY, "rank"]).drop("rank", "_n")


def _fake_ranks(ids: Sequence[Column]) -> Column:
    """Ranks of the two names, or the one of a pool of one, in each of six made-up groups."""
    return F.array(*[F.filter(draws.draw_ranks(F.col("_n"), 2, f"fake{g}-", *ids), lambda r: r.isNotNull()) for g in range(6)])


def _fakes_of_small(items: DataFrame, pools: DataFrame, ids: Sequence[Column]) -> DataFrame:
    """Items with ``_fakes``, six groups of names read from the array of their session."""
    named = F.transform(_fake_ranks(ids), lambda g: F.transform(g, lambda r: F.get("_names", r.cast("int"))))
    # as a generated column the names are read once, however often the texts use them
    return items.join(pools, BY).select(*items.columns, F.inline(F.array(F.struct(named.alias("_fakes")))))


def _fakes_of_large(items: DataFrame, pool: DataFrame, item_key: list[str]) -> DataFrame:
    """The same from pools by rank: one probe per name."""
    held = [c for c in items.columns if c not in item_key]
    sizes = pool.groupBy(*BY).agg(F.max("n_pool").alias("_n"))
    probes = (
        items.join(sizes, BY)
        .select(*items.columns, F.posexplode(_fake_ranks([F.col(c) for c in item_key])).alias("_g", "_ranks"))
        .select("*", F.posexplode("_ranks").alias("_j", "rank"))
    )
    filled = (
        probes.join(pool.select(*BY, "rank", "object"), [*BY, "rank"])
        .groupBy(*item_key)
        .agg(*[F.first(c).alias(c) for c in held], F.array_sort(F.collect_list(F.struct("_g", "_j", "object"))).alias("_f"))
    )

    def group(g: int) -> Column:
        return F.transform(F.filter("_f", lambda s: s["_g"] == g), lambda s: s["object"])

    return filled.select(*items.columns, F.array(*[group(g) for g in range(6)]).alias("_fakes"))


# Orders of three groups a wrong option may show.
_ORDERS = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]


def transition_pattern(
    entries: DataFrame, n_starts: int = 5, size: int = timeline.ENTRIES_PER_TILE
) -> DataFrame:
    """Which sequence of groups was seen over three entries."""
    triples = (
        timeline.neighbours(
            entries.select(*KEY, "kind", "fov", "start_s"), ["kind", "fov", "start_s"], after=2, size=size
        )
        .where(
            (F.col("kind") == "objects") & (F.col("next1.kind") == "objects") & (F.col("next2.kind") == "objects")
            & (F.size("fov") > 0) & (F.size("next1.fov") > 0) & (F.size("next2.fov") > 0)
        )
        .select(
            *KEY, F.array("fov", "next1.fov", "next2.fov").alias("groups"),
            "start_s", F.col("next2.start_s").alias("stop_s"),
        )
    )
    sizes = entries.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_entries"))
    starts = draws.sampled_starts(sizes, BY, 3, n_starts, "transition").select(*KEY, "draw")
    item_key = ["session_id", "draw"]
    ids = [F.col(c) for c in item_key]
    items = starts.join(triples, KEY).dropDuplicates(item_key)
    pool = draws.packed_pool(entries, BY, "transition", F.col("fov"))
    large = pool.large()
    items = items if large is None else draws.ordered.stored(items)  # read for small and for large pools
    filled = _fakes_of_small(items, pool.small(), ids)
    if large is not None:
        filled = filled.unionByName(_fakes_of_large(items, large, item_key))

    def fake(first: int) -> Column:
        return text.seq_text(F.slice("_fakes", first + 1, 3))

    orders = F.array(*[F.array(*[F.lit(i) for i in o]) for o in _ORDERS])
    order = F.get(orders, F.pmod(draws.hash60("order", *ids), F.lit(6)).cast("int"))
    texts = F.struct(
        text.seq_text(F.col("groups")).alias("truth"),
        text.seq_text(F.transform(order, lambda i: F.get("groups", i))).alias("_w0"),
        F.transform(order, lambda i: F.get("groups", i)).alias("_shuffled"),
        fake(0).alias("_w1"),
        fake(3).alias("_w2"),
    )
    shown = filled.select("*", F.inline(F.array(texts)))  # each text is written once, not for every comparison
    usable = (
        (F.col("_shuffled") != F.col("groups"))
        & (F.col("_w1") != F.col("truth")) & (F.col("_w2") != F.col("truth"))
        & (F.col("_w1") != F.col("_w0")) & (F.col("_w2") != F.col("_w0")) & (F.col("_w2") != F.col("_w1"))
    )
    wrong = F.array("_w0", "_w1", "_w2")
    asked = draws.with_options(shown.where(usable), F.col("truth"), wrong, "transition-mix", *ids)
    return asked.select(
        *KEY,
        "draw",
        F.lit("past_transition_pattern").alias("task"),
        range_text(F.col("start_s"), F.col("stop_s")).alias("response_time"),
        F.lit("Which transition best matches the user's gaze pattern?").alias("question"),
        mmss(F.col("stop_s")).alias("time_stamp"),
        "answer",
        "options",
        F.col("groups").alias("correct_sequence"),
    )


def scene_recall(entries: DataFrame, per_session: int = 3) -> DataFrame:
    """Which background name was not visible at a moment."""
    pool = draws.packed_pool(entries, BY, "recall", F.col("outside"))
    sizes = pool.sizes().where(F.col("_n") >= 4)
    looked = entries.where((F.col("kind") == "objects") & (F.size("fov") > 0) & (F.size("outside") >= 3))
    open_items = looked.select(*KEY, "fov", "outside", "start_s").join(sizes, BY)
    # names outside now are a subset of the pool, so a truth exists exactly when the pool is larger
    open_items = open_items.where(F.col("_n") > F.size("outside")).drop("_n")
    chosen = draws.first_per_group(open_items, BY, ["pos"], per_session)
    drawn = draws.draw_from_pool(chosen, pool, BY, KEY, 1, "recall", exclude=F.col("outside"))
    ids = [F.col(k) for k in KEY]
    filled = drawn.withColumn("truth", F.get("drawn", 0)).withColumn(
        "wrong", draws.draw_from_array(F.col("outside"), 3, "visible", *ids)
    )
    asked = draws.with_options(filled, F.col("truth"), F.col("wrong"), "recall-mix", *ids)
    return asked.select(
        *KEY,
        F.lit("past_scene_reconstruction").alias("task"),
        range_text(_not_before_zero(F.col("start_s") - 5), F.col("start_s") + 5).alias("response_time"),
        F.concat(
            F.lit("When the user was gazing at the {"), _names("fov"), F.lit("}, which background object was NOT visible?")
        ).alias("question"),
        mmss(F.col("start_s")).alias("time_stamp"),
        "answer",
        "options",
        F.col("truth").alias("answer_object"),
        F.col("fov").alias("gazed_objects"),
        F.col("outside").alias("background_objects"),
    )


def _identity(filled: DataFrame, seed: str) -> DataFrame:
    asked = draws.with_options(filled, F.col("object"), F.col("wrong"), seed, *[F.col(k) for k in KEY])
    return asked.select(
        *KEY,
        range_text_rounded(F.col("start_s"), F.col("end_s")).alias("response_time"),
        F.lit("What is this?").alias("question"),
        clock_short(F.col("start_s")).alias("time_stamp"),
        "answer",
        "options",
        "object",
    )


def range_text_rounded(start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), clock_short(start), F.lit(" - "), clock_short(end), F.lit("]"))


def askable(episodes: DataFrame) -> DataFrame:
    """Episodes with bounds, a named object and, where the column exists, a caption."""
    out = segments.require_valid_interval(episodes, "object").where(F.trim("object") != "")
    return out.where(F.trim("caption") != "") if "caption" in episodes.columns else out


def identify_easy(episodes: DataFrame) -> DataFrame:
    """Name the gazed object; wrong options are session names never seen close to the gaze."""
    fields = {f: F.transform(objects.trimmed(names), F.lower) for f, names in objects.episode_fields().items()}
    pool = draws.packed_pool(episodes, BY, "identify", F.concat(fields["representative"], fields["outside"]), fields["cropped"])
    items = askable(episodes).select(*KEY, "object", "start_s", "end_s")
    own = F.array(F.lower("object"))
    drawn = draws.draw_from_pool(items, pool, BY, KEY, 3, "identify", exclude=own, keep_unmatched=True)
    spare = F.filter(
        text.words(text.FALLBACK_OBJECTS),
        lambda w: (w != F.lower("object")) & ~F.array_contains(F.col("drawn"), w),
    )
    # only short draws are filled up: the others order no words
    lacking = F.when(F.size("drawn") < 3, spare).otherwise(F.array().cast("array<string>"))
    filler = draws.md5_order(lacking, "fallback", *[F.col(k) for k in KEY])
    filled = drawn.withColumn("wrong", F.slice(F.concat("drawn", filler), 1, 3))
    return _identity(filled, "identify-mix").withColumn("task", F.lit("present_ident_easy"))


def identify_hard(episodes: DataFrame) -> DataFrame:
    """Name the gazed object; wrong options are outside the view at that moment."""
    others = F.filter("outside", lambda o: F.lower(F.trim(o)) != F.lower("object"))
    filled = (
        askable(episodes).withColumn("_o", text.distinct_ci(F.transform(others, F.lower)))
        .where(F.size("_o") >= 3)
        .withColumn("wrong", draws.draw_from_array(F.col("_o"), 3, "hard", *[F.col(k) for k in KEY]))
    )
    return _identity(filled, "hard-mix").withColumn("task", F.lit("present_ident_hard"))


def attribute_questions(annotated: DataFrame, key: str) -> DataFrame:
    """Attribute questions from annotator output; incomplete rows are dropped."""
    clean = annotated.select(
        key,
        "start_s",
        "end_s",
        "object",
        F.lower(F.trim("attribute_type")).alias("attribute_type"),
        F.trim("question").alias("question"),
        F.trim("answer").alias("truth"),
        "distractors",
    )
    complete = clean.where(
        (F.col("attribute_type") != "") & (F.col("question") != "") & (F.col("truth") != "") & (F.size("distractors") > 0)
    )
    asked = draws.with_options(complete, F.col("truth"), F.col("distractors"), "attribute", F.col(key))
    return asked.select(
        key,
        F.lit("present_attr").alias("task"),
        range_text_rounded(F.col("start_s"), F.col("end_s")).alias("response_time"),
        "question",
        clock_short(F.col("start_s")).alias("time_stamp"),
        "answer",
        "options",
        "attribute_type",
        F.col("object").alias("object_name"),
    )


def next_action(
    entries: DataFrame,
    lookback: int = 3,
    low: float = 2.0,
    high: float = 120.0,
    chunk: float = 600.0,
    size: int = timeline.ENTRIES_PER_TILE,
    natural: Callable[[pd.Series], pd.Series] | None = None,
) -> DataFrame:
    """Which action follows the recently seen names.

    ``natural`` rewrites the actions as sentences, once per distinct action; options and answer hold those.
    """
    if natural is not None:
        entries = rewrite_distinct(entries, "action", natural, "_natural")
        entries = entries.withColumn("action", F.coalesce("_natural", "action")).drop("_natural")
    acts = entries.where(F.col("kind") == "action")
    rich = acts.groupBy(*BY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    pool = draws.packed_pool(acts, BY, "action", F.array("action"))
    wide = pool.sizes().where(F.col("_n") >= 4)
    seen = timeline.lookback(entries, lookback, size=size)
    seen = seen.where((F.col("kind") == "objects") & (F.size("context") > 0))
    seen = seen.join(rich, BY, "left_semi").join(wide, BY, "left_semi")
    probes = seen.select(*KEY, F.col("end_s").alias("t"), "context", "context_starts")
    later = acts.select(*KEY, F.col("start_s").alias("t"), "action")
    ahead = joins.next_after(probes, later, BY, "t", chunk, low, high, seq="pos").where(F.col("event").isNotNull())
    ahead = ahead.withColumn("recent", timeline.last_n(F.col("context"), lookback))
    once = ahead.groupBy(*BY, F.array_join("recent", " → ").alias("recent_text")).agg(
        F.min_by(F.struct("pos", "t", "context", "context_starts", "recent", "event"), "pos").alias("_r")
    )
    items = once.select(
        *BY, "recent_text", "_r.pos", "_r.t", "_r.context", "_r.context_starts", "_r.recent",
        F.col("_r.event.action").alias("truth"), F.col("_r.event.t").alias("action_s"),
    )
    drawn = draws.draw_from_pool(items, pool, BY, KEY, 3, "action", exclude=F.array("truth")).where(F.size("drawn") == 3)
    asked = draws.with_options(drawn, F.col("truth"), F.col("drawn"), "action-mix", *[F.col(k) for k in KEY])
    bounds = entries.groupBy(*BY).agg(F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"))
    return asked.join(bounds, BY).select(
        *KEY,
        F.lit("future_action").alias("task"),
        range_text(F.col("first_s"), F.col("last_s")).alias("response_time"),
        F.concat(
            F.lit("Based on the recent fixation pattern ("), "recent_text", F.lit("), what action will the user do next?")
        ).alias("question"),
        mmss(F.col("t")).alias("time_stamp"),
        "answer",
        "options",
        F.col("truth").alias("answer_action"),
        F.col("recent").alias("context_objects"),
        F.zip_with("context", "context_starts", lambda o, s: F.concat(o, F.lit("@"), mmss(s))).alias("context_times"),
        mmss(F.col("action_s")).alias("actual_action_time"),
    )


def alert_spans(entries: DataFrame) -> DataFrame:
    """First start in view (``fov_s``) and outside (``outside_s``) of each name of a session, from one pass over its entries."""

    def marked(side: str, gazed: bool) -> Column:
        names = F.coalesce(side, F.array().cast("array<string>"))
        return F.transform(names, lambda o: F.struct(o.alias("object"), F.lit(gazed).alias("gazed")))

    flat = entries.select(*BY, "start_s", F.explode(F.concat(marked("fov", True), marked("outside", False))).alias("_n"))
    return flat.groupBy(*BY, F.col("_n.object").alias("object")).agg(
        F.min(F.when(F.col("_n.gazed"), F.col("start_s"))).alias("fov_s"),
        F.min(F.when(~F.col("_n.gazed"), F.col("start_s"))).alias("outside_s"),
    )


def _alerts(entries: DataFrame, spans: DataFrame, targets: DataFrame, side: str, task: str, wording: tuple[str, str],
            offsets: Sequence[float] = intervals.ALERT_OFFSETS) -> DataFrame:
    """Alert questions for (session, object, first_s) targets with labelled evaluation points."""
    begun = spans.groupBy(*BY).agg(F.min(F.least("fov_s", "outside_s")).alias("question_s"))
    asked = targets.join(begun, BY).withColumn("points", intervals.alert_points(F.col("first_s"), F.col("question_s"), offsets))
    asked = asked.where(F.size("points") > 0)
    seen = intervals.appearances(entries, side).join(asked, [*BY, "object"])
    # one flag per possible point, or-ed over the appearances with a map-side partial
    hits = [
        F.max((F.col("start_s") <= p) & (p <= F.col("end_s"))).alias(f"_h{i}")
        for i, p in enumerate([F.get("points", i) for i in range(len(offsets))])
    ]
    labelled = seen.groupBy(*BY, "object", "first_s", "question_s", "points").agg(*hits)
    flags = F.array(*[f"_h{i}" for i in range(len(offsets))])
    info = F.transform(
        "points",
        lambda p, i: F.struct(
            mmss(F.floor(p)).alias("realtime"), F.when(F.get(flags, i), 1).otherwise(0).alias("type")
        ),
    )
    made = labelled.withColumn("test_info", info)
    return made.select(
        *BY,
        F.col("object").alias("target_object"),
        F.lit(task).alias("task"),
        F.concat(
            F.lit("["), mmss(F.col("question_s")), F.lit(" - "), F.element_at("test_info", -1)["realtime"], F.lit("]")
        ).alias("response_time"),
        F.concat(F.lit(wording[0]), "object", F.lit(wording[1])).alias("question"),
        mmss(F.col("question_s")).alias("time_stamp"),
        mmss(F.col("first_s")).alias("first_appearance"),
        "test_info",
    )


def alert_target(entries: DataFrame, fixture: Callable[[Column], Column] = text.is_furniture) -> DataFrame:
    """The one viewed name per session an alert is asked for."""
    return _gazed_target(alert_spans(entries), fixture)


def _gazed_target(spans: DataFrame, fixture: Callable[[Column], Column]) -> DataFrame:
    viewed = spans.where(F.col("fov_s").isNotNull() & ~fixture(F.col("object")))
    draw = draws.digest("alert", F.col("session_id"), F.col("object"))
    first = F.struct("object", F.col("fov_s").alias("first_s"))
    return viewed.groupBy(*BY).agg(F.min_by(first, draw).alias("_t")).select(*BY, "_t.*")


def alert_gaze(entries: DataFrame, fixture: Callable[[Column], Column] = text.is_furniture) -> DataFrame:
    """Alert when the user gazes at one drawn name."""
    wording = ("Monitor my gaze and alert me when I gaze on the <", ">.")
    entries = draws.ordered.stored(entries)
    spans = cut(alert_spans(entries))  # read for the targets and the start of the session
    return _alerts(entries, spans, _gazed_target(spans, fixture), "fov", "future_remind_easy", wording)


def alert_appear(entries: DataFrame, fixture: Callable[[Column], Column] = text.is_furniture) -> DataFrame:
    """Alert when a name first appears outside the view; the gaze-alert name is left out."""
    entries = draws.ordered.stored(entries)
    spans = cut(alert_spans(entries))
    outside = spans.where(F.col("outside_s").isNotNull() & ~fixture(F.col("object")))
    rest = outside.select(*BY, "object", F.col("outside_s").alias("first_s")).join(
        _gazed_target(spans, fixture), [*BY, "object"], "left_anti"
    )
    wording = ("Watch the scene and alert me when the <", "> first appears.")
    return _alerts(entries, spans, rest, "outside", "future_remind_hard", wording)


def with_intervals(asked: DataFrame, entries: DataFrame, side: str, chunk: float = 600.0) -> DataFrame:
    """Alert questions with ``fixation_intervals``, the merged spans of their name in order."""
    names = asked.select(*BY, F.col("target_object").alias("object")).distinct()
    merged = alert_intervals(entries, names, side, chunk)
    nested = merged.groupBy(*BY, F.col("object").alias("target_object")).agg(
        F.sort_array(F.collect_list(F.struct("start_s", "end_s"))).alias("_spans")
    )
    spans = F.transform("_spans", lambda s: F.struct(mmss(s["start_s"]).alias("start"), mmss(s["end_s"]).alias("end")))
    return asked.join(nested, [*BY, "target_object"], "left").withColumn("fixation_intervals", spans).drop("_spans")


def alert_intervals(entries: DataFrame, targets: DataFrame, side: str, chunk: float = 600.0) -> DataFrame:
    """Merged intervals of the alert names, flat (session, object, start, end) rows."""
    seen = intervals.appearances(entries, side).join(targets.select(*BY, "object"), [*BY, "object"], "left_semi")
    return intervals.merge_intervals(seen, [*BY, "object"], gap=10.0, chunk=chunk)

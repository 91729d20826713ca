"""Rule and verdict filters over question tables.

A filter maps a question table to the same table plus ``reason``: null for kept rows, else
the first rule that dropped the row. ``split`` separates both, ``drop_counts`` accounts
for them. Model verdicts come in as tables and are joined on the item key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanflow.functions import text
from scanflow.functions.timecode import parse_clock, range_text
from scanflow.operators import draws, objects

Filter = Callable[[DataFrame], DataFrame]


def reasons(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that holds; a rule that is null does not hold."""
    out = None
    for rule, name in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out


def split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return flagged.where(F.col("reason").isNull()).drop("reason"), flagged.where(F.col("reason").isNotNull())


def drop_log(flagged: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per dropped item with its reason."""
    return flagged.where(F.col("reason").isNotNull()).select(*key, "reason")


def drop_counts(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per outcome; kept rows count under ``kept``."""
    return flagged.groupBy(*by, F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def values(options: Column) -> Column:
    return F.transform(options, text.option_value)


def next_action(items: DataFrame, low: int = 3, high: int = 60) -> DataFrame:
    """Gap, context and leak rules; kept rows get a window from the question to action + 5 s."""
    asked, acted = parse_clock(F.col("time_stamp")), parse_clock(F.col("actual_action_time"))
    gap = acted - asked
    reason = reasons(
        (gap <= low, "gap_too_short"),
        (gap > high, "gap_too_long"),
        (text.is_generic_context(F.col("context_objects")), "generic_context"),
        (text.context_leaks(F.col("context_objects"), F.col("answer_action")), "context_in_answer"),
    )
    return (
        items.withColumn("reason", reason)
        .withColumn("needs_polish", text.needs_polish(F.col("options")))
        .withColumn("response_time", range_text(asked, acted + 5))
    )


def alert_appear(items: DataFrame) -> DataFrame:
    return items.withColumn("reason", reasons((text.is_ambiguous(F.col("target_object")), "ambiguous_object")))


def alert_gaze(items: DataFrame, verdicts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Nothing is dropped: a type-0 point turns into 1 when its verdict says yes.

    ``verdicts`` holds (key, point, verdict) with verdict 1, 0 or -1. Points are joined
    flat on (key, point) and nested again, at most five per item.
    """
    key = list(key)
    points = items.select(*key, F.posexplode("test_info").alias("point", "_t"))
    judged = points.join(verdicts.select(*key, "point", "verdict"), [*key, "point"], "left")
    flipped = (F.col("_t.type") == 0) & (F.col("verdict") == 1)
    skipped = (F.col("_t.type") == 0) & F.coalesce(F.col("verdict") < 0, F.lit(True))
    renewed = F.struct(
        F.col("_t.realtime").alias("realtime"),
        F.when(F.coalesce(flipped, F.lit(False)), 1).otherwise(F.col("_t.type")).alias("type"),
    )
    nested = judged.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("point", renewed.alias("t")))).alias("_ps"),
        F.count_if(flipped).alias("n_changed"),
        F.count_if(skipped).alias("n_skipped"),
    )
    out = items.drop("test_info").join(nested, key, "left")
    return out.withColumn("test_info", F.transform("_ps", lambda p: p["t"])).drop("_ps").withColumn(
        "reason", F.lit(None).cast("string")
    )


def _clip_seconds(items: DataFrame, default: float) -> Column:
    """Length of the clip; read items name it ``input_video_clip``."""
    name = next((c for c in ("clip", "input_video_clip") if c in items.columns), None)
    if name is None:
        return F.lit(default)
    return F.coalesce(F.get(name, F.lit(1)) - F.get(name, F.lit(0)), F.lit(default))


def _renamed_options(options: Column) -> Column:
    """Names normalised, letters kept."""
    return F.transform(
        options,
        lambda o: F.when(
            o.contains(". "), F.concat(text.option_letter(o), F.lit(". "), text.norm_name(text.option_value(o)))
        ).otherwise(text.norm_name(o)),
    )


def attribute(items: DataFrame, verdicts: DataFrame | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Clip, human and subjective-type rules; the second member of a confusing pair is replaced.

    ``verdicts`` holds (key, second, replacement, frames_read): a suggested value for the
    pair's second member, or frames_read false when its frames could not be read.
    """
    key = list(key)
    named = items.withColumn("object_name", text.norm_name(F.col("object_name"))).withColumn(
        "options", _renamed_options(F.col("options"))
    )
    reason = reasons(
        (_clip_seconds(items, 10.0) == 0, "zero_duration"),
        (text.is_human(F.col("object_name")), "human_object"),
        (F.col("attribute_type").isin(text.SUBJECTIVE_ATTRIBUTES), "subjective_type"),
    )
    pairs = text.confusing_pairs(values(F.col("options")), F.col("attribute_type"))
    flagged = named.withColumn("reason", reason).withColumn(
        "confusing", F.when(F.col("reason").isNull(), pairs).otherwise(F.slice(pairs, 1, 0))
    )
    if verdicts is None:
        return flagged
    hints = verdicts.groupBy(*key).agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("replacement").isNotNull(), F.struct("second", "replacement")))
        ).alias("_hint"),
        F.min("frames_read").alias("_read"),
    )
    joined = flagged.join(hints, key, "left")
    lost = F.col("reason").isNull() & (F.size("confusing") > 0) & ~F.coalesce(F.col("_read"), F.lit(True))
    seconds = F.array_distinct(F.transform("confusing", lambda p: p["second"]))

    def swap(opts: Column, second: Column) -> Column:
        hint = F.try_element_at(F.col("_hint"), second)
        texts = values(opts)
        usable = hint.isNotNull() & ~F.array_contains(texts, F.coalesce(hint, F.lit("")))
        at = F.array_position(texts, second)
        return F.when(
            usable & (at > 0),
            F.transform(opts, lambda o, i: F.when(i + 1 == at, F.concat(F.char(F.lit(65) + i), F.lit(". "), hint)).otherwise(o)),
        ).otherwise(opts)

    repaired = F.aggregate(seconds, F.col("options"), swap)
    return (
        joined.withColumn("reason", F.when(lost, "frames_missing").otherwise(F.col("reason")))
        .withColumn("options", F.when(F.col("reason").isNull(), repaired).otherwise(F.col("options")))
        .drop("_hint", "_read")
    )


def identify(items: DataFrame) -> DataFrame:
    """Clip and human rules; of a singular/plural pair the plural option is removed.

    The options are lettered again; a question left with fewer than four options, or
    without its truth, is dropped.
    """
    named = items.withColumn("object", text.norm_name(F.col("object"))).withColumn(
        "options", _renamed_options(F.col("options"))
    )
    # each step is a column of its own: lambdas read it instead of computing it per element
    texts = F.col("_texts")
    plurals = F.create_map(*[F.lit(w) for one, many in text.SINGULAR_PLURAL for w in (many, one)])
    extra = F.filter(texts, lambda v: F.array_contains(texts, F.try_element_at(plurals, v)))
    left = F.filter(texts, lambda v: ~F.array_contains(F.col("_extra"), v))
    prepared = named.withColumn("_texts", values(F.col("options"))).withColumn("_extra", extra)
    prepared = prepared.withColumn("_left", left).withColumn("_truth", F.get(texts, F.ascii("answer") - 65))
    paired = F.size("_extra") > 0
    gone = paired & ((F.size("_left") < 4) | F.array_contains("_extra", F.col("_truth")))
    reason = reasons(
        (_clip_seconds(items, 10.0) == 0, "zero_duration"),
        (text.is_human(F.col("object")), "human_object"),
        (gone, "similar_options"),
    )
    place = F.ascii("answer") - 65
    before = F.size(F.filter(F.slice(texts, F.lit(1), place), lambda v: F.array_contains(F.col("_extra"), v)))
    letter = F.char(F.lit(65) + place - before)
    repair = paired & reason.isNull()
    return (
        prepared.withColumn("reason", reason)
        .withColumn("answer", F.when(repair, letter).otherwise(F.col("answer")))
        .withColumn("options", F.when(repair, draws.lettered(F.col("_left"))).otherwise(F.col("options")))
        .drop("_texts", "_extra", "_truth", "_left")
    )


def similar_pairs(options: Column) -> Column:
    """Index pairs i < j of names too close to tell apart, in order.

    ``options`` holds (name, words) structs, so that words are split once per name.
    """
    n = F.size(options)
    indices = F.sequence(F.lit(0), n - 1)
    every = F.flatten(
        F.transform(
            indices,
            lambda i: F.transform(
                F.filter(indices, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j"))
            ),
        )
    )

    def close(p: Column) -> Column:
        a, b = F.get(options, p["i"]), F.get(options, p["j"])
        return text.similar_names(a["name"], b["name"], wa=a["words"], wb=b["words"])

    return F.filter(every, close)


def next_after_group(items: DataFrame, key: Sequence[str], verdicts: DataFrame | None = None, pool_digits: int = 2) -> DataFrame:
    """Human rule; one member of each similar option pair is replaced.

    The replacement of pair number ``nr`` is a verdict (key, nr, replacement) or else a name
    drawn from all names of the data set that the question does not use yet. The pool is
    ranked once, in 16 to the power of ``pool_digits`` chunks, and read by equi-join, so no question meets the
    whole pool.
    """
    key = list(key)

    def blank(col: Column) -> Column:
        return F.replace(col, F.lit("_"), F.lit(" "))

    clean = (
        items.withColumn("options", F.transform("options", blank))
        .withColumn("answer_object", blank(F.col("answer_object")))
        .withColumn("object_group", F.transform("object_group", blank))
        .withColumn("_texts", values(F.col("options")))
    )
    human = F.exists("_texts", text.is_human)
    split_up = F.transform("_texts", lambda t: F.struct(t.alias("name"), text.name_words(t).alias("words")))
    flagged = clean.withColumn("reason", reasons((human, "human_object"))).withColumn("_words", split_up)
    none = F.array().cast("array<struct<i:int,j:int>>")
    pairs = F.when(F.col("reason").isNull(), similar_pairs(F.col("_words"))).otherwise(none)
    flagged = flagged.withColumn("_pairs", pairs).drop("_words")
    names = clean.select(
        F.lit(0).alias("_all"),
        F.explode(F.concat("_texts", F.array("answer_object"), "object_group")).alias("object"),
    )
    pool = draws.ranked_pool(names, ["_all"], "repair", digits=pool_digits)
    # no filter on the pairs: pushed down, it would compare all names a second time
    close = flagged.withColumn("_all", F.lit(0))
    banned = F.array_union(F.array_union("_texts", "object_group"), F.array("answer_object"))
    spare = draws.draw_from_pool(
        close, pool, ["_all"], key, F.size("_pairs"), "repair", exclude=banned, out="_spare", keep_unmatched=True, one_pool=True,
        needed=F.size("_pairs") > 0,
    ).drop("_all")
    if verdicts is not None:
        hints = verdicts.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("nr", "replacement"))).alias("_hint"))
        spare = spare.join(hints, key, "left")
    else:
        spare = spare.withColumn("_hint", F.lit(None).cast("map<int,string>"))

    start = F.struct(F.col("_texts").alias("texts"), F.lit(0).alias("nr"), F.lit(0).alias("fixed"))

    def replace(state: Column, pair: Column) -> Column:
        second_is_truth = F.col("answer_object") == F.get("_texts", pair["j"])
        first_is_truth = F.col("answer_object") == F.get("_texts", pair["i"])
        at = F.when(second_is_truth & ~first_is_truth, pair["i"]).otherwise(pair["j"])
        hint = F.try_element_at(F.col("_hint"), state["nr"])
        unused = F.get(F.filter("_spare", lambda s: ~F.array_contains(state["texts"], s)), 0)
        new = F.when(hint.isNull(), unused).when(~F.array_contains(state["texts"], hint), hint)
        # binding the choice to a lambda variable evaluates it once per pair
        chosen = F.array(F.struct(at.alias("at"), new.alias("new")))

        def step(c: Column) -> Column:
            fits = c["new"].isNotNull()
            texts = F.transform(state["texts"], lambda t, i: F.when(fits & (i == c["at"]), c["new"]).otherwise(t))
            fixed = state["fixed"] + F.when(fits, 1).otherwise(0)
            return F.struct(texts.alias("texts"), (state["nr"] + 1).alias("nr"), fixed.alias("fixed"))

        return F.get(F.transform(chosen, step), 0)

    folded = spare.withColumn("_s", F.aggregate("_pairs", start, replace))
    lettered = F.when(F.size("_pairs") > 0, draws.lettered(F.col("_s.texts"))).otherwise(F.col("options"))
    repaired = folded.withColumn("options", lettered).withColumn("n_fixed", F.col("_s.fixed"))
    return repaired.drop("_texts", "_pairs", "_spare", "_hint", "_s")


def _judged(items: DataFrame, verdicts: DataFrame | None, key: Sequence[str]) -> DataFrame:
    if verdicts is None:
        return items.withColumn("_verdict", F.lit(None).cast("int"))
    return items.join(verdicts.select(*key, F.col("verdict").alias("_verdict")), list(key), "left")


def scene_recall(items: DataFrame, verdicts: DataFrame | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Short clip, human, gazed-among-options and verdict rules."""
    reason = reasons(
        (_clip_seconds(items, 100.0) < 5, "short_clip"),
        (F.exists("gazed_objects", text.is_human), "human_object"),
        (objects.option_overlap(values(F.col("options")), F.col("gazed_objects")), "gazed_in_options"),
        (F.col("_verdict") == 0, "verdict_invalid"),
    )
    return _judged(items, verdicts, key).withColumn("reason", reason).drop("_verdict")


def transition(items: DataFrame, verdicts: DataFrame | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Identical neighbours, short sequence and verdict rules."""
    reason = reasons(
        (objects.has_identical_neighbours(F.col("correct_sequence")), "identical_neighbours"),
        (F.size("correct_sequence") < 2, "short_sequence"),
        (F.col("_verdict") == 0, "verdict_invalid"),
    )
    return _judged(items, verdicts, key).withColumn("reason", reason).drop("_verdict")


def apply_verdicts(
    items: DataFrame, verdicts: DataFrame, key: Sequence[str], label: str | None = None, text_col: str | None = None
) -> DataFrame:
    """Join model verdicts: 0 drops the item, ``relabel`` and ``replacement`` overwrite columns."""
    judged = items.join(verdicts, list(key), "left")
    out = judged.withColumn("reason", F.when(F.col("verdict") == 0, "verdict_invalid"))
    if label is not None:
        out = out.withColumn(label, F.coalesce(F.col("relabel"), F.col(label)))
    if text_col is not None:
        out = out.withColumn(text_col, F.coalesce(F.col("replacement"), F.col(text_col)))
    return out.select(*items.columns, "reason")


def run_filters(tables: dict[str, DataFrame], registry: dict[str, Filter], key: str = "item_key") -> DataFrame:
    """Route named question tables to their filters; unrouted names are skipped.

    Returns flat (file, task, item, reason) rows for all of them.
    """
    parts = []
    for name, table in tables.items():
        task = route(name)
        if task in registry:
            flagged = registry[task](table)
            parts.append(
                flagged.select(
                    F.lit(name).alias("file"), F.lit(task).alias("task"), F.col(key).alias("item"), "reason"
                )
            )
    if not parts:
        raise ValueError("no table has a filter")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def route(name: str) -> str | None:
    """Driver-side twin of ``text.task_from_name`` for file names."""
    low = name.lower()
    return next((task for task, keys in text.TASK_ROUTES if any(k in low for k in keys)), None)

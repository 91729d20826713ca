"""Scores of model replies: choice, alert, timing, latency, overall, judge, leaderboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanflow.functions import text
from scanflow.operators import joins
from scanflow.operators.quantiles import exact_quantiles

# Task keys of result files and their report names.
TASK_NAMES = {
    "past_gaze_sequence_matching": "Gaze Sequence Matching",
    "past_non_fixated_object_identification": "Non-fixated Object ID",
    "past_object_transition_prediction": "Object Transition Prediction",
    "past_scene_recall": "Scene Recall",
    "present_future_action_prediction": "Future Action Prediction",
    "present_object_attribute_recognition": "Object Attribute Recognition",
    "present_object_identification_easy": "Object ID (Easy)",
    "present_object_identification_hard": "Object ID (Hard)",
    "proactive_gaze_triggered_alert": "Gaze-Triggered Alert",
    "proactive_object_appearance_alert": "Object Appearance Alert",
}


def _accuracy(hit: Column, counted: Column) -> list[Column]:
    correct, total = F.count_if(counted & hit), F.count_if(counted)
    share = F.when(total > 0, correct * 100.0 / F.when(total > 0, total)).otherwise(0.0)
    return [correct.alias("n_correct"), total.alias("n_total"), share.alias("accuracy")]


def score_choice(replies: DataFrame, by: Sequence[str], truth: str = "truth", reply: str = "reply") -> DataFrame:
    """Share of replies whose answer letter matches; blank truths do not count."""
    want, got = text.answer_letter(F.col(truth)), text.answer_letter(F.col(reply))
    return replies.groupBy(*by).agg(*_accuracy(want == got, want != ""))


def score_result_items(items: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Items with parallel ``answers`` and ``replies`` arrays, paired by position."""
    pairs = joins.zip_positions(items, "answers", "replies", [key, *by])
    return score_choice(pairs, by, "answers", "replies")


def score_results(items: DataFrame, strict: bool = False) -> DataFrame:
    """Accuracy per (model, task) of result items: files whose questions hold test points are scored as
    alerts, the others as choices.

    A blank truth does not count; a task without counted replies has accuracy 0.
    """
    by = ["model", "task"]
    first = F.get("questions", F.lit(0))
    kinds = items.groupBy(*by).agg(F.max(F.coalesce(first["test_info"].isNotNull(), F.lit(False))).alias("_alert"))
    # one row per result file: the items of a file need not meet in one task
    known = items.join(F.broadcast(kinds), by)
    points = known.where("_alert").select(*by, F.explode("questions").alias("q")).select(*by, F.inline("q.test_info"))
    choices = known.where("not _alert").select(
        *by,
        F.transform("questions", lambda q: q["answer"]).alias("answers"),
        F.transform("model_predictions", lambda p: p["model_prediction"]).alias("replies"),
    )
    found = score_choice(joins.zip_positions(choices, "answers", "replies", by), by, "answers", "replies")
    columns = [*by, "n_correct", "n_total", "accuracy"]
    return found.select(*columns).unionByName(score_alert(points, by, strict).select(*columns))


def score_alert(points: DataFrame, by: Sequence[str], strict: bool = False) -> DataFrame:
    """Alert accuracy per test point (``type`` 1 or 0, ``response``) with precision, recall and F1.

    A point is right when YES (NO) occurs in the reply, so "unknown" counts as NO; with
    ``strict`` the word must stand alone. A null reply is a missing one and right for neither type; a writer
    that puts a null as the text ``None`` makes it hold NO.
    """
    up = F.upper(F.trim(F.coalesce("response", F.lit(""))))
    says = {w: up.rlike(rf"\b{w}\b") if strict else up.contains(w) for w in ("YES", "NO")}
    hit = F.when(F.col("type") == 1, says["YES"]).otherwise(says["NO"])
    out = points.where(F.col("type").isNotNull()).groupBy(*by).agg(
        *_accuracy(hit, F.lit(True)),
        F.count_if((F.col("type") == 1) & says["YES"]).alias("_tp"),
        F.count_if((F.col("type") == 0) & says["YES"]).alias("_fp"),
        F.count_if((F.col("type") == 1) & ~says["YES"]).alias("_fn"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)

    return out.select(
        *by, "n_correct", "n_total", "accuracy",
        ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")).alias("precision"),
        ratio(F.col("_tp"), F.col("_tp") + F.col("_fn")).alias("recall"),
        ratio(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")).alias("f1"),
    )


def timed(replies: DataFrame, margin: float = 3.0) -> DataFrame:
    """Replies with ``on_time`` and the distance to the middle of the truth window."""
    middle = (F.col("window_start") + F.col("window_end")) / 2
    return replies.withColumn(
        "on_time", text.in_window(F.col("seconds"), F.col("window_start"), F.col("window_end"), margin)
    ).withColumn("error_s", F.abs(F.col("seconds") - middle))


def score_timing(replies: DataFrame, subtask: str, margin: float = 3.0) -> DataFrame:
    """Share of replies in their window and response statistics, per subtask and overall (null subtask)."""
    return timed(replies, margin).rollup(subtask).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("on_time").alias("n_on_time"),
        F.avg(F.when(F.col("on_time"), 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg("seconds").alias("mean_seconds"),
        F.stddev_pop("seconds").alias("std_seconds"),
        F.avg("error_s").alias("mean_error"),
        F.stddev_pop("error_s").alias("std_error"),
    )


def score_latency(replies: DataFrame, task: str, width: float = 1.0) -> DataFrame:
    """Latency statistics per task and over all tasks (``overall``)."""
    both = replies.select(
        F.explode(F.array(F.col(task), F.lit("overall"))).alias("task"), F.col("seconds")
    ).where(F.col("seconds").isNotNull())
    basic = both.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("seconds").alias("mean"),
        F.coalesce(F.stddev_samp("seconds"), F.lit(0.0)).alias("std"),
        F.min("seconds").alias("min"),
        F.max("seconds").alias("max"),
    )
    ranks = exact_quantiles(both, ["task"], "seconds", {"median": 0.5, "p95": 0.95, "p99": 0.99}, width)
    return basic.join(ranks, "task")


def score_overall(
    timing: DataFrame, quality: DataFrame, key: str, seq: str, subtask: str, timing_weight: float = 0.5
) -> DataFrame:
    """Mean and population deviation of timing, text and weighted scores, per subtask and overall.

    ``timing`` holds (key, subtask, on_time), ``quality`` (key, seq, text_score); the last
    quality row of a key wins and a null key matches a null key.
    """
    both = joins.equi_join_last(timing, quality, key, seq)
    hit = F.when(F.col("on_time"), 1.0).otherwise(0.0)
    rows = both.select(
        subtask,
        hit.alias("timing"),
        F.col("text_score").alias("text"),
        text.weighted_score(hit, F.col("text_score"), timing_weight, 1 - timing_weight).alias("overall"),
    )
    stats = [f(c).alias(f"{c}_{n}") for c in ("timing", "text", "overall") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return rows.rollup(subtask).agg(F.count(F.lit(1)).alias("n"), *stats)


def score_judge(judged: DataFrame, by_letter: bool = False, scores: Sequence[int] = range(6)) -> DataFrame:
    """Yes/no counts, mean score and score histograms: total, per answer type, optionally per first letter.

    Rows carry ``grp``: ``total``, the type, or its first letter.
    """
    low = F.lower("pred")
    says = F.when(low.contains("yes"), "yes").when(low.contains("no"), "no")
    groups = [F.lit("total"), F.col("a_type")] + ([F.substring("a_type", 1, 1)] if by_letter else [])
    flat = judged.select(
        says.alias("says"), "score", F.explode(F.filter(F.array(*groups), lambda g: g.isNotNull())).alias("grp")
    )
    hist = [
        F.count_if((F.col("says") == word) & (F.col("score") == s)).alias(f"{word}_{s}")
        for word in ("yes", "no")
        for s in scores
    ]
    return flat.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("says") == "yes").alias("n_yes"),
        F.count_if(F.col("says") == "no").alias("n_no"),
        F.avg(F.when(F.col("says") == "yes", 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg("score").alias("mean_score"),
        *hist,
    )


def result_grid(models: DataFrame, scores: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """Every (model, task) cell; cells without results show ``N/A`` and zero counts.

    ``models`` and the task list are small dimensions by nature: their product is the report.
    """
    names = F.create_map(*[F.lit(v) for pair in tasks.items() for v in pair])
    cells = models.select("model", F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task"))
    found = cells.join(scores, ["model", "task"], "left")
    return found.select(
        "model",
        "task",
        names[F.col("task")].alias("task_name"),
        "accuracy",
        F.when(F.col("accuracy").isNull(), "N/A").otherwise(F.format_string("%.2f", "accuracy")).alias("accuracy_text"),
        F.coalesce("n_correct", F.lit(0)).alias("n_correct"),
        F.coalesce("n_total", F.lit(0)).alias("n_total"),
    )


def pivot_summary(grid: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """Model x task accuracy matrix."""
    return grid.groupBy("model").pivot("task", list(tasks)).agg(F.first("accuracy"))


def macro_average(grid: DataFrame) -> DataFrame:
    """Unweighted mean over the tasks a model has results for; 0 without any."""
    return grid.groupBy("model").agg(F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("average"))

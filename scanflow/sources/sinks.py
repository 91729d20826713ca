"""Writers: tables, questions, summaries, reports, and incremental runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanflow.sources import commits


def write_table(df: DataFrame, path: str, by: Sequence[str] = ("session_id",), fmt: str = "parquet") -> None:
    """One folder per key value. Rows are dealt by key, and large keys split, so files follow the data's size."""
    writer = df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by)
    writer.option("header", "true").format(fmt).save(path)


def write_questions(df: DataFrame, path: str) -> None:
    """JSON lines, one folder per task."""
    df.write.mode("overwrite").partitionBy("task").json(path)


def write_results(items: DataFrame, root: str, model: str, tasks: Sequence[str], variant: str = "results") -> None:
    """One ``<model>/<variant>/<task>_output.json`` folder of JSON lines per task."""
    for task in tasks:
        one = items.where(F.col("task") == task).drop("task", "model")
        one.write.mode("overwrite").json(f"{root}/{model}/{variant}/{task}_output.json")


#: What a task asks of a reader.
ABILITIES = {
    "past_next_after_group": "scanpath_reasoning", "past_never_gazed": "scanpath_reasoning",
    "past_transition_pattern": "temporal_reasoning", "past_scene_reconstruction": "episodic_memory",
    "present_ident_easy": "object_grounding", "present_ident_hard": "object_grounding", "present_attr": "object_grounding",
    "future_action": "predictive_reasoning", "future_remind_easy": "object_tracking", "future_remind_hard": "object_tracking",
}


def question_items(
    questions: DataFrame, extra: Sequence[str] = (), session: str = "session_id", video: str = "{}.mp4", category: str = ""
) -> DataFrame:
    """Flat questions as items with a nested ``questions`` array, the exchange form.

    An item names its recording (``video``, the pattern filled with the session) and the recording's
    category, and each question the ability it asks for.
    """
    ability = F.create_map(*[F.lit(v) for pair in ABILITIES.items() for v in pair])
    fields = [c for c in ("question", "time_stamp", "answer", "options", *extra) if c in questions.columns]
    path = F.regexp_replace(F.lit(video), r"\{\}", F.col(session).cast("string"))
    return questions.select(
        "task",
        "response_time",
        path.alias("video"),
        F.lit(category).alias("video_categories"),
        F.array(
            F.struct(F.col("task").alias("task_type"), *fields, ability[F.col("task")].alias("required_ability"))
        ).alias("questions"),
    )


def write_summary(counts: DataFrame, path: str) -> None:
    """Outcome counts with the time of the run; the counts are one row per task and outcome."""
    counts.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").json(path)


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per report table."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")


def pending(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no output yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_incremental(df: DataFrame, path: str, keys: Sequence[str], run: str | None = None) -> int:
    """Add the rows of keys that are not there yet; a rerun adds nothing, and repeating the run ``run`` does nothing.

    Returns the number of rows added. ``read_incremental`` reads the table (see ``sources/commits``).
    """
    return commits.write_commit(df, path, keys, run)


def read_incremental(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return commits.read_commits(spark, path, schema)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Rewrite only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

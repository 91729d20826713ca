"""Model requests: prompts, visible windows, test points, and user functions applied to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanflow.functions.text import fenced_json
from scanflow.functions.timecode import parse_clock
from scanflow.session import cut

# Prompt texts.
GAZE_INSTRUCTION = (
    "In this video, the green dot represents the gaze point (where the person is looking), "
    "and the red circle represents the field of view (FOV) area.\n\n"
)
FOUR_OPTION_RULE = "Answer the question with only the letter (A, B, C, or D) of the correct option."
OPEN_RULE = "Analyze the video and provide the answer to the question."
ALERT_HEAD = (
    "You are monitoring a video stream. Based on what you have seen so far in the video, "
    "answer the following question.\n<video>\n\nQuestion: "
)
ALERT_TAIL = (
    "\n\nIf you have already seen the requested object/event, answer \"Yes\".\n"
    "If you have not seen it yet, answer \"No\".\n\n"
    "Answer only with \"Yes\" or \"No\".\n"
    "Do not include any additional text or explanation in your response.\n"
)
PRESENT_SECONDS = 60.0


def option_letters(options: Column) -> Column:
    """Options with ``A.``, ``B.``, ... unless the first one already has its letter."""
    return F.when(F.get(options, 0).startswith("A."), options).otherwise(
        F.transform(options, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), o))
    )


def choice_prompt(question: Column, options: Column, instruct: bool = False) -> Column:
    head = F.lit(GAZE_INSTRUCTION if instruct else "")
    n = F.coalesce(F.size(options), F.lit(0))
    shown = F.array_join(option_letters(options), "\n")
    listed = F.concat(F.lit("Question: "), question, F.lit("\nOptions:\n"), shown)
    best = F.lit("\n\nThe best option is:")
    return (
        F.when(n <= 0, F.concat(head, F.lit("\nQuestion: "), question, F.lit(f"\n{OPEN_RULE}\n\n\nAnswer:")))
        .when(n == 4, F.concat(head, F.lit("\n"), listed, F.lit(f"\n{FOUR_OPTION_RULE}"), best))
        .otherwise(F.concat(head, listed, best))
    )


def alert_prompt(question: Column, instruct: bool = False) -> Column:
    return F.concat(F.lit(GAZE_INSTRUCTION if instruct else ""), F.lit(ALERT_HEAD), question, F.lit(ALERT_TAIL))


def choice_requests(questions: DataFrame, past: bool, instruct: bool = False) -> DataFrame:
    """One request per question: prompt and the window of the recording it may see."""
    at = parse_clock(F.col("time_stamp"), otherwise="number")
    start = F.lit(0.0) if past else F.greatest(at - PRESENT_SECONDS, F.lit(0.0))
    return questions.select(
        "*",
        choice_prompt(F.col("question"), F.col("options"), instruct).alias("prompt"),
        start.alias("window_start"),
        at.alias("window_end"),
        (at + 0.1).alias("question_time"),
    )


def alert_requests(questions: DataFrame, instruct: bool = False) -> DataFrame:
    """One request per unanswered test point; it sees the recording from 0 up to the point."""
    points = questions.select(
        *[c for c in questions.columns if c != "test_info"], F.posexplode("test_info").alias("point", "_t")
    )
    if "response" in questions.schema["test_info"].dataType.elementType.names:
        points = points.where(F.col("_t.response").isNull())
    return points.select(
        *[c for c in points.columns if c != "_t"],
        F.col("_t.realtime").alias("realtime"),
        F.col("_t.type").alias("type"),
        alert_prompt(F.col("question"), instruct).alias("prompt"),
        F.lit(0.0).alias("window_start"),
        parse_clock(F.col("_t.realtime"), otherwise="number").alias("window_end"),
    )


def predict(requests: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], keep: list[str]) -> DataFrame:
    """Apply a user model to Arrow batches of requests.

    ``fn`` gets a batch and returns ``text`` and ``seconds`` aligned with it. A batch whose
    call raises is retried row by row, so one bad request costs one ``error``, not its batch.
    """
    schema = T.StructType(
        [requests.schema[c] for c in keep]
        + [
            T.StructField("text", T.StringType()),
            T.StructField("seconds", T.DoubleType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def answered(batch: pd.DataFrame) -> pd.DataFrame:
        out = batch[keep].reset_index(drop=True)
        got = fn(batch).reset_index(drop=True)
        return out.assign(text=got["text"], seconds=got["seconds"].astype(float), error=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield answered(batch)
            except Exception:  # noqa: BLE001 - any user error becomes a row
                for i in range(len(batch)):
                    one = batch.iloc[i : i + 1]
                    try:
                        yield answered(one)
                    except Exception as error:  # noqa: BLE001
                        yield one[keep].assign(text=None, seconds=None, error=str(error))

    return requests.mapInPandas(run, schema)


def annotate(
    segments: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], keep: list[str], schema: str
) -> DataFrame:
    """Apply a user annotator to Arrow batches of segments and parse its reply.

    ``fn`` returns one reply text per row, JSON of ``schema`` with or without a code fence.
    Each row gets its parsed ``annotation``; ``error`` tells a failed call or an unreadable reply.
    """
    replied = predict(segments, lambda batch: pd.DataFrame({"text": fn(batch), "seconds": 0.0}), keep)
    parsed = replied.withColumn("annotation", fenced_json(F.col("text"), schema))
    unread = F.when(F.col("annotation").isNull(), F.lit("reply is not readable"))
    return parsed.withColumn("error", F.coalesce("error", unread)).drop("text", "seconds")


#: Rows that share one copy of a value.
VALUE_ROWS = 100_000


def rewrite_distinct(df: DataFrame, col: str, fn: Callable[[pd.Series], pd.Series], out: str) -> DataFrame:
    """Apply ``fn`` once per distinct value of ``col`` and join the result back.

    Rows with a frequent value, or none, are dealt over as many copies of its result as ``VALUE_ROWS`` asks for.
    """
    udf = F.pandas_udf(fn, T.StringType())
    copies = F.floor(F.count(F.lit(1)) / F.lit(VALUE_ROWS)) + 1
    values = cut(df.select(F.col(col).alias("_value")).groupBy("_value").agg(copies.alias("_copies")).withColumn(out, udf("_value")))
    # at most one value for VALUE_ROWS rows
    frequent = F.broadcast(values.where(F.col("_copies") > 1).select("_value", F.col("_copies").alias("_of")))
    dealt = df.join(frequent, F.col(col).eqNullSafe(F.col("_value")), "left").drop("_value")
    dealt = dealt.withColumn("_copy", F.pmod(F.monotonically_increasing_id(), F.coalesce("_of", F.lit(1)))).drop("_of")
    spread = values.select("_value", out, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_nr"))
    same = F.col(col).eqNullSafe(F.col("_value")) & (F.col("_copy") == F.col("_nr"))
    return dealt.join(spread, same, "left").drop("_value", "_copy", "_nr")

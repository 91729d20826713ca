"""Readers of recordings, annotations, questions and result files.

Line files are read as splittable text: a line's place in its file comes from its block
offset and its order inside the block, so even a very long recording is not read whole by
one task; arrays are read by row ranges (``sources/arrays``). JSON array files (one per session or task) are single
records by format; ingest those once and keep the result as Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanflow.functions.text import caption_from_attributes, stem
from scanflow.functions.timecode import frame_code
from scanflow.operators import frames, ordered
from scanflow.sources import arrays, delimited

# The vendor header.
HEADER_LINES = 34
SAMPLES_MARK = "## Number of Samples:"
FIELDS_V1, FIELDS_V2 = 7, 26

QUESTION_SCHEMA = (
    "response_time string, video string, video_path string, video_categories string, "
    "questions array<struct<task_type:string, question:string, time_stamp:string, answer:string, "
    "options:array<string>, required_ability:string, answer_object:string, object_group:array<string>, "
    "gazed_objects:array<string>, background_objects:array<string>, correct_sequence:array<array<string>>, "
    "context_objects:array<string>, answer_action:string, actual_action_time:string, object:string, "
    "object_name:string, attribute_type:string, target_object:string, first_appearance:string, "
    "input_video_clip:array<double>, test_info:array<struct<realtime:string, type:int, response:string>>>>, "
    "model_predictions array<struct<question:string, time_stamp:string, model_prediction:string, "
    "model_response_time_sec:double>>"
)


def numbered_lines(spark: SparkSession, path: str, block: int | None = None, **specs: ordered.Spec) -> DataFrame:
    """Lines with their ``file`` and 0-based ``line`` number, and a column per spec computed along the file."""
    reader = spark.read
    lines = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_nr"),
    )
    out = ordered.scan(lines, ["file"], ["_block", "_nr"], F.col("_block"), coarse=True, line=ordered.row_number(), **specs)
    return out.withColumn("line", F.col("line") - 1).drop("_block", "_nr")


def session_of(file: Column, pattern: str | None = None) -> Column:
    """The file's name without ending, or what ``pattern`` finds in its path."""
    return stem(file) if pattern is None else F.regexp_extract(file, pattern, 1)


def read_gaze_text(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """Vendor gaze text in either version: session, seq, pixel x and y, frame, gaze type.

    The sample-count line sits on the tenth header line in version 1 and later in version
    2. A data line with another number of fields is an error.
    """
    lines = numbered_lines(spark, path)
    versions = (
        lines.where(F.col("line") == 9)
        .groupBy("file")
        .agg(F.max(F.when(F.col("value").contains(SAMPLES_MARK), 1).otherwise(2)).alias("version"))
    )
    body = lines.where(F.col("line") >= HEADER_LINES).join(versions, "file")
    parts = F.split(F.trim("value"), r"\s+")
    rows = body.select(session_of(F.col("file"), session).alias("session_id"), F.col("line").alias("seq"), "version", parts.alias("p"))
    shape = F.when((F.col("version") == 1) & (F.size("p") == FIELDS_V1), 1).when(
        (F.col("version") == 2) & (F.size("p") == FIELDS_V2), 2
    )
    known = rows.withColumn(
        "v", F.coalesce(shape, F.raise_error(F.lit("gaze line has an unsupported number of fields")).cast("int"))
    )

    def field(one: int, two: int) -> Column:
        return F.when(F.col("v") == 1, F.get("p", one)).otherwise(F.get("p", two))

    label = field(6, 25)
    return known.select(
        "session_id",
        "seq",
        field(3, 5).cast("double").alias("x"),
        field(4, 6).cast("double").alias("y"),
        F.when(F.col("v") == 1, F.get("p", 5).try_cast("long")).otherwise(frame_code(F.get("p", 24))).alias("frame_idx"),
        F.when(label == "Fixation", frames.FIXATION).when(label == "Saccade", frames.SACCADE)
        .otherwise(frames.UNKNOWN).alias("gaze_type"),
    )


def read_gaze_csv(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """Timestamped normalised samples with a confidence.

    A session is its file's name without ending, or what the pattern ``session`` finds in the path.
    """
    schema = "canonical_timestamp_s double, norm_pos_x double, norm_pos_y double, confidence double"
    return _csv(spark, path, schema).select(
        session_of(F.col("_file"), session).alias("session_id"),
        F.col("canonical_timestamp_s").alias("t"),
        F.col("norm_pos_x").alias("x"),
        F.col("norm_pos_y").alias("y"),
        "confidence",
    )


def _headers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file`` and ``header``, the first line of each file."""
    first = spark.read.text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_nr"), "value",
    )
    return first.where("_block = 0").groupBy("file").agg(F.min_by("value", "_nr").alias("header"))


def _json(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Records of JSON files with ``_file``: arrays and records over several lines are read whole, lines one by one.

    The driver sees the files' names and their first lines' ends.
    """
    kinds = _headers(spark, path).select("file", F.trim("header").rlike(r"^\{.*\}$").alias("lines")).collect()
    parts = []
    for lines in (True, False):
        files = sorted(r.file for r in kinds if r.lines == lines)
        if files:
            read = spark.read.schema(schema).json(files, multiLine=not lines)
            parts.append(read.select("*", F.col("_metadata.file_path").alias("_file")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, _file string")


def _csv(spark: SparkSession, path: str, schema: str, sep: str = ",", by_place: bool = False) -> DataFrame:
    """Delimited files with a header each, their columns taken by name; ``_file`` is the file of a row, (``_block``, ``_nr``) its place.

    Files may order, add and lack columns as they like, and each may have a header of its own. Quoted fields may hold
    separators, doubled quotes and line breaks. A row with too few fields has nulls at its end, a value that does not fit its type is
    null, blank lines are no rows, and only rows with more fields than their header are left out (``csv_drops`` counts them).
    With ``by_place`` the names of the header do not matter: the columns are the fields in their order.
    """
    wanted = T._parse_datatype_string(schema).fields
    rows = delimited.rows(spark, path, sep).where(~F.col("is_header") & (F.size("fields") <= F.size("header")))
    names = F.transform("header", lambda n: F.trim(F.regexp_replace(n, "^\ufeff", "")))

    def field(i: int, f: T.StructField) -> Column:
        place = F.lit(i) if by_place else F.array_position(names, f.name).cast("int") - 1
        text = F.when(place >= 0, F.get("fields", place))
        return F.when(F.trim(text) != "", text.try_cast(f.dataType)).alias(f.name)

    place = [F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("nr").alias("_nr")]
    return rows.select(*(field(i, f) for i, f in enumerate(wanted)), *place)


def csv_drops(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``file`` and ``dropped``: rows with more fields than their header."""
    long_ = delimited.rows(spark, path, sep).where(F.size("fields") > F.size("header"))
    return long_.groupBy("file").agg(F.count(F.lit(1)).alias("dropped"))


def read_gaze_2d(spark: SparkSession, path: str, width: int, height: int, session: str | None = None) -> DataFrame:
    """Projected gaze: normalised point (centre when missing) and type per frame."""
    schema = "frame_idx long, timestamp_sec double, u double, v double, valid boolean, in_frame boolean"
    raw = _csv(spark, path, schema).withColumn("session_id", session_of(F.col("_file"), session))
    missing = F.col("u").isNull() | F.col("v").isNull()
    return raw.select(
        "session_id",
        "frame_idx",
        F.when(missing, 0.5).otherwise(F.col("u") / width).alias("px"),
        F.when(missing, 0.5).otherwise(F.col("v") / height).alias("py"),
        frames.validity_type(F.col("u"), F.col("v"), F.col("valid"), F.col("in_frame")).alias("gaze_type"),
    )


def read_gaze_array(
    spark: SparkSession, path: str, session: str | None = None, task_bytes: int = arrays.TASK_BYTES, first: str | None = None
) -> DataFrame:
    """``.npy`` arrays of (x, y, validity), one row per frame, read by ranges of ``task_bytes``.

    A point that is not a number is null, and truncated unless it is marked invalid. Where a recording is split into several arrays, the pattern ``first`` finds the frame of a file's first row in its path.
    """
    raw = arrays.read_arrays(spark, path, ["x", "y", "valid"], task_bytes)
    begin = F.lit(0) if first is None else F.regexp_extract("file", first, 1).cast("long")
    inside = F.col("x").between(0, 1) & F.col("y").between(0, 1)
    kind = F.when(F.col("valid") != 1, frames.UNTRACKED).when(inside, frames.FIXATION).otherwise(frames.TRUNCATED)

    def unit(c: str) -> Column:
        return F.when(~F.isnan(c), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))

    return raw.select(
        session_of(F.col("file"), session).alias("session_id"),
        (F.col("row") + begin).alias("frame_idx"),
        unit("x").alias("px"),
        unit("y").alias("py"),
        kind.alias("gaze_type"),
    )


def _sync_rows(spark: SparkSession, path: str, folder: str, session: str | None) -> DataFrame:
    """Numbers of the tab-separated lines before a file's first blank line.

    A recording is the folder above ``folder``, or what the pattern ``session`` finds in the path.
    """
    blank = F.when(F.trim("value") == "", 1).otherwise(0)
    body = numbered_lines(spark, path, _blanks=ordered.running_sum(blank)).where(F.col("_blanks") == 0)
    numbers = F.transform(F.split(F.trim("value"), "\t"), lambda v: v.try_cast("double"))
    return body.select(
        F.regexp_extract("file", session or rf"([^/]+)/{folder}/[^/]+$", 1).alias("session_id"), "line", numbers.alias("n")
    )


def read_poses(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """Camera poses: tick and row-major 4x4 matrix."""
    rows = _sync_rows(spark, path, "Video", session)
    return rows.select("session_id", F.get("n", 1).cast("long").alias("tick"), F.slice("n", 3, 16).alias("pose"))


def read_rays(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """Gaze rays: tick, origin, direction, valid."""
    rows = _sync_rows(spark, path, "Eyes", session)
    names = ["ox", "oy", "oz", "dx", "dy", "dz"]
    return rows.select(
        "session_id",
        F.get("n", 1).cast("long").alias("tick"),
        *[F.get("n", i + 2).alias(n) for i, n in enumerate(names)],
        (F.get("n", 8).cast("long") == 1).alias("valid"),
    )


def read_intrinsics(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    rows = _sync_rows(spark, path, "Video", session).where(F.col("line") == 0)
    return rows.select(
        "session_id",
        F.get("n", 0).alias("fx"),
        F.get("n", 4).alias("fy"),
        F.get("n", 2).alias("cx"),
        F.get("n", 5).alias("cy"),
        F.element_at("n", -2).cast("int").alias("width"),
        F.element_at("n", -1).cast("int").alias("height"),
    )


def read_video_timing(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """First and second non-blank line: start and end tick."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    placed = ordered.numbered(lines, ["file"], ["line"], ordered.bucket(F.col("line"), 65_536), name="nr")
    tick = F.trim("value").try_cast("long")
    return placed.groupBy("file").agg(
        F.max(F.when(F.col("nr") == 0, tick)).alias("start_tick"),
        F.max(F.when(F.col("nr") == 1, tick)).alias("end_tick"),
    ).select(F.regexp_extract("file", session or r"([^/]+)/Video/[^/]+$", 1).alias("session_id"), "start_tick", "end_tick")


def read_actions_csv(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated actions: trimmed text, milliseconds to seconds, place in the file. Columns count by their place."""
    names = ["clip_id", "clip_prefix", "session", "start_ms", "end_ms", "action", "verb", "noun"]
    rows = _csv(spark, path, ", ".join(f"{n} string" for n in names), sep=";", by_place=True)
    rows = ordered.numbered(rows, ["_file"], ["_block", "_nr"], F.col("_block"), name="pos")
    return rows.select(
        F.trim("session").alias("session_id"),
        "pos",
        (F.trim("start_ms").try_cast("double") / 1000).alias("start_s"),
        (F.trim("end_ms").try_cast("double") / 1000).alias("end_s"),
        F.trim("action").alias("action"),
        F.trim("verb").alias("verb"),
        F.trim("noun").alias("noun"),
    )


def read_fine_annotations(
    spark: SparkSession, path: str, schema: str, scene: str | None = None, sessions: DataFrame | None = None
) -> DataFrame:
    """Narrated intervals of one scene, or of the listed sessions."""
    rows = _csv(spark, path, schema)
    if scene is not None:
        rows = rows.where(F.col("scene") == scene)
    if sessions is not None:
        rows = rows.join(sessions, "session_id", "left_semi")
    return rows.select("session_id", "start_s", "end_s", F.col("narration").alias("text"))


def read_annotation_json(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """One JSON array of labelled intervals per session; blank labels are dropped."""
    rows = _json(spark, path, "start double, end double, textAttribute_en string")
    label = F.trim("textAttribute_en")
    return rows.where(F.coalesce(label, F.lit("")) != "").select(
        session_of(F.col("_file"), session).alias("session_id"),
        F.coalesce("start", F.lit(0.0)).alias("start_s"),
        F.coalesce("end", F.lit(0.0)).alias("end_s"),
        label.alias("action"),
    )


def read_nested_annotations(spark: SparkSession, path: str, label: str = "Fine grained action") -> DataFrame:
    """Sessions with nested events: events of one label, text from verb and noun.

    ``both`` marks rows with a verb and a noun, which a timeline keeps; overlap captions
    take either one.
    """
    schema = (
        "video_name string, events array<struct<label:string, start:double, end:double, "
        "attributes:struct<Verb:string, Noun:string>>>"
    )
    events = _json(spark, path, schema).select(
        F.col("video_name").alias("session_id"), F.posexplode("events").alias("pos", "e")
    )
    verb, noun = F.col("e.attributes.Verb"), F.col("e.attributes.Noun")

    def present(part: Column) -> Column:
        return F.coalesce((part != "") & (part != "none"), F.lit(False))

    return events.where(F.col("e.label") == label).select(
        "session_id",
        F.col("pos").cast("long").alias("pos"),
        F.coalesce("e.start", F.lit(0.0)).alias("start_s"),
        F.coalesce("e.end", F.lit(0.0)).alias("end_s"),
        caption_from_attributes(verb, noun).alias("action"),
        (present(verb) & present(noun)).alias("both"),
    )


def read_csv_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV by column name: every record is a row, but for those with too many fields."""
    return _csv(spark, path, schema).drop("_file", "_block", "_nr")


def union_session_files(spark: SparkSession, pattern: str, fallback: str | None, schema: str) -> DataFrame:
    """Per-session CSVs as one table with ``session_name`` (their folder) and ``source_file``.

    Files without rows add nothing, columns a file lacks are null. ``fallback`` is read when ``pattern``
    matches no file.
    """
    path = pattern
    if fallback is not None and not _matches(spark, pattern):
        path = fallback
    return _csv(spark, path, schema).withColumns(
        {"session_name": F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1), "source_file": F.col("_file")}
    ).drop("_file", "_block", "_nr")


def _matches(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question items of JSON array or JSON line files, with their video under one key."""
    rows = _json(spark, path, QUESTION_SCHEMA).drop("_file")
    return rows.withColumn("video", F.coalesce("video", "video_path")).drop("video_path")


def flat_questions(items: DataFrame) -> DataFrame:
    """One row per question of an item, in order."""
    heads = [c for c in items.columns if c not in ("questions", "model_predictions")]
    return items.select(*heads, F.posexplode("questions").alias("nr", "q")).select(*heads, "nr", "q.*")


def read_results(spark: SparkSession, root: str, models: Sequence[str], variants=("results", "results_viz")) -> DataFrame:
    """Result items of all models and variants that exist, with ``model`` and ``task`` from the path."""
    paths = [f"{root}/{m}/{v}/*_output.json" for m in models for v in variants]
    present = [p for p in paths if _matches(spark, p)]
    if not present:
        return spark.createDataFrame([], f"model string, task string, {QUESTION_SCHEMA}")
    # a result is one file, or a folder of part files
    rows = _json(spark, present, QUESTION_SCHEMA)
    found = rows.withColumn("_p", F.regexp_extract("_file", r"([^/]+/[^/]+/[^/]+)_output\.json(?:/[^/]*)?$", 1))
    part = F.split("_p", "/")
    return found.select(F.concat_ws("_", part[0], part[1]).alias("model"), part[2].alias("task"), *rows.drop("_file").columns)


def read_prediction_chunks(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """JSON lines of ``n`` chunk files, or of the single prediction file."""
    schema = "id string, question string, answer string, pred string, answer_type string"
    path = f"{folder}/{n}_*.json" if n > 1 else f"{folder}/pred.json"
    return spark.read.schema(schema).json(path)


def read_latency_map(spark: SparkSession, path: str, task: str | None = None, lines: bool = False) -> DataFrame:
    """Entries ``{name: [response, seconds]}``; the task is taken from the file name, or by a pattern from
    the path. With ``lines`` every line is an array of entries, else the file is one."""
    file = F.col("_metadata.file_path")
    named = F.regexp_replace(stem(file), "_output$", "") if task is None else F.regexp_extract(file, task, 1)
    files = spark.read.text(path, wholetext=not lines).select(
        named.alias("task"),
        F.explode(F.from_json("value", "array<map<string,array<string>>>")).alias("entry"),
    )
    return files.select("task", F.explode("entry").alias("name", "pair")).select(
        "task", "name", F.get("pair", 0).alias("response"), F.get("pair", 1).try_cast("double").alias("seconds")
    )

"""Views of the driver tables in the shape of the package's inputs.

The tables hold no recordings, so events stand in for gaze samples, orders for
timeline entries, embeddings for frame features and priced orders for model replies.
Each view has a SQL twin in ``SQL`` used by the registered oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanflow.operators import ordered

FPS = 24.0
FRAMES_PER_CHUNK = 65_536
MINUTE_US = 60_000_000
DAY = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp, whatever the session time zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their micro-second clock and the integer of ``props``."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        "event_id",
        "event_type",
        "value",
        F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int").alias("k"),
        wall_micros(F.col("ts")).alias("us"),
    )


def gaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per frame: frames are the events of a user in time order."""
    codes = F.create_map(
        *[F.lit(v) for pair in [("error", 0), ("click", 1), ("view", 2), ("signup", 3), ("purchase", 4)] for v in pair]
    )
    rows = ordered.numbered(
        clicks(spark, sf_dir),
        ["session_id"],
        ["us", "event_id"],
        ordered.bucket(F.col("us"), MINUTE_US),
        name="frame_idx",
    )
    return rows.select(
        "session_id",
        "frame_idx",
        (F.col("frame_idx") / F.lit(FPS)).alias("time_seconds"),
        (F.col("value") / F.lit(500.0)).alias("px"),
        (F.col("k") / F.lit(100.0)).alias("py"),
        codes[F.col("event_type")].alias("gaze_type"),
        "event_type",
        "k",
    )


def gaze_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on their real clock, in seconds."""
    return clicks(spark, sf_dir).withColumn("t", F.col("us") / F.lit(1e6))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as labelled intervals of 0.2 s."""
    return purchases(gaze(spark, sf_dir))


def purchases(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("event_type") == "purchase").select(
        "session_id",
        F.col("frame_idx").alias("pos"),
        F.col("time_seconds").alias("start_s"),
        (F.col("time_seconds") + F.lit(0.2)).alias("end_s"),
        F.concat(F.lit("purchase "), (F.col("k") % 7).cast("string")).alias("text"),
    )


def short_segments(spark: SparkSession, sf_dir: str, frames: int = 4) -> DataFrame:
    """Runs of four frames as segments."""
    return segments_of(gaze(spark, sf_dir), frames)


def segments_of(rows: DataFrame, frames: int = 4) -> DataFrame:
    number = F.floor(F.col("frame_idx") / F.lit(frames)).cast("long")
    return (
        rows.groupBy("session_id", number.alias("segment"))
        .agg(F.min("time_seconds").alias("start_s"), F.max("time_seconds").alias("end_s"))
    )


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session and the bounds of each order."""
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("session_id"),
        start.alias("start_s"),
        (start + F.col("o_orderkey") % 30 + 1).alias("end_s"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat objects: one row per line item, in view when it was returned."""
    orders = _intervals(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("object"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "session_id",
            "start_s",
            "end_s",
            "object",
            (F.col("l_returnflag") == "R").alias("in_fov"),
        )
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object entries: sorted distinct names in view and outside, one row per interval.

    Line items become the names of their order before they meet it, so that orders are moved, not line items with
    the interval of each. An order is a handful of rows: building partial sets before the shuffle only costs.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("object"))
    named = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", (F.col("l_returnflag") == "R").alias("in_fov"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(
            F.collect_set(F.when(F.col("in_fov"), F.col("object"))).alias("fov"),
            F.collect_set(F.when(~F.col("in_fov"), F.col("object"))).alias("outside"),
        )
    )
    return (
        _intervals(spark, sf_dir)
        .join(named, F.col("o_orderkey") == F.col("l_orderkey"))
        .repartition("session_id", "start_s", "end_s")
        .groupBy("session_id", "start_s", "end_s")
        .agg(*[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("fov", "outside")])
    )


def order_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fulfilled orders as action entries; half of them collide with an object entry."""
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double")
    shift = F.when(F.col("o_orderkey") % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus") == "F")
        .select(
            F.col("o_custkey").alias("session_id"),
            (start + shift).alias("start_s"),
            (start + F.col("o_orderkey") % 30 + 1 + shift).alias("end_s"),
            F.concat(
                F.lit("use "),
                F.get(F.array(*[F.lit(w) for w in ("anvil", "tool", "plate", "bolt")]), F.col("o_orderkey") % 4),
                F.lit(" "),
                (F.col("o_orderkey") % 11).cast("string"),
            ).alias("action"),
            F.col("o_orderkey").alias("pos"),
        )
    )


def episodes(spark: SparkSession, sf_dir: str, entries: DataFrame | None = None) -> DataFrame:
    """Timeline entries with something in view: the first name is the gazed object."""
    return (
        (timeline(spark, sf_dir) if entries is None else entries)
        .where(F.size("fov") > 0)
        .select(
            "session_id",
            "start_s",
            "end_s",
            (F.col("end_s") - F.col("start_s")).alias("duration"),
            F.col("fov")[0].alias("object"),
            F.slice("fov", 2, F.size("fov")).alias("cropped"),
            "outside",
        )
    )


def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frame histograms: frames of a label in id order."""
    rows = ordered.numbered(
        table(spark, sf_dir, "embeddings").select(
            F.col("label").cast("long").alias("session_id"), "vec_id", F.col("embedding").alias("hist")
        ),
        ["session_id"],
        ["vec_id"],
        ordered.bucket(F.col("vec_id"), 1_000_000),
        name="frame_idx",
    )
    return rows.select(
        "session_id", "frame_idx", (F.col("vec_id") % 25).cast("double").alias("mean_luma"), "hist", "vec_id"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced orders as model replies."""
    letter = F.substring(F.lit("ABCD"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1))
    guess = F.substring(F.lit("ABCD"), (F.col("o_custkey") % 4 + 1).cast("int"), F.lit(1))
    text = (
        F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("answer: "), F.lower(guess)))
        .when(F.col("o_custkey") % 5 == 1, F.concat(guess, F.lit(". spoon")))
        .when(F.col("o_custkey") % 5 == 2, guess)
        .when(F.col("o_custkey") % 5 == 3, F.lit("no idea"))
    )
    truth = F.when(F.col("o_orderkey") % 50 == 0, F.lit("")).otherwise(letter)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_orderstatus").alias("model"),
        F.col("o_orderpriority").alias("task"),
        truth.alias("truth"),
        text.alias("reply"),
        (F.col("o_totalprice") / F.lit(10000.0)).alias("seconds"),
        (F.col("o_orderkey") % 30).cast("double").alias("window_start"),
        (F.col("o_orderkey") % 30 + 5).cast("double").alias("window_end"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judge replies with a score and an answer type."""
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.lit("Yes, same")).otherwise(F.lit("no")).alias("pred"),
        (F.col("doc_id") % 6).cast("int").alias("score"),
        F.concat(
            F.when(F.col("doc_id") % 2 == 0, F.lit("T")).otherwise(F.lit("C")), (F.col("doc_id") % 4).cast("string")
        ).alias("a_type"),
    )


# SQL twins -----------------------------------------------------------------

_DAYS = "CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE)"

_CTE = {
    "clicks": (
        [],
        """SELECT user_id AS session_id, event_id, event_type, value,
        CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, epoch_us(ts) AS us FROM events""",
    ),
    "gaze": (
        ["clicks"],
        """SELECT session_id, frame_idx, frame_idx / 24.0::DOUBLE AS time_seconds, value / 500.0::DOUBLE AS px,
        k / 100.0::DOUBLE AS py,
        CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END
          AS gaze_type, event_type, k
        FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) - 1 AS frame_idx
              FROM clicks)""",
    ),
    "gaze_clock": (["clicks"], "SELECT *, us / 1e6::DOUBLE AS t FROM clicks"),
    "actions": (
        ["gaze"],
        """SELECT session_id, frame_idx AS pos, time_seconds AS start_s, time_seconds + 0.2::DOUBLE AS end_s,
        'purchase ' || CAST(k % 7 AS VARCHAR) AS text FROM gaze WHERE event_type = 'purchase'""",
    ),
    "short_segments": (
        ["gaze"],
        """SELECT session_id, CAST(frame_idx // 4 AS BIGINT) AS segment, min(time_seconds) AS start_s,
        max(time_seconds) AS end_s FROM gaze GROUP BY 1, 2""",
    ),
    "sightings": (
        [],
        f"""SELECT o_custkey AS session_id, {_DAYS} AS start_s, {_DAYS} + o_orderkey % 30 + 1 AS end_s,
        p_name AS object, l_returnflag = 'R' AS in_fov
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    ),
    "timeline": (
        ["sightings"],
        """SELECT session_id, start_s, end_s,
        coalesce(list_sort(list(DISTINCT object) FILTER (WHERE in_fov)), []) AS fov,
        coalesce(list_sort(list(DISTINCT object) FILTER (WHERE NOT in_fov)), []) AS outside
        FROM sightings GROUP BY 1, 2, 3""",
    ),
    "entries": (
        ["timeline"],
        """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_s, end_s) - 1 AS pos
        FROM timeline""",
    ),
    "order_actions": (
        [],
        f"""SELECT o_custkey AS session_id, {_DAYS} + CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0 END AS start_s,
        {_DAYS} + o_orderkey % 30 + 1 + CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0 END AS end_s,
        'use ' || ['anvil', 'tool', 'plate', 'bolt'][o_orderkey % 4 + 1] || ' ' || CAST(o_orderkey % 11 AS VARCHAR) AS action, o_orderkey AS pos
        FROM orders WHERE o_orderstatus = 'F'""",
    ),
    "merged": (
        ["timeline", "order_actions"],
        """SELECT session_id, start_s, end_s, CASE WHEN max(isobj) = 1 THEN 'objects' ELSE 'action' END AS kind,
        coalesce(max(fov) FILTER (WHERE isobj = 1), []) AS fov,
        coalesce(max(outside) FILTER (WHERE isobj = 1), []) AS outside,
        CASE WHEN max(isobj) = 0 THEN arg_min(action, pos) END AS action
        FROM (SELECT session_id, start_s, end_s, 1 AS isobj, fov, outside, NULL AS action, NULL AS pos FROM timeline
              UNION ALL
              SELECT session_id, start_s, end_s, 0, [], [], action, pos FROM order_actions)
        GROUP BY 1, 2, 3""",
    ),
    "merged_pos": (
        ["merged"],
        "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_s, end_s) - 1 AS pos FROM merged",
    ),
    "episodes": (
        ["timeline"],
        """SELECT session_id, start_s, end_s, end_s - start_s AS duration, fov[1] AS object, fov[2:] AS cropped, outside
        FROM timeline WHERE len(fov) > 0""",
    ),
    "frame_features": (
        [],
        """SELECT CAST(label AS BIGINT) AS session_id,
        row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
        CAST(vec_id % 25 AS DOUBLE) AS mean_luma, embedding AS hist, vec_id FROM embeddings""",
    ),
    "predictions": (
        [],
        """SELECT o_orderkey AS item_id, o_orderstatus AS model, o_orderpriority AS task,
        CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE substr('ABCD', CAST(o_orderkey % 4 + 1 AS INTEGER), 1) END AS truth,
        CASE o_custkey % 5 WHEN 0 THEN 'answer: ' || lower(substr('ABCD', CAST(o_custkey % 4 + 1 AS INTEGER), 1))
          WHEN 1 THEN substr('ABCD', CAST(o_custkey % 4 + 1 AS INTEGER), 1) || '. spoon'
          WHEN 2 THEN substr('ABCD', CAST(o_custkey % 4 + 1 AS INTEGER), 1)
          WHEN 3 THEN 'no idea' END AS reply,
        o_totalprice / 10000.0::DOUBLE AS seconds, CAST(o_orderkey % 30 AS DOUBLE) AS window_start,
        CAST(o_orderkey % 30 + 5 AS DOUBLE) AS window_end FROM orders""",
    ),
    "judged": (
        [],
        """SELECT doc_id, CASE WHEN quality = 1 THEN 'Yes, same' ELSE 'no' END AS pred,
        CAST(doc_id % 6 AS INTEGER) AS score,
        CASE WHEN doc_id % 2 = 0 THEN 'T' ELSE 'C' END || CAST(doc_id % 4 AS VARCHAR) AS a_type FROM labels""",
    ),
}


def with_views(*names: str, **extra: str) -> str:
    """``WITH [RECURSIVE]`` prefix holding the named views, what they need, and extra CTEs in order."""
    done: list[str] = []

    def need(name: str) -> None:
        for dep in _CTE[name][0]:
            need(dep)
        if name not in done:
            done.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({_CTE[n][1]})" for n in done] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"

"""Tables that grow by commits: a run adds the rows whose keys are not there yet, once.

Below a table's folder, ``data/<folder>`` holds the rows of a run, ``words/<folder>`` its key filter, and ``log/<version>.json`` says that
the run counts. Only what the log names is read.

* **Key filter.** A key's hash gives one slot among about ``SLOTS`` per key; the occupied slots are stored as 64-bit words
  (about two bytes a key, a table like any other). A later run joins its keys to the words: keys that hit none are
  new without reading any row, and only commits that were hit are read for the exact comparison.
* **Commit.** A run writes its data to a folder of its own and then creates the next file of the log, which must not exist. If
  another run was faster, the rows are compared with what it added and the commit is tried again. Data without an entry in the log
  (a run that died in between) is never read; ``sweep`` removes it.
* **Retry.** A run has a name. Repeating a run that is in the log does nothing, so a lost acknowledgement does no harm.

Null keys equal each other. Rows of one run may repeat a key. Creating a file that must not exist has to be atomic in the file system (as
in HDFS and local folders).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots per key of a filter, and the numbers of bits a slot number can have.
SLOTS = 8
LEVELS = (12, 18, 24, 30, 36, 42)
TRIES = 20


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def entries(spark: SparkSession, path: str) -> list[dict]:
    """The log: version, run, folder, level and rows of every commit, in order."""
    if not _exists(spark, f"{path}/log"):
        return []
    schema = "version long, run string, folder string, level int, rows long"
    return [r.asDict() for r in spark.read.schema(schema).json(f"{path}/log").orderBy("version").collect()]


def create(spark: SparkSession, path: str, entry: dict) -> bool:
    """Add an entry to the log; False if its version is taken."""
    system, place = _file_system(spark, f"{path}/log/{entry['version']:012d}.json")
    try:
        out = system.create(place, False)
    except Exception as error:  # the JVM's exception has no class of its own here
        if "AlreadyExists" in str(error) or "already exists" in str(error):
            return False
        raise
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()
    return True


def _slot(hash_: Column, level: int) -> Column:
    return F.shiftrightunsigned(hash_, 64 - level)


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def key_words(rows: DataFrame, keys: Sequence[str], level: int) -> DataFrame:
    """``word`` and ``bits``: the occupied slots."""
    slot = _slot(_hash(keys), level)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    return rows.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def level_for(rows: int) -> int:
    return next((b for b in LEVELS if (1 << b) >= SLOTS * rows), LEVELS[-1])


def possible(df: DataFrame, path: str, keys: Sequence[str], log: Sequence[dict]) -> DataFrame:
    """folder and key (a struct) of the keys of ``df`` that a commit may hold."""
    spark = df.sparkSession
    probes = df.select(F.struct(*keys).alias("key"), _hash(keys).alias("_hash")).distinct()
    out = None
    for level in sorted({e["level"] for e in log}):
        own = [e for e in log if e["level"] == level]
        words = spark.read.parquet(*[f"{path}/words/{e['folder']}" for e in own]).select(
            "word", "bits", F.regexp_extract(F.col("_metadata.file_path"), r"/words/([^/]+)/", 1).alias("folder")
        )
        slot = _slot(F.col("_hash"), level)
        hits = probes.withColumn("word", F.shiftright(slot, 6)).join(words, "word")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
        found = hits.where(F.col("bits").bitwiseAND(bit) != 0).select("folder", "key")
        out = found if out is None else out.unionByName(found)
    return out


def absent(df: DataFrame, path: str, keys: Sequence[str], log: Sequence[dict]) -> tuple[DataFrame, list[str]]:
    """Rows of ``df`` whose key no commit of the log holds, and the commits that were read to know."""
    if not log:
        return df, []
    spark = df.sparkSession
    maybe = possible(df, path, keys, log)
    folders = sorted(r[0] for r in maybe.select("folder").distinct().collect())
    if not folders:
        return df, []
    held = spark.read.parquet(*[f"{path}/data/{f}" for f in folders]).select(F.struct(*keys).alias("key"))
    known = held.join(maybe.select("key").distinct(), "key", "left_semi").distinct()
    kept = df.withColumn("_key", F.struct(*keys)).join(known, F.col("_key") == F.col("key"), "left_anti")
    return kept.drop("_key"), folders


def write_commit(df: DataFrame, path: str, keys: Sequence[str], run: str | None = None) -> int:
    """Add the rows of keys that are not there yet, as the run ``run``; returns how many rows were added.

    A run that is in the log already adds nothing. Give a run that may be repeated a name of its own.
    """
    spark, keys = df.sparkSession, list(keys)
    run = run or uuid.uuid4().hex
    for _ in range(TRIES):
        log = entries(spark, path)
        if any(e["run"] == run for e in log):
            return 0
        folder = uuid.uuid4().hex
        data = f"{path}/data/{folder}"
        absent(df, path, keys, log)[0].write.parquet(data)
        written = spark.read.schema(df.schema).parquet(data)
        n = written.count()
        if not n:
            _drop(spark, path, folder)
            return 0
        level = level_for(n)
        key_words(written, keys, level).write.parquet(f"{path}/words/{folder}")
        version = log[-1]["version"] + 1 if log else 0
        if create(spark, path, {"version": version, "run": run, "folder": folder, "level": level, "rows": n}):
            return n
        _drop(spark, path, folder)
    raise RuntimeError(f"no commit to {path} after {TRIES} tries: too many runs at once")


def _drop(spark: SparkSession, path: str, folder: str) -> None:
    for part in ("data", "words"):
        system, place = _file_system(spark, f"{path}/{part}/{folder}")
        system.delete(place, True)


def read_commits(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All rows that the log names. Without commits there is nothing to read unless ``schema`` says the columns."""
    log = entries(spark, path)
    if not log:
        if schema is None:
            raise FileNotFoundError(f"no commit in {path}")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{path}/data/{e['folder']}" for e in log])


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Remove the folders of runs that are not in the log; call it when no run is under way."""
    known, gone = {e["folder"] for e in entries(spark, path)}, []
    for part in ("data", "words"):
        system, place = _file_system(spark, f"{path}/{part}")
        for status in system.listStatus(place) if system.exists(place) else []:
            name = status.getPath().getName()
            if name not in known:
                system.delete(status.getPath(), True)
                gone.append(f"{part}/{name}")
    return sorted(gone)

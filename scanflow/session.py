"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "scanflow") -> SparkSession:
    """A local session with the settings the test-suite and ``bench.py`` use.

    On a cluster the caller passes its own session: nothing below is needed for
    correctness, only ``spark.checkpoint.dir`` should name a shared folder.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # local data is small and the work per byte is high: keep all cores busy
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SCANFLOW_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` (the folder every executor can reach) wins. A
    machine-local folder is made only for a ``local`` master, where driver and
    executors share one disk; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    local = getattr(context, "_scanflow_dir", None)
    if local is None:
        local = tempfile.mkdtemp(prefix="scanflow-")
        context._scanflow_dir = local
    return local


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a stage of its own, without lineage.

    Parquet rather than a row checkpoint, so that later reads load only their columns and
    joins know the size. The folder stays until ``release``, since the caller may read its result at any time.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_stages: list[str] = []


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A new folder below the shared one, known to ``release``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stages.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove the stages that this process has written; returns their number.

    Call it when the results built so far have been written or collected: tables that still read a stage
    cannot be read afterwards.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _stages:
        path = jvm.org.apache.hadoop.fs.Path(_stages.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def discard(spark: SparkSession, path: str) -> None:
    """Remove one stage that nothing reads any more, such as a state that a later round has replaced."""
    if path in _stages:
        _stages.remove(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

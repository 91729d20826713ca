"""Running a bounded stream to its end, for queries over stored samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanflow.session import stage_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def scratch(spark: SparkSession, name: str) -> str:
    return stage_path(spark, name)


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Process what is available, write Parquet to the shared folder, return it as a batch table."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", f"{out}-progress")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(out)

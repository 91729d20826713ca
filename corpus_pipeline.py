"""Documents to a mixed, sharded training corpus, stage by stage.

Each stage reads what the stage before has kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanflow.llm import decontaminate, mixing, near_dedup, ranking, sharding
from scanflow.llm.columns import free
from scanflow.session import cut

SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking scores 0.5 or more; learnt outside the held-out third."""
    model = ranking.fit(docs, _table(spark, sf_dir, "labels"), usable=~ranking.held_out())
    (score,) = free(docs.columns, "score")
    return ranking.scored(docs, model, score=score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group: 5-word shingles, similarity 0.8 or more."""
    return near_dedup.one_per_group(docs, shingle=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item (0.8 of its 5-word shingles)."""
    return decontaminate.without_items(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to weights 1, 2, 3: each document with the words the mix reads of it."""
    mixed = mixing.mix_texts(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.place(docs, SHARDS)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("source mixing", mix),
    ("sharding", shards),
]

#: The classifier is a fitted model, so SQL cannot give the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""One registered query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanflow.llm import (
    centroids,
    decontaminate,
    exact_dedup,
    extract,
    merkle,
    mixing,
    near_dedup,
    oracles,
    quality_rules,
    ranking,
    sharding,
    suffix_dedup,
    surrogates,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_suffix_dedup", oracles.SUFFIX_DEDUP)
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from each document because a 100-byte string around them starts earlier."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query("op2_decontamination", oracles.DECONTAMINATION)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, with the item and the share of it found."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_source_mixing")
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weights 1, 2, 3 takes from each document."""
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


@query("op4_surrogates")
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with keyed surrogates in place of personal data, and where they stand."""
    return surrogates.replace(table(spark, sf_dir, "documents"), key="corpus-surrogates")


@query("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract(table(spark, sf_dir, "pages"))


@query("op6_near_dedup", oracles.NEAR_DEDUP)
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document: 3-word shingles, similarity of 0.85 or more."""
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


#: The rules of the url query.
URL_RULES = (
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
)


@query("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page url."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics, the base rule and the learned decision list for every document."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return quality_rules.judge(docs, rules).select(*columns)


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 16 shards, and its shard among 17."""
    return sharding.assign(table(spark, sf_dir, "documents"), 16)


@query("op10_pairwise_ranking")
def op10_pairwise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out third."""
    return ranking.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_merkle_manifest", oracles.MERKLE)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and audit after tampering of every document, in trees by language."""
    return merkle.audit(table(spark, sf_dir, "documents"))


@query("op12_centroid_clusters", oracles.CLUSTERS)
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding after ten exact rounds over eight centroids."""
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


@query("op13_exact_dedup", oracles.EXACT_DEDUP)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document with equal text but for white space, and the row that stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))

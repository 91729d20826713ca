"""The pipeline stage by stage against plain versions."""

import inspect

import pytest

import corpus_pipeline
from helpers import contained, groups, words
from scanflow.llm import mixing, queries, ranking

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage is given, and the last result."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(_kept(spark, stage(spark, out[-1], SF)))
    return out


def _kept(spark, df):
    rows = df.collect()
    return spark.createDataFrame(rows, df.schema)


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_and_columns(spark, steps):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and [t for _, t in df.dtypes] == [t for _, t in steps[0].dtypes]


def test_rejected_documents_go(spark, steps):
    docs, labels = steps[0], spark.read.parquet(f"{SF}/labels.parquet")
    rated = ranking.rate_documents(docs, labels)
    assert {i for i, _ in pairs(steps[1])} == {r.doc_id for r in rated.where("predicted = 1").collect()}
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = {i for i, _ in pairs(steps[1])}
    assert len(clean & kept) > 0.97 * len(clean) and len(kept) < docs.count()


def test_one_of_each_group_stays(steps):
    want, _ = groups(pairs(steps[1]), 5, 80)
    assert {i for i, _ in pairs(steps[2])} == set(want.values()) and len(set(want.values())) < len(want)


def test_leaks_go(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, _, _ in contained(pairs(steps[2]), items)}
    assert leaks and {i for i, _ in pairs(steps[3])} == {i for i, _ in pairs(steps[2])} - leaks


def test_mix_takes_its_words(steps):
    taken = {r.doc_id: r.taken for r in mixing.mix_sizes(steps[3]).collect() if r.taken}
    assert {i: len(words(t)) for i, t in pairs(steps[4])} == taken
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())


def test_every_row_gets_a_place(steps):
    rows = steps[5].collect()
    assert {(r.doc_id, r.text) for r in rows} == set(pairs(steps[4])) and len(rows) == steps[4].count()
    for shard in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own))) and 0 <= shard < corpus_pipeline.SHARDS


def test_run_is_all_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in steps[-1].collect()}


def test_stages_take_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "a b c d e f " * 30, None, "s", None), (3, "x " * 90_000, "de", "s", 1), (2, "a b c d e f " * 30, None, "s", None)]
    for rows in ([], odd):
        for _, stage in corpus_pipeline.STAGES:
            df = spark.createDataFrame(rows, schema)
            assert stage(spark, df, SF).columns[:5] == df.columns and stage(spark, df, SF).count() <= len(rows)


def test_stages_keep_columns_named_like_their_own(spark):
    names = "_doc _print _nr _score score doc print nr row pieces _pieces shard_ slot_ piece place before rows off src block size start n times tag v".split()
    rows = [(i, f"Some words of document {i}, and what follows it. " * 12, "en", f"s{i % 2}", 10, *[f"kept {i}"] * len(names)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert out.columns[: len(df.columns)] == df.columns
        assert all(r[n] == f"kept {r.doc_id}" for r in out.collect() for n in names)


def test_queries_are_registered(spark):
    names = set(queries.QUERIES)
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} and len(names) == 13
    assert all(queries.QUERIES[n](spark, SF).columns for n in sorted(names))

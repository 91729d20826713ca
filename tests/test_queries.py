"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import differences

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, sf_dir).count() >= 0
        return
    diff, _ = differences(spark, con, sf_dir, QUERIES[name], ORACLES[name])
    assert not diff


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_result_does_not_depend_on_partitions(spark, sf_dir):
    from compare import canonical

    def rows(name):
        df = QUERIES[name](spark, sf_dir)
        return canonical(df.columns, [tuple(r) for r in df.collect()])

    names = ["ask_next_after_group", "movements", "merged_appearances"]
    before = {n: rows(n) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {n: rows(n) for n in names} == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")

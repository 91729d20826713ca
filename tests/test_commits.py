"""Incremental tables: filters, crashes, repeated and simultaneous runs."""

import pytest
from pyspark.sql import functions as F

from scanflow.sources import commits


def ids(spark, path):
    return sorted(r.k for r in commits.read_commits(spark, path).collect())


def span(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))


def test_runs_add_what_is_not_there(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.write_commit(span(spark, 0, 100), path, ["k"]) == 100
    assert commits.write_commit(span(spark, 50, 150), path, ["k"]) == 50
    assert commits.write_commit(span(spark, 0, 150), path, ["k"]) == 0
    assert ids(spark, path) == list(range(150))
    assert [e["rows"] for e in commits.entries(spark, path)] == [100, 50]


def test_only_commits_that_may_hold_the_keys_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    for nr in range(4):
        commits.write_commit(span(spark, 1000 * nr, 1000 * nr + 300), path, ["k"])
    log = commits.entries(spark, path)
    rows, read = commits.absent(span(spark, 2000, 2003), path, ["k"], log)
    assert rows.count() == 0 and log[2]["folder"] in read and len(read) < 4
    files = [f for f in rows.inputFiles() if "/data/" in f]
    assert {f.split("/data/")[1].split("/")[0] for f in files} == set(read)
    # the filter never misses a key
    held = commits.possible(commits.read_commits(spark, path), path, ["k"], log)
    assert held.select("key").distinct().count() == 1200


def test_null_and_combined_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, None, "a"), (None, None, "b"), (1, 2, "c"), (None, 2, "d"), (1, 2, "again in one run")]
    df = spark.createDataFrame(rows, "x long, y long, t string")
    assert commits.write_commit(df, path, ["x", "y"]) == 5
    assert commits.write_commit(df.unionByName(spark.createDataFrame([(2, None, "e")], df.schema)), path, ["x", "y"]) == 1
    assert commits.read_commits(spark, path).count() == 6


def test_crash_between_data_and_log_and_a_lost_acknowledgement(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commits.write_commit(span(spark, 0, 10), path, ["k"], "first")
    with monkeypatch.context() as m:
        m.setattr(commits, "create", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            commits.write_commit(span(spark, 0, 30), path, ["k"], "second")
    assert ids(spark, path) == list(range(10))  # data without a log entry does not count
    assert commits.write_commit(span(spark, 0, 30), path, ["k"], "second") == 20
    assert commits.write_commit(span(spark, 0, 30), path, ["k"], "second") == 0
    assert ids(spark, path) == list(range(30))
    assert len(commits.sweep(spark, path)) == 2 and commits.sweep(spark, path) == []
    assert ids(spark, path) == list(range(30))


def test_two_runs_at_once_do_not_add_a_key_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    real, raced = commits.create, []

    def create(spark_, path_, entry):
        if not raced:  # another run commits just before this one
            raced.append(1)
            commits.write_commit(span(spark, 5, 15), path, ["k"], "other")
        return real(spark_, path_, entry)

    monkeypatch.setattr(commits, "create", create)
    assert commits.write_commit(span(spark, 0, 10), path, ["k"], "mine") == 5
    assert ids(spark, path) == list(range(15))


def test_no_commit_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        commits.read_commits(spark, str(tmp_path / "none"))
    assert commits.read_commits(spark, str(tmp_path / "none"), "k long").count() == 0
    assert commits.write_commit(span(spark, 0, 0), str(tmp_path / "none"), ["k"]) == 0

"""Delimited files with quoted line breaks, cut into small blocks, against a plain reader."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from scanflow.sources import delimited, readers


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def plain(path, sep=",", quote='"'):
    with open(path, newline="") as f:
        return [r for r in csv.reader(f, delimiter=sep, quotechar=quote, skipinitialspace=True) if r not in ([], [""])]


def quoted(rng, quote):
    words = ["cut", "a" + quote + quote + "b", "x,y", "line\nbreak", "\n\n", "", " lead", quote * 2, "né;e", ",,", "\n,\n" + quote * 2 + ","]
    return quote + "".join(rng.choice(words) for _ in range(rng.randrange(4))) + quote + rng.choice(["", "", "tail", " t"])


@pytest.mark.parametrize("quote", ['"', "'"])
def test_records_equal_a_plain_reader(spark, tmp_path, small_blocks, quote):
    rng = random.Random(3)
    for nr in range(12):
        lines = []
        for i in range(rng.choice([0, 1, 60])):
            cells = [rng.choice([str(i), "", f"va{quote}lue", "plain text", " lead", quoted(rng, quote)]) for _ in range(rng.randrange(2, 6))]
            lines.append(rng.choice(["", " "]).join([""]) + ("," + rng.choice(["", " "])).join(cells))
        (tmp_path / f"f{nr}.csv").write_text("\n".join(lines) + ("\n" if nr % 2 else ""))
    got = {}
    for r in delimited.rows(spark, str(tmp_path), quote=quote).orderBy("file", "block", "nr").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(list(r.fields))
    for nr in range(12):
        want = plain(tmp_path / f"f{nr}.csv", quote=quote)
        assert got.get(f"f{nr}.csv", []) == want


def test_a_quote_that_is_never_closed_costs_no_other_row(spark, tmp_path, small_blocks):
    rows = ["a,b"] + [f'{i},"x{i}"' for i in range(40)] + ['40,"open'] + [f"{i},y" for i in range(41, 90)]
    (tmp_path / "f.csv").write_text("\n".join(rows))
    read = readers.read_csv_tolerant(spark, str(tmp_path), "a long, b string").orderBy("a").collect()
    assert [r.a for r in read] == list(range(90)) and read[40].b == "open" and read[60].b == "y"


def test_a_thousand_headers_in_one_plan(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"f{i}.csv").write_text(f'c{i},v,more{i}\n"cut\nonion {i}",{i},x\nc{i},v,more{i}\ntoo,many,fields,here\n')
    read = readers.read_csv_tolerant(spark, str(tmp_path / "*.csv"), "v string, c7 string")
    assert read._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 4
    rows = read.collect()
    # a data row equal to the header is data
    assert sorted(r.v for r in rows) == sorted([str(i) for i in range(1000)] + ["v"] * 1000)
    assert sorted(r.c7 for r in rows if r.c7 is not None) == ["c7", "cut\nonion 7"]
    drops = readers.csv_drops(spark, str(tmp_path / "*.csv"))
    assert drops.count() == 1000 and drops.agg(F.sum("dropped")).first()[0] == 1000


def test_actions_keep_their_place_and_bad_numbers(spark, tmp_path, small_blocks):
    lines = ["x;y"] + [f"{i}; p; S1; {i * 100 if i != 5 else 'bad'}; {i * 100 + 50};do {i};do;it" for i in range(50)]
    (tmp_path / "a.csv").write_text("\n".join(["a;b;c;d;e;f;g;h"] + lines[1:]))
    rows = readers.read_actions_csv(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(50)) and [r.action for r in rows] == [f"do {i}" for i in range(50)]
    assert rows[5].start_s is None and rows[6].start_s == 0.6

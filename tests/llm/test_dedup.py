"""Repeated strings, near-duplicate groups and benchmark search against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import ODD_SCHEMA, contained, groups, odd_rows, repeats
from scanflow.llm import components, decontaminate, near_dedup, suffix_dedup

LINE = "The quick brown fox jumps over the lazy dog while seven wizards quietly box and judge my vow of long silence. "


def docs_of(spark, *texts):
    return spark.createDataFrame(odd_rows(*texts), ODD_SCHEMA).repartition(3)


def small(spark, sf_dir, n=200):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") < n)


def check_repeats(df, **options):
    want = repeats([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(df, **options).collect()}
    assert got == want
    return got


def test_repeats_of_a_table(spark, sf_dir):
    assert sum(r[1] for r in check_repeats(small(spark, sf_dir), with_text=False).values()) > 0


def test_repeats_of_odd_rows(spark):
    check_repeats(
        docs_of(
            spark, None, "", "short", LINE, "x" + LINE, LINE[1:], "a" * 350, "b" + "a" * 120, "ab" * 130, LINE * 3,
            "é" * 80, "é" * 60 + LINE, LINE[:99], LINE[:100], "y" + "ab" * 60, ("z" * 150 + LINE) * 2,
        )
    )


def test_repeats_in_small_slabs_and_batches(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check_repeats(small(spark, sf_dir, 60), slab=257)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_keep_bytes(spark):
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(spark, LINE, "ab" + LINE + "cd")).collect()}
    assert bytes(rows[0].kept).decode() == LINE and rows[0].spans == []
    assert bytes(rows[1].kept) == b"abcd" and tuple(rows[1].spans[0]) == (2, 2 + len(LINE))


def test_repeats_with_shared_ids(spark):
    rows = [(1, LINE), (1, LINE), (None, LINE), (2, LINE)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # the null id comes first and keeps its text; equal rows are one document
    assert sorted((r.doc_id is not None, r.n_removed) for r in got) == [(False, 0)] + [(True, len(LINE))] * 3


@pytest.mark.parametrize("batch", ["10000", "1"])
def test_equal_rows_are_one_document(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(1, LINE), (1, LINE), (2, LINE), (2, LINE), (3, "x")], "doc_id long, text string").repartition(4)
        got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
        assert got == [(1, 0), (1, 0), (2, len(LINE)), (2, len(LINE)), (3, 0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def check_groups(df, shingle=3, percent=85):
    want, sets = groups([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], shingle, percent)
    got = near_dedup.near_groups(df, shingle=shingle, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(sets[i]), root, root == i) for i, root in want.items()
    }
    return want


def test_groups_of_a_table(spark, sf_dir):
    want = check_groups(small(spark, sf_dir))
    assert any(i != root for i, root in want.items())


@pytest.mark.parametrize("percent", [85, 80])
def test_groups_of_edited_copies(spark, percent):
    """Copies with ever more edits: many pairs lie around the threshold and stars fall apart."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 5000, 150)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for k in rng.choice(len(base), rng.integers(0, 14), replace=False):
            copy[k] = f"e{rng.integers(0, 40)}"
        texts.append(" ".join(copy))
    check_groups(docs_of(spark, *texts), percent=percent)


def test_groups_compare_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(w if rng.random() > 0.04 else f"x{rng.integers(9)}" for w in base) for _ in range(60)]
    df = docs_of(spark, *texts)
    want, _ = groups([(r.doc_id, r.text) for r in df.collect()], 3, 85)
    got = near_dedup.near_groups(df, block=8).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_groups_of_odd_rows(spark):
    long_ = " ".join(f"w{k % 977}" for k in range(30_000))
    check_groups(docs_of(spark, None, "", " \t\n", "a b", "A B", "a b c", "a  b\nc", "a b c d", long_, long_ + " end", "ÄB c d", "äb c d"))


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c"), (1, "A b c"), (2, "x y z"), (None, "a b c"), (None, "n u l l"), (5, None), (6, "")]
    df = spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, hub string")
    left = near_dedup.one_per_group(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in left.collect() if r.text) == [(-1, "n u l l"), (1, "A b c"), (2, "x y z")]
    assert left.where("doc_id in (5, 6)").count() == 2


def test_one_row_of_repeats_and_null_ids_stays(spark):
    rows = [(1, "a b c d", "en"), (1, "a b c d", "de"), (1, "a b c d", "de"), (1, "A b c d", "en"), (4, "a b c d", "en")]
    rows += [(None, "x y z", "en")] * 3 + [(None, "X y z", "en"), (None, "u v w", None), (7, None, "en"), (7, "", "en"), (7, "", "en"), (8, "", "en")]
    # one id, two unlike groups: each keeps a row
    rows += [(9, "k l m", "en"), (9, "o p q", "en"), (10, "o p q", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in near_dedup.one_per_group(df.repartition(4)).collect()]
    want = {(1, "a b c d"), (None, "x y z"), (None, "u v w"), (7, ""), (8, ""), (9, "k l m"), (9, "o p q")}
    assert len(got) == len(want) and {(i, (t or "").lower()) for i, t, _ in got} == want
    assert sorted(got, key=str) == sorted((tuple(r) for r in near_dedup.one_per_group(df.coalesce(1)).collect()), key=str)


def test_repeats_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a b c d")] * 3, "doc_id long, text string")
    plan = near_dedup.one_per_group(df)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_signatures_fill_every_bin():
    hashes = np.array([1 << 40, 5 << 60, 9 << 60, 7 << 50], dtype=np.uint64)
    order = np.argsort(hashes)
    value = near_dedup.signatures(hashes[order], np.zeros(4, dtype=np.int64), 2, 64)
    assert set(value[0].tolist()) <= set(hashes.tolist()) and not value[1].any()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def check_contained(docs, items, **options):
    want = contained([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = decontaminate.contained_items(docs, items, **options).collect()
    assert {(r.doc_id, r.item_id, r.n_shared) for r in got} == want and len(got) == len(want)
    return want


def test_items_in_a_table(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = check_contained(small(spark, sf_dir), items)
    assert want and want == check_contained(small(spark, sf_dir), items, limit=100)


def test_items_in_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    near = item.replace("twelve", "dozen")
    far = item.replace("six", "6")
    pad = " ".join(f"p{k}" for k in range(25_000))
    docs = docs_of(spark, None, "", item, near, far, item.upper(), pad + " " + item + " " + pad, "short item", "a short item here", item)
    items = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "short item", 1), (None, item, 2)], "item_id long, text string, doc int")
    check_contained(docs, items)
    left = decontaminate.without_items(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 4, 8]
    none = items.limit(0)
    assert decontaminate.contained_items(docs, none).count() == 0
    assert decontaminate.without_items(docs, none).count() == 10


def test_empty_tables(spark):
    empty = spark.createDataFrame([], ODD_SCHEMA)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert near_dedup.near_groups(empty).count() == 0
    assert near_dedup.one_per_group(empty).count() == 0
    assert decontaminate.contained_items(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_repeats_of_many_texts_under_one_id(spark):
    """Rows of one id are documents of their own, in the order of a hash of their text."""
    rng = np.random.default_rng(11)
    words = np.array("one two three four five six seven eight nine ten eleven twelve".split())
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    texts = [" ".join([base[rng.integers(12)], str(i), base[rng.integers(12)]]) for i in range(80)]
    df = spark.createDataFrame([(None if i % 3 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    order = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    ids = sorted(texts, key=lambda t: (texts.index(t) % 3 == 0, order[t]))  # the null id comes first
    want = sorted(repeats(list(enumerate(ids))).values())
    got = sorted(tuple(r)[1:5] for r in suffix_dedup.remove_repeats(df, with_text=False).collect())
    assert got == want


def test_a_hot_trigger_is_dealt_over_tasks(spark, monkeypatch):
    """A line that stands between different neighbours in every document."""
    rng = np.random.default_rng(5)
    hot = "the line that stands everywhere, eighty bytes long or so, zzz zzz zzz "
    texts = ["".join(rng.choice(list("abcdefgh "), 70)) + hot + "".join(rng.choice(list("abcdefgh "), 70)) for _ in range(150)]
    texts += texts[:20] + [t[30:] for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 0.9)
    found = []
    real = suffix_dedup._hot_triggers
    monkeypatch.setattr(suffix_dedup, "_hot_triggers", lambda *a: found.append(real(*a)) or found[-1])
    check_repeats(df)
    assert found[0]
    pieces = suffix_dedup._identity(df, "doc_id", "text").mapInArrow(suffix_dedup._parser(100, 32, 1 << 19), suffix_dedup.PIECE)
    salts = suffix_dedup._ranked(pieces, found[0]).where(F.col("trigger").isin(found[0])).groupBy("trigger").agg(F.countDistinct("salt").alias("n"))
    assert max(r.n for r in salts.collect()) > 20
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, slab=1 << 21)


def test_one_outsider_of_a_large_star_meets_each_member_once(spark, monkeypatch):
    members, block = 300, 16
    edges = spark.createDataFrame([(0, 0, 0, v, v, v) for v in range(1, members + 1)], "hub long, hub_doc long, hub_print long, v long, doc long, print long")
    roots = spark.createDataFrame([(v, 0) for v in range(members)], "u long, root long")  # the last one is outside
    texts = spark.createDataFrame([(v, v, f"text {v}") for v in range(members + 1)], "doc long, print long, text string")
    sizes = []
    monkeypatch.setattr(near_dedup, "_block_links", lambda *_: lambda t: _count(t))

    def _count(table):
        import pyarrow as pa

        return pa.table({"u": pa.array([table.num_rows], pa.int64()), "v": pa.array([sum(table["rest"].to_pylist())], pa.int64())})

    rows = near_dedup._rest_links(edges, roots, texts, 3, 85, block).collect()
    sizes = [r.u for r in rows]
    blocks = -(-members // block)
    assert sum(sizes) <= members + blocks + 1 and max(sizes) <= 3 * block and all(r.v >= 1 for r in rows)


def test_pipeline_helpers_keep_clashing_columns(spark):
    names = ["doc", "print", "_doc", "_print", "nr", "_nr", "Doc", "row"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names if n != "Doc")
    df = spark.createDataFrame([(i, LINE * 2 + str(i // 2) * 3, *["kept"] * 7) for i in range(6)], schema)
    left = near_dedup.one_per_group(df, shingle=5, percent=80)
    assert left.columns == df.columns and all(v == "kept" for r in left.collect() for v in r[2:])

"""Mixing and sharding: plain versions, reruns, limits, movement."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from helpers import ODD_SCHEMA, odd_rows, words
from scanflow.llm import mixing, sharding


def read(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain_targets(sizes, weights=(1.0, 2.0, 3.0), repeats=3):
    """source -> target, by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(repeats * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = sum(weight[s] for s in free)
        target = {s: left * weight[s] / share for s in free} | {s: float(repeats * sizes[s]) for s in capped}
        above = {s for s in free if target[s] > repeats * sizes[s]}
        if not above:
            return target
        capped |= above


def check_mix(df, near=0.02):
    rows = mixing.mix_sizes(df).collect()
    assert len(rows) == df.count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(near * t, 2 * mixing.BLOCK)
    return sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.taken) for r in rows), want


def test_mix_of_a_table_and_reruns(spark, sf_dir):
    df = read(spark, sf_dir)
    first, _ = check_mix(df)
    again, _ = check_mix(df.repartition(7).withColumn("off", F.lit(1)))
    assert first == again


def test_sizes_are_words_of_whole_texts(spark, sf_dir):
    df = read(spark, sf_dir)
    texts = dict(df.select("doc_id", "text").collect())
    assert all(r["size"] == len(words(texts[r.doc_id])) for r in mixing.mix_sizes(df).collect())


def test_mix_stops_at_three_reads(spark):
    rows = [(k, "w " * 5_000, "b") for k in range(20)] + [(100 + k, "tiny text of six words here", "c") for k in range(200)] + [(999, "x " * 7_000, None)]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_mix_of_odd_rows(spark):
    rows = odd_rows(None, "", "one", "one two", "one two", "long " * 20_000, " \n ") + [(None, "null id", None, None) + (None,) * 12] * 2
    df = spark.createDataFrame(rows, ODD_SCHEMA)
    check_mix(df, near=0.1)
    assert mixing.mix_sizes(df.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix_sizes(df.where("text is null")).collect())


def test_every_pass_reads_every_block_once(spark):
    j = np.arange(5_000)
    for n in (1, 2, 3, 64, 4_999, 5_000):
        got = mixing.permuted(j[:n], np.full(n, n), np.full(n, 12345, dtype=np.uint64))
        assert sorted(got) == list(range(n))
    assert list(mixing.permuted(j[:64], np.full(64, 64), np.zeros(64, np.uint64))) != list(range(64))
    sources = spark.createDataFrame([("a", 0, 1_000, 2_600.0, 5_000.0), ("b", 1, 900, 200.0, 5_000.0)], "source string, src int, source_size long, target double, _words double")
    reads = defaultdict(Counter)
    rows = mixing.slots(sources, block=10, shard_slots=40).collect()
    for r in rows:
        reads[r.src][r.block] += 1
    assert set(reads[0].values()) == {2, 3} and len(reads[0]) == 100 and sum(reads[0].values()) == 260
    assert set(reads[1].values()) == {1} and sum(reads[1].values()) == 20
    assert len({r.shard for r in rows}) == 13 and sorted(r.slot for r in rows if r.src == 0) == list(range(260))


def test_mixed_texts_hold_the_words_taken(spark, sf_dir):
    df = read(spark, sf_dir)
    taken = {r.doc_id: r.taken for r in mixing.mix_sizes(df).collect()}
    source = dict(df.select("doc_id", "text").collect())
    mixed = mixing.mix_texts(df)
    assert mixed.columns == df.columns
    got = {r.doc_id: r.text for r in mixed.collect()}
    assert set(got) == {i for i, n in taken.items() if n}
    for i, text in got.items():
        assert len(words(text)) == taken[i] and not Counter(set(words(text))) - Counter(words(source[i]))


def test_mixed_texts_of_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(None, "", "one two three", "x " * 500, "x " * 500), ODD_SCHEMA)
    rows = mixing.mix_texts(df).collect()
    assert mixing.mix_texts(df).columns == df.columns and {r.doc_id for r in rows} <= {2, 3, 4}
    assert mixing.mix_texts(df.limit(0)).count() == 0


def check_shards(df, n=16):
    rows = sharding.assign(df, n).collect()
    assert len(rows) == df.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < n and r["grown_shard"] in (r["shard"], n) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def test_shards_of_a_table(spark, sf_dir):
    df = read(spark, sf_dir)
    texts = dict(df.select("doc_id", "text").collect())
    rows = check_shards(df)
    for r in rows:
        body = texts[r.doc_id].encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 1, zlib.crc32(body))
    moved = [r for r in rows if r["grown_shard"] == 16]
    assert 0 < len(moved) < len(rows) / 6
    shuffled = df.repartition(5).withColumn("shard", F.lit("x"))
    assert {r.doc_id: r["shard"] for r in check_shards(shuffled)} == {r.doc_id: r["shard"] for r in rows}


def test_shards_of_odd_rows(spark):
    rows = odd_rows(None, "", "a", "a", "long " * 30_000) + [(None, "null id", None, None) + (None,) * 12] * 3
    df = spark.createDataFrame(rows, ODD_SCHEMA)
    got = check_shards(df)
    assert next(r for r in got if r.doc_id == 0)["size"] == 1 and next(r for r in got if r.doc_id == 0)["text_crc32"] == 0
    assert sharding.assign(df.limit(0)).count() == 0
    placed = sharding.place(df)
    assert placed.columns == [c for c in df.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert placed.count() == len(rows)


def test_weights_share_rows_and_confine_movement(spark):
    keys = spark.range(20_000)
    tree = {"r0": {"a": {0: 1.0, 1: 3.0}, "b": {2: 4.0}}, "r1": {"c": {3: 4.0, 4: 4.0}}}
    heavier = {"r0": {"a": {0: 1.0, 1: 3.0}, "b": {2: 4.0}}, "r1": {"c": {3: 4.0, 4: 8.0}}}
    both = keys.select(sharding.placed(F.col("id"), tree).alias("old"), sharding.placed(F.col("id"), heavier).alias("new")).collect()
    count = Counter(r.old["shard"] for r in both)
    assert all(abs(count[s] / 20_000 - w / 16) < 0.02 for s, w in {0: 1, 1: 3, 2: 4, 3: 4, 4: 4}.items())
    moved = {(r.old["shard"], r.new["shard"]) for r in both if r.old["shard"] != r.new["shard"]}
    # rows leave r0 for r1, and within rack c only shard 4 gains
    assert all(new in (3, 4) for _, new in moved) and (3, 4) in moved and (4, 3) not in moved
    assert {s for s in count} == {0, 1, 2, 3, 4}
    without = {"r0": {"a": {0: 1.0, 1: 0.0}}}
    assert {r[0]["shard"] for r in keys.select(sharding.placed(F.col("id"), without)).distinct().collect()} == {0}


def test_shard_files_keep_the_slots(spark, sf_dir, tmp_path):
    placed = sharding.place(read(spark, sf_dir), 4)
    sharding.write_shards(placed, str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r["shard"], r["slot"]) for r in back.collect()} == {(r.doc_id, r["shard"], r["slot"]) for r in placed.collect()}


def test_one_more_shard_is_the_grown_tree(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    for n in (16, 17, 20):
        now = {r.doc_id: (r["shard"], r.grown_shard) for r in sharding.assign(df, n).collect()}
        then = {r.doc_id: r["shard"] for r in sharding.assign(df, n + 1).collect()}
        assert {i: g for i, (_, g) in now.items()} == then
        assert all(s in (now[i][0], n) for i, s in then.items()) and n in then.values()


def test_slots_of_a_hot_key_are_dealt_over_pieces(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.col("id").alias("piece"), F.lit("x").alias("before"))
    rows = sharding.place(df, 4).collect()
    assert sorted(r["slot"] for r in rows) == list(range(3000)) and sorted(r["piece"] for r in rows) == list(range(3000))


def test_mixed_blocks_make_up_the_mix(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing.slots, "__defaults__", (mixing.BLOCK, 40, mixing.SEED))
    df = read(spark, sf_dir).limit(400).withColumn("shard", F.lit("own")).withColumn("doc", F.lit(1)).withColumn("pieces", F.lit(2))
    df = spark.createDataFrame(df.collect(), df.schema)
    blocks = mixing.mixed_blocks(df).collect()
    taken, counts = Counter(), defaultdict(Counter)
    for r in blocks:
        taken[r.doc_id] += r.n
    for shard, source, slot in {(r["shard"], r.source, r.slot) for r in blocks}:
        counts[source][shard] += 1
    assert {r.doc_id: r.taken for r in mixing.mix_sizes(df).collect() if r.taken} == taken
    shards = {s for c in counts.values() for s in c}
    assert len(shards) > 5 and any(len(set(c.values())) > 2 for c in counts.values())  # the draw is seen in the shards
    # every slot's words, from the documents it reads
    texts = dict(df.select("doc_id", "text").collect())
    want = defaultdict(list)
    for r in sorted(blocks, key=lambda r: r.off):
        want[r["shard"], r.source, r.slot] += words(texts[r.doc_id])[r.start : r.start + r.n]
    got = {(r["shard"], r.source, r.slot): r.text.split(" ") for r in mixing.shard_texts(df).collect()}
    assert got == dict(want) and sum(map(len, got.values())) == sum(taken.values())
    assert all(len(v) <= mixing.BLOCK for v in got.values())
    mixed = mixing.mix_texts(df)
    assert mixed.columns == df.columns and {(r["shard"], r["doc"], r["pieces"]) for r in mixed.collect()} == {("own", 1, 2)}

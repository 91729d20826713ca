"""Manifest trees, clusters and exact groups against plain versions."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from helpers import ODD_SCHEMA, odd_rows
from scanflow.llm import centroids, exact_dedup, merkle

ODD = f"doc_id long, text string, lang string, source string, n_chars long, {ODD_SCHEMA.split('n_chars long, ')[1]}"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- manifest


@pytest.mark.parametrize("leaves", [1, 2, 7, 8, 9, 63, 64, 65, 73, 511, 512, 513, 600])
def test_positions_are_the_order_of_completion(leaves):
    height = merkle.tree_height(leaves)
    log = merkle.append_log([f"{i}" for i in range(leaves)], height)
    level, seen = [f"{i}" for i in range(leaves)], []
    for k in range(height + 1):
        places = merkle.node_position(k, np.arange(len(level)), leaves)
        assert [log[p] for p in places] == level
        seen += list(places)
        level = [sha(*level[i : i + 8]) for i in range(0, len(level), 8)]
    assert sorted(seen) == list(range(len(log)))


def plain_leaf(row, text):
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(leaves):
    """Root and, per leaf, (place, siblings) per level."""
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for leaf, place in enumerate(places):
            run = level[place // 8 * 8 : place // 8 * 8 + 8]
            paths[leaf].append((place % 8, run[: place % 8] + run[place % 8 + 1 :]))
        level = [sha(*level[i : i + 8]) for i in range(0, len(level), 8)]
        places = [p // 8 for p in places]
    return level[0], paths


def plain_audit(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    tops, done = [], []
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        members = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
        leaves = [plain_leaf(r, r["text"]) for r in members]
        root, paths = plain_tree(leaves)
        tops.append(root)
        done.append((members, leaves, root, paths))
    root, above = plain_tree(tops) if tops else (None, [])
    out = []
    for (members, leaves, subroot, paths), up in zip(done, above):
        for row, leaf, path in zip(members, leaves, paths):
            path = path + up
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
            text = row["text"]
            if hit and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = plain_leaf(row, text)
            for place, siblings in path:
                node = sha(*siblings[:place], node, *siblings[place:])
            proof = sha(*(s for _, siblings in path for s in siblings))
            out.append((row["doc_id"], leaf, subroot, root, proof, node, node == root))
    return out


def test_audit_equals_the_plain_trees(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TIER", 1)  # several tiers on a small table
    texts = [None if i % 11 == 0 else "" if i % 7 == 0 else f"Text {i % 40} È" * (i % 5 + 1) for i in range(700)]
    rows = [(i * 37 % 1000, t, [None, "de", "en", "", "é"][0 if i % 9 == 0 else 2 if i < 400 else i % 5], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "Null id", "en", None, None)] * 2 + [(5, "Twice", "one of its own", "s", 1)] * 3 + [(6, "Alone", "zz", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = [tuple(r) for r in merkle.audit(df).collect()]
    want = plain_audit([dict(zip(schema.replace(",", "").split()[::2], r)) for r in rows])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_log_holds_every_node_at_its_position(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TIER", 2)
    df = spark.createDataFrame([(i, "one" if i < 600 else "two") for i in range(700)], "doc_id long, lang string")
    made = merkle.manifest(df, "lang", "doc_id", ["doc_id"])
    log = {}
    for r in made.groups.nodes().collect():
        log.setdefault(r["grp"], {})[r["position"]] = r["digest"]
    for grp, ids in (("=one", range(600)), ("=two", range(600, 700))):
        leaves = [sha(f"{len(str(i))}:{i}") for i in ids]
        whole = merkle.append_log(leaves, merkle.tree_height(len(leaves)))
        assert [log[grp][p] for p in range(len(log[grp]))] == whole
    assert [r["root"] for r in made.forest.roots().collect()] == [merkle.digest([log["=one"][max(log["=one"])], log["=two"][max(log["=two"])]])]


def test_manifest_of_odd_tables(spark):
    df = spark.createDataFrame(odd_rows("A", None, "", "x" * 300000, "A", first=3), ODD)
    rows = merkle.audit(df).collect()
    plain = plain_audit([r.asDict() for r in df.collect()])
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(plain, key=repr)
    assert merkle.audit(df.limit(0)).collect() == []


# --- clusters


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    marks = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))
    centres = [list(v) for _, v in marks[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centres = [[sum(col) // len(m) for col in zip(*m)] if m else c for m, c in zip(members, centres)]
    at = [(i, *nearest(v)) for i, v in kept]
    whole = sum(d for _, d, _ in at)
    per = {n: sum(d for _, d, m in at if m == n) for n in range(len(centres))}
    return sorted((i, n, d, per[n], whole, sha(",".join(map(str, centres[n])))) for i, d, n in at)


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 64))
    rows = [(i, [float(x) for x in middles[i % 12] * 2 + rng.normal(size=64) * (0.2 if i % 3 else 1.5)]) for i in range(420)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # equal vectors
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [float("nan")] * 64), (2003, [float("inf")] + [0.0] * 63), (2004, [None] + [0.0] * 63), (2005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = sorted(tuple(r) for r in centroids.clustered(df).collect())
    assert got == plain_clusters(rows)
    for rescan in (-1.0, 2.0):  # an anchor each round, and one in all
        found, centres, shares = centroids.cluster(df, rescan=rescan)
        assert sorted(tuple(r) for r in found.collect()) == [r[:3] for r in got]
    shares = centroids.cluster(df)[2]
    assert len(shares) == 10 and min(shares) < 0.1


def test_few_vectors_repeated_ids_and_large_components(spark):
    schema = "vec_id long, embedding array<float>, cluster int, id string, x long"
    rows = [(i % 2, [float(i)] * 64, 9, "q", 1) for i in range(5)]
    got = sorted(tuple(r) for r in centroids.clustered(spark.createDataFrame(rows, schema)).collect())
    assert got == plain_clusters([(r[0], r[1]) for r in rows])
    assert centroids.clustered(spark.createDataFrame([], schema)).collect() == []
    huge = [(1, [1e30] * 64, 0, "", 0), (None, [-1e30] * 64, 0, "", 0), (2, [0.0] * 64, 0, "", 0)]
    assert [r["distance"] for r in centroids.clustered(spark.createDataFrame(huge, schema)).collect()] == [0, 0, 0]


def test_approach_bounds_every_point_of_the_sphere():
    rng = np.random.default_rng(1)
    for trial in range(200):
        dims = int(rng.integers(2, 6))
        old = rng.normal(size=(4, dims)) * 50
        new = old + rng.normal(size=(4, dims)) * rng.choice([1, 10, 60])
        radius = np.abs(rng.normal(size=4)) * 30
        bound, drift = centroids.approach(old, new, radius), np.linalg.norm(new - old, axis=1)
        assert (bound <= drift[None, :] * (1 + 1e-8) + 1e-9).all()
        for i in range(4):
            way = rng.normal(size=(300, dims))
            points = old[i] + way / np.linalg.norm(way, axis=1)[:, None] * radius[i] * rng.random((300, 1)) ** (1 / dims)
            for j in range(4):
                if i != j:
                    nearer = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
                    assert nearer.max() <= bound[i, j] + 1e-9
    # well below the full drift where the sphere lies aside
    assert centroids.approach(np.array([[0, 100], [0, 0]]), np.array([[0, 100], [10, 0]]), np.array([5.0, 0]))[0, 1] < 1.5


# --- exact groups


def plain_groups(rows):
    """doc_id -> keep_id, size, kept, sha; ids are unique."""
    groups = {}
    for i, t in rows:
        body = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(sha(body), []).append((-len(t or ""), i))
    out = []
    for mark, members in groups.items():
        best = min(members)[1]
        out += [(i, best, len(members), i == best, mark) for _, i in members]
    return sorted(out)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_exact_groups_equal_plain_groups(spark, bits):
    texts = ["a b", "ab", "a  b", None, "", " \n", "A b", "é\tè", "éè ", "x y", "xy"] + ["hot  row" + " " * (i % 4) for i in range(60)] + [f"text {i % 7}" for i in range(40)]
    rows = [((i * 31) % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    got = sorted(tuple(r) for r in exact_dedup.exact_groups(df, bits=bits).collect())
    assert got == plain_groups(rows)
    few = sorted(tuple(r) for r in exact_dedup.exact_groups(df, runs=2, bits=bits).collect())
    assert few == got


def test_one_row_of_each_text_stays(spark):
    long = "word " * 60000
    rows = odd_rows("same text", "same  text", None, "", long, long, "other") + odd_rows("same  text", first=1)
    rows += [(None, "no id", *rows[0][2:]), (None, "no id", *rows[0][2:])]
    df = spark.createDataFrame(rows, ODD)
    groups = exact_dedup.exact_groups(df).collect()
    assert len(groups) == len(rows)
    assert sorted((r["keep_id"], r["group_size"]) for r in groups if r["kept"] and r["keep_id"] is not None) == [(1, 3), (2, 2), (4, 2), (6, 1)]
    assert [r["group_size"] for r in groups if r["kept"] and r["keep_id"] is None] == [2]
    left = exact_dedup.distinct_texts(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in left.collect()) == [-1, 1, 2, 4, 6]
    assert exact_dedup.exact_groups(df.limit(0)).collect() == [] and exact_dedup.distinct_texts(df.limit(0)).collect() == []


def test_equal_digests_alone_do_not_join_texts(spark):
    entry = "struct<less:long,none:boolean,doc:long,at:long>"
    schema = f"run int, digest binary, n_bytes long, check long, best {entry}, rows long, range int"
    rows = [(r, b"d", 4, c, (-4, False, r, r), 1, 0) for r, c in ((0, 1), (1, 1), (2, 2), (3, 1))]
    last = exact_dedup.merged(spark.createDataFrame(rows, schema), 4, bits=1).collect()
    assert sorted((r["check"], r["rows"], r["best"]["doc"]) for r in last) == [(1, 3, 0), (2, 1, 2)]

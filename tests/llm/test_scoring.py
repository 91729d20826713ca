"""Ranking, decision lists, url verdicts: held-out accuracy and plain versions of every fixed part."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helpers import ODD_SCHEMA, WORD, odd_rows, words
from scanflow.llm import quality_rules, queries, ranking, url_filter


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- ranking ----


def test_ranking_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = ranking.rate_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    rows = got.join(read(spark, sf_dir, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_ranking_never_sees_held_out_labels_or_other_columns(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    base = {r.doc_id: r.score for r in ranking.rate_documents(docs, labels).collect()}
    turned = labels.withColumn("quality", F.when(ranking.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}).repartition(5)
    assert {r.doc_id: r.score for r in ranking.rate_documents(other, turned).collect()} == base


def test_ranking_of_odd_rows(spark, sf_dir):
    long_ = "word " * 60_000
    rows = odd_rows(None, "", "same text here", "same text here", long_, "\n\n") + odd_rows("null id")[0:0]
    docs = spark.createDataFrame(rows, ODD_SCHEMA)
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0), (9, 1), (9, 0)], "doc_id long, quality int")
    flat = ranking.rate_documents(docs, labels).collect()
    assert [r.score for r in flat] == [0.5] * 6 and all(r.predicted == 1 for r in flat)
    model = ranking.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    scored = {r.doc_id: r.score for r in ranking.scored(docs, model).collect()}
    assert scored[0] == scored[1] and scored[2] == scored[3] and all(0 <= s <= 1 for s in scored.values())
    assert ranking.scored(docs, model).columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert ranking.rate_documents(docs.limit(0), labels).count() == 0
    assert ranking.rate_documents(docs, labels.limit(0)).count() == 6


def hot_labelled(spark):
    """An id labelled 0 has a third of all rows, every other one of them a repeat; max_rows of 60 is below its share."""
    calm = lambda k: " ".join(f"calm{(k * 7 + j) % 997} word," for j in range(40))
    loud = lambda k: " ".join(f"WIN{(k * 5 + j) % 991}!!! $$${j}|{k}" for j in range(40))
    good, bad = [(k, calm(k)) for k in range(2, 42)], [(k, loud(k)) for k in range(42, 82)]
    hot = [(1, loud(k // 2 + 100)) for k in range(400)]
    docs = spark.createDataFrame(good + bad + hot, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, int(2 <= k < 42)) for k in range(1, 82)] + [(1, 0)] * 100, "doc_id long, quality int")
    return docs, labels


def test_bound_of_the_sample_knows_no_label(spark):
    docs, labels = hot_labelled(spark)
    model = ranking.fit(docs, labels, max_rows=60)
    assert np.abs(model.weights).max() > 0
    rated = ranking.scored(docs, model).collect()
    assert all((r.score >= 0.5) == (2 <= r.doc_id < 42) for r in rated)
    rows = ranking.sample(docs, labels, "doc_id", "text", "quality", 60).distinct().collect()
    assert len(rows) == 60 and len({r._id for r in rows}) == 60 and {r._label for r in rows} == {0, 1}
    again = ranking.sample(docs.repartition(3), labels, "doc_id", "text", "quality", 60).distinct().collect()
    assert set(again) == set(rows)
    assert ranking.sample(docs, labels, "doc_id", "text", "quality", 1000).distinct().count() == 80 + 200


def test_rules_with_a_hot_labelled_id(spark):
    docs, labels = hot_labelled(spark)
    # all different documents: 40 good ones, 240 others; a bound by label would leave no good one
    rules = quality_rules.fit(docs, labels, max_rows=120)
    assert rules
    judged = [r for r in quality_rules.judge(docs, rules).collect() if not r.base_failed]
    assert judged and all(r.kept == (2 <= r.doc_id < 42) for r in judged)


def test_pairs_learn_an_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    label = (x @ [2.0, -1.0, 0.0] > 0.7).astype(int)
    model = ranking.fit_pairs(x, label)
    assert np.mean((model.score(x) >= 0.5) == label) > 0.97
    assert abs(model.weights[2]) < 0.2 * abs(model.weights[0])


# ---- decision lists ----


def plain_statistics(text):
    w, text = words(text), text or ""
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_lines": len(lines),
    }


def check_statistics(df):
    got = quality_rules.statistics(df).collect()
    texts = dict(df.select("doc_id", "text").collect())
    for r in got:
        want = plain_statistics(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
    return got


def test_statistics_of_a_table(spark, sf_dir):
    check_statistics(read(spark, sf_dir, "documents"))


def test_statistics_of_odd_rows(spark):
    texts = [None, "", "\n\n", "a b c a b c", "a a a a", "x y", "x y z", "é\u00a0ü é\u00a0ü", "l\nl\n l\nl\r\n", "#*$%&|<>" * 3, "a b c d " * 9_000, "A|B\x0bc\x0cd"]
    rows = check_statistics(spark.createDataFrame(odd_rows(*texts), ODD_SCHEMA))
    assert len(rows) == len(texts)
    judged = quality_rules.judge(spark.createDataFrame(odd_rows(*texts), ODD_SCHEMA), []).collect()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in judged)
    assert not any(r.kept for r in judged)


def test_a_filter_on_statistics_stays_cheap(spark, sf_dir):
    judged = quality_rules.judge(read(spark, "/root/testdata/sf0.01", "documents"), [])
    assert judged.where("kept and n_repeat_words < 10").count() > 0


def test_rules_on_unseen_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rules = quality_rules.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality_rules.judge(docs, rules).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").collect()
    assert rules and len(rows) > 40
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95


def test_covering_finds_conjunctions_in_order(spark):
    rng = np.random.default_rng(2)
    x = rng.random((900, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.3) & (x[:, 2] > 0.6))
    rules = quality_rules.learn(x, bad, ("a", "b", "c"))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    number = [r[0] for r in df.select(quality_rules.verdict(rules)).collect()]
    first = [next((k for k, rule in enumerate(rules, 1) if quality_rules._holds(x[i : i + 1], ("a", "b", "c"), rule)[0]), 0) for i in range(len(x))]
    assert number == first and np.mean((np.array(number) > 0) == bad) > 0.95


def test_rules_without_labels(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    assert quality_rules.fit(docs, labels.limit(0)) == []
    assert quality_rules.fit(docs, labels.where("quality = 1")) == []
    assert quality_rules.judge(docs.limit(0), []).count() == 0


# ---- urls ----


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def plain_rule(host, path):
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(str(r)), default=None)
    return (None, None) if best is None else (str(best), best.verdict)


ODD_URLS = [
    None, "", "no scheme", "http://", "HTTP://ÄB.Example.ORG/es/x?y#z", "https://org", "https://org/", "x://a.org?/es/", "x://fakeorg/",
    "x://example.org/en/12", "x://example.org/en/2", "x://www.example.com/fr/", "x://example.com:80/de/", "x://u@example.com/de/1#/fr/",
    "a://b://c/d", "x://example.org/es", "x://y/" + "p" * 100_000 + "?q=1&r=2", "x://com/de/\nline",
]


def test_hosts_paths_and_rules(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    odd = spark.createDataFrame(list(enumerate(ODD_URLS, 10_000)), "page_id long, url string")
    both = pages.unionByName(odd)
    urls = dict(both.collect())
    for r in url_filter.judge(both, queries.URL_RULES).collect():
        host, path = plain_url(urls[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.log_odds > 0 else "allow"))


def test_trees_separate_labelled_urls(spark):
    good = [(f"https://news{k % 7}.example.com/en/{k}.html", "allow") for k in range(300)]
    spam = [(f"https://x{k % 5}-win-win.example.net/p?id={k}&ref={k * 7}&s=1", "block") for k in range(300)]
    labelled = spark.createDataFrame(good + spam + [(None, "block"), ("z://z", None)], "url string, verdict string")
    test = spark.createDataFrame([(1, "https://news9.example.com/en/77.html"), (2, "https://x9-win-win.example.net/p?id=8&ref=1&s=2")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(test, (), labelled).collect()}
    assert got == {1: "allow", 2: "block"}


def test_entropy_and_columns_match_the_trees(spark):
    urls = ["https://a.b/c", "aaaa", "", "http://é.org/x?y=1"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = url_filter._lexical(df, "url").collect()
    for r in rows:
        n = Counter(r.url)
        want = -sum(c / len(r.url) * math.log2(c / len(r.url)) for c in n.values()) if r.url else 0.0
        assert abs(r.entropy - want) < 1e-9
    rng = np.random.default_rng(4)
    x = rng.random((500, 2))
    trees = url_filter.boost(x, ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float), ("a", "b"))
    table = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    got = [r[0] for r in table.select(trees.column()).collect()]
    assert np.allclose(got, trees.values(x)) and np.mean((np.array(got) > 0) == ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3))) > 0.95


def test_urls_without_labels(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").withColumns({"host": F.lit(1), "verdict": F.lit("x"), "_suffix": F.lit(None)})
    assert {r.verdict for r in url_filter.judge(pages, ()).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0

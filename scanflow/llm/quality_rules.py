"""Learned decision lists over text statistics.

``statistics`` measures whole texts with built-in functions only. ``learn`` covers the bad rows of a bounded
labelled sample one rule at a time: a rule grows by the threshold condition of the best information gain on
two thirds of the rows still uncovered, is pruned from its end on the last third, and is kept while it is more
often right than wrong there. ``verdict`` writes the list as one ordered conditional expression; a row that
no rule takes is kept.

Within a text, repeated 3-word windows are found by sorting (window hash, position) pairs of that text, so
time and memory follow its length. Texts without a repeated window skip the sort.

Rows: null or empty text has no words, zero statistics, and shares of 0. Rows without a label are not learnt
from; without rows of both labels the list is empty and every row is kept by it. Repeated rows are measured
alike. Columns that clash with a statistic are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanflow.llm.ranking import sample

MAX_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals")
SHARES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "bang_share", "capital_share")


def _removed(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match a class."""
    return F.length(text) - F.length(F.regexp_replace(text, F.lit(pattern), F.lit("")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it or the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array ``w``."""

    def covered(p: Column) -> Column:
        # p: places of repeated windows, ascending; each adds its words up to the next one
        reach = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

    def found(s: Column) -> Column:
        # s: (window, place) in order of the window; equal neighbours are repeats
        def twice(x: Column, j: Column) -> Column:
            same = [F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False)) for k in (j + 1, j - 1)]
            return same[0] | same[1]

        return _let(F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"])), covered)

    def counted(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(F.sort_array(pairs), found)).otherwise(F.lit(0))

    windows = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) > 3, _let(F.slice(windows, 1, F.greatest(F.size(w) - 2, F.lit(1))), counted)).otherwise(F.lit(0))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the columns COUNTS (long) and SHARES (double)."""
    body = F.coalesce(F.col(text), F.lit(""))
    kept = docs.drop(*(c for c in (*COUNTS, *SHARES) if c != text)).withColumn("_text", body)

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("repeats"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dups"))

    lines = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD))
    measured = kept.withColumns(
        {
            "_words": _let(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), of_words),
            "_lines": _let(lines, of_lines),
            "n_symbols": _removed(F.col("_text"), r"[#*$%&|<>]+").cast("long"),
            "n_bangs": _removed(F.col("_text"), r"!+").cast("long"),
            "n_capitals": _removed(F.col("_text"), r"[A-Z]+").cast("long"),
        }
    ).drop("_text", text)
    counted = measured.withColumns(
        {
            "n_words": F.col("_words.n").cast("long"),
            "word_chars": F.col("_words.chars").cast("long"),
            "n_repeat_words": F.col("_words.repeats").cast("long"),
            "n_lines": F.col("_lines.n").cast("long"),
            "n_dup_lines": F.col("_lines.dups").cast("long"),
        }
    ).drop("_words", "_lines")
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return counted.withColumns(
        {
            "word_length": F.col("word_chars") / n,
            "symbol_share": F.col("n_symbols") / n,
            "dup_line_share": F.col("n_dup_lines") / lines,
            "repeat_share": F.col("n_repeat_words") / n,
            "bang_share": F.col("n_bangs") / n,
            "capital_share": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.name)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _holds(x: np.ndarray, names: tuple[str, ...], rule: Rule) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        v = x[:, names.index(c.name)]
        out &= (v > c.threshold) if c.above else (v <= c.threshold)
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...], cuts: int) -> tuple[float, Condition | None]:
    """The condition with the largest gain of information over the rows given."""
    p, n = bad.sum(), len(bad) - bad.sum()
    found: tuple[float, Condition | None] = (1e-9, None)
    base = np.log2(p / (p + n))
    for k, name in enumerate(names):
        values = np.unique(x[:, k])
        if len(values) < 2:
            continue
        middles = (values[1:] + values[:-1]) / 2
        if len(middles) > cuts:
            middles = np.unique(np.quantile(x[:, k], np.linspace(0, 1, cuts + 2)[1:-1]).tolist() + [middles[0], middles[-1]])
        for t in middles:
            high = x[:, k] > t
            for above, mask in ((True, high), (False, ~high)):
                a, b = bad[mask].sum(), mask.sum() - bad[mask].sum()
                if a and (gain := a * (np.log2(a / (a + b)) - base)) > found[0]:
                    found = (gain, Condition(name, above, float(t)))
    return found


def learn(
    x: np.ndarray, bad: np.ndarray, names: tuple[str, ...], max_rules: int = 12, max_conditions: int = 4,
    min_precision: float = 0.9, cuts: int = 64, seed: int = 11,
) -> list[Rule]:
    """Sequential covering: rules in the order they were found."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    while len(rules) < max_rules:
        at = np.flatnonzero(left)
        if bad[at].sum() < 5 or bad[at].all():
            break
        at = rng.permutation(at)
        grow, prune = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
        rule: Rule = ()
        live = grow
        while len(rule) < max_conditions and 0 < bad[live].sum() < len(live):
            _, condition = _best_condition(x[live], bad[live], names, cuts)
            if condition is None:
                break
            rule += (condition,)
            live = live[_holds(x[live], names, (condition,))]

        def worth(r: Rule) -> float:
            hit = _holds(x[prune], names, r)
            p = bad[prune][hit].sum()
            return (2 * p - hit.sum()) / max(1, hit.sum())

        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = _holds(x[prune], names, rule)
        if not hit.any() or bad[prune][hit].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~_holds(x, names, rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that takes a row (from 1), 0 if none does."""
    if not rules:
        return F.lit(0)
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return out.otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, names: tuple[str, ...] = SHARES) -> list[Rule]:
    """Rules from at most ``max_rows`` labelled documents, chosen as ``ranking.sample`` does.

    Rows that the fixed base rule rejects teach nothing.
    """
    known = sample(docs, labels, doc_id, text, label, max_rows)
    measured = statistics(known, "_text").select("_id", "_print", "_label", base_failed().alias("_failed"), *names)
    rows = measured.distinct().select("_label", "_failed", *names).collect()
    table = np.array([(r[0], *r[2:]) for r in rows if not r[1]], dtype=float).reshape(-1, 1 + len(names))
    table = table[np.lexsort(table.T[::-1])]
    bad = table[:, 0] == 0
    return learn(table[:, 1:], bad, names) if bad.any() and not bad.all() else []


def judge(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed, rule (0: none) and kept of every document."""
    measured = statistics(docs.select(F.col(doc_id), F.col(text).alias("text")))
    return measured.withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )

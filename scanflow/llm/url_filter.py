"""URL verdicts: explicit rules first, gradient-boosted trees over lexical features for the rest.

Features are built-in column functions over the whole url: length, depth, shares of digits, character
entropy, parameter count, hyphens, host labels, and statistics of the host's suffix (its last two labels)
over the labelled urls. Trees are fitted to the logistic loss on a bounded labelled sample and become
nested conditional expressions, so scoring is one projection.

Suffix statistics come from one grouped count over all labelled urls, joined by suffix; a hot suffix is
reduced before the shuffle.

Rows: a null url, or one without ``://``, has an empty host and path; its features are those of an empty
text. Without labelled urls of both kinds the trees are empty and the verdict is ``allow``. Repeated urls are
judged alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanflow.session import cut

MAX_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "digit_share", "entropy", "parameters", "hyphens",
    "host_labels", "has_fragment", "suffix_share", "suffix_rows",
)


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and the start of a path."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def ruled(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    text = verdict = None
    # longest first, so the first that fits wins
    for rule in sorted(rules, key=lambda r: (-len(str(r)), str(r))):
        fits = rule.fits(host, path)
        text = F.when(fits, F.lit(str(rule))) if text is None else text.when(fits, F.lit(str(rule)))
        verdict = F.when(fits, F.lit(rule.verdict)) if verdict is None else verdict.when(fits, F.lit(rule.verdict))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if text is None else (text, verdict)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it or the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), 0)


def _entropy(text: Column) -> Column:
    """Bits per character. Sorted characters form runs; the runs' lengths are the counts."""

    def of_sorted(c: Column) -> Column:
        change = F.transform(c, lambda x, i: F.when(F.coalesce(F.get(c, i - 1) != x, F.lit(True)), i))

        def of_runs(r: Column) -> Column:
            sizes = F.transform(r, lambda i, k: (F.coalesce(F.get(r, k + 1), F.size(c)) - i).cast("double"))
            inner = F.aggregate(sizes, F.lit(0.0), lambda total, n: total + n * F.log2(n))
            return F.log2(F.size(c).cast("double")) - inner / F.size(c)

        return _let(F.filter(change, lambda i: i.isNotNull()), of_runs)

    return F.when(F.length(text) > 0, _let(F.sort_array(F.split(text, "")), of_sorted)).otherwise(F.lit(0.0))


def _lexical(df: DataFrame, url: str) -> DataFrame:
    """``df`` with _host, _path, _suffix and the lexical features of FEATURES (doubles)."""
    body = F.coalesce(F.col(url), F.lit(""))
    host, path = split_url(F.col(url))
    split = df.withColumns({"_u": body, "_host": F.coalesce(host, F.lit("")), "_path": F.coalesce(path, F.lit(""))})
    u = F.col("_u")
    numbers = {
        "url_length": F.length(u),
        "host_length": F.length("_host"),
        "path_length": F.length("_path"),
        "depth": F.regexp_count("_path", F.lit("/")),
        "digit_share": F.regexp_count(u, F.lit("[0-9]")) / F.greatest(F.length(u), F.lit(1)),
        "entropy": _entropy(u),
        "parameters": F.regexp_count(F.regexp_extract(u, r"(?s)\?([^#]*)", 1), F.lit("[^&=]+=[^&]*")),
        "hyphens": F.regexp_count("_host", F.lit("-")),
        "host_labels": F.regexp_count("_host", F.lit(r"[^.]+")),
        "has_fragment": F.contains(u, F.lit("#")).cast("int"),
    }
    typed = {k: v.cast("double") for k, v in numbers.items()}
    suffix = F.regexp_extract("_host", r"([^.]*\.?[^.]*)$", 1)
    return split.withColumns(typed).withColumn("_suffix", suffix).drop("_u")


def _suffix_counts(labelled: DataFrame) -> DataFrame:
    # written, so that a suffix with a large share of all urls is joined as two plain tables
    return cut(labelled.groupBy("_suffix").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_blocked").alias("_hits")))


def _with_suffixes(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds the share of blocked urls (smoothed to the half) and the log count per suffix."""
    rows, hits = F.coalesce("_rows", F.lit(0)), F.coalesce("_hits", F.lit(0))
    return (
        df.join(counts, "_suffix", "left")
        .withColumns({"suffix_share": (hits + 5.0) / (rows + 10.0), "suffix_rows": F.log1p(rows.cast("double"))})
        .drop("_rows", "_hits")
    )


Node = tuple  # ("leaf", value) or ("split", feature, threshold, left, right)


def _grow(x: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, cuts: list[np.ndarray], depth: int, rate: float, least: int) -> Node:
    g, h = gradient.sum(), curvature.sum()
    leaf = ("leaf", float(rate * g / (h + 1.0)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best = (1e-6, None, None)
    for k, edges in enumerate(cuts):
        if not len(edges):
            continue
        slot = np.searchsorted(edges, x[:, k], side="left")
        gl = np.cumsum(np.bincount(slot, gradient, len(edges) + 1))[:-1]
        hl = np.cumsum(np.bincount(slot, curvature, len(edges) + 1))[:-1]
        nl = np.cumsum(np.bincount(slot, minlength=len(edges) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(nl < least) | (len(x) - nl < least)] = 0
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), k, float(edges[at]))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    sides = [_grow(x[m], gradient[m], curvature[m], cuts, depth - 1, rate, least) for m in (left, ~left)]
    return ("split", best[1], best[2], *sides)


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node[0] == "leaf":
        return np.full(len(x), node[1])
    return np.where(x[:, node[1]] <= node[2], _apply(node[3], x), _apply(node[4], x))


@dataclass(frozen=True)
class Trees:
    names: tuple[str, ...]
    start: float
    nodes: tuple[Node, ...]

    def column(self) -> Column:
        """Log odds of ``block``."""

        def written(node: Node) -> Column:
            if node[0] == "leaf":
                return F.lit(node[1])
            return F.when(F.col(self.names[node[1]]) <= F.lit(node[2]), written(node[3])).otherwise(written(node[4]))

        out = F.lit(self.start)
        for node in self.nodes:
            out = out + written(node)
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for node in self.nodes:
            out = out + _apply(node, x)
        return out


def boost(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, rounds: int = 20, depth: int = 3, rate: float = 0.3, edges: int = 32, least: int = 5) -> Trees:
    """Trees fitted one after the other to the gradient of the logistic loss. ``y``: 1 for block."""
    if not len(y) or y.min() == y.max():
        return Trees(names, 0.0, ())
    share = y.mean()
    start = float(np.log(share / (1 - share)))
    cuts = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        middles = (values[1:] + values[:-1]) / 2
        cuts.append(middles if len(middles) <= edges else np.unique(np.quantile(middles, np.linspace(0, 1, edges))))
    f, nodes = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        node = _grow(x, y - p, p * (1 - p), cuts, depth, rate, least)
        f = f + _apply(node, x)
        nodes.append(node)
    return Trees(names, start, tuple(nodes))


def fit(labelled: DataFrame, url: str = "url", label: str = "verdict", max_rows: int = MAX_ROWS) -> tuple[Trees, DataFrame]:
    """Trees from at most ``max_rows`` labelled urls (in the order of a hash of the url), and the counts
    of labelled suffixes. ``label`` holds ``block`` or ``allow``; other rows are left out."""
    known = labelled.where(F.col(label).isin("block", "allow")).select(F.col(url).alias("url"), (F.col(label) == "block").cast("int").alias("_blocked"))
    host, _ = split_url(F.col("url"))
    suffix = F.regexp_extract(F.coalesce(host, F.lit("")), r"([^.]*\.?[^.]*)$", 1)
    suffixes = _suffix_counts(known.select(suffix.alias("_suffix"), "_blocked"))
    picked = known.orderBy(F.xxhash64("url"), "url", "_blocked").limit(max_rows)
    measured = _with_suffixes(_lexical(picked, "url"), suffixes)
    rows = measured.select("_blocked", *FEATURES).collect()
    table = np.array([tuple(r) for r in rows], dtype=float).reshape(len(rows), 1 + len(FEATURES))
    table = table[np.lexsort(table.T[::-1])]
    return boost(table[:, 1:], table[:, 0]), suffixes


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and log_odds of every page.

    ``labelled`` has the columns ``url`` and ``verdict``; by default the pages that a rule decides teach the
    trees. Those labels know only the hosts of the rules, so how good the verdict is elsewhere is not measured; labels
    of other urls are what a real use passes here.
    """
    slim = pages.select(F.col(key).alias(key), F.col(url).alias("_url"))
    if labelled is None:
        rule, verdict = ruled(rules, *split_url(F.col("_url")))
        labelled = slim.select(F.col("_url").alias("url"), verdict.alias("verdict"))
    trees, suffixes = fit(labelled)
    measured = _with_suffixes(_lexical(slim, "_url"), suffixes)
    rule, verdict = ruled(rules, F.col("_host"), F.col("_path"))
    out = measured.withColumns({"rule": rule, "_verdict": verdict, "log_odds": trees.column()})
    learnt = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        key, F.col("_host").alias("host"), F.col("_path").alias("path"), "rule",
        F.coalesce("_verdict", learnt).alias("verdict"), "log_odds",
    )

"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a linear score of text features. Preference pairs (a document labelled good, one
labelled bad) give feature differences; the weights minimize the logistic loss of those differences, so only
the order between documents is learnt. The score's zero is then set at a quantile of the training scores:
the quantile that separates the labels best. The published score is the logistic of the shifted strength.

Fitting uses a bounded sample: at most ``max_rows`` different labelled documents, one of each id before the
others, in the order of a hash, and ``max_pairs`` pairs drawn from them. Every row is scored, over its whole text, in one pass without a
shuffle.

Rows: null or empty text has the features of an empty text and is scored like any other. Rows without a
label (or with a null one) are not learnt from. Labels of one kind only, or none, give weights 0: every
score is 0.5. Repeated rows score alike. Language, source and id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanflow.llm import textbytes as tb

MAX_ROWS = 20_000
MAX_PAIRS = 200_000
SLAB = 1 << 20

FEATURES = (
    "log_words", "log_chars", "word_length", "upper_share", "digit_share", "symbol_share", "pipe_share",
    "bang_share", "stop_share", "line_share", "repeat_share", "distinct_share", "long_word_share", "comma_share",
)

#: Byte classes behind the shares.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>=@~^{}[]", "pipe": b"|", "bang": b"!", "stop": b".?", "line": b"\n", "comma": b","}


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    zero: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        # the sum runs over a fixed order of columns, so a row's score never depends on its batch
        out = np.zeros(len(x))
        for k in range(x.shape[1]):
            out += (x[:, k] - self.mean[k]) / self.scale[k] * self.weights[k]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.strength(x) - self.zero, -500, 500)))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text of a buffer."""
    rows = len(offsets) - 1
    if not rows:
        return np.zeros((0, len(FEATURES)))
    counts = {}
    for name, chars in _CLASSES.items():
        member = np.zeros(256, dtype=bool)
        member[list(chars)] = True
        seen = np.concatenate([[0], np.cumsum(member[data])])
        counts[name] = (seen[offsets[1:]] - seen[offsets[:-1]]).astype(float)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = (lead[offsets[1:]] - lead[offsets[:-1]]).astype(float)
    begin, end, first = tb.words(data, offsets)
    n = np.diff(first).astype(float)
    of_row = np.repeat(np.arange(rows), np.diff(first))
    size = (end - begin).astype(float)
    word = tb.Rolling(data).of(begin, end) if len(begin) else np.zeros(0, np.uint64)

    def by_row(values: np.ndarray) -> np.ndarray:
        return np.bincount(of_row, weights=values, minlength=rows)

    again = np.zeros(len(word))
    if len(word) > 1:
        again[1:] = (word[1:] == word[:-1]) & (of_row[1:] == of_row[:-1])
    order = np.lexsort((word, of_row))
    fresh = np.ones(len(word))
    if len(word) > 1:
        a, b = order[1:], order[:-1]
        fresh[1:] = (word[a] != word[b]) | (of_row[a] != of_row[b])
    distinct = np.bincount(of_row[order], weights=fresh, minlength=rows) if len(word) else np.zeros(rows)
    per_word, per_char = np.maximum(n, 1), np.maximum(chars, 1)
    return np.stack(
        [
            np.log1p(n), np.log1p(chars), by_row(size) / per_word, counts["upper"] / per_char, counts["digit"] / per_char,
            counts["symbol"] / per_word, counts["pipe"] / per_word, counts["bang"] / per_word, counts["stop"] / per_word,
            counts["line"] / per_word, by_row(again) / per_word, distinct / per_word, by_row((size > 20).astype(float)) / per_word,
            counts["comma"] / per_word,
        ],
        axis=1,
    )


def _column_features(column: pa.Array) -> np.ndarray:
    data, offsets = tb.column_bytes(column)
    parts = [
        features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tb.row_groups(offsets, SLAB)
    ]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _column_features(batch.column("text"))
        arrays = [*batch.columns[:-1], *(pa.array(x[:, k]) for k in range(x.shape[1]))]
        yield pa.RecordBatch.from_arrays(arrays, names=["_id", "label", "_print", *FEATURES])


def fit_pairs(x: np.ndarray, label: np.ndarray, max_pairs: int = MAX_PAIRS, seed: int = 7, penalty: float = 1e-3, steps: int = 60) -> Model:
    """Weights of the logistic loss over feature differences, zero at the best quantile of the scores."""
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    pairs = min(max_pairs, 20 * (len(good) + len(bad)))
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(width)
    for _ in range(steps):  # Newton steps, damped by the penalty
        p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -500, 500)))
        gradient = -(d * p[:, None]).mean(axis=0) + penalty * w
        curvature = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(width)
        step = np.linalg.solve(curvature, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    cuts = np.quantile(s, np.arange(1, 1000) / 1000)
    ordered_bad, ordered_good = np.sort(s[bad]), np.sort(s[good])
    right = np.searchsorted(ordered_bad, cuts) / len(bad) + 1 - np.searchsorted(ordered_good, cuts) / len(good)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return Model(mean, scale, w, float(cuts[best[len(best) // 2]]))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """_id, _label, _print (hash of the text) and _text of at most ``max_rows`` different labelled documents.

    Rows equal in id, text and label are one document, yet all of them are returned. One document of each
    labelled id comes first, then the others, both in the order of a hash that knows no label and no feature:
    neither the bound nor an id with a large share of the rows decides which labels are seen.
    """
    picked = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(max_rows)
    )
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(body).alias("_print"), body.alias("_text"))
    # picked, firsts and chosen are bounded by max_rows, hence small enough to send to every executor
    known = texts.select("_id", "_print").join(F.broadcast(picked), "_id").distinct()
    firsts = known.groupBy("_id").agg(F.min("_print").alias("_first"))
    chosen = (
        known.join(F.broadcast(firsts), "_id")
        .orderBy(F.col("_print") != F.col("_first"), F.xxhash64("_id", "_print"), "_id", "_print", "_label")
        .limit(max_rows)
        .select("_id", "_print", "_label")
    )
    return texts.join(F.broadcast(chosen), ["_id", "_print"]).select("_id", "_label", "_print", "_text")


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    max_rows: int = MAX_ROWS, usable: Column | None = None,
) -> Model:
    """Fit on at most ``max_rows`` labelled documents for which ``usable`` (over the label table) holds."""
    known = labels.where(usable) if usable is not None else labels
    rows = sample(docs, known, doc_id, text, label, max_rows).withColumnsRenamed({"_label": "label", "_text": "text"})
    id_type = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, label int, _print long, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = rows.mapInArrow(_measure, schema).distinct().select("label", *FEATURES).collect()
    table = np.array([tuple(r) for r in rows], dtype=float).reshape(len(rows), 1 + len(FEATURES))
    table = table[np.lexsort(table.T[::-1])]
    return fit_pairs(table[:, 1:], table[:, 0])


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score column (a clashing one is replaced). One pass, no shuffle."""
    kept = docs.drop(score)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = model.score(_column_features(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, score])

    schema = T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType())])
    return kept.mapInArrow(rate, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for ids never learnt from: crc32 of the id's text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def rate_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of held-out ids are not used."""
    model = fit(docs, labels, doc_id, text, label, max_rows, ~held_out(doc_id))
    slim = docs.select(F.col(doc_id), F.col(text))
    return scored(slim, model, text).select(
        doc_id, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

"""Groups of documents with equal texts, by tree-merging sorted runs of digests.

Texts are equal when they agree after all characters of ``[\\x20\\x09-\\x0D]`` are deleted.

* **Runs.** Every input partition gives rows of digest, normalised length, an independent 64-bit check, place and
  original length. Within a run equal texts are reduced to one entry: the best row and the number of rows.
* **Rounds.** Runs merge along a binomial tree whose edges are taken ``BITS`` at a time: in each round a run
  goes to the run that has its low ``BITS`` bits cleared, and up to ``2**BITS`` sorted runs meet there. Every range of
  digests (there are ``RANGES``, more than tasks) has a tree of its own, so no task holds a whole run, and the last round
  leaves one sorted run a range, not one in all.
* **Verified.** Entries are one text only if digest, length and check all agree; the merge then keeps the better of their
  rows at every level. A text that a third of all documents share is one entry per run after the first step, and at
  most ``2**BITS`` entries meet in a round.
* **Answers.** The last runs are joined to the entries of the first ones (at most one entry a run and text), and those to
  the rows by (run, text), so no task gets all rows of a hot text.

Rows: a null text counts as empty, and all empty texts are one group. Of rows equal in length and id, and of null ids
(which come after all others), the first in the input's order stays; exactly one row of a group is kept.
An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanflow.llm import textbytes as tb
from scanflow.session import cut

RUNS = 1024
BITS = 4
RANGES = 1 << 14
SLAB = 1 << 20
SAME = ["digest", "n_bytes", "check"]


def _deleted() -> np.ndarray:
    """Which bytes go: the space and 9 to 13."""
    table = np.zeros(256, dtype=bool)
    table[[0x20, 9, 10, 11, 12, 13]] = True
    return table


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gone = _deleted()
    for batch in batches:
        data, offsets = tb.column_bytes(batch.column("text"))
        for a, b in tb.row_groups(offsets, SLAB):
            body, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            stays = ~gone[body]
            ends = np.concatenate([[0], np.cumsum(stays)])[cuts]
            points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])[cuts]
            rest = memoryview(body[stays].tobytes())
            pieces = [rest[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]
            check = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in pieces), np.uint64, len(pieces))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").slice(a, b - a), batch.column("run").slice(a, b - a),
                    batch.column("at").slice(a, b - a), pa.array(np.diff(points)),
                    pa.array([hashlib.sha256(p).digest() for p in pieces], pa.binary()),
                    pa.array(np.diff(ends)), pa.array(check.view(np.int64)),
                ],
                names=["doc", "run", "at", "points", *SAME],
            )


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int = RUNS) -> DataFrame:
    """A row per document: doc, run, place in the input, code points and the three marks of its normalised text."""
    rows = docs.select(
        F.col(doc_id).alias("doc"),
        F.pmod(F.spark_partition_id(), F.lit(runs)).cast("int").alias("run"),
        F.monotonically_increasing_id().alias("at"),
        F.col(text).cast("string").alias("text"),
    )
    kept = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "text"]
    marks = [("points", T.LongType()), ("digest", T.BinaryType()), ("n_bytes", T.LongType()), ("check", T.LongType())]
    return rows.mapInArrow(_digests, T.StructType(kept + [T.StructField(n, t) for n, t in marks]))


def first_runs(rows: DataFrame, ranges: int = RANGES) -> DataFrame:
    """One entry per run and text: the best row and how many there are."""
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc").isNull().alias("none"), "doc", "at")).alias("best")
    part = F.pmod(F.xxhash64("digest"), F.lit(ranges)).cast("int")
    return rows.groupBy("run", *SAME).agg(best, F.count(F.lit(1)).alias("rows")).withColumn("range", part)


def merge_round(runs: DataFrame, bits: int = BITS) -> DataFrame:
    """Every run goes to the one with its low ``bits`` bits cleared (renumbered densely) and is merged there."""
    met = (
        runs.withColumn("run", F.shiftright("run", bits))
        .repartition("range", "run")
        .sortWithinPartitions("range", "run", *SAME)
    )
    return met.groupBy("range", "run", *SAME).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))


def merged(runs: DataFrame, n_runs: int, bits: int = BITS) -> DataFrame:
    """One sorted run a range, after as many rounds as ``n_runs`` runs need."""
    while n_runs > 1:
        runs, n_runs = merge_round(runs, bits), -(-n_runs >> bits)
    return runs


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int = RUNS, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    return _groups(cut(digests(docs, doc_id, text, runs)), bits).select(
        F.col("doc").alias(doc_id), "keep_id", "group_size", "kept", "text_sha256"
    )


def _groups(rows: DataFrame, bits: int) -> DataFrame:
    highest = rows.agg(F.max("run")).first()[0]
    first = cut(first_runs(rows))
    last = merged(first, (highest or 0) + 1, bits).select(*SAME, "best", F.col("rows").alias("group_size"))
    answers = first.select("run", *SAME).join(last, SAME)
    return rows.join(answers, ["run", *SAME]).select(
        "doc", "at", F.col("best.doc").alias("keep_id"), "group_size",
        (F.col("at") == F.col("best.at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each group, all columns unchanged."""
    table = cut(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("nr")))
    rows = cut(digests(table.select(F.struct(f"row.{doc_id}", "nr").alias("doc"), f"row.{text}"), "doc", text))
    ids = rows.select(F.col("doc.nr").alias("nr"), F.col(f"doc.{doc_id}").alias("doc"), *[c for c in rows.columns if c != "doc"])
    groups = _groups(ids.withColumn("at", F.col("nr")), bits).where("kept").select(F.col("at").alias("nr"))
    return table.join(groups, "nr", "left_semi").select("row.*")

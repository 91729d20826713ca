"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

A document contains an item if it holds at least ``share`` of the item's distinct word shingles, however long
the document is. Items are partitioned by size (powers of two). All items of a partition get MinHash
signatures of one length, the shingles of least hash: so many that a document with the wanted share of any
item of the partition must hold at least one of them (one more than the shingles that may be missing). The
search therefore loses no pair. Documents too short for a partition are not looked up in it. Every candidate
pair is then verified on the full shingle sets.

Items are the query set. They are read in blocks of bounded size; each block is sent to the executors and
meets every document in one pass without a shuffle. Nothing of the documents reaches the driver.

Rows: null texts have no shingles and match nothing, on either side. A text shorter than a shingle is one
shingle as a whole. Repeated documents or items each give their own rows. Ids may be null and are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanflow.llm import textbytes as tb

SHINGLE = 5
SHARE = 0.8
BLOCK_SHINGLES = 2_000_000
SLAB = 1 << 20


def _hashes(data: np.ndarray, offsets: np.ndarray, size: int):
    lowered = tb.lower_ascii(data)
    begin, end, first = tb.words(lowered, offsets)
    word = tb.Rolling(lowered).of(begin, end) if len(begin) else np.zeros(0, np.uint64)
    return tb.shingles(word, first, size)


def _missing(n: int, share: float) -> int:
    """Most shingles of n that a match may lack."""
    return n - int(np.ceil(share * n - 1e-9))


@dataclass
class Index:
    """One block of items: signatures and full sets, as sorted arrays."""

    ids: list
    sizes: np.ndarray
    least: np.ndarray  # shingles that a document must have to be looked up for the item
    signature: np.ndarray  # sorted hashes
    owner: np.ndarray  # item of each signature hash
    member: np.ndarray  # all shingles, item after item, each run sorted
    bounds: np.ndarray
    share: float

    @classmethod
    def build(cls, ids: list, sets: list[np.ndarray], share: float) -> "Index":
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        signature, owner, least = [], [], []
        for k, s in enumerate(sets):
            upper = 1 << int(np.ceil(np.log2(len(s))))  # the partition's largest item
            lower = upper // 2 + 1 if upper > 1 else 1
            signature.append(s[: _missing(upper, share) + 1])
            owner.append(np.full(len(signature[-1]), k))
            least.append(lower - _missing(lower, share))
        joint, whose = np.concatenate(signature), np.concatenate(owner)
        order = np.argsort(joint, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return cls(ids, sizes, np.array(least), joint[order], whose[order], np.concatenate(sets), bounds, share)

    def parts(self) -> tuple:
        """Plain arrays, which travel without this module."""
        return self.ids, self.sizes, self.least, self.signature, self.owner, self.member, self.bounds, self.share

    def matches(self, hashes: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of all rows; ``rows`` is sorted."""
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(self.signature & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        near = np.flatnonzero(bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        low = np.searchsorted(self.signature, hashes[near], side="left")
        high = np.searchsorted(self.signature, hashes[near], side="right")
        near, low, high = near[high > low], low[high > low], high[high > low]
        if not len(near):
            return []
        count = high - low
        at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pairs = np.unique(np.stack([np.repeat(rows[near], count), self.owner[at]], axis=1), axis=0)
        found = []
        looked, first = np.unique(pairs[:, 0], return_index=True)
        begin, end = np.searchsorted(rows, looked), np.searchsorted(rows, looked + 1)
        for row, a, b, mine in zip(looked, begin, end, np.split(pairs[:, 1], first[1:])):
            own = np.unique(hashes[a:b])
            for item in mine:
                if len(own) < self.least[item]:
                    continue
                wanted = self.member[self.bounds[item] : self.bounds[item + 1]]
                at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                shared = int((own[at] == wanted).sum())
                if shared >= self.sizes[item] - _missing(int(self.sizes[item]), self.share):
                    found.append((int(row), int(item), shared))
        return found


def _sets(items: DataFrame, item_id: str, text: str, shingle: int) -> DataFrame:
    """item and its sorted distinct shingles; items without words are left out."""

    def hash_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column("text"))
            hashes, rows, _ = _hashes(data, offsets, shingle)
            cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array(sets, type=pa.list_(pa.int64()))], names=["item", "set"]
            )

    slim = items.select(F.col(item_id).cast("long").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInArrow(hash_items, "item long, set array<long>").where(F.size("set") > 0)


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", share: float = SHARE, shingle: int = SHINGLE, limit: int = BLOCK_SHINGLES) -> Iterator[Index]:
    """The items as indexes of about ``limit`` shingles each (one item at least), in the order of their ids."""
    ids, sets, size = [], [], 0
    for row in _sets(items, item_id, text, shingle).orderBy("item", "set").toLocalIterator():
        if sets and size + len(row["set"]) > limit:
            yield Index.build(ids, sets, share)
            ids, sets, size = [], [], 0
        ids.append(row["item"])
        sets.append(np.array(row["set"], dtype=np.int64).view(np.uint64))
        size += len(sets[-1])
    if sets:
        yield Index.build(ids, sets, share)


def _slab_matches(index: Index, data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[tuple[int, int, int]]:
    found = []
    for a, b in tb.row_groups(offsets, SLAB):
        hashes, rows, _ = _hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
        found += [(row + a, item, shared) for row, item, shared in index.matches(hashes, rows)]
    return found


RESULT = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", share: float = SHARE, shingle: int = SHINGLE, limit: int = BLOCK_SHINGLES,
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every pair that reaches ``share``."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = spark.createDataFrame([], RESULT)
    for index in blocks(items, item_id, item_text, share, shingle, limit):
        shared = spark.sparkContext.broadcast(index.parts())  # at most ``limit`` shingles beyond one item

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in batches:
                data, offsets = tb.column_bytes(batch.column("text"))
                found = _slab_matches(index, data, offsets, shingle)
                if not found:
                    continue
                row, item, n = (np.array(x, dtype=np.int64) for x in zip(*found))
                size = index.sizes[item]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pa.array(row)), pa.array([index.ids[i] for i in item], type=pa.int64()), pa.array(n), pa.array(size), pa.array(n / size)],
                    names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
                )

        out = out.unionByName(slim.mapInArrow(search, RESULT))
    return out


def without_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    share: float = SHARE, shingle: int = SHINGLE, limit: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns are kept."""
    out = docs
    for index in blocks(items, item_id, item_text, share, shingle, limit):
        shared = docs.sparkSession.sparkContext.broadcast(index.parts())

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in batches:
                data, offsets = tb.column_bytes(batch.column(text))
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[row for row, _, _ in _slab_matches(index, data, offsets, shingle)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out

"""Merkle manifest of a table as a postorder append log, with proofs by closed-form positions.

A group's leaves, in the order of their key, are the lowest level of a tree. While a level has more than one node, every
``FAN`` consecutive nodes (the last run may be shorter, one node even) become the hash of their concatenated digests.
The roots of the groups, in the order of the groups, are the leaves of one more such tree.

* **Log.** A node is appended when its last child is there, the open runs at the right edge when the leaves end. Nodes before a
  node are counted level by level from the sizes of subtrees, so the position of any node is a formula of its level, its
  index and the number of leaves (``node_position``); no index is kept. A subtree is a contiguous piece of the log.
* **Builders.** A builder owns an aligned subtree of ``FAN**TIER`` leaves and appends its piece of the log. The roots
  of builders are the leaves of the next tier of builders, so a tree of any size takes few tiers, and a group with a third of all
  rows is spread over as many builders as any other rows.
* **Proofs.** From the top tier down every piece passes to its leaves the siblings on the way to the root, read from the piece
  at their positions. A step holds the digests left and right of the node, so folding a leaf needs no positions.
* **Order.** Leaves are numbered by one sort over ranges: the place in a range plus the rows of the group in the ranges before,
  of which there are as many as partitions.

Rows: a null field is the text ``-``; a null group is a group of its own and comes first; a null key comes first in its
group; rows equal in group and key are ordered by their leaf; rows equal in all columns are leaves of their own. An empty table gives no
rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanflow.session import cut

FAN = 8
TIER = 4
SLICE = 1024
_PLACE = (1 << 33) - 1


def tree_height(leaves: int) -> int:
    """Levels above the leaves."""
    height = 0
    while FAN**height < leaves:
        height += 1
    return height


def node_position(level: int, index, leaves: int, height: int | None = None):
    """Place of a node in the log of a tree; ``index`` is a number or an array of numbers.

    Before a node that ends at leaf ``end`` stand the nodes of lower levels that end there or earlier, and
    the nodes of its own and higher levels that end earlier.
    """
    height = tree_height(leaves) if height is None else height
    end = np.minimum((np.asarray(index, dtype=np.int64) + 1) * FAN**level, leaves)
    place = np.zeros_like(end)
    for below in range(level):
        place += -(-end // FAN**below)
    for above in range(level, height + 1):
        place += (end - 1) // FAN**above
    return place


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def append_log(leaves: Sequence[str], height: int) -> list[str]:
    """All nodes of a tree in the order of their completion."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(height + 1)]

    def append(level: int, node: str) -> None:
        log.append(node)
        if level < height:
            open_runs[level].append(node)
            if len(open_runs[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        append(level + 1, digest(run))

    for leaf in leaves:
        append(0, leaf)
    for level in range(height):
        if open_runs[level]:
            close(level)
    return log


def field(value: Column) -> Column:
    """Text of a field in a leaf: its length in bytes, a colon and its value, or ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(group: Column) -> Column:
    """A text that sorts like the group, bytewise and null first, and is never null."""
    text = group.cast("string")
    return F.when(text.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), text))


def number(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` of (grp, ...) with ``idx`` from 0 in the order of their group and ``total``, the rows of the group.

    Equal rows are told apart by their place in the written input, so many of them still spread over ranges.
    """
    sorted_rows = (
        cut(rows)
        .withColumn("_tie", F.monotonically_increasing_id())
        .orderBy("grp", *order, "_tie")
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    at = F.col("_at")
    placed = cut(sorted_rows.select(*rows.columns, F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit(_PLACE)).alias("_nr")))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy("grp", "_part")
        .agg(F.min("_nr").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first"))
        .withColumn("total", F.sum("_rows").over(Window.partitionBy("grp")))
        .select("grp", "_part", "_shift", "total")
    )
    return placed.join(parts, ["grp", "_part"]).select(*rows.columns, (F.col("_nr") + F.col("_shift")).alias("idx"), "total")


def _height(total: Column) -> Column:
    return sum((F.when(total > F.lit(FAN**j), 1).otherwise(0) for j in range(21)), F.lit(0))


def _append_pieces(tier: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = []
            for height, members in zip(batch.column("height").to_pylist(), batch.column("members")):
                leaves = members.values.field("digest").to_pylist()
                logs.append(append_log(leaves, min(TIER, height - TIER * tier)))
            names = ["grp", "builder", "total", "height", "members"]
            payload = [batch.column(n) for n in names[:-1]]
            lists = batch.column("members")
            inner = lists.flatten().field("payload")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            carried = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([*payload, pa.array(logs, pa.list_(pa.string())), carried], names=[*names[:-1], "log", "payload"])

    return build


def _pieces(nodes: DataFrame, tier: int) -> DataFrame:
    """One row per builder of a tier: its piece of the log and what its leaves carry, in their order."""
    members = F.sort_array(F.collect_list(F.struct("idx", "digest", "payload"))).alias("members")
    width = FAN**TIER
    grouped = nodes.groupBy("grp", F.floor(F.col("idx") / F.lit(width)).cast("long").alias("builder"), "total").agg(members)
    payload = nodes.schema["payload"].dataType.simpleString()
    schema = f"grp string, builder long, total long, height int, log array<string>, payload array<{payload}>"
    return grouped.withColumn("height", _height(F.col("total"))).mapInArrow(_append_pieces(tier), schema)


@dataclass
class Tree:
    """Pieces of the log, a table per tier, lowest first."""

    tiers: list[DataFrame]

    def roots(self) -> DataFrame:
        """grp and root of every group."""
        tops = [_top(pieces, t).select("grp", F.element_at("log", -1).alias("root")) for t, pieces in enumerate(self.tiers)]
        out = tops[0]
        for more in tops[1:]:
            out = out.unionByName(more)
        return out

    def nodes(self) -> DataFrame:
        """The log itself: grp, position and digest of every node."""
        out = None
        for tier, pieces in enumerate(self.tiers):
            flat = pieces.mapInArrow(_addressed(tier), "grp string, position long, level int, node long, digest string")
            out = flat if out is None else out.unionByName(flat)
        return out


def _top(pieces: DataFrame, tier: int) -> DataFrame:
    low = F.col("height") <= TIER * (tier + 1)
    return pieces.where(low if tier == 0 else low & (F.col("height") > TIER * tier))


def grow(numbered: DataFrame) -> Tree:
    """The trees of all groups of (grp, idx, total, digest, payload)."""
    most = numbered.agg(F.max("total")).first()[0] or 1
    nodes, tiers = numbered, []
    for tier in range(max(1, -(-tree_height(most) // TIER))):
        pieces = cut(_pieces(nodes, tier))
        tiers.append(pieces)
        nodes = pieces.where(F.col("height") > TIER * (tier + 1)).select(
            "grp", F.col("builder").alias("idx"), "total", F.element_at("log", -1).alias("digest"), F.lit(0).alias("payload")
        )
    return Tree(tiers)


def _levels(log: Sequence[str], leaves: int, height: int) -> list[list[str]]:
    """Digests of each level of a piece, read at their positions."""
    out = []
    for level in range(height + 1):
        count = -(-leaves // FAN**level)
        out.append([log[p] for p in node_position(level, np.arange(count), leaves, height)])
    return out


def _addressed(tier: int):
    """Positions in the whole log of a group; leaves of a higher tier are nodes of the tier below and left out."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                height = min(TIER, row["height"] - TIER * tier)
                levels = _levels(row["log"], len(row["payload"]), height)
                for level in range(1 if tier else 0, height + 1):
                    count = len(levels[level])
                    nodes = row["builder"] * FAN ** (TIER - level) + np.arange(count)
                    places = node_position(TIER * tier + level, nodes, row["total"], row["height"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["grp"]] * count), pa.array(places), pa.array([TIER * tier + level] * count, pa.int32()),
                         pa.array(nodes), pa.array(levels[level])],
                        names=["grp", "position", "level", "node", "digest"],
                    )

    return flat


_STEPS = "array<struct<left:string,right:string>>"


def _sides(nodes: Sequence[str]) -> list[tuple[str, str]]:
    """What stands left and right of every node in its run."""
    out = []
    for first in range(0, len(nodes), FAN):
        run = nodes[first : first + FAN]
        out += [("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))]
    return out


def _hand_down(tier: int):
    """The steps from every leaf of a piece to the root."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("grp", "builder", "height", "log", "root", "above", "path")}
                payload = batch.column("payload")[i].values
                n = len(payload)
                height = min(TIER, row["height"] - TIER * tier)
                levels = _levels(row["log"], n, height)
                sides = [_sides(nodes) for nodes in levels[:-1]]
                above = [(s["left"], s["right"]) for s in row["path"]]
                for a in range(0, n, SLICE):
                    b = min(n, a + SLICE)
                    steps = [s for k in range(a, b) for s in [side[k // FAN**level] for level, side in enumerate(sides)] + above]
                    offsets = np.arange(b - a + 1, dtype=np.int32) * (height + len(above))
                    pairs = pa.StructArray.from_arrays(
                        [pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.string())], ["left", "right"]
                    )
                    same = [pa.array([row[c]] * (b - a), pa.string()) for c in ("grp", "root", "above")]
                    first = row["builder"] * FAN**TIER
                    yield pa.RecordBatch.from_arrays(
                        [same[0], pa.array(np.arange(first + a, first + b)), pa.array(levels[0][a:b]), payload.slice(a, b - a), *same[1:],
                         pa.ListArray.from_arrays(pa.array(offsets), pairs)],
                        names=["grp", "idx", "digest", "payload", "root", "above", "path"],
                    )

    return expand


def proofs(tree: Tree, tops: DataFrame) -> DataFrame:
    """grp, idx, digest, payload and the steps (``path``) of every leaf.

    ``tops`` has a row per group: grp, root, above and path, the steps that go on from the group's root (none for a
    single tree); ``root`` and ``above`` are handed on unchanged.
    """
    down = None
    for tier in range(len(tree.tiers) - 1, -1, -1):
        pieces = tree.tiers[tier]
        whole = _top(pieces, tier).join(tops, "grp")
        if down is not None:
            lower = pieces.where(F.col("height") > TIER * (tier + 1))
            ends = down.select("grp", F.col("idx").alias("builder"), "root", "above", "path")
            whole = whole.unionByName(lower.join(ends, ["grp", "builder"]))
        payload = pieces.schema["payload"].dataType.elementType.simpleString()
        schema = f"grp string, idx long, digest string, payload {payload}, root string, above string, path {_STEPS}"
        down = whole.mapInArrow(_hand_down(tier), schema)
    return down


@dataclass
class Manifest:
    """Trees of the groups and the tree of their roots."""

    groups: Tree
    forest: Tree


def manifest(docs: DataFrame, group: str, key: str, columns: Sequence[str], carry: Sequence[Column] = ()) -> Manifest:
    """Trees over the leaves of ``docs``: hashes of ``columns``, by ``group`` in the order of ``key``.

    Leaves carry the key and the columns of ``carry``.
    """
    leaves = docs.select(
        group_key(docs[group]).alias("grp"),
        leaf_digest(*[docs[c] for c in columns]).alias("digest"),
        F.struct(docs[key].alias("key"), *carry).alias("payload"),
    )
    rows = leaves.select("grp", F.col("payload.key").alias("key"), "digest", "payload")
    groups = grow(number(rows, ["key", "digest"]).drop("key"))
    tops = groups.roots().select(F.lit("").alias("grp"), F.col("root").alias("digest"), F.col("grp").alias("payload"))
    return Manifest(groups, grow(number(tops, ["payload"])))


def all_proofs(made: Manifest) -> DataFrame:
    """A row per leaf: its payload's columns, leaf, subroot, root and ``path``, the steps to the root."""
    roots = made.forest.roots().select("grp", "root", F.lit("").alias("above"), F.array().cast(_STEPS).alias("path"))
    subroots = proofs(made.forest, roots).select(
        F.col("payload").alias("grp"), F.col("digest").alias("above"), "root", "path"
    )
    leaves = proofs(made.groups, subroots)
    return leaves.select("payload.*", F.col("digest").alias("leaf"), F.col("above").alias("subroot"), "root", "path")


def siblings_digest(path: Column) -> Column:
    """Hash of all siblings on the way to the root."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


#: The columns of a leaf, in their order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def audit(docs: DataFrame) -> DataFrame:
    """Every document's leaf and proof, and whether its leaf after tampering still folds to the root.

    Tampering lower-cases A-Z in the text of the documents whose crc32(doc_id as text) is divisible by 3; a null id is never one.
    """
    hit = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    values = {c: docs[c] for c in COLUMNS}
    changed = leaf_digest(*(values | {"text": F.translate(docs["text"], _UPPER, _LOWER)}).values())
    made = manifest(docs, "lang", "doc_id", COLUMNS, [F.when(hit, changed).alias("changed")])
    rows = all_proofs(made)
    path = F.col("path")
    return rows.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(path).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), path).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

"""Placement of rows by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards. At each level a row draws one number per child from a hash of its
key and the child's name, ``-ln(u) / weight``, and goes to the child with the least draw; a child's weight is
the sum of what it holds. Draws of different children are independent, so a changed weight moves rows only
into or out of that child: movement stays inside the subtrees whose weights change, and an added subtree
takes rows only into itself.

A new shard joins as a subtree of its own (a region with one rack), so no row moves between older shards. The tree
of more than ``BASE`` shards is the tree of ``BASE`` shards grown one by one, so the number of shards alone decides the tree, and
placing over one more shard is the same as growing. Fewer than ``BASE`` shards are dealt evenly over regions and racks.

Everything is a column expression. Slots are numbered without sorting a whole shard: rows are cut into pieces
by a hash of the key and of what breaks ties, numbered within (shard, piece), and shifted by the sizes of the pieces before. Only
the piece counts, ``shards * pieces`` rows, are summed along a shard.

Rows: a null key counts as the empty string, a null text as empty (size 1, checksum 0). Equal keys share
their shard; equal rows take neighbouring slots, and which is which cannot be told apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanflow.llm.columns import free

Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

REGIONS, RACKS, BASE = 2, 2, 16


def even_tree(shards: int, regions: int = REGIONS, racks: int = RACKS, base: int = BASE) -> dict:
    """Shards 0 .. shards - 1 of weight 1: the first ``base`` dealt in order over regions and racks, the others grown."""
    if shards > base:
        return grown(even_tree(shards - 1, regions, racks, base), shards - 1)
    tree: dict = {}
    for shard in range(shards):
        region, rack = shard * regions // shards, shard * regions * racks // shards % racks
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> dict:
    """The tree with one more shard, in a region of its own."""
    return {**tree, f"region-of-{shard}": {"rack0": {shard: weight}}}


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _least(key: Column, children: Sequence[tuple[str, float, Column]]) -> Column:
    """Value of the child with the least draw; children are (name, weight, value)."""
    live = [c for c in children if c[1] > 0]
    if len(live) == 1:
        return live[0][2]
    draws = F.array(*(F.struct(_draw(key, name, weight).alias("draw"), F.lit(i).alias("child")) for i, (name, weight, _) in enumerate(live)))
    won = F.array_min(draws)["child"]
    out = F.when(won == 0, live[0][2])
    for i, (_, _, value) in enumerate(live[1:], 1):
        out = out.when(won == i, value)
    return out


def placed(key: Column, tree: Tree) -> Column:
    """Struct of region, rack and shard for a key. Subtrees of weight 0 take no row."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    regions = []
    for region, racks in tree.items():
        inner, above = [], 0.0
        for rack, shards in racks.items():
            leaves = [
                (f"{region}/{rack}/{shard}", weight, F.struct(F.lit(region).alias("region"), F.lit(rack).alias("rack"), F.lit(shard).alias("shard")))
                for shard, weight in shards.items()
            ]
            total = float(sum(w for _, w, _ in leaves))
            if total > 0:
                inner.append((f"{region}/{rack}", total, _least(key, leaves)))
                above += total
        if inner:
            regions.append((region, above, _least(key, inner)))
    if not regions:
        raise ValueError("the tree holds no shard of positive weight")
    return _least(key, regions)


def with_slots(df: DataFrame, shard: str, key: str, ties: Sequence[str], pieces: int = 256) -> DataFrame:
    """``df`` with ``slot``: gapless from 0 in each shard, in an order given by key and ``ties``.

    Rows that share a key, or have none, are dealt over the pieces by their ties.
    """
    piece, place, before, rows = free(df.columns, "piece", "place", "before", "rows")
    number = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), *ties), F.lit(pieces)).cast("int")
    cut = df.withColumn(piece, number)
    along = Window.partitionBy(shard).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        cut.groupBy(shard, piece)
        .agg(F.count(F.lit(1)).alias(rows))
        .withColumn(before, F.coalesce(F.sum(rows).over(along), F.lit(0)))
        .drop(rows)
    )
    inner = Window.partitionBy(shard, piece).orderBy(key, *ties)
    return (
        cut.withColumn(place, F.row_number().over(inner))
        .join(earlier, [shard, piece])
        .withColumn("slot", F.col(before) + F.col(place) - 1)
        .drop(piece, place, before)
    )


def assign(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot and grown_shard of every row.

    ``size`` is the number of UTF-8 bytes plus 1. ``grown_shard`` is the shard under ``shards + 1``
    shards: either ``shard`` or the new one.
    """
    tree = tree or even_tree(shards)
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.col(doc_id)
    base = docs.select(
        key.alias(doc_id),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        placed(key, tree).alias("_at"),
        placed(key, grown(tree, shards))["shard"].alias("grown_shard"),
    )
    flat = base.select(doc_id, "size", "text_crc32", F.lit("key").alias("law"), "_at.region", "_at.rack", "_at.shard", "grown_shard")
    return with_slots(flat, "shard", doc_id, ["text_crc32", "size"])


def place(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", tree: Tree | None = None) -> DataFrame:
    """``docs`` with the columns ``shard`` and ``slot``; clashing columns of ``docs`` are replaced."""
    kept = docs.drop("shard", "slot")
    order = [c for c, kind in kept.dtypes if c != doc_id and not kind.startswith(("map", "variant"))]
    shard = placed(F.col(doc_id), tree or even_tree(shards))["shard"]
    return with_slots(kept.withColumn("shard", shard), "shard", doc_id, order).select(*kept.columns, "shard", "slot")


def write_shards(placed_docs: DataFrame, path: str, files: int = 1) -> None:
    """One folder per shard with ``files`` files each, rows in slot order."""
    part = F.pmod(F.col("slot"), F.lit(files))
    (
        placed_docs.withColumn("_part", part)
        .repartition("shard", "_part")
        .drop("_part")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )

"""Mixing sources to target weights over fixed-length blocks.

* The words of a source's documents, in the order of a hash of their id, form one stream, cut into blocks
  of ``block`` words. Offsets are two-level prefix sums: within (source, chunk of the hash) and over the
  chunk totals, so a hot source is never sorted in one task.
* Targets share all words by weight; a target above ``repeats`` times its source's words stops there and the
  excess is shared again by weight.
* A source takes as many blocks (slots) as its target asks for. For each source the slots are drawn over the
  output shards by a multinomial draw whose total is the source's slots: a shard's counts are multinomial, and
  a source meets its target exactly, to a block.
* Slot j of a source reads block ``p_e(j mod n)`` with e = j div n and n blocks: each pass e has a keyed
  pseudorandom permutation of the block numbers, so a block is read again only after all others. Slots
  and blocks meet in an equi-join on (source, block): ``mixed_blocks`` has the pieces of documents that make up each slot of each shard.
  The words taken, the mixed documents and the texts of the shards are all made from that table.

All draws depend on the seed, the source's rank and the block numbers alone; reruns and other partitionings agree.

Rows: null text has no words, is taken 0 times and stays in the result. A null source is a source of its own
and comes last. Rows that share an id are ordered by size, checksum and text hash; equal rows are
interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanflow.llm import textbytes as tb
from scanflow.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
REPEATS = 3
BLOCK = 64
CHUNKS = 1024
SHARD_SLOTS = 65_536
SEED = 20_177


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc"),
        F.col(source).cast("string").alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(body).alias("print"),
    )


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: source, src (its rank from 0), source_size, target.

    Sources are few against rows; only their totals meet in one task. A target is ``level * weight`` below its
    limit, where the level is what the sources below their limits share; sorted by limit / weight, the sources
    at their limit come first.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = total.withColumn("src", F.row_number().over(everything) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("src") % len(weights) + 1).cast("int"))
    limited = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(repeats))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "src")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shared = limited.withColumns(
        {
            "_words": F.sum("source_size").over(whole).cast("double"),
            "_weights": F.sum("weight").over(whole),
            "_limits": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "_passed": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("_level", (F.col("_words") - F.col("_limits")) / (F.col("_weights") - F.col("_passed")))
    free = F.col("limit") > F.col("_level") * F.col("weight")
    level = F.min(F.when(free, F.struct(F.col("limit") / F.col("weight"), F.col("src"), F.col("_level").alias("level")))).over(whole)["level"]
    target = F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit")))
    return shared.select("source", "src", "source_size", target.alias("target"), "_words")


def _offsets(sized: DataFrame, sources: DataFrame, chunks: int) -> DataFrame:
    """Rows with src, source_size, target and ``off``, the number of words before them in their source."""
    joined = sized.join(
        sources.withColumnRenamed("source", "_s"), sized["source"].eqNullSafe(F.col("_s")), "inner"
    ).drop("_s", "_words")
    # the text's hash spreads rows that share an id
    chunk = F.pmod(F.xxhash64(F.coalesce(F.col("doc").cast("string"), F.lit("")), "print"), F.lit(chunks)).cast("int")
    parts = joined.withColumn("_chunk", chunk)
    along = Window.partitionBy("src").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        parts.groupBy("src", "_chunk")
        .agg(F.sum("size").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(along), F.lit(0)))
        .drop("_size")
    )
    inner = Window.partitionBy("src", "_chunk").orderBy("doc", "size", "print").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("_inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(before, ["src", "_chunk"])
        .withColumn("off", F.col("_before") + F.col("_inner"))
        .drop("_chunk", "_before", "_inner")
    )


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """One row per (document, block): ``start`` and ``n``, its words there. Empty documents keep one row."""
    first = F.floor(F.col("off") / block)
    last = F.floor((F.col("off") + F.col("size") - 1) / block)
    blocks = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(None).cast("long")))
    out = placed.withColumn("block", F.explode(blocks))
    begin = F.greatest(F.col("off"), F.col("block") * block)
    end = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block)
    return out.withColumns(
        {"start": F.coalesce(begin - F.col("off"), F.lit(0)), "n": F.coalesce(end - begin, F.lit(0))}
    )


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Entry j of the key's pseudorandom permutation of 0 .. n - 1.

    A balanced Feistel network over the least even number of bits that holds n, walked until it lands
    below n.
    """
    if not len(j):
        return j.astype(np.int64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = j.astype(np.uint64)
    n, key = n.astype(np.uint64), tb.mix(key)
    live = np.arange(len(j))
    while len(live):
        h, m, k = half[live], mask[live], key[live]
        left, right = out[live] >> h, out[live] & m
        for r in range(rounds):
            turn = tb.mix(right + tb.mix(k + np.uint64(r + 1))) & m
            left, right = right, left ^ turn
        out[live] = (left << h) | right
        live = live[out[live] >= n[live]]
    return out.astype(np.int64)


def slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, src, slot and block of every block read."""
    size, target = F.col("source_size"), F.col("target")
    blocks = F.ceil(size / block).cast("long")
    wanted = F.when(size > 0, F.round(target * blocks / size)).otherwise(0).cast("long")
    shards = F.greatest(F.lit(1), F.ceil(F.col("_words") / (block * shard_slots))).cast("long")
    counted = sources.select("src", blocks.alias("blocks"), wanted.alias("slots"), shards.alias("shards"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng = np.random.default_rng([seed, row["src"]])
                n = rng.multinomial(row["slots"], np.full(row["shards"], 1.0 / row["shards"]))
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                some = np.flatnonzero(n)
                one = np.ones(len(some), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(one * row["src"]), pa.array(one * row["blocks"]), pa.array(first[some]), pa.array(n[some])],
                    names=["shard", "src", "blocks", "first", "n"],
                )

    shares = counted.mapInArrow(draw, "shard long, src long, blocks long, first long, n long").repartition("shard", "src")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for low in range(row["first"], row["first"] + row["n"], 1 << 16):
                    j = np.arange(low, min(low + (1 << 16), row["first"] + row["n"]))
                    turn, inner = j // row["blocks"], j % row["blocks"]
                    key = tb.mix(turn.astype(np.uint64) + np.uint64(seed)) + np.uint64(row["src"])
                    one = np.ones(len(j), dtype=np.int64)
                    found = permuted(inner, one * row["blocks"], key)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one * row["shard"]), pa.array(one * row["src"]), pa.array(j), pa.array(found)],
                        names=["shard", "src", "slot", "block"],
                    )

    return shares.mapInArrow(read, "shard long, src long, slot long, block long")


def _read_pieces(docs: DataFrame, doc_id: str, text: str, source: str, weights: Sequence[float], repeats: int, block: int, seed: int) -> DataFrame:
    """Pieces of all documents, a row for each slot that reads one; ``shard`` and ``slot`` are null where none does."""
    # texts are counted once; totals, offsets and targets read the counts
    sized = cut(_sized(docs, doc_id, text, source))
    sources = targets(sized, weights, repeats)
    pieces = _pieces(_offsets(sized, sources, CHUNKS), block)
    # both sides grow with the words, though a planner sees the slots come from a few source rows
    return pieces.join(slots(sources, block, seed=seed).hint("merge"), ["src", "block"], "left")


def mixed_blocks(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """The mix: shard, source, src (the source's rank), slot, block, off (place in the source's words), doc_id, start and n.

    A slot is a block of a source; its rows, by ``off``, are the words ``start .. start + n - 1`` of documents. Within a shard,
    slots of one source are numbered in sequence.
    """
    read = _read_pieces(docs, doc_id, text, source, weights, repeats, block, seed).where(F.col("slot").isNotNull())
    return read.select(
        "shard", "source", "src", "slot", "block", (F.col("off") + F.col("start")).alias("off"), F.col("doc").alias(doc_id), "print", "start", "n"
    )


def mix_sizes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix reads) of every document."""
    read = _read_pieces(docs, doc_id, text, source, weights, repeats, block, seed)
    # the offset tells rows of one id apart; rows without words share one and keep a count
    keys = ["doc", "source", "size", "print", "source_size", "target", "off"]
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("n"))), F.lit(0))
    rows = read.groupBy(*keys).agg(taken.alias("taken"), F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("_same"))
    copies = F.explode(F.array_repeat(F.lit(0), F.greatest(F.col("_same"), F.lit(1)).cast("int")))
    return rows.select(F.col("doc").alias(doc_id), "source", "size", "source_size", "target", "taken", copies.alias("_copy")).drop("_copy")


def _with_pieces(docs: DataFrame, plan: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``pieces`` of the documents that ``plan`` (doc, print, pieces) names."""
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("_doc"), F.xxhash64(body).alias("_print"))
    return rows.join(plan, rows["_doc"].eqNullSafe(plan["doc"]) & (rows["_print"] == plan["print"])).select("row", "pieces")


def mix_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """``docs`` with each text replaced by the words the mix reads of it; documents never read are left out.

    Pass by pass (first every piece read once or more, then every piece read twice or more, ...) the pieces
    follow one another in document order; passes are joined by a line break, and neighbouring pieces keep the
    text between them. Rows equal in id and text get the first one's pieces.
    """
    read = _read_pieces(docs, doc_id, text, source, weights, repeats, block, seed).where(F.col("slot").isNotNull())
    times = read.groupBy("doc", "print", "off", "start", "n").agg(F.count(F.lit(1)).alias("times"))
    first = times.groupBy("doc", "print", "off").agg(F.collect_list(F.struct("start", "n", "times")).alias("pieces"))
    plan = first.groupBy("doc", "print").agg(F.min_by("pieces", "off").alias("pieces"))
    names = list(docs.columns)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.column("row").flatten()))
            out = [
                _written(raw, begin, end, pieces)
                for raw, begin, end, pieces in _worded(columns[text], batch.column("pieces").to_pylist())
            ]
            arrays = [pa.array(out, type=pa.string()) if c == text else columns[c] for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return _with_pieces(docs, plan, doc_id, text).mapInArrow(rewrite, docs.schema)


def _worded(column: pa.Array, pieces: list) -> Iterator[tuple]:
    """Bytes, begin and end of the words, and pieces of every text."""
    data, offsets = tb.column_bytes(column)
    raw = data.tobytes()
    for row, own in enumerate(pieces):
        low, high = int(offsets[row]), int(offsets[row + 1])
        begin, end, _ = tb.words(data[low:high], np.array([0, high - low]))
        yield raw[low:high], begin, end, own


def shard_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """shard, source, slot and text of every slot: its block's words, from one document after the other, joined by spaces."""
    mixed = cut(mixed_blocks(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.col(source).alias("source")),
                             "doc", "text", "source", weights, repeats, block, seed))
    # rows equal in id and text give the same words, so one of them serves all slots
    piece = F.struct("shard", "src", "slot", "off", "start", "n")
    plan = mixed.groupBy("doc", "print").agg(F.collect_list(piece).alias("pieces"))
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).dropDuplicates()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, begin, end, pieces in _worded(batch.column("row").flatten()[1], batch.column("pieces").to_pylist()):
                for p in pieces:
                    words = " ".join(raw[begin[k] : end[k]].decode("utf-8") for k in range(p["start"], p["start"] + p["n"]))
                    rows.append((p["shard"], p["src"], p["slot"], p["off"], words))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "src", "slot", "off", "words"])

    cut_out = _with_pieces(texts, plan, "doc", "text").mapInArrow(parts, "shard long, src long, slot long, off long, words string")
    whole = cut_out.groupBy("shard", "src", "slot").agg(F.array_sort(F.collect_list(F.struct("off", "words"))).alias("p"))
    names = mixed.select("src", "source").distinct()
    joined = F.array_join(F.transform("p", lambda x: x["words"]), " ")
    return whole.join(names, "src").select("shard", "source", "slot", joined.alias("text"))


def _written(body: bytes, begin: np.ndarray, end: np.ndarray, pieces: list[dict]) -> str:
    lines = []
    ordered = sorted(pieces, key=lambda p: p["start"])
    for turn in range(1, 1 + max(p["times"] for p in ordered)):
        runs: list[list[int]] = []
        for p in ordered:
            if p["times"] >= turn:
                if runs and runs[-1][1] == p["start"]:
                    runs[-1][1] += p["n"]
                else:
                    runs.append([p["start"], p["start"] + p["n"]])
        lines.append(" ".join(body[begin[a] : end[b - 1]].decode("utf-8") for a, b in runs))
    return "\n".join(lines)

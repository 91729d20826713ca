"""Removal of repeated 100-byte strings by prefix-free parsing.

A rolling hash over ``gram`` bytes triggers phrase borders: the trigger of a ``window``-byte string is its
gram with the least hash (the leftmost of equal ones). It depends on the string alone, so equal strings
share their trigger wherever they stand. A phrase is the longest run of neighbouring windows with one
trigger; phrases overlap by ``window - 1`` bytes, and every window lies in exactly one phrase.

The order of the corpus' suffixes by their first ``window`` bytes comes from two smaller orders:

* *Parse*: occurrences of phrases, ordered by (trigger, phrase, document, position). An occurrence after
  the first of its phrase holds only windows that start earlier, so all of them are marked by rank alone.
* *Dictionary*: the first occurrence of each phrase. A phrase that is alone with its trigger cannot share
  a window with another one. A window that reaches half of its free bytes to the left (right) of the trigger
  can only be shared by phrases with those bytes in common, so phrases are split by what stands left and
  right. Only what is left then gives its suffixes (windows), which are ordered by (content, document,
  position); equal neighbours are repeats.

Each Arrow batch keeps the first of equal phrases (and of equal windows) before the shuffle. A passage that
stands in a third of all rows therefore reaches a task once per batch, not once per row. Texts are shuffled
by document only. Phrases compare by 57-bit hashes within one 64-bit trigger. Triggers that very many different
phrases share are found in a sample; their phrases are ranked in several tasks, split by phrase, with the same result.

Rows: null text counts as empty. Rows that share a doc_id are told apart by a hash of their text, in whose
order they count; rows equal in both are one document, each gets that document's result. A null doc_id
comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanflow.llm import textbytes as tb
from scanflow.session import cut

WINDOW = 100
GRAM = 32
SLAB = 1 << 19

#: A trigger that stands this often in a sample, with different phrases, is dealt over ``SALTS`` tasks.
SAMPLE, OFTEN, MOST_HOT, SALTS = 1 / 256, 16, 1000, 256

PIECE = "trigger long, phrase long, sides long, doc long, tag long, pos long"


def _identity(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc (nulls least), tag (hash of the text, tells rows of one doc_id apart), text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(body).alias("tag"), body.alias("text")
    )


def _segments(offsets: np.ndarray, window: int, slab: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, begin, end) within the buffer, together about ``slab`` bytes.

    A longer row is cut into pieces that overlap by ``window - 1`` bytes.
    """
    held, size = [], 0
    for row in range(len(offsets) - 1):
        begin, end = int(offsets[row]), int(offsets[row + 1])
        while end - begin >= window:
            stop = min(end, begin + slab + window - 1)
            if held and size + stop - begin > slab:
                yield held
                held, size = [], 0
            held.append((row, begin, stop))
            size += stop - begin
            begin += slab
    if held:
        yield held


def _parse(data: np.ndarray, starts: np.ndarray, window: int, gram: int):
    """Begin, number of windows, trigger, phrase hash and sides of the phrases in a slab of pieces.

    ``sides`` holds 24-bit hashes of the half free bytes left and right of the trigger and, in the low byte,
    the trigger's distance from the begin.
    """
    roll = tb.Rolling(data)
    n = len(data)
    grams = roll.grams(gram)
    low = np.uint64((1 << 21) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, need = 1, window - gram + 1
    while span * 2 <= need:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < need:
        best = np.minimum(best[: len(best) - (need - span)], best[need - span :])
    anchor = (best & low).astype(np.int64)
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    valid = np.arange(len(anchor)) + window <= ends[: len(anchor)]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(fresh)
    seen = np.concatenate([[0], np.cumsum(valid)])
    count = seen[np.append(begin[1:], len(anchor))] - seen[begin]
    at = anchor[begin]
    phrase = roll.of(begin, begin + count + window - 1)
    half = (window - gram) // 2
    # bytes beyond the piece belong to no window of the phrase, so any value will do for them
    left = roll.of(np.maximum(at - half, 0), at)
    right = roll.of(np.minimum(at + gram, n), np.minimum(at + gram + half, n))
    bits = np.uint64((1 << 24) - 1)
    sides = (left & bits) << np.uint64(32) | (right & bits) << np.uint64(8) | (at - begin).astype(np.uint64)
    return begin, count, grams[at], phrase, sides


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """True for the first of equal entries."""
    joint = keys[0]
    for k in keys[1:]:
        joint = tb.mix(joint + np.uint64(tb.BASE) * k)
    order = np.argsort(joint, kind="stable")
    same = np.zeros(len(joint), dtype=bool)
    same[order[1:]] = joint[order[1:]] == joint[order[:-1]]
    return ~same


def _settle(doc, tag, pos, count, trigger, phrase, sides) -> pa.RecordBatch:
    """Pieces of a batch, which stand in document order: the first of equal ones stay open (odd trigger).

    The others are repeats already. Neighbouring ones are joined to one run of windows; such a run has an
    even trigger that only spreads it, and its length in place of the phrase.
    """
    first = _firsts(trigger, phrase)
    at = np.flatnonzero(~first)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[at[1:]] != doc[at[:-1]]) | (tag[at[1:]] != tag[at[:-1]]) | (pos[at[1:]] != pos[at[:-1]] + count[at[:-1]])
    head = at[np.flatnonzero(new)]
    runs = np.add.reduceat(count[at], np.flatnonzero(new)) if len(at) else count[at]
    spread = tb.mix(doc[head].astype(np.uint64) + tb.mix(tag[head].view(np.uint64)) + (pos[head] >> 12).astype(np.uint64)) & ~np.uint64(1)
    low = (phrase[first] & ~np.uint64(127)) | count[first].astype(np.uint64)
    columns = [
        np.concatenate([trigger[first] | np.uint64(1), spread]).view(np.int64),
        np.concatenate([low.view(np.int64), runs.astype(np.int64)]),
        np.concatenate([sides[first].view(np.int64), np.zeros(len(head), dtype=np.int64)]),
        np.concatenate([doc[first], doc[head]]),
        np.concatenate([tag[first], tag[head]]),
        np.concatenate([pos[first], pos[head]]),
    ]
    names = ["trigger", "phrase", "sides", "doc", "tag", "pos"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _in_order(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of a batch in the order of their documents; of rows that are one document only the first."""
    doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
    order = np.lexsort((tag, doc))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (doc[order[1:]] != doc[order[:-1]]) | (tag[order[1:]] != tag[order[:-1]])
    return order[fresh]


def _slabs(batch: pa.RecordBatch, window: int, slab: int):
    """Slabs of a batch in document order: data, begin of its pieces, their rows and offsets in the text."""
    order = _in_order(batch)
    data, offsets = tb.column_bytes(batch.column("text"))
    sizes = np.diff(offsets)[order]
    virtual = np.concatenate([[0], np.cumsum(sizes)])
    for pieces in _segments(virtual, window, slab):
        rows = np.array([order[p[0]] for p in pieces])
        inner = np.array([p[1] - virtual[p[0]] for p in pieces])
        lens = np.array([p[2] - p[1] for p in pieces])
        begin = offsets[rows] + inner
        buf = np.concatenate([data[b : b + length] for b, length in zip(begin, lens)])
        yield buf, np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64), rows, inner


def _parser(window: int, gram: int, slab: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            parts = []
            for buf, starts, rows, inner in _slabs(batch, window, slab):
                begin, count, trigger, phrase, sides = _parse(buf, starts, window, gram)
                piece = np.searchsorted(starts, begin, side="right") - 1
                row = rows[piece]
                pos = inner[piece] + begin - starts[piece]
                parts.append((doc[row], tag[row], pos, count, trigger, phrase, sides))
            if parts:
                yield _settle(*(np.concatenate(x) for x in zip(*parts)))

    return parse


def _unpack(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and number of windows of packed values."""
    return items >> 32, items & ((1 << 32) - 1)


def _suffixes(window: int):
    """Windows of the open phrases of each document, the first of equal ones of a batch only."""

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = _in_order(batch)
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            data, offsets = tb.column_bytes(batch.column("text"))
            lists = batch.column("open")
            inner, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            at = at - at[0]
            parts = []
            for row in order:
                begin, count = _unpack(inner[at[row] : at[row + 1]])
                if not len(begin):
                    continue
                body = data[offsets[row] : offsets[row + 1]]
                # cover the phrases by as few stretches as possible, each hashed once
                begin, index = np.unique(begin, return_index=True)
                count = count[index]
                stop = np.maximum.accumulate(begin + count + window - 1)
                cut = np.flatnonzero(np.concatenate([[True], begin[1:] > stop[:-1]]))
                for a, b in zip(cut, np.append(cut[1:], len(begin))):
                    low, high = int(begin[a]), min(int(stop[b - 1]), len(body))
                    live = np.zeros(high - low + 1, dtype=np.int64)
                    np.add.at(live, begin[a:b] - low, 1)
                    np.add.at(live, np.minimum(begin[a:b] + count[a:b] - low, high - low), -1)
                    start = np.flatnonzero(np.cumsum(live) > 0)
                    start = start[start + window <= high - low]
                    if not len(start):
                        continue
                    roll = tb.Rolling(body[low:high])
                    content = roll.of(start, start + window)
                    half = roll.of(start, start + window // 2)
                    one = np.ones(len(start), dtype=np.int64)
                    parts.append((one * doc[row], one * tag[row], low + start, one, content, half, np.zeros_like(half)))
            if parts:
                yield _settle(*(np.concatenate(x) for x in zip(*parts)))

    return enumerate_


def _spans(window: int, size: int, *lists: np.ndarray) -> np.ndarray:
    """Maximal removed runs, as rows of (begin, end), from packed repeats."""
    begin, count = _unpack(np.concatenate(lists))
    end = np.minimum(begin + count + window - 1, size)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    if not len(begin):
        return np.zeros((0, 2), dtype=np.int64)
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    return np.stack([begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]], axis=1)


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>, kept binary"


def _cutter(window: int, with_text: bool):
    def carve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column("text"))
            raw = data.tobytes()
            packed = []
            for name in ("closed", "again"):
                lists = batch.column(name)
                at = lists.offsets.to_numpy()
                packed.append((lists.flatten().to_numpy(zero_copy_only=False), at - at[0]))
            doc = batch.column("doc")
            rows = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for row in range(batch.num_rows):
                body = raw[offsets[row] : offsets[row + 1]]
                spans = _spans(window, len(body), *(v[at[row] : at[row + 1]] for v, at in packed))
                edges = [0, *spans.ravel().tolist(), len(body)]
                kept = b"".join(body[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                rows["n_bytes"].append(len(body))
                rows["n_removed"].append(len(body) - len(kept))
                rows["n_spans"].append(len(spans))
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                rows["spans"].append([{"begin": int(b), "end": int(e)} for b, e in spans] if with_text else None)
                rows["kept"].append(kept if with_text else None)
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [doc, *(pa.array(v, type=t) for v, t in zip(rows.values(), kinds))], names=["doc", *rows]
            )

    return carve


def _hot_triggers(base: DataFrame, parse) -> list[int]:
    """Triggers of many different phrases, found in a sample of the documents; at most ``MOST_HOT``.

    The list decides only how the work is dealt: a trigger on it is known to have two phrases, any other is looked at as a whole.
    """
    seen = base.sample(False, SAMPLE, 7).mapInArrow(parse, PIECE).where(F.col("trigger").bitwiseAND(F.lit(1)) == 1)
    often = seen.groupBy("trigger").agg(F.count(F.lit(1)).alias("n"), F.min("phrase").alias("low"), F.max("phrase").alias("high"))
    hot = often.where((F.col("n") >= OFTEN) & (F.col("low") != F.col("high"))).orderBy(F.col("n").desc(), "trigger").limit(MOST_HOT)
    return [r["trigger"] for r in hot.select("trigger").collect()]


def _ranked(pieces: DataFrame, hot: list[int] = ()) -> DataFrame:
    """The pieces that matter: ``again`` (an earlier equal piece exists) or alone in their phrase, but not
    alone with their trigger. The rest, most of a corpus, ends here. Phrases of a hot trigger are ranked in several tasks."""
    known = F.col("trigger").isin(list(hot)) if len(hot) else F.lit(False)
    salt = F.when(known, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    order = Window.partitionBy("trigger", "salt").orderBy("phrase", "doc", "tag", "pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    settled = F.col("trigger").bitwiseAND(F.lit(1)) == 0
    # equal rows in different batches bring the same piece of the same document twice
    itself = (F.lag("doc").over(order) == F.col("doc")) & (F.lag("tag").over(order) == F.col("tag")) & (F.lag("pos").over(order) == F.col("pos"))
    repeat = (F.lag("phrase").over(order) == F.col("phrase")) & ~itself
    return (
        pieces.withColumn("salt", salt)
        .withColumn("again", settled | F.coalesce(repeat, F.lit(False)))
        .withColumn("shared", known | (F.first("phrase").over(whole) != F.last("phrase").over(whole)))
        .where("again or shared")
    )


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces as doc, tag, begin, count (of windows) with ``again`` and what narrowing needs."""
    settled = F.col("trigger").bitwiseAND(F.lit(1)) == 0
    return pieces.select(
        "doc", "tag", F.col("pos").alias("begin"),
        F.when(settled, F.col("phrase")).otherwise(F.col("phrase").bitwiseAND(F.lit(127))).alias("count"),
        "again", "trigger", "phrase", "sides",
    )


def _narrowed(placed: DataFrame, window: int, gram: int) -> DataFrame:
    """Repeats as they are, and open phrases cut to the windows that another phrase may share.

    A window that begins ``half`` or more before the trigger holds all of the left side, one that begins
    ``half`` or less before it all of the right side (of ``half`` bytes each).
    """
    half = (window - gram) // 2
    left, right = F.shiftright("sides", 32), F.shiftright("sides", 8).bitwiseAND(F.lit((1 << 24) - 1))
    there = F.col("sides").bitwiseAND(F.lit(255))

    # few pieces are left here; they are written, since each side's phrases are counted apart and joined back
    split = cut(placed.withColumns({"_left": left, "_right": right}))

    def several(side: str, name: str) -> DataFrame:
        fresh = split.where(~F.col("again")).groupBy("trigger", side)
        found = fresh.agg(F.min("phrase").alias("_a"), F.max("phrase").alias("_b")).where("_a <> _b")
        return found.select("trigger", side, F.lit(True).alias(name))

    joined = split.join(several("_left", "_on_left"), ["trigger", "_left"], "left").join(several("_right", "_on_right"), ["trigger", "_right"], "left")
    no = F.lit(False)
    known = joined.withColumns({"_on_left": F.coalesce("_on_left", no), "_on_right": F.coalesce("_on_right", no)})
    whole = F.col("again")
    low = F.when(whole | F.col("_on_left"), F.lit(0)).otherwise(F.greatest(F.lit(0), there - half))
    high = F.when(whole | F.col("_on_right"), F.col("count")).otherwise(F.least(F.col("count"), there - half + 1))
    cut_ = known.where("again or _on_left or _on_right").withColumns({"_low": low, "_high": high}).where("_high > _low")
    return cut_.select("doc", "tag", (F.col("begin") + F.col("_low")).alias("begin"), (F.col("_high") - F.col("_low")).alias("count"), "again")


def _by_document(placed: DataFrame, **kinds) -> DataFrame:
    """One row per document: packed repeats or open phrases. A list is bounded by its document."""
    packed = F.shiftleft(F.col("begin"), 32).bitwiseOR(F.col("count"))
    return placed.groupBy("doc", "tag").agg(
        *(F.collect_list(F.when(cond, packed)).alias(name) for name, cond in kinds.items())
    )


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
    slab: int = SLAB, with_text: bool = True,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text``
    the removed ``spans`` and the ``kept`` bytes (binary: a cut may split a character).

    A byte is removed if a ``window``-byte string that covers it also starts earlier, in a smaller
    document or earlier in its own. Strings are judged on the input. Columns of ``docs`` beyond the two
    named ones are not looked at.
    """
    if not 2 <= gram <= window <= gram + 126:
        raise ValueError("need 2 <= gram <= window <= gram + 126")
    if slab + window > 1 << 21:
        raise ValueError("a slab holds at most 2**21 bytes")
    base = _identity(docs, doc_id, text)
    parse = _parser(window, gram, slab)
    pieces = base.mapInArrow(parse, PIECE)
    known = _narrowed(_placed(_ranked(pieces, _hot_triggers(base, parse))), window, gram)
    by_doc = cut(_by_document(known, closed=F.col("again"), open=~F.col("again")))
    named = base.repartition("doc", "tag")
    opened = named.join(by_doc.where(F.size("open") > 0).select("doc", "tag", "open"), ["doc", "tag"])
    windows = _ranked(opened.select("doc", "tag", "text", "open").mapInArrow(_suffixes(window), PIECE))
    again = _by_document(_placed(windows.where("again")), again=F.col("again"))
    none = F.array().cast("array<long>")
    whole = (
        named.join(by_doc.select("doc", "tag", "closed"), ["doc", "tag"], "left")
        .join(again, ["doc", "tag"], "left")
        .select("doc", "text", F.coalesce("closed", none).alias("closed"), F.coalesce("again", none).alias("again"))
    )
    out = whole.mapInArrow(_cutter(window, with_text), RESULT)
    kept = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if with_text else [])]
    real = F.when(F.col("doc") != F.lit(-(1 << 63)), F.col("doc"))
    return out.select(real.alias(doc_id), *kept)

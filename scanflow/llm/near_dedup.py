"""Near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped candidates.

* **Signatures.** One hash per word shingle. Its high bits choose one of ``rows * bands`` bins, and a bin keeps
  its least hash. Empty bins borrow from a bin that a fixed random sequence for that bin names first among the
  non-empty ones (optimal densification). A document also gets its set size and a fingerprint of its set.
* **Classes.** Documents with equal sets form one class, found by fingerprint; only classes go on. A set too
  small for any other set to reach the threshold has no bands.
* **Stars.** ``rows`` bins form a band. Classes that agree in a band share a bucket, and each bucket gives
  edges from its least class to the others: as many edges as members, not their square. Edges are verified on
  the full sets, and linked classes join into components.
* **Rest.** Two classes of one star can be linked although their centre is not. Stars whose members lie in
  several components are checked again, on full sets: only members outside the centre's component are
  compared, with the members of other components, in blocks of bounded size: a star of M members with R of them
  outside ships about M * R / ``block`` texts. No link between members of a star
  is lost; what the bands can miss is a pair at the threshold that shares none of them. There are as many
  bands as make that rarer than ``miss`` (42 for 0.85 and 1e-7).

Texts travel to the two verifications only for classes with candidates. Nothing is collected: edges, stars and
components are tables.

Rows: null texts and texts without words have an empty set, size 0, and form a group of their own row.
Shorter texts than a shingle are one shingle as a whole. Rows that share an id are told apart by a hash of
their text; rows equal in both are in one group. A null id counts as the largest: it represents a group only
if no other id is there, and its row is kept then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanflow.llm import textbytes as tb
from scanflow.llm.columns import free
from scanflow.llm.components import components
from scanflow.session import cut

SHINGLE = 3
PERCENT = 85
ROWS = 7
MISS = 1e-7
BLOCK = 256
TRIES = 400
SLAB = 1 << 20
LAST = (1 << 63) - 1


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that a pair at the threshold shares none with a chance of at most ``miss``."""
    if percent >= 100:
        return 1
    return int(np.ceil(np.log(miss) / np.log1p(-((percent / 100) ** rows))))


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted by (row, hash), and their rows."""
    lowered = tb.lower_ascii(data)
    begin, end, first = tb.words(lowered, offsets)
    word = tb.Rolling(lowered).of(begin, end) if len(begin) else np.zeros(0, np.uint64)
    hashes, rows, _ = tb.shingles(word, first, size)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[fresh], rows[fresh]


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return run[cuts[1:]] - run[cuts[:-1]]


def signatures(hashes: np.ndarray, rows: np.ndarray, n_rows: int, bins: int, tries: int = TRIES) -> np.ndarray:
    """One value per row and bin from sets sorted by (row, hash); rows without shingles are zero."""
    value = np.zeros((n_rows, bins), dtype=np.uint64)
    filled = np.zeros((n_rows, bins), dtype=bool)
    if not len(hashes):
        return value
    place = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    least = np.ones(len(hashes), dtype=bool)
    least[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
    value[rows[least], place[least]] = hashes[least]
    filled[rows[least], place[least]] = True
    some = filled.any(axis=1)
    row, bin_ = np.nonzero(~filled & some[:, None])
    for turn in range(tries):
        if not len(row):
            break
        donor = (tb.mix(bin_.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(turn + 1)) % np.uint64(bins)).astype(np.int64)
        found = filled[row, donor]
        value[row[found], bin_[found]] = value[row[found], donor[found]]
        row, bin_ = row[~found], bin_[~found]
    if len(row):  # sets of a few shingles: the first filled bin serves
        value[row, bin_] = value[row, filled[row].argmax(axis=1)]
    return value


def _signer(shingle: int, percent: int, rows_: int, bands: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column("text"))
            for a, b in tb.row_groups(offsets, SLAB):
                n_rows = b - a
                hashes, rows = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                cuts = np.searchsorted(rows, np.arange(n_rows + 1))
                n = np.diff(cuts)
                one, two = _sums(tb.mix(hashes), cuts), _sums(tb.mix(hashes ^ np.uint64(tb.BASE)), cuts)
                group = tb.mix(tb.mix(one) + two + n.astype(np.uint64)).view(np.int64)
                # the next larger set that holds this one must reach the threshold
                wide = n * 100 >= percent * (n + 1)
                value = signatures(hashes[wide[rows]], rows[wide[rows]], n_rows, rows_ * bands).reshape(n_rows, bands, rows_)
                code = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n_rows, bands)).copy()
                for k in range(rows_):
                    code = tb.mix(code * np.uint64(tb.BASE) + value[:, :, k])
                flat = pa.array(code[wide].reshape(-1).view(np.int64))
                bounds = np.concatenate([[0], np.cumsum(np.where(wide, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(a, n_rows), batch.column("print").slice(a, n_rows),
                        pa.array(group, mask=n == 0), pa.array(n), pa.ListArray.from_arrays(pa.array(bounds), flat),
                    ],
                    names=["doc", "print", "v", "n", "bands"],
                )

    return sign


def _enough(shared, a, b, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def _verifier(shingle: int, percent: int):
    """Shared shingles of the two texts of an edge, and whether they are enough."""

    def column_sets(column: pa.Array, key: np.ndarray) -> dict[int, np.ndarray]:
        values, first = np.unique(key, return_index=True)
        data, offsets = tb.column_bytes(column.take(pa.array(first)))
        out = {}
        for a, b in tb.row_groups(offsets, SLAB):
            hashes, rows = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
            cuts = np.searchsorted(rows, np.arange(b - a + 1))
            out |= {int(values[a + i]): hashes[cuts[i] : cuts[i + 1]] for i in range(b - a)}
        return out

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub, v = batch.column("hub").to_numpy(), batch.column("v").to_numpy()
            left, right = column_sets(batch.column("hub_text"), hub), column_sets(batch.column("text"), v)
            good = np.zeros(len(hub), dtype=bool)
            for i in range(len(hub)):
                a, b = left[int(hub[i])], right[int(v[i])]
                at = np.minimum(np.searchsorted(a, b), max(0, len(a) - 1))
                good[i] = len(a) > 0 and _enough(int((a[at] == b).sum()), len(a), len(b), percent)
            yield pa.RecordBatch.from_arrays([pa.array(hub[good]), pa.array(v[good])], names=["hub", "v"])

    return verify


def _block_links(shingle: int, percent: int, width: int = 4096):
    """Links between different components among the rows of one block pair, as a spanning set."""

    def compare(table: pa.Table) -> pa.Table:
        comp, rest = table["comp"].to_numpy(), table["rest"].to_numpy(zero_copy_only=False)
        data, offsets = tb.column_bytes(table["text"])
        hashes, rows = [], []
        for a, b in tb.row_groups(offsets, SLAB):
            h, r = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
            hashes.append(h)
            rows.append(r + a)
        hashes, rows = np.concatenate(hashes), np.concatenate(rows)
        n = np.bincount(rows, minlength=len(comp))
        _, code, often = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = often[code] > 1  # a shingle of one row alone adds to no pair
        _, code = np.unique(code[shared], return_inverse=True)
        rows = rows[shared]
        order = np.argsort(code, kind="stable")
        code, rows = code[order], rows[order]
        asked = np.flatnonzero(rest)
        common = np.zeros((len(asked), len(comp)), dtype=np.float32)
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            a, b = np.searchsorted(code, [low, low + width])
            held = np.zeros((len(comp), width), dtype=np.float32)
            held[rows[a:b], code[a:b] - low] = 1
            common += held[asked] @ held.T
        found = _enough(common.astype(np.int64), n[asked][:, None], n[None, :], percent) & (comp[asked][:, None] != comp[None, :])
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        for i, j in zip(*np.nonzero(found)):
            a, b = find(int(comp[asked[i]])), find(int(comp[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((max(a, b), min(a, b)))
        u, v = (np.array(x, dtype=np.int64) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    return compare


def _rest_links(edges: DataFrame, roots: DataFrame, texts: DataFrame, shingle: int, percent: int, block: int) -> DataFrame:
    """Links between components inside the stars."""
    hubs = edges.select("hub", F.col("hub").alias("v"), F.col("hub_doc").alias("doc"), F.col("hub_print").alias("print")).distinct()
    members = edges.select("hub", "v", "doc", "print").unionByName(hubs)
    known = members.join(roots.withColumnRenamed("u", "v"), "v", "left").withColumn("comp", F.coalesce("root", "v")).drop("root")
    by_comp = known.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("v") == F.col("hub")).alias("own"))
    near = F.sum(F.when(F.col("own"), F.col("n")))
    # written, so that a hub with a large share of all members is joined as two plain tables
    stars = cut(
        by_comp.groupBy("hub")
        .agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("comps"), near.alias("near"), F.max(F.when(F.col("own"), F.col("comp"))).alias("centre"))
        .where("size > 2 and comps > 1")
        .select(
            "hub", "centre", F.ceil(F.col("near") / block).cast("int").alias("near_blocks"),
            F.ceil((F.col("size") - F.col("near")) / block).cast("int").alias("rest_blocks"),
        )
    )
    # members outside the centre's component have blocks of their own and meet all blocks, the others meet only those
    open_ = known.join(stars, "hub").withColumn("rest", F.col("comp") != F.col("centre"))
    hashed, last = F.xxhash64("v", "hub"), F.col("near_blocks") + F.col("rest_blocks") - 1
    mine = F.when(F.col("rest"), F.col("near_blocks") + F.pmod(hashed, F.col("rest_blocks"))).otherwise(F.pmod(hashed, F.col("near_blocks")))
    met = F.sequence(F.when(F.col("rest"), F.lit(0)).otherwise(F.col("near_blocks")), last)
    other = open_.withColumn("mine", mine.cast("int")).withColumn("other", F.explode(met))
    pairs = other.select("hub", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "comp", "rest", "doc", "print")
    return (
        texts.join(pairs.hint("merge"), ["doc", "print"])
        .select("hub", "low", "high", "comp", "rest", "text")
        .groupBy("hub", "low", "high")
        .applyInArrow(_block_links(shingle, percent), "u long, v long")
    )


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(body).alias("print"), body.alias("text"))


def _groups(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, rows: int, bands: int, block: int) -> DataFrame:
    """doc, print, n and least (doc and print of the group's least document) of every row."""
    texts = _keyed(docs, doc_id, text)
    signed = cut(texts.mapInArrow(_signer(shingle, percent, rows, bands), "doc long, print long, v long, n long, bands array<long>"))
    least = F.min(F.struct("doc", "print"))
    classes = signed.where(F.size("bands") > 0).groupBy("v").agg(least.alias("id"), F.first("bands").alias("bands"))
    buckets = classes.select("v", "id", F.explode("bands").alias("bucket"))
    centres = (
        buckets.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "v")).alias("c"))
        .where("size > 1")
        .select("bucket", "c")
    )
    edges = cut(
        buckets.join(centres, "bucket")
        .where(F.col("v") != F.col("c.v"))
        .select(
            F.col("c.v").alias("hub"), F.col("c.id.doc").alias("hub_doc"), F.col("c.id.print").alias("hub_print"),
            "v", F.col("id.doc").alias("doc"), F.col("id.print").alias("print"),
        )
        .distinct()
    )
    hub_texts = texts.select(F.col("doc").alias("hub_doc"), F.col("print").alias("hub_print"), F.col("text").alias("hub_text"))
    both = edges.join(texts, ["doc", "print"]).join(hub_texts, ["hub_doc", "hub_print"]).select("hub", "v", "hub_text", "text")
    linked = cut(both.mapInArrow(_verifier(shingle, percent), "hub long, v long"))
    roots = components(linked, "hub", "v")
    more = components(_rest_links(edges, roots, texts, shingle, percent, block))
    vertex = (
        roots.join(more.select(F.col("u").alias("root"), F.col("root").alias("top")), "root", "left")
        .select(F.col("u").alias("v"), F.coalesce("top", "root").alias("top"))
    )
    # a class that only the second check links is no vertex of the first graph
    late = more.join(roots, "u", "left_anti").select(F.col("u").alias("v"), F.col("root").alias("top"))
    # each table below is written, so that a class or a component with a large share of all rows meets its
    # label in a plain join of two shuffled tables, whose large partitions Spark splits
    first = signed.where("v is not null").groupBy("v").agg(least.alias("first"))
    tops = cut(vertex.unionByName(late).join(first, "v"))
    least_of = cut(tops.groupBy("top").agg(F.min("first").alias("least")))
    named = tops.join(least_of, "top").select("v", "least")
    label = cut(first.join(named, "v", "left").select("v", F.coalesce("least", "first").alias("least")))
    rows_ = signed.select("doc", "print", "v", "n").join(label, "v", "left")
    return rows_.select("doc", "print", "n", F.coalesce("least", F.struct("doc", "print")).alias("least"))


def _named(c: str) -> Column:
    return F.when(F.col(c) != F.lit(LAST), F.col(c))


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    rows: int = ROWS, miss: float = MISS, block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    found = _groups(docs, doc_id, text, shingle, percent, rows, bands_for(percent, rows, miss), block)
    return found.select(
        _named("doc").alias(doc_id), F.col("n").alias("n_shingles"), _named("least.doc").alias("component_id"),
        (F.col("doc") == F.col("least.doc")).alias("kept"),
    )


def one_per_group(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    rows: int = ROWS, miss: float = MISS, block: int = BLOCK,
) -> DataFrame:
    """One row of each group, with all its columns: the least by id (null last), hash of the text, other columns.

    Texts without a shingle are in no group; of their rows, too, those equal in id and text leave one.
    """
    found = _groups(docs, doc_id, text, shingle, percent, rows, bands_for(percent, rows, miss), block)
    d, p, nr = free(docs.columns, "doc", "print", "nr")
    chosen = (F.col("doc") == F.col("least.doc")) & (F.col("print") == F.col("least.print"))
    stay = found.where(chosen).select(F.col("doc").alias(d), F.col("print").alias(p)).distinct()
    keyed = docs.withColumns(
        {d: F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), p: F.xxhash64(F.coalesce(F.col(text), F.lit("")))}
    )
    # Spark takes the first row of a key before the shuffle too, so repeats never meet in one task; rows that
    # this order does not tell apart are equal. Maps have no order.
    others = [F.col(c) for c, kind in docs.dtypes if c != text and "map<" not in kind]
    first = F.row_number().over(Window.partitionBy(d, p).orderBy(*others, F.col(text).isNull()))
    single = keyed.withColumn(nr, first).where(F.col(nr) == 1)
    return single.join(stay, [d, p], "left_semi").select(*docs.columns)

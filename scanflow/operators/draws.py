"""Deterministic draws.

Every draw is decided by md5, so it does not depend on partitioning. A draw from a
session-wide pool never pairs items with the whole pool: the pool's names get a dense
rank in an md5 permutation of their session, and an item reads only as many ranks as it can
need (k plus its own exclusions), each chosen by a hash of its own, so every subset of the pool
can be drawn. Each read is an equi-join on (session, rank), which spreads the items and pool of a
large session over all tasks. A pool of at most ``POOL_ROWS`` names is one array instead, which
meets the items of its session in one join; nothing is exploded and gathered again. ``packed_pool`` makes
these arrays from a timeline's name lists in one grouping; only long sessions are ranked name by name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanflow.operators import ordered
from scanflow.session import cut


#: Names of a pool that an item may carry; from larger pools each rank is read for itself.
POOL_ROWS = 256

#: Ranks that are read as plain columns before an array of ranks is made.
FIRST_RANKS = 4


def digest(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def hash60(seed: str, *parts: Column) -> Column:
    """Non-negative number of the first 15 hex digits of the digest."""
    return F.conv(F.substring(digest(seed, *parts), 1, 15), 16, 10).cast("long")


def ranked_pool(names: DataFrame, by: Sequence[str], seed: str, name: str = "object", digits: int = 1) -> DataFrame:
    """Distinct names of a session with a dense 0-based ``rank`` in md5 order and the pool size ``n_pool``.

    The order is scanned in 16 to the power of ``digits`` chunks per session. Draws read the pool twice, for
    its sizes and by rank, so it is written to the shared folder once.
    """
    by = list(by)
    named = names.select(*by, name)
    # sixteen bytes sort like their hex digits
    hashed = named.distinct().withColumn("_h", F.unhex(digest(seed, *[F.col(c) for c in by], F.col(name))))
    ranked = ordered.scan(
        hashed, by, ["_h", name], F.substring(F.hex("_h"), 1, digits), counted=named,
        rank=ordered.row_number(), n_pool=ordered.total(F.lit(1)),
    )
    return cut(ranked.select(*by, name, (F.col("rank") - 1).alias("rank"), "n_pool"))


@dataclass(frozen=True)
class Pool:
    """Names of sessions in md5 order, as ``packed_pool`` makes them.

    ``packed`` has a row per session with its names in order (``_names``) and their number (``_n``); the names of sessions
    too long for one row are in ``long``, as ``ranked_pool`` gives them. No session is in both.
    """

    by: list[str]
    packed: DataFrame
    long: DataFrame | None = None
    name: str = "object"

    def sizes(self) -> DataFrame:
        """Names of each session as ``_n``."""
        out = self.packed.select(*self.by, "_n")
        return out if self.long is None else out.unionByName(_sizes(self.long, self.by))

    def small(self) -> DataFrame:
        """``_n`` and ``_names`` of the pools that an item may carry."""
        out = self.packed.where(F.col("_n") <= POOL_ROWS)
        return out if self.long is None else out.unionByName(_gathered(self.long, self.by, self.name))

    def large(self) -> DataFrame | None:
        """The other pools by rank; None without any."""
        big = self.packed.where(F.col("_n") > POOL_ROWS)
        if big.isEmpty() and self.long is None:
            return None
        out = big.select(*self.by, F.posexplode("_names").alias("rank", self.name), F.col("_n").alias("n_pool"))
        out = out.withColumn("rank", F.col("rank").cast("long"))
        return out if self.long is None else out.unionByName(self.long.where(F.col("n_pool") > POOL_ROWS))


def packed_pool(rows: DataFrame, by: Sequence[str], seed: str, names: Column, without: Column | None = None) -> Pool:
    """Pool of the distinct names in the arrays ``names`` of a session's rows, less those in its arrays ``without``.

    It has the ranks of ``ranked_pool``. Sessions are counted first: one of at most ``ordered.SESSION_ROWS`` names is gathered,
    ordered and written as one row, longer ones are ranked name by name. Rows without a session are left out: no item meets them.
    """
    by = list(by)
    empty = F.array().cast("array<string>")
    lists = rows.select(*by, F.coalesce(names, empty).alias("_in"), (empty if without is None else F.coalesce(without, empty)).alias("_out"))
    held = F.size("_in") + F.size("_out")
    lists = lists.dropna(subset=by).where(held > 0)
    counts = lists.groupBy(*by).agg(F.sum(held).alias("_rows")).where(F.col("_rows") > ordered.SESSION_ROWS)
    listed = cut(counts.select(*by))
    many = not listed.isEmpty()
    short = lists.join(F.broadcast(listed), by, "left_anti") if many else lists

    def all_of(col: str) -> Column:
        return F.array_distinct(F.flatten(F.collect_list(col)))

    # lists of a session seldom repeat: partial ones before the shuffle would only cost
    gathered = short.repartition(*by).groupBy(*by).agg(all_of("_in").alias("_in"), all_of("_out").alias("_out"))
    kept = F.col("_in") if without is None else F.array_except("_in", "_out")
    # sixteen bytes sort like their hex digits
    tagged = F.transform(kept, lambda x: F.struct(F.unhex(digest(seed, *[F.col(c) for c in by], x)).alias("h"), x.alias("v")))
    packed = gathered.select(*by, F.sort_array(tagged).alias("_t")).where(F.size("_t") > 0)
    packed = cut(packed.select(*by, F.size("_t").cast("long").alias("_n"), F.col("_t.v").alias("_names")))
    if not many:
        return Pool(by, packed)

    def marked(col: str, left: bool) -> Column:
        return F.transform(col, lambda x: F.struct(x.alias("v"), F.lit(left).alias("left")))

    flat = lists.join(F.broadcast(listed), by, "left_semi").select(*by, F.explode(F.concat(marked("_in", False), marked("_out", True))).alias("_x"))
    named = flat.groupBy(*by, F.col("_x.v").alias("object")).agg(F.max("_x.left").alias("_left")).where(~F.col("_left"))
    return Pool(by, packed, ranked_pool(cut(named.select(*by, "object")), by, seed))


def _sizes(pool: DataFrame, by: list[str]) -> DataFrame:
    return pool.groupBy(*by).agg(F.max("n_pool").alias("_n"))


def _gathered(pool: DataFrame, by: list[str], name: str) -> DataFrame:
    """The pools of ``ranked_pool`` that an item may carry, one row each."""
    names = F.array_sort(F.collect_list(F.struct("rank", F.col(name).alias("v"))))
    small = pool.where(F.col("n_pool") <= POOL_ROWS).groupBy(*by).agg(F.max("n_pool").alias("_n"), names.alias("_names"))
    return small.select(*by, "_n", F.col("_names.v").alias("_names"))


def draw_from_pool(
    items: DataFrame,
    pool: DataFrame | Pool,
    by: Sequence[str],
    key: Sequence[str],
    k: int | Column,
    seed: str,
    exclude: Column | None = None,
    name: str = "object",
    out: str = "drawn",
    keep_unmatched: bool = False,
    one_pool: bool = False,
    needed: Column | None = None,
) -> DataFrame:
    """Add ``out``: up to ``k`` pool names per item, none of them in ``exclude``.

    ``pool`` comes from ``ranked_pool`` or ``packed_pool``. Items of sessions without a pool are dropped
    unless ``keep_unmatched``, which gives them an empty draw. With ``one_pool`` the key
    ``by`` is one constant, so the pool size is a single row and is broadcast. Items whose
    ``needed`` is false read nothing.
    """
    by, key = list(by), list(key)
    how = "left" if keep_unmatched else "inner"
    banned = F.array().cast("array<string>") if exclude is None else exclude
    wanted = F.lit(True) if needed is None else needed
    want = F.lit(k) if isinstance(k, int) else k
    asked = items.select("*", banned.alias("_banned"), wanted.alias("_needed"), want.alias("_want"))
    if isinstance(pool, Pool):
        small, large = pool.small(), pool.large()
        many = large is not None
    else:
        small, large = _gathered(pool, by, name), pool.where(F.col("n_pool") > POOL_ROWS)
        many = not large.isEmpty()
    asked = ordered.stored(asked) if many else asked  # read for small and for large pools
    small = F.broadcast(small) if one_pool else small
    sizes = _sizes(large, by) if many else None
    sizes = F.broadcast(sizes) if many and one_pool else sizes
    rest = asked.join(sizes, by, "left_anti") if many and keep_unmatched else asked
    met = rest.join(small, by, how)
    met, drawn = _read_from_array(met, seed, [F.col(c) for c in key], k)
    drawn = F.coalesce(drawn, F.array().cast("array<string>")) if keep_unmatched else drawn
    held = [c for c in items.columns if c not in by]
    # as a generated column the draw is made once, however often it is read
    out_of_small = met.select(*by, *held, F.inline_outer(F.array(F.struct(drawn.alias(out)))))
    out_of_small = out_of_small if keep_unmatched else out_of_small.where(F.col(out).isNotNull())
    if not many:
        return out_of_small
    return out_of_small.unionByName(_draw_by_rank(asked, large, sizes, by, key, held, seed, name, out, keep_unmatched))


def _read_from_array(met: DataFrame, seed: str, ids: list[Column], k: int | Column) -> tuple[DataFrame, Column]:
    """``met`` with helper columns, and the draw from its ``_names``.

    Most items find ``k`` different free names at their first ranks, which are read as plain columns. The others read as many
    ranks as they can need, and only what still lacks names goes on to the neighbours.
    """

    def free(ranks: Column) -> Column:
        read = F.transform(ranks, lambda r: F.get("_names", r.cast("int")))
        return F.filter(read, lambda v: v.isNotNull() & ~F.array_contains("_banned", v))

    def fewer(found: Column) -> Column:
        got = F.transform(F.array(free(found)), lambda f: F.when(F.size(f) >= F.col("_want"), f).otherwise(free(_steps(seed, ids, found))))
        return F.slice(F.get(got, 0), 1, F.col("_want"))

    whole = F.when(_reads(), F.get(F.transform(F.array(F.array_distinct(_hashed(seed, ids, F.lit(0), _reach() - 1))), fewer), 0))
    if not isinstance(k, int) or not 0 < k <= FIRST_RANKS:
        return met, whole
    met = met.withColumns({f"_r{i}": F.when(F.col("_n") > 0, F.pmod(hash60(seed, *ids, F.lit(i)), F.col("_n"))) for i in range(k)})
    met = met.withColumns({f"_v{i}": F.get("_names", F.col(f"_r{i}").cast("int")) for i in range(k)})
    done = F.col("_needed")
    for i in range(k):
        done &= F.col(f"_v{i}").isNotNull() & ~F.array_contains("_banned", F.col(f"_v{i}"))
        for j in range(i):
            done &= F.col(f"_r{i}") != F.col(f"_r{j}")
    return met, F.when(done, F.array(*[F.col(f"_v{i}") for i in range(k)])).otherwise(whole)


def _reach() -> Column:
    """Ranks an item can need."""
    return F.col("_want") + F.size("_banned")


def _reads() -> Column:
    return F.col("_needed") & (_reach() > 0) & (F.col("_n") > 0)


def _hashed(seed: str, ids: list[Column], first: Column, last: Column) -> Column:
    return F.transform(F.sequence(first, last), lambda s: F.pmod(hash60(seed, *ids, s), F.col("_n")))


def _steps(seed: str, ids: list[Column], found: Column) -> Column:
    """The ranks an item reads: the hashed ones of ``found`` first, then neighbours in case too few of them differ."""
    reads = _reach()
    some = F.least(F.col("_n"), reads).cast("int")
    begin = F.pmod(hash60(seed, *ids), F.col("_n"))
    # the first neighbour is bound to a lambda variable: it is hashed once
    nearby = F.flatten(
        F.transform(F.array(begin), lambda b: F.transform(F.sequence(F.lit(0), 3 * reads - 1), lambda s: F.pmod(b + s, F.col("_n"))))
    )
    more = F.array_distinct(F.concat(found, _hashed(seed, ids, reads, 2 * reads - 1), nearby))
    return F.slice(F.when(F.size(found) >= some, found).otherwise(more), 1, some)


def _ranks(seed: str, ids: list[Column]) -> Column:
    """All ranks an item reads; null if it reads none."""
    once = F.transform(F.array(F.array_distinct(_hashed(seed, ids, F.lit(0), _reach() - 1))), lambda d: _steps(seed, ids, d))
    return F.when(_reads(), F.get(once, 0))


def _draw_by_rank(
    asked: DataFrame, pool: DataFrame, sizes: DataFrame, by: list[str], key: list[str], held: list[str], seed: str, name: str, out: str,
    keep_unmatched: bool,
) -> DataFrame:
    """Draws from large pools: one probe per rank."""
    ids = [f"_k{i}" for i in range(len(key))]
    steps = _ranks(seed, [F.col(i) for i in ids])
    probes = (
        asked.select(*by, F.struct(*held).alias("_item"), "_banned", "_needed", "_want")
        .join(sizes, by)
        .withColumns({i: _held(c, by) for i, c in zip(ids, key)})
        .select("*", (F.posexplode_outer(steps) if keep_unmatched else F.posexplode(steps)).alias("_step", "rank"))
    )
    # of an item's probes only the first one carries the item itself
    once = F.coalesce(F.col("_step") == 0, F.lit(True))
    probes = probes.select(
        *by,
        *ids,
        "_step",
        "rank",
        F.when(once, F.struct("_item", "_banned", "_want")).alias("_once"),
    )
    found = probes.join(pool.select(*by, "rank", name), [*by, "rank"], "left" if keep_unmatched else "inner")
    read = F.when(F.col(name).isNotNull(), F.struct("_step", F.col(name).alias("v")))
    # an item reads a few ranks; partial lists before the shuffle would only cost
    grouped = found.repartition(*by, *ids).groupBy(*by, *ids).agg(
        F.first("_once", ignorenulls=True).alias("_once"), F.array_sort(F.collect_list(read)).alias("_found")
    )
    free = F.filter("_found", lambda s: ~F.array_contains(F.col("_once._banned"), s["v"]))
    drawn = F.transform(F.slice(free, 1, F.col("_once._want")), lambda s: s["v"])
    return grouped.select(*by, *[F.col(f"_once._item.{c}").alias(c) for c in held], drawn.alias(out))


def _held(col: str, by: list[str]) -> Column:
    return F.col(col) if col in by else F.col(f"_item.{col}")


def draw_ranks(size: Column, k: int, seed: str, *parts: Column) -> Column:
    """``k`` distinct ranks below ``size`` (uniform over subsets), by shifting past earlier picks."""

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        # bound to a lambda variable, a value is computed once however often it is used
        return F.get(F.transform(F.array(value), use), 0)

    def hashed(i: int) -> Column:
        return F.pmod(hash60(f"{seed}{i}", *parts), F.when(size - i > 0, size - i))

    def shifted(pick: Column, lowers: Column | None, i: int) -> Column:
        for j in range(i):
            lower = F.get(lowers, j)
            pick = F.when(pick >= lower, pick + 1).otherwise(pick)
        return pick

    def further(picks: Column, i: int) -> Column:
        if i == k:
            return picks
        pick = once(F.sort_array(picks), lambda s: once(hashed(i), lambda p: shifted(p, s, i)))
        return once(F.array_append(picks, pick), lambda more: further(more, i + 1))

    return once(F.array(hashed(0)), lambda first: further(first, 1))


def draw_from_array(pool: Column, k: int, seed: str, *parts: Column) -> Column:
    """``k`` names of the row's own array in md5 order."""
    return F.slice(md5_order(pool, seed, *parts), 1, k)


def md5_order(names: Column, seed: str, *parts: Column) -> Column:
    """The array's names sorted by their digest."""
    prefix = F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])
    tagged = F.transform(names, lambda x: F.concat(F.md5(F.concat_ws("|", prefix, x)), x))
    return F.transform(F.array_sort(tagged), lambda x: F.substr(x, F.lit(33)))


def lettered(options: Column) -> Column:
    return F.transform(options, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), o))


def with_options(df: DataFrame, truth: Column, wrong: Column, seed: str, *parts: Column) -> DataFrame:
    """Add shuffled lettered ``options`` and the ``answer`` letter of the truth."""
    mixed = md5_order(F.concat(F.array(truth), wrong), seed, *parts)
    out = df.withColumn("_mixed", mixed)
    letter = F.char(F.lit(64) + F.array_position("_mixed", truth).cast("int"))
    return out.withColumn("answer", letter).withColumn("options", lettered(F.col("_mixed"))).drop("_mixed")


def sample_per_group(rows: DataFrame, by: Sequence[str], k: int, seed: str, *ids: str) -> DataFrame:
    """``k`` rows per group by md5; Spark trims each task to ``k`` rows per group before the shuffle."""
    window = Window.partitionBy(*by).orderBy("_h", *ids)
    hashed = rows.withColumn("_h", digest(seed, *[F.col(c) for c in ids]))
    return hashed.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= k).drop("_h", "_r")


def first_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[str], k: int = 3) -> DataFrame:
    """The first ``k`` rows per group, trimmed per task before the shuffle like ``sample_per_group``."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= k).drop("_r")


def sampled_starts(sizes: DataFrame, by: Sequence[str], length: int, draws: int, seed: str) -> DataFrame:
    """``draws`` window starts per session, repetition allowed, from sessions of at least ``length`` entries."""
    by = list(by)
    room = F.col("n_entries") - (length - 1)
    return (
        sizes.where(room > 0)
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("pos", F.pmod(hash60(seed, *[F.col(c) for c in by], F.col("draw")), room))
    )


def contiguous_chunks(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], cut: Column, parts: int
) -> DataFrame:
    """Number rows into ``parts`` contiguous chunks of equal ceiling size."""
    placed = ordered.scan(rows, by, order, cut, _i=ordered.row_number(), _n=ordered.total(F.lit(1)))
    size = F.ceil(F.col("_n") / F.lit(parts))
    return placed.withColumn("chunk", F.floor((F.col("_i") - 1) / size).cast("long")).drop("_i", "_n")

"""Ordered operators over sessions of any size.

A session may hold a large share of all rows, so no operator here sorts a whole
session in one task. Rows are first cut into chunks that are contiguous in the
session's order:

* ``scan`` runs ordinary windows inside (session, chunk), reduces every chunk to
  one summary row, runs the same function over the summary rows of a session and
  joins the carried value back. Only the summaries of a session meet in one task.
  A session of at most ``SESSION_ROWS`` rows is one chunk and needs no summaries.
  Rows and summaries are two readers of one input: stored columns are read twice (the summaries
  read few of them), but an input that holds a window, such as another scan, a join or a grouping is written to the
  shared folder first. Chained scans thus read each input once, however long the chain.
* ``tiles`` serves bounded row frames over dense positions: rows near a tile edge
  are copied to the neighbouring tile, so a plain window inside the tile is exact
  and one shuffle is enough.

``chunk`` must never decrease along ``order``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanflow.session import cut

CHUNK = "_chunk"
SESSION = "_session"
TILE = "_tile"
HOME = "_home"
VOID = "_void"

#: Rows of a session that one window may take; longer sessions go by chunks.
SESSION_ROWS = 1 << 16


@dataclass(frozen=True)
class Spec:
    kind: str
    expr: Column | None = None
    inclusive: bool = False


def row_number() -> Spec:
    """1-based position of the row in its session."""
    return Spec("number")


def running_sum(expr: Column, inclusive: bool = True) -> Spec:
    return Spec("sum", expr, inclusive)


def running_max(expr: Column, inclusive: bool = False) -> Spec:
    return Spec("max", expr, inclusive)


def last_value(expr: Column, inclusive: bool = False) -> Spec:
    """Nearest earlier non-null value; a struct is never null, so this is ``lag`` for structs."""
    return Spec("last", expr, inclusive)


def next_value(expr: Column, inclusive: bool = False) -> Spec:
    """Nearest later non-null value; ``lead`` for structs."""
    return Spec("next", expr, inclusive)


def total(expr: Column) -> Spec:
    """Sum over the whole session."""
    return Spec("total", expr)


def bucket(position: Column, width: float) -> Column:
    """Chunk number of a numeric position."""
    return F.floor(position / F.lit(float(width))).cast("long")


def _derived(df: DataFrame) -> bool:
    """Whether ``df`` is work that should not be done twice: its plan holds a window (such as an earlier scan), a join or a grouping."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return any(node in plan for node in ("Window [", "Join ", "Aggregate ["))


def stored(df: DataFrame) -> DataFrame:
    """``df`` for several readers: written to the shared folder once if it holds work, else as it is."""
    return cut(df) if _derived(df) else df


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    counted: DataFrame | None = None,
    coarse: bool = False,
    **specs: Spec,
) -> DataFrame:
    """Add one column per spec, each computed along ``order`` within ``by``.

    Sessions are counted first, so that only the long ones are cut into chunks. ``counted`` is another table to count instead: one
    that is cheaper to read and has at least as many rows of each session. With ``coarse`` chunks are large by nature, such as blocks of
    a file: nothing is counted.
    """
    session, order = list(by), list(order)
    # one struct as the key: a null session is a session of its own, in windows and in the join alike
    by = [SESSION]
    keys = [SESSION, CHUNK]
    base = df.withColumns({CHUNK: chunk, SESSION: F.struct(*session) if session else F.lit(0)})
    if _derived(df):
        base = cut(base)
    base, many = base.withColumn(VOID, F.col(CHUNK).isNull()), base
    if not coarse:
        listed = base if counted is None else counted.withColumn(SESSION, F.struct(*session) if session else F.lit(0))
        sizes = listed.groupBy(SESSION).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > SESSION_ROWS)
        # one row per SESSION_ROWS rows at most, mostly none
        long = cut(sizes.select(SESSION, F.lit(True).alias("_long")))
        many = None if long.isEmpty() else base.join(F.broadcast(long), SESSION, "left_semi")
        base = base.join(F.broadcast(long), SESSION, "left").withColumn(CHUNK, F.when(F.col("_long"), F.col(CHUNK))).drop("_long")
    ahead = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order])
    # rows without a chunk see no later ones that have one
    back = Window.partitionBy(*keys, VOID).orderBy(*[F.col(c).desc() for c in order])
    first, here = Window.unboundedPreceding, Window.currentRow
    along = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(first, -1)
    against = Window.partitionBy(*by).orderBy(F.col(CHUNK).desc()).rowsBetween(first, -1)
    whole = Window.partitionBy(*by)
    stamp = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]

    local, summary, carried, final = {}, {}, {}, {}
    for name, spec in specs.items():
        inside, above = f"_in_{name}", f"_up_{name}"
        stop = here if spec.inclusive else -1
        if spec.kind == "number":
            local[inside] = F.row_number().over(ahead).cast("long")
            summary[above] = F.count(F.lit(1))
            carried[above] = F.sum(above).over(along)
            final[name] = F.col(inside) + F.coalesce(F.col(above), F.lit(0))
        elif spec.kind == "sum":
            local[inside] = F.sum(spec.expr).over(ahead.rowsBetween(first, stop))
            summary[above] = F.sum(spec.expr)
            carried[above] = F.sum(above).over(along)
            final[name] = F.coalesce(F.col(inside), F.lit(0)) + F.coalesce(F.col(above), F.lit(0))
        elif spec.kind == "max":
            local[inside] = F.max(spec.expr).over(ahead.rowsBetween(first, stop))
            summary[above] = F.max(spec.expr)
            carried[above] = F.max(above).over(along)
            final[name] = F.greatest(F.col(inside), F.col(above))
        elif spec.kind in ("last", "next"):
            forward = spec.kind == "last"
            side = ahead if forward else back
            pick = F.max if forward else F.min
            local[inside] = F.last(spec.expr, ignorenulls=True).over(side.rowsBetween(first, stop))
            summary[above] = pick(F.when(spec.expr.isNotNull(), F.struct(*stamp, spec.expr.alias("v"))))
            carried[above] = F.last(above, ignorenulls=True).over(along if forward else against)
            final[name] = F.coalesce(F.col(inside), F.col(f"{above}.v"))
        elif spec.kind == "total":
            local[inside] = F.sum(spec.expr).over(Window.partitionBy(*keys))
            summary[above] = F.sum(spec.expr)
            carried[above] = F.sum(above).over(whole)
            final[name] = F.when(~F.col(VOID), F.coalesce(above, inside))
        else:
            raise ValueError(spec.kind)

    inner = base.select("*", *[c.alias(n) for n, c in local.items()])
    if many is None:  # nothing is carried
        kinds = base.groupBy(*keys).agg(*[c.alias(n) for n, c in summary.items()]).select(*[c.alias(n) for n, c in carried.items()]).schema
        out = inner.select("*", *[F.lit(None).cast(kinds[n].dataType).alias(n) for n in summary])
    else:
        carry = many.groupBy(*keys).agg(*[c.alias(n) for n, c in summary.items()])
        carry = carry.select(*keys, *[c.alias(n) for n, c in carried.items()])
        out = inner.join(carry, keys, "left")
    # the key holds the session's columns: they need not be moved twice
    kept = [F.col(SESSION)[c].alias(c) if c in session else F.col(c) for c in df.columns]
    return out.select(*kept, *[c.alias(n) for n, c in final.items()])


def islands(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    breaks: Column,
    key: Column,
    name: str = "island",
) -> DataFrame:
    """Label each row with ``key`` of the latest row (itself included) where ``breaks`` holds."""
    return scan(df, by, order, chunk, **{name: last_value(F.when(breaks, key), inclusive=True)})


def numbered(
    df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column, name: str = "pos", coarse: bool = False
) -> DataFrame:
    """0-based dense position per session."""
    out = scan(df, by, order, chunk, coarse=coarse, **{name: row_number()})
    return out.withColumn(name, F.col(name) - 1)


def tiles(df: DataFrame, pos: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Copy rows so that each tile of ``size`` dense positions also holds its halo.

    The caller runs windows over (session, ``TILE``) ordered by ``pos`` and keeps the
    rows with ``HOME``. Copies grow the data by (before + after) / size.
    """
    if max(before, after) > size:
        raise ValueError("halo wider than a tile")
    tile = F.floor(F.col(pos) / F.lit(size)).cast("long")
    offset = F.col(pos) - tile * size
    copies = [F.struct(tile.alias("t"), F.lit(True).alias("h"))]
    if before:
        copies.append(F.when(offset >= size - before, F.struct((tile + 1).alias("t"), F.lit(False).alias("h"))))
    if after:
        copies.append(F.when(offset < after, F.struct((tile - 1).alias("t"), F.lit(False).alias("h"))))
    return (
        df.withColumn("_copy", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
        .withColumn(TILE, F.col("_copy.t"))
        .withColumn(HOME, F.col("_copy.h"))
        .drop("_copy")
    )


def tile_window(by: Sequence[str], pos: str):
    return Window.partitionBy(*by, TILE).orderBy(pos)


def home(df: DataFrame) -> DataFrame:
    return df.where(F.col(HOME)).drop(TILE, HOME)


PLACE = "_place"


def placed(df: DataFrame, order: Sequence[str], bits: int = 12, chunk: str = CHUNK) -> DataFrame:
    """``df`` sorted over ranges by ``order`` and written, with its place and its chunk.

    ``PLACE`` is unique and grows along ``order``; a chunk is a run of at most ``2**bits`` rows, whatever the values and their
    density, so equal rows and long sessions are spread as well. Places of different ranges are not dense.
    """
    base = stored(df)
    return cut(
        base.orderBy(*order).withColumn(PLACE, F.monotonically_increasing_id()).withColumn(chunk, F.shiftright(PLACE, bits))
    )

"""Delimited text with quotes, read as splittable lines.

A quoted field may hold line breaks, so a line can only be understood from the state in which it begins: outside quotes, or
inside a quoted field. A block of a file does not know that state. Each line is therefore taken as a function
of it: what is the state after the line, for either state before. Such a function keeps the state, turns it round, or sets it.
Functions of lines are composed inside a block, functions of blocks along the file, and the state found for a block's begin
settles its lines. Lines that belong to a record of several are then joined; all others are records as they are.

Quotes follow the usual rules: a field is quoted if a quote is its first character (after blanks), a doubled quote inside stands for one,
what follows the closing quote belongs to the field, and a quote inside an unquoted field is a character like any other. A quote
that is never closed would swallow the rest of its file: those lines are taken one by one instead.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanflow.operators import ordered
from scanflow.session import cut


class Pattern:
    """Regular expressions for one separator and one quote, both a single character."""

    def __init__(self, sep: str, quote: str):
        if len(sep) != 1 or len(quote) != 1:
            raise ValueError("separator and quote are single characters")
        self.sep, self.quote = sep, quote
        s, q = re.escape(sep), re.escape(quote)
        inside = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
        closed = f" *+{q}{inside}{q}[^{s}]*+"
        plain = f"(?! *+{q})[^{s}]*+"
        fields = f"(?:(?:{closed}|{plain}){s})*+"
        self.opens = rf"^{fields} *+{q}{inside}\z"
        self.stays = rf"^{inside}\z"
        self.reopens = rf"^{inside}{q}[^{s}]*+{s}{fields} *+{q}{inside}\z"
        # an open field at the end is a field as well
        self.field = rf"\G{s}({closed}|{plain}|(?s:.*))"
        self.quoted = f"^ *+{q}"
        self.parts = rf"^ *+{q}({inside})(?:{q}|\z)(.*)\z"
        self.blanks = f"{s} *+"


def _line_states(value: Column, p: Pattern) -> tuple[Column, Column]:
    """Whether a line ends inside quotes if it begins outside them, and if it begins inside."""
    quotes = value.contains(p.quote)
    outside = quotes & value.rlike(p.opens)
    inside = ~quotes | value.rlike(p.stays) | value.rlike(p.reopens)
    return outside, inside


def _turned(state: Column, times: Column) -> Column:
    return state != (F.pmod(times, F.lit(2)) == 1)


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line with its place: file, block, and a number that grows inside the block."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nr"), "value",
    )


def line_states(raw: DataFrame, p: Pattern) -> DataFrame:
    """``raw`` with whether a line begins (``before``) and ends (``after``) inside quotes."""
    outside, inside = _line_states(F.col("value"), p)
    sets, turns = F.col("o") == F.col("i"), (F.col("o") & ~F.col("i")).cast("int")
    here, along = Window.partitionBy("file", "block").orderBy("nr"), Window.partitionBy("file").orderBy("block")
    begin = Window.unboundedPreceding
    counted = raw.withColumns({"o": outside, "i": inside}).withColumn("upto", F.sum(turns).over(here.rowsBetween(begin, 0)))
    # a block as a function: the last line that sets the state, and the turns since
    blocks = (
        counted.groupBy("file", "block")
        .agg(F.max(F.when(sets, F.struct("nr", "o", "upto"))).alias("set"), F.max("upto").alias("all"))
        .select("file", "block", "set.o", (F.col("all") - F.coalesce("set.upto", F.lit(0))).alias("turns"))
        .withColumn("sum", F.sum("turns").over(along.rowsBetween(begin, 0)))
        .withColumn("base", F.when(F.col("o").isNotNull(), F.struct("o", (F.col("sum") - F.col("turns")).alias("sum"))))
        .withColumn("base", F.last("base", ignorenulls=True).over(along.rowsBetween(begin, -1)))
    )
    since = F.col("sum") - F.col("turns") - F.coalesce(F.col("base.sum"), F.lit(0))
    entries = blocks.select("file", "block", _turned(F.coalesce("base.o", F.lit(False)), since).alias("entry"))
    fixed = F.last(F.when(sets, F.struct("o", "upto")), ignorenulls=True).over(here.rowsBetween(begin, -1))
    local = counted.withColumn("fixed", fixed).join(entries, ["file", "block"])
    done = F.col("upto") - turns
    before = F.when(F.col("fixed").isNotNull(), _turned(F.col("fixed.o"), done - F.col("fixed.upto"))).otherwise(_turned(F.col("entry"), done))
    return local.withColumn("before", before).select(
        *raw.columns, "before", F.when(F.col("before"), F.col("i")).otherwise(F.col("o")).alias("after")
    )


def records(spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """Records (file, block, nr, value) that are not blank; broken ones are joined with line feeds.

    Files without any quote are read as they are; others are written once with the state of their lines.
    """
    p, fields = Pattern(sep, quote), ["file", "block", "nr", "value"]
    raw = raw_lines(spark, path)
    if raw.where(F.col("value").contains(quote)).isEmpty():
        return raw.where(F.trim("value") != "")
    known = cut(line_states(raw, p))
    whole = known.where(~F.col("before") & ~F.col("after"))
    place = F.struct("block", "nr")
    broken = known.where(F.col("before") | F.col("after"))
    parts = cut(ordered.islands(broken, ["file"], ["block", "nr"], F.col("block"), ~F.col("before"), place, name="start"))
    ends = parts.groupBy("file", "start").agg((~F.max_by("after", place)).alias("closed"))
    judged = parts.join(ends, ["file", "start"])
    joined = (
        judged.where("closed")
        .groupBy("file", "start")
        .agg(F.array_sort(F.collect_list(F.struct("block", "nr", "value"))).alias("l"))
        .select("file", "start.block", "start.nr", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("value"))
    )
    mended = cut(joined.unionByName(judged.where("NOT closed").select(*fields)))
    every = whole.select(*fields).unionByName(mended)
    return every.where(F.trim("value") != "")


def split(value: Column, sep: str = ",", quote: str = '"') -> Column:
    """Fields of a record, without the blanks before them and the quotes around them."""
    p = Pattern(sep, quote)

    def bare(f: Column) -> Column:
        inner = F.replace(F.regexp_extract(f, p.parts, 1), F.lit(quote * 2), F.lit(quote))
        return F.when(f.rlike(p.quoted), F.concat(inner, F.regexp_extract(f, p.parts, 2))).otherwise(F.ltrim(f))

    careful = F.transform(F.regexp_extract_all(F.concat(F.lit(sep), value), F.lit(p.field), F.lit(1)), bare)
    return F.when(value.contains(quote), careful).otherwise(F.split(F.ltrim(value), p.blanks, -1))


def rows(spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """file, block, nr and fields of every record, whether it is its file's first (``is_header``), and that one's fields (``header``)."""
    found = records(spark, path, sep, quote)
    heads = found.groupBy("file").agg(F.min(F.struct("block", "nr", "value")).alias("_h"))
    names = heads.select("file", F.col("_h.block").alias("_b"), F.col("_h.nr").alias("_n"), split(F.col("_h.value"), sep, quote).alias("header"))
    cells = found.select("file", "block", "nr", split(F.col("value"), sep, quote).alias("fields")).join(names, "file")
    first = (F.col("block") == F.col("_b")) & (F.col("nr") == F.col("_n"))
    return cells.select("file", "block", "nr", "fields", first.alias("is_header"), "header")

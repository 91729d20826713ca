"""Clock text, frame numbers and ticks as column expressions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_PER_SECOND = 10_000_000


def _int(col: Column) -> Column:
    return F.floor(col).cast("long")


def mmss(seconds: Column) -> Column:
    """``MM:SS``, truncating; minutes may exceed 59."""
    return F.format_string("%02d:%02d", _int(seconds / 60), _int(F.pmod(seconds, F.lit(60))))


def clock_ms(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``, truncating."""
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        _int(seconds / 3600),
        _int(F.pmod(seconds, F.lit(3600)) / 60),
        _int(F.pmod(seconds, F.lit(60))),
        _int(F.pmod(seconds, F.lit(1)) * 1000),
    )


def clock_rounded(seconds: Column, clamp: bool = False) -> Column:
    """``HH:MM:SS`` of the half-to-even rounded second."""
    whole = F.rint(seconds).cast("long")
    if clamp:
        whole = F.greatest(whole, F.lit(0))
    return F.format_string(
        "%02d:%02d:%02d", _int(whole / 3600), _int(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    )


def clock_short(seconds: Column) -> Column:
    """``clock_rounded`` without a zero hour."""
    text = clock_rounded(seconds)
    return F.when(text.startswith("00:"), F.substring(text, 4, 16)).otherwise(text)


def parse_clock(text: Column, otherwise: str = "zero") -> Column:
    """Seconds of ``MM:SS`` or ``HH:MM:SS``; other shapes give 0, or their number with ``otherwise='number'``."""
    parts = F.split(text, ":")

    def part(i: int) -> Column:
        return F.get(parts, i).try_cast("long")

    rest = F.lit(0.0) if otherwise == "zero" else text.try_cast("double")
    return (
        F.when(F.size(parts) == 2, (part(0) * 60 + part(1)).cast("double"))
        .when(F.size(parts) == 3, (part(0) * 3600 + part(1) * 60 + part(2)).cast("double"))
        .otherwise(rest)
    )


def range_bounds(text: Column) -> tuple[Column, Column]:
    """Seconds of both ends of ``[a - b]``; null when the text has another shape."""
    bare = F.btrim(text, F.lit("[]"))
    halves = F.split(bare, " - ")
    good = F.size(halves) == 2

    def end(i: int) -> Column:
        piece = F.trim(F.get(halves, i))
        shaped = piece.rlike(r"^\d+:\d+(:\d+)?$")
        return F.when(good & shaped, parse_clock(piece))

    return end(0), end(1)


def range_text(start: Column, end: Column) -> Column:
    """``[MM:SS - MM:SS]``."""
    return F.concat(F.lit("["), mmss(start), F.lit(" - "), mmss(end), F.lit("]"))


def span_bounds(text: Column) -> tuple[Column, Column]:
    """Ends of ``a-b`` where each end is seconds or clock text."""
    halves = F.split(text, "-", 2)
    ends = [F.trim(F.get(halves, i)) for i in (0, 1)]
    low, high = (F.when(e.contains(":"), parse_clock(e)).otherwise(e.try_cast("double")) for e in ends)
    return low, high


def truth_span(text: Column, margin: int = 10) -> Column:
    """``start-end`` whole seconds with ``margin`` added to the end; null for unparsable text."""
    low, high = range_bounds(text)
    span = F.concat(low.cast("long").cast("string"), F.lit("-"), (high + margin).cast("long").cast("string"))
    return F.when(text.startswith("[") & text.contains(" - "), span)


def frame_code(text: Column, fps: int = 24) -> Column:
    """Frame number of ``hh:mm:ss:ff``."""
    parts = [F.get(F.split(text, ":"), i).try_cast("long") for i in range(4)]
    return (parts[0] * 3600 + parts[1] * 60 + parts[2]) * fps + parts[3]


def frame_index(seconds: Column, fps: float) -> Column:
    return _int(seconds * F.lit(fps))


def frame_tick(start: Column, frame: Column, fps: float) -> Column:
    """Exact 100-ns tick of a frame: the rate is kept as a fraction, arithmetic stays integer."""
    rate = Fraction(fps).limit_denominator()
    scaled = frame.cast("decimal(20,0)") * F.lit(rate.denominator * TICKS_PER_SECOND).cast("decimal(18,0)")
    step = F.floor(scaled / F.lit(rate.numerator).cast("decimal(12,0)"))
    return start + step.cast("long")

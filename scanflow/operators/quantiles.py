"""Exact quantiles without gathering a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanflow.operators import ordered


def exact_quantiles(
    rows: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], width: float
) -> DataFrame:
    """Linearly interpolated quantiles per group.

    Values are first counted, so repeated ones cost one row each, then ranked by a running
    count over value buckets of ``width``. Only the values that hold a wanted rank are kept.
    """
    by = list(by)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered.scan(
        counted,
        by,
        [value],
        ordered.bucket(F.col(value), width),
        _upto=ordered.running_sum(F.col("_c")),
        _n=ordered.total(F.col("_c")),
    )
    picks = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.floor(place)
        share = place - low
        first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
        at_low = low.between(first, last)
        at_high = F.least(low + 1, F.col("_n") - 1).between(first, last)
        weight = F.when(at_low, 1 - share).otherwise(0.0) + F.when(at_high, share).otherwise(0.0)
        picks.append(F.sum(F.when(at_low | at_high, F.col(value) * weight)).alias(name))
    return ranked.groupBy(*by).agg(*picks)

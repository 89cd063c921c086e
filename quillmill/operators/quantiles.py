"""Exact quantiles of a column without gathering or sorting it: histograms that close in on the wanted places."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import settle

BINS, SPAN, MIDDLE = 1024, 8192, 4096  # SPAN: numbers set aside for the bins of an interval


def _bin(value: Column, lo: float, hi: float) -> Column:
    """The bin of a value of [lo, hi], rising with the value."""
    if (lo > 0) == (hi > 0) and lo != 0 and max(abs(lo), abs(hi)) / BINS <= min(abs(lo), abs(hi)):  # its ends fall into different bins
        return F.least(F.floor((value - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).cast("int")
    magnitude = F.floor(F.log2(F.abs(value))).cast("int") + 1100  # at least 1 for any double
    return F.lit(MIDDLE) + F.when(value == 0, 0).when(value > 0, magnitude).otherwise(-magnitude)


def order_statistics(values: DataFrame, column: str, places: Sequence[int]) -> dict[int, float]:
    """{place: the value at that 0-based place in ascending order} of a double column without nulls or NaN.

    Every pass cuts each interval that still holds a wanted place into bins and counts them, with their least and greatest
    value, in one aggregation that is partial before its shuffle; the next pass looks at the bins of the wanted places alone,
    between their own extremes. An interval over many magnitudes is cut by sign and binary exponent, any other into BINS
    of equal width. A bin of one value is an answer, so ties end the search; ordinary data needs three or four passes,
    any at most about eight. A few thousand rows for each wanted place reach the driver.
    """
    ends = values.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    wanted = sorted({p for p in places if 0 <= p < ends.n})
    found: dict[int, float] = {}
    # (least value, greatest value, rows below it, places wanted in it)
    open_ = [(ends.lo, ends.hi, 0, wanted)] if wanted else []
    while open_:
        bins = F.lit(None).cast("int")
        cuts = []
        for k, (lo, hi, below, inside) in enumerate(open_):
            if lo == hi:
                found |= dict.fromkeys(inside, lo)
                continue
            cuts.append((k, below, inside))
            bins = F.coalesce(bins, F.when(F.col(column).between(lo, hi), F.lit(k * SPAN) + _bin(F.col(column), lo, hi)))
        if not cuts:
            break
        rows = values.select(F.col(column).alias("v"), bins.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        following = []
        for k, below, inside in cuts:
            at = below
            for r in sorted((r for r in rows if r.bin // SPAN == k), key=lambda r: r.bin):
                here = [p for p in inside if at <= p < at + r.n]
                if here:
                    following.append((r.lo, r.hi, at, here))
                at += r.n
        open_ = following
    return found


def exact_quantiles(rows: DataFrame, column: str, points: Sequence[float]) -> list[tuple[float, float | None]]:
    """(point, value) pairs: between its two neighbours a quantile is interpolated. Nulls and NaN do not count; without
    values the quantiles are None."""
    values = settle(rows.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")), "values")
    n = values.count()
    at = {p: (n - 1) * p for p in points}
    known = order_statistics(values, "v", [f(x) for x in at.values() for f in (math.floor, math.ceil)]) if n else {}
    out = []
    for p in points:
        if not n:
            out.append((p, None))
            continue
        lo, hi = known[math.floor(at[p])], known[math.ceil(at[p])]
        out.append((p, lo if lo == hi else (math.ceil(at[p]) - at[p]) * lo + (at[p] - math.floor(at[p])) * hi))
    return out

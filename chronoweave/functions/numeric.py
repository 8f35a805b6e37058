"""Weights, rates and scaling rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def recency_weight(mid: Column, focus_year: Column | None) -> Column:
    """Gaussian fall-off around the focus year (sigma 40), 0.85 without a focus."""
    if focus_year is None:
        return F.lit(0.85)
    d = F.abs(mid - focus_year)
    w = F.lit(0.15) + F.lit(0.85) * F.exp(-(d * d) / F.lit(2.0 * 40 * 40))
    return F.coalesce(w, F.lit(0.85))


def rank_weight(rank: Column) -> Column:
    return F.when(rank == 1, 1.0).otherwise(F.greatest(F.lit(0.15), 1 - F.lit(0.18) * (rank - 1)))


def cluster_count(n: Column) -> Column:
    """Clusters for ``n`` points: half-even rounded root kept within 4..16, 0 for none."""
    k = F.greatest(F.lit(4), F.least(F.lit(16), F.rint(F.sqrt(n)).cast("int")))
    return F.when(n <= 0, 0).otherwise(k)


def unit_scale(value: Column, low: Column, high: Column, flat: Column | None = None) -> Column:
    """Min-max scaling; a flat range divides by one unless ``flat`` gives its value."""
    width = high - low
    scaled = (value - low) / F.when(width == 0, 1.0).otherwise(width)
    return scaled if flat is None else F.when(width == 0, flat).otherwise(scaled)


def expand_end_by_century(start: Column, end: Column) -> Column:
    """1914-18 -> 1918, by the century of the start."""
    return F.when(end < 100, F.floor(start / 100).cast("int") * 100 + end).otherwise(end)

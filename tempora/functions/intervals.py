"""Times and intervals as column expressions. Boundaries are integer deciseconds inside jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_time(x: Column) -> Column:
    """Seconds rounded half-even to one decimal; 0 for what is no number."""
    return F.coalesce(F.bround(x.try_cast("double"), 1), F.lit(0.0))


def clamp(x: Column, low: Column, high: Column) -> Column:
    """Between low and high; where they cross, high wins."""
    return F.least(F.greatest(x, low), high)


def interval_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def interval_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over the hull of both intervals; 0 for an empty hull."""
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull > 0, interval_overlap(a_start, a_end, b_start, b_end).cast("double") / hull).otherwise(0.0)

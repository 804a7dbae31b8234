"""Ranges of a sortable column by given bounds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_of(value: Column, bounds: Sequence[float]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``; 0 for a null value.

    Bounds are looked up in two steps of about the square root of their number.
    """
    bounds = list(bounds)
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    starts = F.array(*[F.lit(b[0]) for b in blocks])
    block = F.size(F.filter(starts, lambda b: b <= value))
    rows = F.array(*[F.array(*map(F.lit, b)) for b in blocks])
    inside = F.size(F.filter(F.get(rows, block - 1), lambda b: b <= value))
    return F.when(block > 0, (block - 1) * step + inside).otherwise(0).cast("int")

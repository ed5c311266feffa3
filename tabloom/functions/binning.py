"""Bin codes from edges, as expressions."""

from __future__ import annotations

from collections.abc import Sequence
from math import inf

from pyspark.sql import Column
from pyspark.sql import functions as F


def right_closed(c: Column, edges: Sequence[float], lowest: bool = True) -> Column:
    """The number of the interval (edges[i], edges[i + 1]] that holds c, the first with its lower end; outside null."""
    inner = [float(e) for e in edges[1:-1]]
    low, high = float(edges[0]), float(edges[-1])
    code = sum((F.when(c > F.lit(e), 1).otherwise(0) for e in inner), F.lit(0)) if len(inner) <= 64 else F.size(
        F.filter(F.array(*[F.lit(e) for e in inner]), lambda e: e < c)
    )
    inside = c.isNotNull()
    if low > -inf:
        inside &= (c >= low) if lowest else (c > low)
    if high < inf:
        inside &= c <= high
    return F.when(inside, code).cast("int")


def left_closed(c: Column, edges: Sequence[float]) -> Column:
    """The number of inner edges at or below c."""
    return F.when(c.isNotNull(), sum((F.when(c >= F.lit(float(e)), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))).cast("int")


def distinct_edges(values: Sequence[float | None]) -> list[float]:
    return sorted({float(v) for v in values if v is not None})


def equal_width(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) * i / bins for i in range(bins + 1)]

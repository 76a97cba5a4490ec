"""Bin numbers of values by sorted edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges_array(edges: list[float]) -> Column:
    return F.lit([float(e) for e in edges])


def search_left(v: Column, edges: list[float]) -> Column:
    """The number of edges below v: a value on an edge belongs to the bin under it. NaN is above all edges."""
    return F.size(F.filter(edges_array(edges), lambda e: F.isnan(v) | (e < v)))


def digitize(v: Column, edges: list[float]) -> Column:
    """The number of edges at or below v: a value on an edge belongs to the bin above it."""
    return F.size(F.filter(edges_array(edges), lambda e: F.isnan(v) | (e <= v)))


def search_left_even(v: Column, lo: float, step: float, n: int) -> Column:
    """As :func:`search_left` for n edges lo, lo + step, ...: arithmetic first, then exact at the edges."""
    k = F.greatest(F.least(F.ceil((v - lo) / step), F.lit(n)), F.lit(0)).cast("int")
    k = F.when((k > 0) & ((k - 1) * step + lo >= v), k - 1).otherwise(k)
    k = F.when((k < n) & (k * step + lo < v), k + 1).otherwise(k)
    return F.when(F.isnan(v), F.lit(n)).otherwise(k)


def linspace(lo: float, hi: float, n: int) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n - 1)] + [float(hi)]

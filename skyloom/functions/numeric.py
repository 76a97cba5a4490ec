"""Floating-point semantics of array libraries, as column expressions.

Spark takes NaN as the largest number and gives NULL for logarithms of non-positive
numbers. These helpers make NaN compare false, and logarithms NaN or infinite.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

INF, NAN = float("inf"), float("nan")
#: Pogson's ratio as an exponent: 2.5 log10(e).
POGSON = 1.0857362047581294


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def lt(a: Column, b: Column | float) -> Column:
    """a < b, false for NaN. NaN is Spark's largest number, so only b needs a guard; scans can take a plain bound."""
    return (a < b) & ~F.isnan(b) if isinstance(b, Column) else a < F.lit(float(b))


def gt(a: Column, b: Column | float) -> Column:
    """a > b, false for NaN."""
    return (a > (b if isinstance(b, Column) else F.lit(float(b)))) & ~F.isnan(a)


def between(c: Column, lo: float, hi: float) -> Column:
    """lo < c < hi."""
    return gt(c, lo) & lt(c, hi)


def log10(c: Column) -> Column:
    """-inf for 0, NaN for negative numbers and NaN."""
    return F.when(c > 0, F.log10(c)).when(c == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is signed infinity, 0/0 is NaN."""
    return (
        F.when(b != 0, F.try_divide(a, b))
        .when((a == 0) | F.isnan(a), F.lit(NAN))
        .when(a > 0, F.lit(INF))
        .when(a < 0, F.lit(-INF))
    )


def clip(c: Column, lo: float, hi: float) -> Column:
    """c held in [lo, hi]; NaN stays."""
    return F.when(F.isnan(c), c).otherwise(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def no_nan(df: DataFrame, columns: list[str] | None = None) -> Column:
    """True where no floating column (of those named, or of all) is NaN or null."""
    kinds = (DoubleType, FloatType)
    own = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and (columns is None or f.name in columns)]
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")) for c in own], F.lit(True))


def require(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"columns not in the table: {missing}")

"""Interpolants as piecewise polynomials that columns can evaluate.

A curve is knots k0 < k1 < ... and a polynomial (c0, c1, c2) in (v - knot) for each interval.
They are found once on the driver; evaluation looks the interval up in a literal array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.binning import digitize


@dataclass(frozen=True)
class Curve:
    knots: tuple[float, ...]
    pieces: tuple[tuple[float, float, float], ...]
    below: float | None = None  # value under the first knot; None extends the first piece
    above: float | None = None

    def column(self, v: Column) -> Column:
        n = len(self.pieces)
        i = F.greatest(F.least(digitize(v, list(self.knots)), F.lit(n)), F.lit(1))
        piece = F.element_at(F.lit([[float(k), *map(float, p)] for k, p in zip(self.knots, self.pieces, strict=False)]), i)
        d = v - piece[0]
        out = piece[1] + d * (piece[2] + d * piece[3])
        if self.above is not None:
            out = F.when(v > self.knots[-1], F.lit(float(self.above))).otherwise(out)
        if self.below is not None:
            out = F.when(v < self.knots[0], F.lit(float(self.below))).otherwise(out)
        return F.when(F.isnan(v), F.lit(float("nan"))).otherwise(out)

    def __call__(self, v: np.ndarray) -> np.ndarray:
        v = np.asarray(v, float)
        i = np.clip(np.searchsorted(self.knots, v, side="right") - 1, 0, len(self.pieces) - 1)
        p = np.array(self.pieces)[i]
        d = v - np.array(self.knots)[i]
        out = p[:, 0] + d * (p[:, 1] + d * p[:, 2])
        if self.above is not None:
            out = np.where(v > self.knots[-1], self.above, out)
        if self.below is not None:
            out = np.where(v < self.knots[0], self.below, out)
        return out

    def sql(self, v: str) -> str:
        """The curve as a SQL expression in v."""
        whens = []
        for k, (a, b, c) in reversed(list(zip(self.knots, self.pieces, strict=False))):
            d = f"({v} - ({k!r}::DOUBLE))"
            whens.append((k, f"({a!r}::DOUBLE) + {d} * (({b!r}::DOUBLE) + {d} * ({c!r}::DOUBLE))"))
        cases = " ".join(f"WHEN {v} >= {k!r}::DOUBLE THEN {e}" for k, e in whens[:-1])
        body = f"CASE {cases} ELSE {whens[-1][1]} END" if cases else whens[-1][1]
        head = ""
        if self.below is not None:
            head += f"WHEN {v} < {self.knots[0]!r}::DOUBLE THEN {float(self.below)!r}::DOUBLE "
        if self.above is not None:
            head += f"WHEN {v} > {self.knots[-1]!r}::DOUBLE THEN {float(self.above)!r}::DOUBLE "
        return f"(CASE {head} ELSE {body} END)" if head else f"({body})"


def linear(x: list[float], y: list[float]) -> Curve:
    """Linear interpolation that goes on beyond both ends. Points are sorted first."""
    x, y = (np.asarray(a, float) for a in (x, y))
    if len(x) < 2:
        raise ValueError("a curve needs two points at least")
    by = np.argsort(x, kind="stable")
    x, y = x[by], y[by]
    slope = np.diff(y) / np.diff(x)
    return Curve(tuple(x.tolist()), tuple((float(a), float(s), 0.0) for a, s in zip(y[:-1], slope, strict=True)))


def quadratic(x: list[float], y: list[float], below: float, above: float) -> Curve:
    """The interpolating quadratic spline with knots halfway between inner points, and fixed values outside.

    The first and the last midpoint aren't knots.
    """
    x, y = (np.asarray(a, float) for a in (x, y))
    if len(x) < 3:
        raise ValueError("a quadratic spline needs three points at least")
    inner = ((x[1:] + x[:-1]) / 2)[1:-1]
    knots = np.concatenate(([x[0]], inner, [x[-1]]))
    # Truncated powers: 1, d, d^2 and (x - knot)^2 for inner knots; as many as points.
    basis = lambda v: np.column_stack(
        [np.ones_like(v), v - x[0], (v - x[0]) ** 2] + [np.maximum(v - t, 0) ** 2 for t in inner]
    )
    c = np.linalg.solve(basis(x), y)
    pieces = []
    for a in knots[:-1]:
        on = [(t, k) for t, k in zip(inner, c[3:], strict=True) if t <= a]
        d = a - x[0]
        value = c[0] + c[1] * d + c[2] * d * d + sum(k * (a - t) ** 2 for t, k in on)
        slope = c[1] + 2 * c[2] * d + sum(2 * k * (a - t) for t, k in on)
        pieces.append((float(value), float(slope), float(c[2] + sum(k for _, k in on))))
    return Curve(tuple(knots.tolist()), tuple(pieces), below, above)

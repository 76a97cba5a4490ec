"""Mock photometric redshifts: a Gaussian core and a skewed Student-t tail (Jones and Faddy 2003)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.binning import digitize
from skyloom.functions.draws import normal, uniform
from skyloom.functions.numeric import clip, is_finite, require

#: Draws of a row, the first one and the retries.
DRAWS = 11
Z_RANGE = (0.0, 6.0)
#: Points of a tabulated quantile function.
QUANTILES = 2048


@dataclass(frozen=True)
class ScatterModel:
    # The published core tables, and tail fits, by i-band and redshift bin.
    mag_edges: tuple = (15.5, 22.0, 23.0, 24.0, 29.0)
    z_edges: tuple = (0.0, 0.3, 0.7, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0)
    bias: tuple = (
        (0.0, 0.002, -0.002, 0.001, 0.001, 0.001, 0.001, 0.001),
        (0.0, -0.0, -0.002, -0.004, 0.01, 0.01, 0.01, 0.01),
        (0.003, -0.0, -0.001, -0.006, -0.002, 0.024, 0.007, 0.0),
        (0.008, -0.005, 0.007, -0.015, -0.019, 0.017, 0.011, 0.0),
    )
    sigma: tuple = (
        (0.01, 0.02, 0.026, 0.038, 0.038, 0.038, 0.038, 0.038),
        (0.011, 0.019, 0.025, 0.036, 0.062, 0.062, 0.062, 0.062),
        (0.011, 0.022, 0.027, 0.044, 0.063, 0.115, 0.093, 0.074),
        (0.013, 0.023, 0.025, 0.051, 0.069, 0.12, 0.103, 0.069),
    )
    tail_share: tuple = (0.0709, 0.0672, 0.0618, 0.2425)
    tail_loc: tuple = (0.0431, -0.0847, -0.0371, -0.0979)
    tail_scale: tuple = (0.1585, 0.1018, 0.4109, 0.2499)
    tail_a: tuple = (8.4098, 0.5426, 1.1277, 0.5394)
    tail_b: tuple = (8.747, 0.4436, 0.8467, 0.5454)


KHOSTOVAN26 = ScatterModel()
ZCOSMOS = ScatterModel(
    tail_share=(0.088, 0.1377, 0.4312, 0.4312),
    tail_loc=(-0.0055, 0.1568, 0.2, 0.2),
    tail_scale=(0.2041, 0.3522, 0.237, 0.237),
    tail_a=(3.7662, 10.1149, 2.0, 2.0),
    tail_b=(4.0, 11.2095, 4.0, 4.0),
)


@lru_cache(maxsize=64)
def skew_t_quantiles(a: float, b: float, n: int = QUANTILES) -> tuple[float, ...]:
    """The quantile function at n + 1 even points, the ends at 1/4n from 0 and 1.

    With d from Beta(a, b), t = (2d - 1) sqrt(a + b) / (2 sqrt(d (1 - d))). Beta's distribution
    function is summed over a grid in the logit of d, which reaches far into both tails.
    """
    x = np.linspace(-60, 60, 240_001)
    # density of the logit: d^a (1 - d)^b / B(a, b)
    log_d, log_1d = -np.logaddexp(0, -x), -np.logaddexp(0, x)
    beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    f = np.exp(a * log_d + b * log_1d - beta)
    cdf = np.concatenate(([0.0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(x))))
    cdf /= cdf[-1]
    u = np.arange(n + 1) / n
    u[0], u[-1] = 0.25 / n, 1 - 0.25 / n
    at = np.interp(u, cdf, x)
    # (2d - 1) / (2 sqrt(d (1 - d))) = sinh(logit / 2)
    return tuple((np.sinh(at / 2) * math.sqrt(a + b)).tolist())


def _look_up(rows: tuple, *index: Column) -> Column:
    out = F.lit([list(map(float, r)) if isinstance(r, tuple) else float(r) for r in rows])
    for i in index:
        out = F.element_at(out, i)
    return out


def scatter(
    df: DataFrame,
    row_id: str,
    mag_i: str = "mag_i",
    redshift: str = "z",
    out: str = "photoz_mock",
    model: ScatterModel = KHOSTOVAN26,
    seed: int = 42,
    tails: bool = True,
) -> DataFrame:
    """Add a mock redshift: the first of DRAWS draws that lies in [0, 6], else the last one, clipped.

    Rows without a finite magnitude and a positive finite redshift keep theirs, clipped.
    Bins are closed on the left; values outside belong to the nearest bin. Without ``tails``
    every draw is from the core.
    """
    require(df, [row_id, mag_i, redshift])
    i, z, key = F.col(mag_i), F.col(redshift), F.col(row_id)
    nearest = lambda v, edges: F.greatest(F.lit(1), F.least(F.lit(len(edges) - 1), digitize(v, list(edges))))
    binned = df.withColumns({"__m": nearest(i, model.mag_edges), "__z": nearest(z, model.z_edges)})
    m, zb = F.col("__m"), F.col("__z")
    binned = binned.withColumns(
        {
            "__mean": _look_up(model.bias, m, zb),
            "__sd": _look_up(model.sigma, m, zb),
            "__tail": _look_up(model.tail_share, m),
            "__loc": _look_up(model.tail_loc, m),
            "__scale": _look_up(model.tail_scale, m),
        }
    )
    tables = F.lit([list(skew_t_quantiles(a, b)) for a, b in zip(model.tail_a, model.tail_b, strict=True)])

    def candidate(k: Column) -> Column:
        stream = lambda kind: F.concat(F.lit(f"scatter.{kind}."), k.cast("string"))
        core = F.col("__mean") + F.col("__sd") * normal(key, seed, stream("core"))
        if not tails:
            return z + core
        u = uniform(key, seed, stream("tail")) * QUANTILES
        at, table = F.floor(u).cast("int") + 1, F.element_at(tables, m)
        low, high = F.element_at(table, at), F.element_at(table, at + 1)
        t = low + (high - low) * (u - F.floor(u))
        tail = uniform(key, seed, stream("kind")) < F.col("__tail")
        return z + F.when(tail, F.col("__loc") + F.col("__scale") * t).otherwise(core)

    lo, hi = Z_RANGE
    # Rounds of draws: most rows have their first draw in range, so later ones are made where it isn't.
    binned = binned.withColumn("__draw", candidate(F.lit(0)))
    inside = lambda c: (c >= lo) & (c <= hi)
    retries = F.transform(F.sequence(F.lit(1), F.lit(DRAWS - 1)), candidate)
    binned = binned.withColumn("__retry", F.when(~inside(F.col("__draw")), retries))
    found = F.get(F.filter("__retry", inside), F.lit(0))
    kept = F.when(inside(F.col("__draw")), F.col("__draw")).otherwise(
        F.coalesce(found, clip(F.element_at("__retry", -1), lo, hi))
    )
    valid = is_finite(i) & is_finite(z) & (z > 0)
    return binned.withColumn(out, F.when(valid, kept).otherwise(clip(z, lo, hi))).drop("__m", "__z", "__mean", "__sd", "__tail", "__loc", "__scale", "__draw", "__retry")

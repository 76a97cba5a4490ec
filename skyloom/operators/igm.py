"""Absorption by the intergalactic medium (Inoue et al. 2014), added to the two bluest bands.

Optical depths are tabulated on the driver over (wavelength, redshift); rows are evaluated
in Arrow batches, since a row's result is an integral over the whole filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import require

# Wavelength of the Lyman series' lines from 2 to 40, and coefficients of the
# forest (three) and of damped systems (two), table 2 of Inoue et al. (2014).
LINES = """
1215.67 1.690e-02 2.354e-03 1.026e-04 1.617e-04 5.390e-05
1025.72 4.692e-03 6.536e-04 2.849e-05 1.545e-04 5.151e-05
972.537 2.239e-03 3.119e-04 1.360e-05 1.498e-04 4.992e-05
949.743 1.319e-03 1.837e-04 8.010e-06 1.460e-04 4.868e-05
937.803 8.707e-04 1.213e-04 5.287e-06 1.429e-04 4.763e-05
930.748 6.178e-04 8.606e-05 3.752e-06 1.402e-04 4.672e-05
926.226 4.609e-04 6.421e-05 2.799e-06 1.377e-04 4.590e-05
923.150 3.569e-04 4.971e-05 2.167e-06 1.355e-04 4.516e-05
920.963 2.843e-04 3.960e-05 1.726e-06 1.335e-04 4.448e-05
919.352 2.318e-04 3.229e-05 1.407e-06 1.316e-04 4.385e-05
918.129 1.923e-04 2.679e-05 1.168e-06 1.298e-04 4.326e-05
917.181 1.622e-04 2.259e-05 9.847e-07 1.281e-04 4.271e-05
916.429 1.385e-04 1.929e-05 8.410e-07 1.265e-04 4.218e-05
915.824 1.196e-04 1.666e-05 7.263e-07 1.250e-04 4.168e-05
915.329 1.043e-04 1.453e-05 6.334e-07 1.236e-04 4.120e-05
914.919 9.174e-05 1.278e-05 5.571e-07 1.222e-04 4.075e-05
914.576 8.128e-05 1.132e-05 4.936e-07 1.209e-04 4.031e-05
914.286 7.251e-05 1.010e-05 4.403e-07 1.197e-04 3.989e-05
914.039 6.505e-05 9.062e-06 3.950e-07 1.185e-04 3.949e-05
913.826 5.868e-05 8.174e-06 3.563e-07 1.173e-04 3.910e-05
913.641 5.319e-05 7.409e-06 3.230e-07 1.162e-04 3.872e-05
913.480 4.843e-05 6.746e-06 2.941e-07 1.151e-04 3.836e-05
913.339 4.427e-05 6.167e-06 2.689e-07 1.140e-04 3.800e-05
913.215 4.063e-05 5.660e-06 2.467e-07 1.130e-04 3.766e-05
913.104 3.738e-05 5.207e-06 2.270e-07 1.120e-04 3.732e-05
913.006 3.454e-05 4.811e-06 2.097e-07 1.110e-04 3.700e-05
912.918 3.199e-05 4.456e-06 1.943e-07 1.101e-04 3.668e-05
912.839 2.971e-05 4.139e-06 1.804e-07 1.091e-04 3.637e-05
912.768 2.766e-05 3.853e-06 1.680e-07 1.082e-04 3.607e-05
912.703 2.582e-05 3.596e-06 1.568e-07 1.073e-04 3.578e-05
912.645 2.415e-05 3.364e-06 1.466e-07 1.065e-04 3.549e-05
912.592 2.263e-05 3.153e-06 1.375e-07 1.056e-04 3.521e-05
912.543 2.126e-05 2.961e-06 1.291e-07 1.048e-04 3.493e-05
912.499 2.000e-05 2.785e-06 1.214e-07 1.040e-04 3.466e-05
912.458 1.885e-05 2.625e-06 1.145e-07 1.032e-04 3.440e-05
912.420 1.779e-05 2.479e-06 1.080e-07 1.024e-04 3.414e-05
912.385 1.682e-05 2.343e-06 1.022e-07 1.017e-04 3.389e-05
912.353 1.593e-05 2.219e-06 9.673e-08 1.009e-04 3.364e-05
912.324 1.510e-05 2.103e-06 9.169e-08 1.002e-04 3.339e-05
"""
LYMAN_LIMIT = 911.8
_LINES = np.array([[float(x) for x in row.split()] for row in LINES.split("\n") if row])
# Powers of the scaled wavelength, and the breaks between them.
FOREST_POWERS, FOREST_BREAKS = (1.2, 3.7, 5.5), (2.2, 5.7)
DAMPED_POWERS, DAMPED_BREAKS = (2.0, 3.0), (3.0,)


def _powers(x: np.ndarray, coefficients: np.ndarray, powers: tuple, breaks: tuple) -> np.ndarray:
    """A x^p of every line, with A and p by the interval of x."""
    part = np.digitize(x, breaks)
    return coefficients[np.arange(len(_LINES))[None, :], part] * x ** np.asarray(powers)[part]


def _level(tau: np.ndarray) -> np.ndarray:
    """A continuum's depth doesn't fall towards short wavelengths: it stays at its largest value."""
    top = tau.argmax(axis=1)
    return np.where(np.arange(tau.shape[1])[None, :] < top[:, None], tau.max(axis=1, keepdims=True), tau)


class OpticalDepth:
    """tau at ascending observed wavelengths (Angstrom) for arrays of redshifts: (redshifts, wavelengths).

    A line adds a term that doesn't depend on the redshift, if its scaled wavelength x is
    between 1 and 1 + z. So terms are cumulated once in the order of x, and a redshift only
    looks its place up.
    """

    def __init__(self, wavelength: np.ndarray):
        w = np.asarray(wavelength, float)
        x = w[:, None] / _LINES[None, :, 0]
        terms = _powers(x, _LINES[:, 1:4], FOREST_POWERS, FOREST_BREAKS) + _powers(x, _LINES[:, 4:], DAMPED_POWERS, DAMPED_BREAKS)
        terms = np.where(x > 1, terms, 0.0)
        by = np.argsort(x, axis=1)
        self.x = np.take_along_axis(x, by, axis=1)
        self.sums = np.concatenate((np.zeros((len(w), 1)), np.cumsum(np.take_along_axis(terms, by, axis=1), axis=1)), axis=1)
        self.y = np.maximum(w / LYMAN_LIMIT, 1e-9)[None, :]
        self.above = self.y >= 1

    def __call__(self, z: np.ndarray) -> np.ndarray:
        z = np.atleast_1d(np.asarray(z, float))
        lines = np.stack([s[np.searchsorted(x, 1 + z, side="left")] for x, s in zip(self.x, self.sums, strict=True)], axis=1)
        return lines + _level(self._forest(z)) + _level(self._damped(z))

    def _pick(self, cases: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        conditions = [np.broadcast_arrays(c & self.above, v)[0] for c, v in cases]
        return np.select(conditions, [v for _, v in cases], 0.0)

    def _forest(self, z: np.ndarray) -> np.ndarray:
        y, s = self.y, 1 + z[:, None]
        low, high = s < 2.2, s >= 5.7
        mid = ~low & ~high
        a, b, c, d = y**1.2, y**2.1, y**3.7, y**5.5
        return self._pick(
            [
                (low & (y < s), 0.325 * (a - s**-0.9 * b)),
                (mid & (y < 2.2), 2.55e-2 * s**1.6 * b + 0.325 * a - 0.25 * b),
                (mid & (y < s), 2.55e-2 * (s**1.6 * b - c)),
                (high & (y < 2.2), 5.22e-4 * s**3.4 * b + 0.325 * a - 3.14e-2 * b),
                (high & (y < 5.7), 5.22e-4 * s**3.4 * b + 0.218 * b - 2.55e-2 * c),
                (high & (y < s), 5.22e-4 * (s**3.4 * b - d)),
            ]
        )

    def _damped(self, z: np.ndarray) -> np.ndarray:
        y, s = self.y, 1 + z[:, None]
        low = s < 3
        slow = y**-0.3
        common = 4.7e-2 * s**3 - 1.78e-2 * s**3.3 * slow
        return self._pick(
            [
                (low & (y < s), 0.211 * s**2 - 7.66e-2 * s**2.3 * slow - 0.135 * y**2),
                (~low & (y < 3), 0.634 + common - 0.135 * y**2 - 0.291 * slow),
                (~low & (y < s), common - 2.92e-2 * y**3),
            ]
        )


def optical_depth(wavelength: np.ndarray, z: float) -> np.ndarray:
    return OpticalDepth(wavelength)(np.array([z]))[0]


@dataclass(frozen=True)
class IGMConfig:
    """``filters`` maps the two bands to (wavelengths, transmissions) on one even grid."""

    filters: dict[str, tuple[np.ndarray, np.ndarray]]
    redshift: str = "redshift"
    uv_slope: bool = True
    interpolate: bool = True
    redshift_grid: tuple[float, float, int] = (1.5, 4.0, 100)
    #: Outside the grid: "inf" (no light is transmitted) or "exact".
    out_of_grid: str = "inf"

    def validate(self) -> IGMConfig:
        if len(self.filters) != 2:
            raise ValueError("two filters are needed")
        grids = [np.asarray(w, float) for w, _ in self.filters.values()]
        if len(grids[0]) != len(grids[1]) or not np.allclose(*grids):
            raise ValueError("both filters must have the same wavelengths")
        if self.out_of_grid not in ("inf", "exact"):
            raise ValueError("out_of_grid must be 'inf' or 'exact'")
        return self


def _mean_wavelength(w: np.ndarray, t: np.ndarray, beta: float = -2.0) -> float:
    return float(np.sum(w ** (beta + 2) * t) / np.sum(w ** (beta + 1) * t))


def magnitude_shift(w: np.ndarray, t: np.ndarray, transmission: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """-2.5 log10 of the transmitted share of a power-law spectrum; ``transmission`` is (rows, wavelengths)."""
    weight = np.exp((beta[:, None] + 1) * np.log(w)[None, :]) * t[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return -2.5 * np.log10((transmission * weight).sum(axis=1) / weight.sum(axis=1))


def igm_extinction(df: DataFrame, cfg: IGMConfig) -> DataFrame:
    """Add the absorption to both bands. A NaN or null redshift gives NaN."""
    cfg.validate()
    (band_u, (w, tu)), (band_g, (_, tg)) = cfg.filters.items()
    require(df, [cfg.redshift, band_u, band_g])
    w, tu, tg = (np.asarray(a, float) for a in (w, tu, tg))
    lo, hi, n = cfg.redshift_grid
    zs = np.linspace(lo, hi, n)
    depth = OpticalDepth(w)
    grid = np.exp(-depth(zs)) if cfg.interpolate else None
    ratio = -2.5 * np.log10(_mean_wavelength(w, tu) / _mean_wavelength(w, tg))

    def transmission(z: np.ndarray) -> np.ndarray:
        out = np.zeros((len(z), len(w)))
        inside = (z >= lo) & (z <= hi) if cfg.interpolate else np.zeros(len(z), bool)
        if inside.any():
            at = (z[inside] - lo) / (hi - lo) * (n - 1)
            i = np.clip(at.astype(int), 0, n - 2)
            f = (at - i)[:, None]
            out[inside] = grid[i] * (1 - f) + grid[i + 1] * f
        if not cfg.interpolate or cfg.out_of_grid == "exact":
            rest = ~inside & ~np.isnan(z)
            if rest.any():
                out[rest] = np.exp(-depth(z[rest]))
        out[np.isnan(z)] = np.nan
        return out

    @F.pandas_udf("u double, g double")
    def shifts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for z, u, g in batches:
            parts = []
            for a in range(0, len(z), 2048):  # bounds the (rows, wavelengths) arrays
                zz, uu, gg = (np.asarray(x.iloc[a : a + 2048], float) for x in (z, u, g))
                beta = (uu - gg) / ratio - 2 if cfg.uv_slope else np.full(len(zz), -2.0)
                t = transmission(zz)
                parts.append(pd.DataFrame({"u": magnitude_shift(w, tu, t, beta), "g": magnitude_shift(w, tg, t, beta)}))
            yield pd.concat(parts) if parts else pd.DataFrame({"u": [], "g": []}, dtype=float)

    d = df.withColumn("__shift", shifts(cfg.redshift, band_u, band_g))
    return d.withColumns({band_u: F.col(band_u) + F.col("__shift.u"), band_g: F.col(band_g) + F.col("__shift.g")}).drop("__shift")

"""Dust extinction: the law of Cardelli, Clayton and Mathis (1989), and effective wavelengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# R_V, and the published coefficients of a(x) and b(x), x in inverse microns.
R_V = 3.1
OPTICAL_A = (1.0, 0.17699, -0.50447, -0.02427, 0.72085, 0.01979, -0.77530, 0.32999)
OPTICAL_B = (0.0, 1.41338, 2.28305, 1.07233, -5.38434, -0.62251, 5.30260, -2.09002)
FAR_A = (-1.073, -0.628, 0.137, -0.070)
FAR_B = (13.670, 4.257, -0.420, 0.374)
# A / E(B-V) of the six optical bands.
A_OVER_EBV = {"u": 4.81, "g": 3.64, "r": 2.70, "i": 2.06, "z": 1.58, "y": 1.31}


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def ccm_a_over_ebv(wavelength: Column, strict: bool = True) -> Column:
    """A(wavelength) / E(B-V) for wavelengths in Angstrom.

    Outside 0.3 to 11 inverse microns the row fails, or gives null if not ``strict``.
    """
    x = F.lit(1.0) / (wavelength * 1.0e-4)
    infrared = F.pow(x, F.lit(1.61))
    y, far, bump = x - 1.82, x - 8.0, x - 5.9
    near_a = 1.752 - 0.316 * x - 0.104 / ((x - 4.67) * (x - 4.67) + 0.341)
    near_b = -3.090 + 1.825 * x + 1.206 / ((x - 4.62) * (x - 4.62) + 0.263)
    mid_a = near_a - 0.04473 * bump * bump - 0.009779 * bump * bump * bump
    mid_b = near_b + 0.2130 * bump * bump + 0.1207 * bump * bump * bump

    def law(a: Column, b: Column) -> Column:
        return R_V * a + b

    out = (
        F.when((x >= 0.3) & (x <= 1.1), law(0.574 * infrared, -0.527 * infrared))
        .when((x > 1.1) & (x <= 3.3), law(polynomial(y, OPTICAL_A), polynomial(y, OPTICAL_B)))
        .when((x > 3.3) & (x <= 5.9), law(near_a, near_b))
        .when((x > 5.9) & (x <= 8.0), law(mid_a, mid_b))
        .when((x > 8.0) & (x < 11.0), law(polynomial(far, FAR_A), polynomial(far, FAR_B)))
    )
    if not strict:
        return out
    error = F.raise_error(F.concat(F.lit("wavelength outside the model's range: "), wavelength.cast("string")))
    return F.when(out.isNull() & wavelength.isNotNull(), error.cast("double")).otherwise(out)


def lambda_effective(df: DataFrame, wavelength: str = "wavelength", transmission: str = "transmission", by: list[str] | None = None) -> DataFrame:
    """Transmission-weighted mean wavelength, of the table or of every group. A zero total gives null."""
    total = F.sum(F.col(transmission))
    mean = F.try_divide(F.sum(F.col(wavelength) * F.col(transmission)), total).alias("lambda_effective")
    return df.groupBy(*by).agg(mean) if by else df.agg(mean)


def lambda_effective_arrays(wavelength: Column, transmission: Column) -> Column:
    """The same for two array columns."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(total(F.zip_with(wavelength, transmission, lambda w, t: w * t)), total(transmission))

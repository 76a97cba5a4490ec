"""Semi-major and semi-minor axes from the shape columns that catalogs have.

Every function appends ``major`` and ``minor``. With ``to_arcsec`` both are multiplied by
the pixel scale.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import NAN, divide, require

ARCSEC_PER_PIX = 0.2


@dataclass(frozen=True)
class Axes:
    major: str = "major"
    minor: str = "minor"
    to_arcsec: bool = False
    arcsec_per_pix: float = ARCSEC_PER_PIX

    def append(self, df: DataFrame, a: Column, b: Column) -> DataFrame:
        k = float(self.arcsec_per_pix) if self.to_arcsec else None
        return df.withColumns({self.major: a * k if k else a, self.minor: b * k if k else b})


def axis_ratio(e: Column) -> Column:
    return (1.0 - e) / (1.0 + e)


def _size_axes(size: Column, e: Column) -> tuple[Column, Column]:
    minor = F.sqrt(size * size * axis_ratio(e))
    return divide(size * size, minor), minor


def major_ellipticity(df: DataFrame, size: str = "size", ellipticity: str = "ellipticity", axes: Axes = Axes()) -> DataFrame:
    """The size is the major axis."""
    require(df, [size, ellipticity])
    a = F.col(size).cast("double")
    return axes.append(df, a, a * axis_ratio(F.col(ellipticity)))


def size_ellipticity(df: DataFrame, size: str = "size", ellipticity: str = "ellipticity", axes: Axes = Axes()) -> DataFrame:
    """The size is the geometric mean of the axes. An ellipticity of 1 gives an infinite major axis."""
    require(df, [size, ellipticity])
    return axes.append(df, *_size_axes(F.col(size).cast("double"), F.col(ellipticity)))


def bulge_disk(
    df: DataFrame,
    bulge: str = "size_bulge_true",
    disk: str = "size_disk_true",
    ratio: str = "bulge_to_total_ratio",
    ellipticity: str = "ellipticity_true",
    axes: Axes = Axes(),
) -> DataFrame:
    """The size is that of bulge and disk, weighted by the bulge's share of light."""
    require(df, [bulge, disk, ratio, ellipticity])
    f = F.col(ratio)
    return axes.append(df, *_size_axes(F.col(bulge) * f + F.col(disk) * (1.0 - f), F.col(ellipticity)))


def moments(df: DataFrame, xx: str = "shape_xx", xy: str = "shape_xy", yy: str = "shape_yy", axes: Axes = Axes()) -> DataFrame:
    """Axes of the ellipse with these second moments; NaN where the moments belong to none."""
    require(df, [xx, xy, yy])
    x, m, y = F.col(xx), F.col(xy), F.col(yy)
    t = F.sqrt((x - y) * (x - y) + 4.0 * m * m)
    root = lambda c: F.when(c >= 0, F.sqrt(c)).otherwise(F.lit(NAN))
    return axes.append(df, root((x + y + t) / 2.0), root((x + y - t) / 2.0))

"""Synthetic lookup tables: success rates, maps and filters with plausible shapes.

They stand in for survey data, which this repository doesn't have, and are no survey's
measurements. Grids are ranges of ids with a formula, so no data is stored.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.selections import Rates


def falling(k: int, n: int, top: float = 0.95, bottom: float = 0.2) -> float:
    return round(top - (top - bottom) * (k / (n - 1)) ** 2, 6)


DEEP2 = [falling(k, 26) for k in range(26)]
VVDS_I = [falling(k, 14) for k in range(14)]
VVDS_BRIGHT = ([0.1 * k for k in range(12)], [round(0.9 - 0.02 * ((k - 4) ** 2) / 4, 6) for k in range(12)])
VVDS_DEEP = ([0.2 * k for k in range(20)], [falling(k, 20, 0.9, 0.3) for k in range(20)])
#: Shapes of the grids (rows iy, columns ix).
ZCOSMOS_SHAPE, HSC_SHAPE = (300, 238), (200, 200)
#: Rate of a cell, as SQL for both engines: a smooth fall towards faint and red cells.
GRID_RATE = "round(0.95 - 0.6 * (iy / {ny}.0) * (ix / {nx}.0) - 0.1 * (iy / {ny}.0), 6)"


def grid(spark: SparkSession, shape: tuple[int, int]) -> DataFrame:
    ny, nx = shape
    iy, ix = F.floor(F.col("id") / nx).cast("int"), (F.col("id") % nx).cast("int")
    y, x = iy.cast("double") / ny, ix.cast("double") / nx
    return spark.range(ny * nx).select(iy.alias("iy"), ix.alias("ix"), F.round(0.95 - 0.6 * y * x - 0.1 * y, 6).alias("rate"))


def rates(spark: SparkSession) -> Rates:
    return Rates(DEEP2, VVDS_I, VVDS_BRIGHT, VVDS_DEEP, grid(spark, ZCOSMOS_SHAPE), grid(spark, HSC_SHAPE))


def pixel_map(spark: SparkSession, nside: int, value: Column) -> DataFrame:
    """A full-sky map (pixel, value), the value a function of the column pixel."""
    return spark.range(12 * nside * nside).select(F.col("id").alias("pixel")).select("pixel", value.alias("value"))


def bump(lo: float, hi: float, center: float, width: float, n: int = 301) -> tuple[np.ndarray, np.ndarray]:
    """A bell-shaped filter on an even grid."""
    w = np.linspace(lo, hi, n)
    return w, np.exp(-((w - center) ** 2) / (2 * width**2))


FILTERS = {
    "u": bump(3000.0, 6000.0, 3700.0, 200.0),
    "g": bump(3000.0, 6000.0, 4800.0, 350.0),
}

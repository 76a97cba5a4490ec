"""Grid selection: per-cell acceptance ratios with exact numbers for every ratio."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.functions.binning import search_left_even
from skyloom.functions.draws import uniform
from skyloom.functions.numeric import require

#: Parts in which the rows of one ratio are ranked.
PARTS = 64


@dataclass(frozen=True)
class GridConfig:
    """x and y are a band, or a difference of two. ``ratios`` has iy, ix and ratio; ``reference`` mag, color and specz."""

    ratios: DataFrame
    n_y: int
    n_x: int
    x_band_1: str
    y_band_1: str
    x_limits: tuple[float, float]
    y_limits: tuple[float, float]
    x_band_2: str | None = None
    y_band_2: str | None = None
    reference: DataFrame | None = None
    redshift: str = "redshift"
    row_id: str = "row_id"
    color_redshift_cut: bool = True
    percentile_cut: float = 99.0
    redshift_cut: float = 100.0
    scaling_factor: float = 1.588
    seed: int = 12345
    drop_rows: bool = True

    def validate(self) -> GridConfig:
        if self.redshift_cut < 0:
            raise ValueError("redshift_cut must not be negative")
        if not 0 <= self.percentile_cut <= 100:
            raise ValueError("percentile_cut must be between 0 and 100")
        if self.color_redshift_cut and self.reference is None:
            raise ValueError("a cut by colour and redshift needs a reference sample")
        return self


def _value(a: str, b: str | None) -> Column:
    return F.col(a) - F.col(b) if b else F.col(a)


def _cell(v: Column, limits: tuple[float, float], n: int) -> Column:
    return search_left_even(v, limits[0], (limits[1] - limits[0]) / n, n + 1) - 1


def ratio_rank(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    """Add __rank (from 1) of every row among those of its __ratio, by keyed draws, and __n, their number.

    A few ratios can hold most rows, so the rows of a ratio are ranked in PARTS ranges of
    the draw, each shifted by the sizes of the ranges before. The shifts have at most
    (number of ratios x PARTS) rows, and the number of ratios is that of the grid's cells.
    """
    drawn = df.withColumn("__u", uniform(F.col(row_id), seed, "grid")).withColumn("__part", F.floor(F.col("__u") * PARTS).cast("int"))
    sizes = drawn.groupBy("__ratio", "__part").agg(F.count(F.lit(1)).alias("__size"))
    ratio = Window.partitionBy("__ratio")
    before = ratio.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "__ratio", "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__shift"), F.sum("__size").over(ratio).alias("__n")
    )
    inside = Window.partitionBy("__ratio", "__part").orderBy("__u", row_id)
    return (
        drawn.withColumn("__at", F.row_number().over(inside))
        .join(F.broadcast(shifts), ["__ratio", "__part"])
        .withColumn("__rank", F.col("__at") + F.col("__shift"))
    )


def grid_selection(df: DataFrame, cfg: GridConfig) -> DataFrame:
    """Rows kept by the ratio of their cell, under the cell's redshift limit.

    Rows outside the grid have ratio 0 and limit 99. Of the n rows of a ratio that pass
    the redshift cuts, n x ratio x factor are kept, at most n; a fraction adds one row when a
    draw of the ratio is at most the ratio. Rows at z <= 0 go last. Limits and ratios have
    the same axes.
    """
    cfg.validate()
    require(df, [cfg.row_id, cfg.redshift])
    x, y = _value(cfg.x_band_1, cfg.x_band_2), _value(cfg.y_band_1, cfg.y_band_2)
    placed = df.withColumns({"__ix": _cell(x, cfg.x_limits, cfg.n_x), "__iy": _cell(y, cfg.y_limits, cfg.n_y)})
    cells = cfg.ratios.select(F.col("iy").cast("int").alias("__iy"), F.col("ix").cast("int").alias("__ix"), F.col("ratio").alias("__ratio"))
    # The grid's size is fixed: n_y x n_x cells.
    placed = placed.join(F.broadcast(cells), ["__iy", "__ix"], "left")
    inside = F.col("__ratio").isNotNull()
    if cfg.color_redshift_cut:
        limits = (
            cfg.reference.select(
                _cell(F.col("mag"), cfg.x_limits, cfg.n_x).alias("__ix"), _cell(F.col("color"), cfg.y_limits, cfg.n_y).alias("__iy"), "specz"
            )
            .groupBy("__iy", "__ix")
            .agg(F.percentile("specz", cfg.percentile_cut / 100.0).alias("__max"))
        )
        placed = placed.join(F.broadcast(limits), ["__iy", "__ix"], "left")
        limit = F.when(inside, F.coalesce("__max", F.lit(0.0))).otherwise(99.0)
    else:
        limit = F.when(inside, 100.0).otherwise(99.0)
    z = F.col(cfg.redshift)
    under = ~F.isnan(z) & (z <= limit)
    if cfg.redshift_cut != 100:
        under = under & (z <= cfg.redshift_cut)
    cut = placed.withColumn("__ratio", F.coalesce("__ratio", F.lit(0.0))).where(F.coalesce(under, F.lit(False)))
    factor = cfg.scaling_factor if cfg.color_redshift_cut else 1.0
    ranked = ratio_rank(cut, cfg.row_id, cfg.seed)
    plain = F.col("__n") * F.col("__ratio")
    k = F.when(plain * factor <= F.col("__n"), plain * factor).otherwise(F.col("__n").cast("double"))
    extra = (F.floor(k) != k) & (uniform(F.round("__ratio", 12).cast("string"), cfg.seed, "grid.extra") <= F.col("__ratio"))
    number = F.floor(k) + extra.cast("int")
    kept = ranked.where((F.col("__rank") <= number) & (z > 0))
    if cfg.drop_rows:
        return kept.select(df.columns)
    flag = kept.select(cfg.row_id, F.lit(1).alias("flag"))
    return df.join(flag, cfg.row_id, "left").withColumn("flag", F.coalesce("flag", F.lit(0)))

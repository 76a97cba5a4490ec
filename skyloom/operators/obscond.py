"""Photometric errors under observing conditions that vary over the sky.

Maps are tables by ring pixel. They join once into a table of conditions, and the catalog
joins it on its pixel; every row then has its own depth. No loop over pixels.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.functions.draws import uniform
from skyloom.functions.dust import A_OVER_EBV
from skyloom.functions.sky import ang2pix_ring, check_nside, pixel_centers
from skyloom.operators.errors import ErrorParams, add_errors

SHARED = ("airmass", "tvis", "EBV")
BY_BAND = ("m5", "nVisYr", "gamma", "msky", "theta", "km")
OUTSIDE = -99
#: Pixels in a part of the sky when weights are cumulated: a map of 805 million pixels has 12,288 parts.
PART_PIXELS = 65_536

#: A map: a number for the whole footprint, or a table (pixel, value).
Map = float | DataFrame


@dataclass(frozen=True)
class ObsConditions:
    """``maps`` has a number or table for shared keys, and one for each band for the others."""

    mask: DataFrame
    maps: dict[str, Map | dict[str, Map]]
    nside: int = 128
    weight: DataFrame | None = None
    years: float | None = None
    total_visits: bool = True
    ra: str = "ra"
    dec: str = "dec"
    params: ErrorParams = field(default_factory=ErrorParams)
    seed: int = 42

    def validate(self) -> ObsConditions:
        check_nside(self.nside)
        if self.mask is None:
            raise ValueError("a mask is needed")
        if self.years is not None and not isinstance(self.years, float):
            raise TypeError("years must be a float")
        for key, value in self.maps.items():
            if key in SHARED:
                if not isinstance(value, (float, DataFrame)):
                    raise TypeError(f"{key} must be a float or a table")
            elif key in BY_BAND:
                if not isinstance(value, dict) or not value:
                    raise ValueError(f"{key} must have a map for at least one band")
                if any(not isinstance(v, (float, DataFrame)) for v in value.values()):
                    raise TypeError(f"{key} must have a float or a table for each band")
            else:
                raise ValueError(f"unknown condition {key}")
        return self


def footprint(cfg: ObsConditions) -> DataFrame:
    """Pixels of the mask: values above 0 (negative ones count as 0)."""
    return cfg.mask.where(~F.isnan(F.col("value").cast("double")) & (F.col("value") > 0)).select(F.col("pixel").cast("long").alias("pixel")).distinct()


def conditions(cfg: ObsConditions) -> DataFrame:
    """One row a pixel of the footprint, with a column for every condition: 12 nside^2 rows at most."""
    out = footprint(cfg)
    years = cfg.years if cfg.years is not None else 10.0
    for key, value in cfg.maps.items():
        for band, m in value.items() if isinstance(value, dict) else [("", value)]:
            name = f"__{key}_{band}"
            if isinstance(m, DataFrame):
                own = m.select(F.col("pixel").cast("long").alias("pixel"), F.col("value").cast("double").alias(name))
                out = out.join(own, "pixel", "left")
            else:
                out = out.withColumn(name, F.lit(m))
            if key == "nVisYr" and cfg.total_visits:
                out = out.withColumn(name, F.col(name) / years)
    return out


def assign_pixels(df: DataFrame, cfg: ObsConditions) -> DataFrame:
    """Add ``pixel``: that of the position, or -99 outside the footprint.

    Without positions, a pixel is drawn by weight, and ``ra`` and ``decl`` are its center. The
    table of cumulated weights has a row a pixel and stays a table: draws meet it through equal
    slices of [0, 1), and Spark decides by its size whether to broadcast it.
    """
    if cfg.ra in df.columns and cfg.dec in df.columns:
        inside = footprint(cfg).withColumn("__in", F.lit(True))
        placed = df.withColumn("pixel", F.coalesce(ang2pix_ring(F.col(cfg.ra), F.col(cfg.dec), cfg.nside), F.lit(OUTSIDE)))
        joined = placed.join(inside, "pixel", "left")
        return joined.select(*df.columns, F.when(F.col("__in"), F.col("pixel")).otherwise(F.lit(OUTSIDE)).cast("long").alias("pixel"))
    pixels = footprint(cfg)
    if cfg.weight is not None:
        own = cfg.weight.select(F.col("pixel").cast("long").alias("pixel"), F.col("value").cast("double").alias("w"))
        pixels = pixels.join(own, "pixel", "left").select("pixel", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    else:
        pixels = pixels.withColumn("w", F.lit(1.0))
    # Weights are cumulated in parts of the sky: inside a part by a window, and over the parts' sums.
    parts = pixels.withColumn("part", F.floor(F.col("pixel") / PART_PIXELS))
    sums = parts.groupBy("part").agg(F.sum("w").alias("own"), F.count(F.lit(1)).alias("n"))
    total = sums.agg(F.sum("own").alias("w"), F.sum("n").alias("n")).first()
    if not total["w"] or total["w"] <= 0:
        raise ValueError("no pixel of the footprint has a positive weight")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    last = F.lead("part").over(Window.orderBy("part")).isNull()
    shifts = sums.select(
        "part",
        F.coalesce(F.sum("own").over(before), F.lit(0.0)).alias("from"),
        F.when(last, F.lit(2.0 * total["w"])).otherwise(F.sum("own").over(upto)).alias("to"),
    )
    inside = Window.partitionBy("part").orderBy("pixel")
    start = F.col("from") + F.coalesce(F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = parts.where("w > 0").join(shifts, "part").withColumn("start", start)
    # Each pixel's share of [0, 1) goes up to the next one's, so shares leave no gap.
    stop = F.coalesce(F.lead("start").over(inside), F.col("to"))
    lon, lat = pixel_centers(F.col("pixel"), cfg.nside)
    shares = starts.withColumn("stop", stop).select(
        "pixel", (F.col("start") / total["w"]).alias("__lo"), (F.col("stop") / total["w"]).alias("__hi"), lon.alias("ra"), lat.alias("decl")
    )
    # About as many slices as pixels: a slice meets few pixels, however fine the map.
    slices = int(total["n"])
    spread = shares.withColumn(
        "__slice",
        F.explode(F.sequence(F.floor(F.col("__lo") * slices), F.least(F.floor(F.col("__hi") * slices), F.lit(slices - 1)))),
    )
    u = uniform(F.col(cfg.params.row_id), cfg.seed, "pixel")
    drawn = df.drop("ra", "decl").withColumn("__u", u).withColumn("__slice", F.floor(F.col("__u") * slices))
    own = [c for c in df.columns if c not in ("ra", "decl")]
    joined = drawn.join(spread, "__slice").where((F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi")))
    return joined.select(*own, "ra", "decl", "pixel")


def with_conditions(df: DataFrame, cfg: ObsConditions, noiseless: bool = False) -> DataFrame:
    """Reddened and noisy magnitudes by each row's conditions; default conditions outside the footprint.

    Without any map, the default model is used and no pixel is added.
    """
    cfg.validate()
    params = cfg.params if cfg.years is None else replace(cfg.params, years=cfg.years)
    if not cfg.maps:
        return add_errors(df, params, noiseless=noiseless)
    placed = assign_pixels(df, cfg)
    joined = placed.join(conditions(cfg), "pixel", "left")
    if "EBV" in cfg.maps:
        ebv = F.coalesce(F.col("__EBV_"), F.lit(0.0))
        joined = joined.withColumns({params.mag(b): F.col(params.mag(b)) + ebv * A_OVER_EBV[b] for b in params.bands if b in A_OVER_EBV})
    over: dict[str, dict] = {}
    for b in params.bands:
        default = {
            "gamma": params.gamma[b],
            "nVisYr": params.visits_per_year[b],
            "msky": params.msky.get(b, 0.0),
            "theta": params.theta[b],
            "km": params.km.get(b, 0.0),
            "airmass": params.airmass,
            "tvis": params.tvis,
        }
        own = over.setdefault(b, {})
        for key, value in cfg.maps.items():
            name = f"__{key}_{b}" if isinstance(value, dict) else f"__{key}_"
            if key == "EBV" or (isinstance(value, dict) and b not in value):
                continue
            c = F.col(name)
            own[key] = F.coalesce(c, F.lit(float(default[key]))) if key in default else c
    out = add_errors(joined, params, over, noiseless)
    errors = [f"{params.mag(b)}_err" for b in params.bands]
    return out.select(*placed.columns, *errors)

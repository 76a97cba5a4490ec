"""Photometric columns: flux and magnitude, hyperbolic magnitudes, reddening by a dust map."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.dust import A_OVER_EBV
from skyloom.functions.numeric import NAN, POGSON, divide, is_finite, log10, require
from skyloom.functions.sky import ang2pix_ring

BANDS = ("u", "g", "r", "i", "z", "y")


@dataclass(frozen=True)
class FluxColumns:
    """Names of the magnitude (or flux) and error columns of a catalog."""

    values: Sequence[str] = tuple(f"mag_{b}_lsst" for b in BANDS)
    errors: Sequence[str] = tuple(f"mag_err_{b}_lsst" for b in BANDS)
    zeropoints: Sequence[float] = ()
    is_flux: bool = False

    def validate(self) -> FluxColumns:
        if len(self.values) != len(self.errors):
            raise IndexError("there must be as many error columns as value columns")
        if self.zeropoints and len(self.zeropoints) != len(self.values):
            raise IndexError("there must be as many zeropoints as value columns")
        return self

    @property
    def zeros(self) -> Sequence[float]:
        return self.zeropoints or [0.0] * len(self.values)


def flux_of(mag: Column, zeropoint: float = 0.0) -> Column:
    return F.exp((F.lit(float(zeropoint)) - mag) / POGSON)


def flux_error_of(flux: Column, mag_error: Column) -> Column:
    return mag_error / POGSON * flux


def as_fluxes(df: DataFrame, cols: FluxColumns = FluxColumns(), keep: Sequence[str] = ()) -> DataFrame:
    """Value and error columns as fluxes: converted from magnitudes, or as they are."""
    cols.validate()
    require(df, [*cols.values, *cols.errors])
    out = [F.col(c) for c in keep]
    for v, e, zp in zip(cols.values, cols.errors, cols.zeros, strict=True):
        if cols.is_flux:
            out += [F.col(v), F.col(e)]
        else:
            flux = flux_of(F.col(v), zp)
            out += [flux.alias(v), flux_error_of(flux, F.col(e)).alias(e)]
    return df.select(*out)


def flux_to_mag(
    df: DataFrame,
    bands: Sequence[str] = BANDS,
    flux_name: str = "{band}_gaap1p0Flux",
    flux_err_name: str = "{band}_gaap1p0FluxErr",
    mag_name: str = "mag_{band}_lsst",
    mag_err_name: str = "mag_err_{band}_lsst",
    copy_cols: dict[str, str] | None = None,
    offset: float = 31.4,
) -> DataFrame:
    """Magnitudes of nJy fluxes, their errors, and copied columns (new name -> old name).

    A magnitude that isn't finite is NaN; its error is left as it comes out.
    """
    out = []
    for b in bands:
        flux, err = F.col(flux_name.format(band=b)), F.col(flux_err_name.format(band=b))
        mag = -2.5 * log10(flux) + offset
        out.append(F.when(is_finite(mag), mag).otherwise(F.lit(NAN)).alias(mag_name.format(band=b)))
        out.append(divide(err, flux * 0.4 * math.log(10)).alias(mag_err_name.format(band=b)))
    return df.select(*out, *[F.col(old).alias(new) for new, old in (copy_cols or {}).items()])


#: Parts that a range of values is counted in, and values that are put in order at last.
MEDIAN_PARTS, MEDIAN_ROWS = 4096, 20_000


def exact_medians(df: DataFrame, columns: Sequence[str]) -> list[float | None]:
    """Exact medians (of an even number: the mean of the middle two), without null and NaN; None without values.

    All columns are narrowed down together: their values are counted in equal parts of a range,
    then only the part with the middle is looked at, until it has few values. The driver gets
    MEDIAN_PARTS counts or MEDIAN_ROWS values a column, no task more than its share of rows.
    """
    value = lambda c: F.col(c).cast("double")
    big = F.lit(1.7976931348623157e308)  # infinite values count as the largest numbers while narrowing down
    inside = lambda c: F.greatest(F.least(value(c), big), -big)
    usable = lambda c: value(c).isNotNull() & ~F.isnan(value(c))
    stats = df.agg(
        *[f(F.when(usable(c), x)).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f, x in (("n", F.count, F.lit(1)), ("lo", F.min, inside(c)), ("hi", F.max, inside(c)))]
    ).first()
    # Of each column: the range that holds the middle, the values below it, and those in it.
    state = {k: [stats[f"lo{k}"], stats[f"hi{k}"], 0, stats[f"n{k}"]] for k in range(len(columns)) if stats[f"n{k}"]}
    out: list[float | None] = [None] * len(columns)

    def exploded(make) -> DataFrame:
        found = [F.when(usable(columns[k]) & inside(columns[k]).between(lo, hi), make(k, lo, hi)) for k, (lo, hi, _, _) in state.items()]
        return df.select(F.explode(F.array(*found)).alias("x")).where("x is not null").select("x.*")

    while state:
        for k, (lo, hi, _, _) in list(state.items()):
            if lo == hi:
                out[k] = float("inf") * math.copysign(1, lo) if abs(lo) == 1.7976931348623157e308 else lo
                del state[k]
        if not state:
            break
        if all(m <= MEDIAN_ROWS for _, _, _, m in state.values()):
            rows = exploded(lambda k, lo, hi: F.struct(F.lit(k).alias("k"), value(columns[k]).alias("v"))).toArrow()
            ks, vs = rows["k"].to_numpy(), rows["v"].to_numpy()
            for k, (_, _, below, _) in state.items():
                own, n = np.sort(vs[ks == k]), stats[f"n{k}"]
                out[k] = float((own[(n - 1) // 2 - below] + own[n // 2 - below]) / 2)
            break

        def part(k, lo, hi):
            at = F.floor((inside(columns[k]) / 2 - lo / 2) / (hi / 2 - lo / 2) * MEDIAN_PARTS)
            return F.struct(F.lit(k).alias("k"), F.least(at, F.lit(MEDIAN_PARTS - 1)).alias("p"), inside(columns[k]).alias("v"))

        counts = exploded(part).groupBy("k", "p").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for k, rows in groupby(counts.orderBy("k", "p").collect(), key=lambda r: r["k"]):
            n, (_, _, below, _), kept = stats[f"n{k}"], state[k], []
            for r in rows:
                # Of both middle ranks, parts from the first's to the second's stay.
                if not kept and below + r["m"] <= (n - 1) // 2:
                    below += r["m"]
                elif not kept or below + sum(x["m"] for x in kept) <= n // 2:
                    kept.append(r)
            state[k] = [kept[0]["lo"], kept[-1]["hi"], below, sum(x["m"] for x in kept)]
            if len(kept) == 2 and state[k][3] > MEDIAN_ROWS:
                # The middle lies between two parts: it is their nearest values' mean.
                out[k] = (kept[0]["hi"] + kept[1]["lo"]) / 2
                del state[k]
    return out


def hyperbolic_smoothing(df: DataFrame, cols: FluxColumns = FluxColumns()) -> DataFrame:
    """One row a band: filter, field (0), zeropoint, ref_flux, median_flux_error, b_relative, b_absolute.

    The softening b is the median flux error over the reference flux, times sqrt(Pogson's
    ratio) (Lupton et al. 1999). NaN errors are left out. The medians are found at once, in a
    few scans for all bands; the table that is returned holds them as values.
    """
    cols.validate()
    medians = exact_medians(as_fluxes(df, cols), cols.errors)
    rows = [(v, float(zp), m) for v, zp, m in zip(cols.values, cols.zeros, medians, strict=True)]
    table = df.sparkSession.createDataFrame(rows, "filter string, zeropoint double, median_flux_error double")
    ref = F.exp(F.col("zeropoint") / POGSON)
    b = math.sqrt(POGSON) * F.col("median_flux_error")
    return table.select(
        "filter",
        F.lit(0).alias("field"),
        "zeropoint",
        ref.alias("ref_flux"),
        "median_flux_error",
        (b / ref).alias("b_relative"),
        b.alias("b_absolute"),
    )


def hyperbolic_magnitudes(
    df: DataFrame, smoothing: DataFrame, cols: FluxColumns = FluxColumns(), keep: Sequence[str] = ()
) -> DataFrame:
    """Hyperbolic magnitudes and errors, named by mag_ -> mag_hyp_, with a smoothing table.

    The table has a row a band and field; of a band's fields, the median b is taken. It is
    pivoted into one row and broadcast: its size is the number of bands. A band that it lacks
    is an error when the plan runs; nothing runs before.
    """
    cols.validate()
    aggs = []
    for k, v in enumerate(cols.values):
        own = F.col("filter") == v
        aggs.append(F.percentile(F.when(own & ~F.isnan("b_relative"), F.col("b_relative")), 0.5).alias(f"__b{k}"))
        missing = F.raise_error(F.lit(f"no smoothing parameters for: {v}"))
        aggs.append(F.coalesce(F.max(F.when(own, F.col("ref_flux"))), missing.cast("double")).alias(f"__r{k}"))
    one = smoothing.agg(*aggs)
    require(df, [*cols.values, *cols.errors])
    flux = df.crossJoin(F.broadcast(one))  # one row
    steps, out = {}, [F.col(c) for c in keep]
    for k, (v, e, zp) in enumerate(zip(cols.values, cols.errors, cols.zeros, strict=True)):
        value = F.col(v) if cols.is_flux else flux_of(F.col(v), zp)
        error = F.col(e) if cols.is_flux else flux_error_of(value, F.col(e))
        b, ref = F.col(f"__b{k}"), F.col(f"__r{k}")
        steps |= {f"__x{k}": value / ref, f"__e{k}": error / ref}
        x, err = F.col(f"__x{k}"), F.col(f"__e{k}")
        out.append((-POGSON * (F.asinh(x / (2.0 * b)) + F.log(b))).alias(v.replace("mag_", "mag_hyp_")))
        out.append((POGSON * err / F.sqrt(x * x + 4.0 * b * b)).alias(e.replace("mag_", "mag_hyp_")))
    flux = flux.withColumns(steps)
    return flux.select(*out)


@dataclass(frozen=True)
class DustMap:
    """A sky map of E(B-V) by ring pixel; ``table`` has pixel and ebv."""

    table: DataFrame
    nside: int
    ra: str = "ra"
    dec: str = "dec"
    mags: dict[str, float] = field(default_factory=lambda: {f"mag_{b}_lsst": a for b, a in A_OVER_EBV.items()})
    copy_cols: Sequence[str] = ()
    copy_all_cols: bool = False


def apply_dust(df: DataFrame, dust: DustMap, sign: int) -> DataFrame:
    """m + sign x E(B-V) x A for every band; positions outside the map have no dust.

    The output has the magnitudes and the copied columns. The map joins on the pixel: it has
    12 nside^2 rows at most, and Spark broadcasts it only if that is small.
    """
    require(df, [dust.ra, dust.dec, *dust.mags])
    pixels = dust.table.select(F.col("pixel").cast("long").alias("__pixel"), F.col("ebv").alias("__ebv"))
    joined = df.withColumn("__pixel", ang2pix_ring(F.col(dust.ra), F.col(dust.dec), dust.nside)).join(pixels, "__pixel", "left")
    ebv = F.coalesce("__ebv", F.lit(0.0))
    new = {m: F.col(m) + sign * a * ebv for m, a in dust.mags.items()}
    if dust.copy_all_cols:
        return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])
    return joined.select(*[c.alias(m) for m, c in new.items()], *dust.copy_cols)


def redden(df: DataFrame, dust: DustMap) -> DataFrame:
    return apply_dust(df, dust, 1)


def deredden(df: DataFrame, dust: DustMap) -> DataFrame:
    return apply_dust(df, dust, -1)

"""Registered queries over the test tables, each with a SQL oracle where SQL can state it.

Every query runs over all rows of its table. Floating results are rounded to six decimals,
since engines differ in the last bits.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.dust import A_OVER_EBV, FAR_A, FAR_B, OPTICAL_A, OPTICAL_B, ccm_a_over_ebv, lambda_effective
from skyloom.functions.numeric import POGSON
from skyloom.functions.sky import ang2pix_ring
from skyloom.operators import blending, degraders, errors, grid, igm, obscond, photometry, scatter, selections, shapes
from skyloom.plans import pipelines
from skyloom.sources import catalogs, rates
from skyloom.sources.catalog_view import catalog, catalog_sql, draw_sql
from skyloom.sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
BANDS = "ugrizy"
MAGS = [f"mag_{b}_lsst" for b in BANDS]
ERRS = [f"mag_err_{b}_lsst" for b in BANDS]
PHOT = ["redshift", *MAGS]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return wrap


def rounded(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in columns])


def source(*columns: str) -> str:
    return f"({catalog_sql(columns=list(columns))})"


def r6(expr: str, name: str) -> str:
    return f'round({expr}, 6) AS "{name}"'


# --- sources and photometry ---

_SOURCE = list(catalogs.DEFAULT_QUANTITIES)


@query(
    "source_sample",
    f"SELECT {', '.join(r6(c, c) for c in _SOURCE)} FROM {source(*_SOURCE)} WHERE mag_i_lsst < 25.3 "
    f"ORDER BY {draw_sql('source', 42)}, row_id LIMIT 1000",
)
def source_sample(spark, d):
    out = catalogs.source_sample(catalog(spark, d, columns=_SOURCE), 1000, "row_id", filters=["mag_i_lsst < 25.3"])
    return rounded(out, *_SOURCE, keys=())


@query(
    "flux_to_mag",
    "SELECT row_id, "
    + ", ".join(
        f"CASE WHEN f_{b} > 0 THEN round(-2.5 * log10(f_{b}) + 31.4, 6) ELSE 'NaN'::DOUBLE END AS mag_{b}_lsst, "
        f"round(e_{b} / (f_{b} * 0.4 * {math.log(10)!r}), 6) AS mag_err_{b}_lsst"
        for b in "gi"
    )
    + f" FROM (SELECT row_id, 1000.0 * size + 1 AS f_g, 10.0 * ellipticity + 1 AS e_g, 500.0 * size - 600 AS f_i, 5.0 AS e_i FROM {source('size', 'ellipticity')})",
)
def flux_to_mag(spark, d):
    c = catalog(spark, d, columns=["size", "ellipticity"]).selectExpr(
        "row_id",
        "1000.0e0 * size + 1 g_gaap1p0Flux",
        "10.0e0 * ellipticity + 1 g_gaap1p0FluxErr",
        "500.0e0 * size - 600 i_gaap1p0Flux",
        "5.0e0 i_gaap1p0FluxErr",
    )
    out = photometry.flux_to_mag(c, "gi", copy_cols={"row_id": "row_id"})
    return rounded(out, "mag_g_lsst", "mag_err_g_lsst", "mag_i_lsst", "mag_err_i_lsst")


def _flux_sql(v: str, e: str) -> tuple[str, str]:
    f = f"exp((0.0 - {v}) / {POGSON!r}::DOUBLE)"
    return f, f"({e} / {POGSON!r}::DOUBLE * {f})"


@query(
    "as_fluxes",
    "SELECT row_id, "
    + ", ".join(
        f"round(1e9 * {_flux_sql(v, e)[0]}, 6) AS {v}, round(1e9 * {_flux_sql(v, e)[1]}, 6) AS {e}" for v, e in zip(MAGS, ERRS, strict=True)
    )
    + f" FROM {source(*MAGS, *ERRS)}",
)
def as_fluxes(spark, d):
    out = photometry.as_fluxes(catalog(spark, d, columns=[*MAGS, *ERRS]), keep=["row_id"])
    return out.select("row_id", *[F.round(F.lit(1e9) * F.col(c), 6).alias(c) for c in [*MAGS, *ERRS]])


def _smoothing_sql() -> str:
    parts = []
    for v, e in zip(MAGS, ERRS, strict=True):
        parts.append(
            f"SELECT '{v}' AS filter, CAST(0 AS INTEGER) AS field, 0.0::DOUBLE AS zeropoint, 1.0::DOUBLE AS ref_flux, "
            f"median({_flux_sql(v, e)[1]}) AS median_flux_error FROM cat"
        )
    return (
        f"WITH cat AS {source(*MAGS, *ERRS)}, p AS ({' UNION ALL '.join(parts)}) "
        f"SELECT *, {math.sqrt(POGSON)!r}::DOUBLE * median_flux_error AS b FROM p"
    )


@query(
    "hyperbolic_smoothing",
    "SELECT filter, field, zeropoint, ref_flux, round(1e12 * median_flux_error, 3) AS median_flux_error, round(1e12 * b, 3) AS b_relative, "
    f"round(1e12 * b, 3) AS b_absolute FROM ({_smoothing_sql()})",
)
def hyperbolic_smoothing(spark, d):
    out = photometry.hyperbolic_smoothing(catalog(spark, d, columns=[*MAGS, *ERRS]))
    small = ["median_flux_error", "b_relative", "b_absolute"]
    return out.select("filter", "field", "zeropoint", "ref_flux", *[F.round(F.lit(1e12) * F.col(c), 3).alias(c) for c in small])


def _hyperbolic_sql() -> str:
    cols = []
    for v, e in zip(MAGS, ERRS, strict=True):
        f, s = _flux_sql(v, e)
        b = f"(SELECT b FROM sm WHERE filter = '{v}')"
        cols.append(r6(f"-{POGSON!r}::DOUBLE * (asinh({f} / (2.0 * {b})) + ln({b}))", v.replace("mag_", "mag_hyp_")))
        cols.append(r6(f"{POGSON!r}::DOUBLE * {s} / sqrt({f} * {f} + 4.0 * {b} * {b})", e.replace("mag_", "mag_hyp_")))
    return f"WITH sm AS ({_smoothing_sql()}) SELECT row_id, {', '.join(cols)} FROM {source(*MAGS, *ERRS)}"


@query("hyperbolic_magnitudes", _hyperbolic_sql())
def hyperbolic_magnitudes(spark, d):
    c = catalog(spark, d, columns=[*MAGS, *ERRS])
    out = photometry.hyperbolic_magnitudes(c, photometry.hyperbolic_smoothing(c), keep=["row_id"])
    return rounded(out, *[m.replace("mag_", "mag_hyp_") for m in [*MAGS, *ERRS]])


# --- sky maps ---

NSIDE = 256
#: The pixels around the catalog's patch, so that maps stay small here.
PIXELS = (380_000, 406_000)
EBV = "0.02e0 + 0.001e0 * (pixel % 37)"


def sky_map(spark: SparkSession, value: str) -> DataFrame:
    return spark.range(*PIXELS).select(F.col("id").alias("pixel")).select("pixel", F.expr(value).alias("value"))


def pixel_sql(ra: str = "ra", dec: str = "dec", nside: int = NSIDE) -> str:
    """HEALPix ring pixels for the equatorial belt and the caps, in DuckDB."""
    n = float(nside)
    z = f"cos(pi() / 2 - radians({dec}))"
    tt = f"((radians({ra}) - 2 * pi() * floor(radians({ra}) / (2 * pi()))) / (pi() / 2))"
    jp, jm = f"floor({n} * (0.5 + {tt}) - {n} * {z} * 0.75)", f"floor({n} * (0.5 + {tt}) + {n} * {z} * 0.75)"
    ring = f"({nside} + 1 + {jp} - {jm})"
    k = f"(1 - ({ring})::BIGINT % 2)"
    ip = f"(floor(({jp} + {jm} - {nside} + {k} + 1) / 2)::BIGINT % {4 * nside})"
    belt = f"{2 * nside * (nside - 1)} + ({ring} - 1) * {4 * nside} + {ip}"
    t = f"({n} * sqrt(3.0 * (1.0 - abs({z}))))"
    tp = f"({tt} - floor({tt}))"
    cr = f"(floor({tp} * {t}) + floor((1.0 - {tp}) * {t}) + 1)"
    ci = f"(floor({tt} * {cr})::BIGINT % (4 * {cr})::BIGINT)"
    cap = f"CASE WHEN {z} > 0 THEN 2 * {cr} * ({cr} - 1) + {ci} ELSE {12 * nside * nside} - 2 * {cr} * ({cr} + 1) + {ci} END"
    return f"(CASE WHEN abs({z}) <= 2.0::DOUBLE / 3.0 THEN {belt} ELSE {cap} END)::BIGINT"


WIDE = "ra * 36.0e0 - 360.0e0 AS lon, dec * 449.0e0 AS lat"


@query(
    "healpix_assign",
    f"SELECT row_id, {pixel_sql('lon', 'lat')} AS pixel FROM (SELECT row_id, {WIDE} FROM {source('ra', 'dec')})",
)
def healpix_assign(spark, d):
    c = catalog(spark, d, columns=["ra", "dec"]).selectExpr("row_id", *WIDE.split(", "))
    return c.select("row_id", ang2pix_ring(F.col("lon"), F.col("lat"), NSIDE).alias("pixel"))


def dust_map(spark: SparkSession) -> photometry.DustMap:
    return photometry.DustMap(sky_map(spark, EBV).withColumnRenamed("value", "ebv"), NSIDE, copy_cols=("row_id",))


def dust_sql(inner: str, sign: str, mags: list[str] = MAGS) -> str:
    """A query with reddened magnitudes in the place of its own."""
    pixel = pixel_sql()
    ebv = f"(CASE WHEN pixel >= {PIXELS[0]} AND pixel < {PIXELS[1]} THEN {EBV} ELSE 0.0 END)"
    new = ", ".join(f"{m} {sign} {A_OVER_EBV[m[4]]}::DOUBLE * {ebv} AS {m}" for m in mags)
    return f"(SELECT * EXCLUDE (pixel) REPLACE ({new}) FROM (SELECT *, {pixel} AS pixel FROM {inner}))"


for _name, _sign, _f in (("redden", "+", photometry.redden), ("deredden", "-", photometry.deredden)):
    query(
        _name,
        f"SELECT row_id, {', '.join(r6(m, m) for m in MAGS)} FROM {dust_sql(source(*MAGS, 'ra', 'dec'), _sign)}",
    )(lambda spark, d, f=_f: rounded(f(catalog(spark, d, columns=[*MAGS, "ra", "dec"]), dust_map(spark)), *MAGS))


# --- shapes and dust law ---

_Q = "((1 - {e}) / (1 + {e}))"


def _shape(name: str, columns: list[str], major: str, minor: str, f: Callable[[DataFrame], DataFrame]) -> None:
    sql = f"SELECT row_id, {r6(major, 'major')}, {r6(minor, 'minor')} FROM {source(*columns)}"
    query(name, sql)(lambda spark, d: rounded(f(catalog(spark, d, columns=columns)), "major", "minor"))


_q = _Q.format(e="ellipticity")
_s = "(size_bulge_true * bulge_to_total_ratio + size_disk_true * (1 - bulge_to_total_ratio))"
_t = "sqrt((shape_xx - shape_yy) * (shape_xx - shape_yy) + 4 * shape_xy * shape_xy)"
_shape("major_ellip_ab", ["size", "ellipticity"], "0.2 * size", f"0.2 * size * {_q}", lambda c: shapes.major_ellipticity(c, axes=shapes.Axes(to_arcsec=True)))
_shape("size_ellip_ab", ["size", "ellipticity"], f"size * size / sqrt(size * size * {_q})", f"sqrt(size * size * {_q})", shapes.size_ellipticity)
_shape(
    "bulge_disk_ab",
    ["size_bulge_true", "size_disk_true", "bulge_to_total_ratio", "ellipticity"],
    f"{_s} * {_s} / sqrt({_s} * {_s} * {_q})",
    f"sqrt({_s} * {_s} * {_q})",
    lambda c: shapes.bulge_disk(c, ellipticity="ellipticity"),
)
_shape(
    "moments_ab",
    ["shape_xx", "shape_xy", "shape_yy"],
    f"sqrt((shape_xx + shape_yy + {_t}) / 2)",
    f"CASE WHEN shape_xx + shape_yy - {_t} >= 0 THEN sqrt((shape_xx + shape_yy - {_t}) / 2) ELSE 'NaN'::DOUBLE END",
    shapes.moments,
)


def _poly(y: str, c: tuple[float, ...]) -> str:
    return "(" + " + ".join(f"({a!r}::DOUBLE) * pow({y}, {i})" for i, a in enumerate(c)) + ")"


_na = "(1.752 - 0.316 * x - 0.104 / (pow(x - 4.67, 2) + 0.341))"
_nb = "(-3.090 + 1.825 * x + 1.206 / (pow(x - 4.62, 2) + 0.263))"


@query(
    "ccm_extinction",
    "SELECT row_id, round(CASE WHEN x >= 0.3 AND x <= 1.1 THEN 3.1 * 0.574 * pow(x, 1.61) - 0.527 * pow(x, 1.61) "
    f"WHEN x <= 3.3 THEN 3.1 * {_poly('(x - 1.82)', OPTICAL_A)} + {_poly('(x - 1.82)', OPTICAL_B)} "
    f"WHEN x <= 5.9 THEN 3.1 * {_na} + {_nb} "
    f"WHEN x <= 8.0 THEN 3.1 * ({_na} - 0.04473 * pow(x - 5.9, 2) - 0.009779 * pow(x - 5.9, 3)) + {_nb} + 0.2130 * pow(x - 5.9, 2) + 0.1207 * pow(x - 5.9, 3) "
    f"ELSE 3.1 * {_poly('(x - 8.0)', FAR_A)} + {_poly('(x - 8.0)', FAR_B)} END, 6) AS a_over_ebv "
    f"FROM (SELECT row_id, 1.0::DOUBLE / ((950.0 + 10500.0 * redshift) * 1.0e-4::DOUBLE) AS x FROM {source('redshift')})",
)
def ccm_extinction(spark, d):
    c = catalog(spark, d, columns=["redshift"])
    return c.select("row_id", F.round(ccm_a_over_ebv(950.0 + 10500.0 * F.col("redshift")), 6).alias("a_over_ebv"))


@query(
    "lambda_effective",
    "SELECT l_returnflag AS curve, round(sum((l_quantity * 100 + 3000) * l_discount) / sum(l_discount), 6) AS lambda_effective "
    "FROM lineitem GROUP BY l_returnflag",
)
def lambda_effective_query(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_returnflag").alias("curve"), (F.col("l_quantity") * 100 + 3000).alias("wavelength"), F.col("l_discount").alias("transmission")
    )
    return lambda_effective(t, by=["curve"]).select("curve", F.round("lambda_effective", 6).alias("lambda_effective"))


@query(
    "lambda_effective_file",
    "SELECT round(sum((3000.0::DOUBLE + p_partkey) * p_size) / sum(p_size), 6) AS lambda_effective FROM part",
)
def lambda_effective_file(spark, d):
    """The curve goes through a filter file: a text table with a comment, written to the shared folder."""
    path = f"{shared_dir(spark)}/filter-{uuid.uuid4().hex}"
    t = spark.read.parquet(f"{d}/part.parquet")
    lines = t.select(F.concat_ws("  ", (3000.0 + F.col("p_partkey")).cast("string"), F.col("p_size").cast("string"), F.lit("# part")).alias("value"))
    lines.write.text(path)
    return lambda_effective(catalogs.filter_curve(spark, path)).select(F.round("lambda_effective", 6).alias("lambda_effective"))


# --- selections ---

g, r, i, z = "mag_g_lsst", "mag_r_lsst", "mag_i_lsst", "mag_z_lsst"
_br, _ri = f"({g} + 0.35 * ({g} - {r}) - ({r} - 0.30 * ({r} - {i})))", f"({r} - 0.30 * ({r} - {i}) - ({i} - 0.50 * ({r} - {i})))"
_rr = f"({r} - 0.30 * ({r} - {i}))"
_cp = f"(0.7 * ({g} - {r}) + 1.2 * ({r} - {i} - 0.18))"
_dr = f"({r} - {i} - ({g} - {r}) / 8.0)"
_deep2_rate = selections.deep2_curve(selections.Rates(deep2=rates.DEEP2)).sql(r)
_v = selections.vvds_curves(selections.Rates(vvds_i=rates.VVDS_I, vvds_bright=rates.VVDS_BRIGHT, vvds_deep=rates.VVDS_DEEP))
GAMA_SQL, BGS_SQL = f"{r} < 19.87", f"{r} < 19.5"
BOSS_SQL = (
    f"(({r} > 16 AND {r} < 20 AND abs({r} - {i} - ({g} - {r}) / 4.0 - 0.18) < 0.2 AND {r} < 13.35 + {_cp} / 0.3) OR "
    f"({i} > 17.5 AND {i} < 20.1 AND {_dr} > 0.55 AND {i} < 19.98 + 1.6 * ({_dr} - 0.7) AND {r} - {i} < 2))"
)


def grid_rate_sql(y: str, x: str, y_edges: tuple, x_edges: tuple, shape: tuple[int, int]) -> tuple[str, str, str]:
    """Bins of both values and the cell's rate; bins count the edges below a value."""
    iy = f"(len(list_filter(range(0, {y_edges[2]}), lambda k: {y_edges[0]!r}::DOUBLE + k * {y_edges[1]!r}::DOUBLE < {y})) - 1)"
    ix = f"(len(list_filter(range(0, {x_edges[2]}), lambda k: {x_edges[0]!r}::DOUBLE + k * {x_edges[1]!r}::DOUBLE < {x})) - 1)"
    ny, nx = shape
    rate = (
        f"CASE WHEN iy >= 0 AND iy < {ny} AND ix >= 0 AND ix < {nx} THEN "
        f"round(0.95::DOUBLE - 0.6::DOUBLE * (iy::DOUBLE / {ny}) * (ix::DOUBLE / {nx}) - 0.1::DOUBLE * (iy::DOUBLE / {ny}), 6) ELSE 0.0 END"
    )
    return iy, ix, rate


def _binned(y: str, x: str, ye: tuple, xe: tuple, shape: tuple[int, int]) -> str:
    iy, ix, rate = grid_rate_sql(y, x, ye, xe, shape)
    return f"(SELECT *, {rate} AS rate FROM (SELECT *, {iy} AS iy, {ix} AS ix FROM {source(*PHOT)}))"


_ZC = _binned(i, "redshift", selections.ZCOSMOS_I, selections.ZCOSMOS_Z, rates.ZCOSMOS_SHAPE)
_HSC = _binned(i, f"({g} - {z})", selections.even_edges(selections.HSC_I), selections.even_edges(selections.HSC_GZ), rates.HSC_SHAPE)
_HSC_CUT = f"{i} > 13 AND {i} < 26 AND {g} - {z} > -2 AND {g} - {z} < 6 AND {draw_sql('hsc', 42)} <= rate"
SPEC = {
    "spec_gama": ("GAMA", source(*PHOT), GAMA_SQL),
    "spec_boss": ("BOSS", source(*PHOT), BOSS_SQL),
    "spec_deep2": (
        "DEEP2",
        source(*PHOT),
        f"{r} > 18.5 AND {r} < 24.1 AND ({g} - {r} < 2.45 * ({r} - {i}) - 0.2976 OR {r} - {i} > 1.1 OR {g} - {r} < 0.5) "
        f"AND {draw_sql('deep2', 42)} < {_deep2_rate}",
    ),
    "spec_deep2_lsst": (
        "DEEP2_LSST",
        source(*PHOT),
        f"{_rr} > 18.5 AND {_rr} < 24.1 AND ({_br} < 2.45 * {_ri} - 0.2976 OR {_ri} > 1.1 OR {_br} < 0.33) AND {draw_sql('deep2', 42)} < {_deep2_rate}",
    ),
    "spec_vvds": (
        "VVDSf02",
        source(*PHOT),
        f"{i} > 17.5 AND {i} < 24.0 AND {draw_sql('vvds.i', 42)} < {_v[0].sql(i)} AND {draw_sql('vvds.z', 42)} < "
        f"CASE WHEN {i} <= 22.5 THEN {_v[1].sql('redshift')} ELSE {_v[2].sql('redshift')} END",
    ),
    "spec_zcosmos": ("zCOSMOS", _ZC, f"{i} > 15.0 AND {i} < 22.5 AND {draw_sql('zcosmos', 42)} <= rate"),
    "spec_hsc": ("HSC", _HSC, _HSC_CUT),
    "spec_desi_lrg": (
        "DESI_LRG",
        source(*PHOT, "W1"),
        f"{z} < 21.60 AND {z} - W1 > 0.8 * ({r} - {z}) - 0.6 AND ({g} - W1 > 2.9 OR {r} - W1 > 1.8) AND "
        f"(({r} - W1 > 1.8 * (W1 - 17.14) AND {r} - W1 > W1 - 16.33) OR {r} - W1 > 3.3)",
    ),
    "spec_desi_elg_lop": (
        "DESI_ELG_LOP",
        source(*PHOT),
        f"{g} > 20 AND {g} < 24.1 AND {r} - {z} > 0.15 AND {g} - {r} < 0.5 * ({r} - {z}) + 0.1 AND {g} - {r} < -1.2 * ({r} - {z}) + 1.3",
    ),
    "spec_desi_bgs": ("DESI_BGS", source(*PHOT), BGS_SQL),
}


def spec_config(spark: SparkSession, **more) -> selections.SpecConfig:
    return selections.SpecConfig(downsample=False, rates=rates.rates(spark), **more)


def spec_catalog(spark: SparkSession, d: str, survey: str) -> DataFrame:
    return catalog(spark, d, columns=[*PHOT, "W1"] if survey == "DESI_LRG" else PHOT)


for _name, (_survey, _from, _where) in SPEC.items():
    query(_name, f"SELECT row_id, {r6('redshift', 'redshift')}, {r6(i, i)} FROM {_from} WHERE {_where}")(
        lambda spark, d, s=_survey: rounded(selections.select(spec_catalog(spark, d, s), s, spec_config(spark)), "redshift", i)
    )


@query(
    "spec_hsc_percentile",
    f"WITH b AS {_HSC}, c AS (SELECT iy, ix, quantile_cont(redshift, 0.7) AS top FROM b GROUP BY iy, ix) "
    f"SELECT row_id, {r6('redshift', 'redshift')} FROM b JOIN c USING (iy, ix) WHERE {_HSC_CUT} AND redshift <= top",
)
def spec_hsc_percentile(spark, d):
    out = selections.select(spec_catalog(spark, d, "HSC"), "HSC", spec_config(spark, percentile_cut=70.0))
    return rounded(out, "redshift")


@query(
    "spec_downsample",
    f"SELECT row_id, {r6('redshift', 'redshift')} FROM {source(*PHOT)} WHERE {GAMA_SQL} ORDER BY {draw_sql('downsample', 42)}, row_id LIMIT 200",
)
def spec_downsample(spark, d):
    cfg = selections.SpecConfig(n_tot=200)
    return rounded(selections.select(spec_catalog(spark, d, "GAMA"), "GAMA", cfg), "redshift")


@query("spec_flag_mode", f"SELECT row_id, CAST({BOSS_SQL} AS INTEGER) AS flag FROM {source(*PHOT)}")
def spec_flag_mode(spark, d):
    return selections.select(spec_catalog(spark, d, "BOSS"), "BOSS", spec_config(spark, drop_rows=False)).select("row_id", "flag")


@query(
    "desi_phy",
    f"SELECT row_id, {r6('redshift', 'redshift')}, {r6('log_mass', 'log_mass')} FROM {source('redshift', 'log_mass')} "
    "WHERE log_mass > CASE WHEN redshift < 1 THEN 11 + 2 * redshift ELSE 13 - 0.5 * (redshift - 1) END",
)
def desi_phy(spark, d):
    table = spark.createDataFrame([(0.0, 11.0), (1.0, 13.0), (2.0, 12.5)], "z double, thresh double")
    cfg = selections.PhysicalThreshold.from_table(table, "log_mass")
    return rounded(selections.desi_physical(catalog(spark, d, columns=["redshift", "log_mass"]), cfg), "redshift", "log_mass")


@query(
    "inv_redshift",
    f"SELECT row_id, {r6('redshift', 'redshift')} FROM {source('redshift')} "
    f"WHERE redshift = 0 OR {draw_sql('inv_redshift', 42)} <= least(1.0::DOUBLE, 0.8::DOUBLE / redshift)",
)
def inv_redshift(spark, d):
    return rounded(degraders.inv_redshift_incompleteness(catalog(spark, d, columns=["redshift"]), 0.8, "row_id"), "redshift")


@query(
    "line_confusion",
    f"WITH c AS {source('redshift')}, w AS (SELECT row_id FROM c WHERE redshift > 5007.0::DOUBLE / 3727.0 - 1 "
    f"ORDER BY {draw_sql('line_confusion', 42)}, row_id LIMIT (SELECT CAST(floor(0.05 * count(*)) AS BIGINT) FROM c)) "
    "SELECT row_id, round(CASE WHEN row_id IN (SELECT row_id FROM w) THEN (1 + redshift) * 3727.0::DOUBLE / 5007.0 - 1 ELSE redshift END, 6) AS redshift FROM c",
)
def line_confusion(spark, d):
    out = degraders.line_confusion(catalog(spark, d, columns=["redshift"]), 3727.0, 5007.0, 0.05, "row_id", "redshift")
    return rounded(out, "redshift")


# --- grid selection ---

_NY = _NX = 20
_XL, _YL = (16.0, 26.0), (-1.0, 4.0)
_gz = f"({g} - {z})"


def _cell_sql(v: str, limits: tuple[float, float], n: int) -> str:
    return f"(len(list_filter(range(0, {n + 1}), lambda k: {limits[0]!r}::DOUBLE + k * {(limits[1] - limits[0]) / n!r}::DOUBLE < {v})) - 1)"


_GRID_COLS = ["redshift", g, i, z]
_GRID_SQL = f"""
WITH c AS (SELECT *, {_cell_sql(i, _XL, _NX)} AS ix, {_cell_sql(_gz, _YL, _NY)} AS iy FROM {source(*_GRID_COLS)}),
ref AS (SELECT *, {_cell_sql(i, _XL, _NX)} AS ix, {_cell_sql(_gz, _YL, _NY)} AS iy FROM ({catalog_sql("customer", "c_custkey", _GRID_COLS)})),
top AS (SELECT iy, ix, quantile_cont(redshift, 0.99) AS top FROM ref GROUP BY iy, ix),
p AS (SELECT c.*, CASE WHEN c.ix BETWEEN 0 AND {_NX - 1} AND c.iy BETWEEN 0 AND {_NY - 1} THEN (1 + (c.iy + c.ix) % 5) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS ratio,
  CASE WHEN c.ix BETWEEN 0 AND {_NX - 1} AND c.iy BETWEEN 0 AND {_NY - 1} THEN coalesce(top, 0.0) ELSE 99.0 END AS lim
  FROM c LEFT JOIN top ON c.iy = top.iy AND c.ix = top.ix),
k AS (SELECT *, {draw_sql("grid", 12345)} AS u FROM p WHERE redshift <= lim),
n AS (SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY u, row_id) AS rk, count(*) OVER (PARTITION BY ratio) AS n FROM k),
m AS (SELECT *, CASE WHEN n * ratio * 1.588::DOUBLE <= n THEN n * ratio * 1.588::DOUBLE ELSE n::DOUBLE END AS keep FROM n)
SELECT row_id, round(redshift, 6) AS redshift FROM m WHERE redshift > 0 AND rk <= floor(keep) + CASE WHEN floor(keep) <> keep
  AND {draw_sql("grid.extra", 12345, "round(ratio, 12)")} <= ratio THEN 1 ELSE 0 END
"""


@query("grid_selection", _GRID_SQL)
def grid_selection(spark, d):
    ratios = spark.range(_NY * _NX).selectExpr(
        f"cast(id div {_NX} as int) iy", f"cast(id % {_NX} as int) ix", f"(1 + (id div {_NX} + id % {_NX}) % 5) / 10.0e0 ratio"
    )
    ref = catalog(spark, d, "customer", "c_custkey", _GRID_COLS)
    cfg = grid.GridConfig(
        ratios,
        _NY,
        _NX,
        i,
        g,
        _XL,
        _YL,
        y_band_2=z,
        reference=ref.select(F.col(i).alias("mag"), (F.col(g) - F.col(z)).alias("color"), F.col("redshift").alias("specz")),
    )
    return rounded(grid.grid_selection(catalog(spark, d, columns=_GRID_COLS), cfg), "redshift")


# --- noise ---


def normal_sql(stream: str, seed: int) -> str:
    u1 = f"greatest({draw_sql(stream, seed)}, {2.0**-33!r}::DOUBLE)"
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r}::DOUBLE * {draw_sql(stream, seed, first=9)}))"


def depth_of(p: errors.ErrorParams, b: str) -> float:
    if b in p.m5:
        one = p.m5[b]
    else:
        one = p.cm[b] + 0.5 * (p.msky[b] - 21.0) + 2.5 * math.log10(0.7 / p.theta[b]) + 1.25 * math.log10(p.tvis / 30.0) - p.km[b] * (p.airmass - 1.0)
    return one + 1.25 * math.log10(p.visits_per_year[b] * p.years)


def errors_sql(inner: str, p: errors.ErrorParams, depths: dict[str, str] | None = None, noise: bool = True) -> str:
    """A query with noisy magnitudes in the place of its own, and their errors."""
    floor = math.pow(10.0, p.sigma_sys / 2.5) - 1.0

    def nsr(m: str, b: str) -> str:
        depth = (depths or {}).get(b, f"{depth_of(p, b)!r}::DOUBLE")
        x = f"pow(10.0::DOUBLE, 0.4::DOUBLE * ({m} - ({depth})))"
        return f"sqrt((0.04::DOUBLE - {p.gamma[b]!r}::DOUBLE) * {x} + {p.gamma[b]!r}::DOUBLE * {x} * {x} + {floor * floor!r}::DOUBLE)"

    out = inner
    if noise:
        seen = ", ".join(f"1.0::DOUBLE + {nsr(p.mag(b), b)} * {normal_sql('err.' + p.mag(b), p.seed)} AS seen_{k}" for k, b in enumerate(p.bands))
        new = ", ".join(
            f"CASE WHEN seen_{k} > 0 THEN {p.mag(b)} - 2.5::DOUBLE * log10(seen_{k}) ELSE 'inf'::DOUBLE END AS {p.mag(b)}" for k, b in enumerate(p.bands)
        )
        drop = ", ".join(f"seen_{k}" for k in range(len(p.bands)))
        out = f"(SELECT * EXCLUDE ({drop}) REPLACE ({new}) FROM (SELECT *, {seen} FROM {inner}))"
    err = ", ".join(
        f"CASE WHEN isinf({p.mag(b)}) THEN 'inf'::DOUBLE ELSE 2.5::DOUBLE * log10(1.0::DOUBLE + {nsr(p.mag(b), b)}) END AS {p.mag(b)}_err" for b in p.bands
    )
    return f"(SELECT *, {err} FROM {out})"


RENAME = {b: f"mag_{b}_lsst" for b in BANDS}
#: Bands of other missions are put on the catalog's columns.
ERROR_QUERIES = {
    "err_lsst": ("LSSTErrorModel", RENAME),
    **{
        f"err_{q}": (f"{c}ErrorModel", dict(zip(errors.PRESETS[f"{c}ErrorModel"].bands, ("mag_r_lsst", "mag_i_lsst", "mag_z_lsst", "mag_y_lsst"), strict=False)))
        for q, c in (
            ("roman", "Roman"),
            ("roman_wide", "RomanWide"),
            ("roman_medium", "RomanMedium"),
            ("roman_deep", "RomanDeep"),
            ("roman_ultradeep", "RomanUltraDeep"),
            ("euclid", "Euclid"),
            ("euclid_wide", "EuclidWide"),
            ("euclid_deep", "EuclidDeep"),
        )
    },
}


def _error_query(name: str, model: str, rename: dict[str, str]) -> None:
    p = errors.preset(model, rename=rename)
    cols = [p.mag(b) for b in p.bands]
    shown = cols + [f"{c}_err" for c in cols]
    query(name, f"SELECT row_id, {', '.join(r6(c, c) for c in shown)} FROM {errors_sql(source(*cols), p)}")(
        lambda spark, d: rounded(errors.add_errors(catalog(spark, d, columns=cols), p), *shown)
    )


for _name, (_model, _rename) in ERROR_QUERIES.items():
    _error_query(_name, _model, _rename)

_LSST = errors.preset("LSSTErrorModel", rename=RENAME)
_ERR_COLS = MAGS + [f"{m}_err" for m in MAGS]
M5_MAP, MASK_MAP = "23.0e0 + 0.01e0 * (pixel % 50)", "cast(pixel % 5 as double)"


def obs_conditions(spark: SparkSession) -> obscond.ObsConditions:
    return obscond.ObsConditions(
        mask=sky_map(spark, MASK_MAP),
        maps={"m5": {"i": sky_map(spark, M5_MAP)}, "EBV": sky_map(spark, EBV)},
        nside=NSIDE,
        weight=sky_map(spark, "1.0e0 + pixel % 3"),
        params=_LSST,
    )


def obs_sql(inner: str) -> str:
    """Reddening and depth by pixel inside the footprint; a query with pixel -99 outside."""
    placed = f"(SELECT *, {pixel_sql()} AS p0 FROM {inner})"
    placed = f"(SELECT * EXCLUDE (p0), CASE WHEN p0 >= {PIXELS[0]} AND p0 < {PIXELS[1]} AND p0 % 5 > 0 THEN p0 ELSE -99 END AS pixel FROM {placed})"
    new = ", ".join(f"{m} + CASE WHEN pixel = -99 THEN 0.0 ELSE {EBV} END * {A_OVER_EBV[m[4]]}::DOUBLE AS {m}" for m in MAGS)
    visits = 1.25 * math.log10(_LSST.visits_per_year["i"] * _LSST.years)
    depth = f"CASE WHEN pixel = -99 THEN {depth_of(_LSST, 'i')!r}::DOUBLE ELSE {M5_MAP} + {visits!r}::DOUBLE END"
    return errors_sql(f"(SELECT * REPLACE ({new}) FROM {placed})", _LSST, {"i": depth})


@query(
    "obs_condition",
    f"SELECT row_id, CAST(pixel AS BIGINT) AS pixel, {', '.join(r6(c, c) for c in _ERR_COLS)} FROM {obs_sql(source(*MAGS, 'ra', 'dec'))}",
)
def obs_condition(spark, d):
    out = obscond.with_conditions(catalog(spark, d, columns=[*MAGS, "ra", "dec"]), obs_conditions(spark))
    return rounded(out, *_ERR_COLS, keys=("row_id", "pixel"))


@query(
    "obs_condition_weighted",
    f"WITH m AS (SELECT pixel, 1.0::DOUBLE + pixel % 3 AS w FROM range({PIXELS[0]}, {PIXELS[1]}) t(pixel) WHERE pixel % 5 > 0), "
    "k AS (SELECT pixel, (sum(w) OVER (ORDER BY pixel)) / (SELECT sum(w) FROM m) AS hi, w / (SELECT sum(w) FROM m) AS share FROM m), "
    "e AS (SELECT pixel, coalesce(lag(hi) OVER (ORDER BY pixel), 0.0) AS lo FROM k) "
    f"SELECT c.row_id, e.pixel FROM (SELECT row_id, {draw_sql('pixel', 42)} AS u FROM {source('mag_i_lsst')}) c ASOF JOIN e ON c.u >= e.lo",
)
def obs_condition_weighted(spark, d):
    out = obscond.assign_pixels(catalog(spark, d, columns=["mag_i_lsst"]), obs_conditions(spark))
    return out.select("row_id", "pixel")


def _digit(v: str, edges: tuple) -> str:
    inner = " ".join(f"WHEN {v} < {e!r} THEN {k}" for k, e in enumerate(edges[1:-1], 1))
    return f"(CASE {inner} ELSE {len(edges) - 1} END)"


def _scatter_sql() -> str:
    m = scatter.KHOSTOVAN26
    table = lambda t: "[" + ", ".join("[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in row) + "]" for row in t) + "]"
    base = (
        f"(SELECT row_id, redshift, {table(m.bias)}[mb][zb] AS mean, {table(m.sigma)}[mb][zb] AS sd FROM "
        f"(SELECT *, {_digit(i, m.mag_edges)} AS mb, {_digit('redshift', m.z_edges)} AS zb FROM {source('redshift', i)}))"
    )
    draws = [f"redshift + mean + sd * {normal_sql(f'scatter.core.{k}', 42)}" for k in range(scatter.DRAWS)]
    cases = " ".join(f"WHEN {x} BETWEEN 0 AND 6 THEN {x}" for x in draws)
    return f"SELECT row_id, round(CASE {cases} ELSE least(6.0, greatest(0.0, {draws[-1]})) END, 6) AS photoz_mock FROM {base}"


@query("scatter_core", _scatter_sql())
def scatter_core(spark, d):
    return rounded(scatter.scatter(catalog(spark, d, columns=["redshift", i]), "row_id", i, "redshift", tails=False), "photoz_mock")


def _scatter_full_sql() -> str:
    """All draws of every row; the first inside the range, else the last one, clipped."""
    m = scatter.KHOSTOVAN26
    row = lambda t: "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in t) + "]"
    table = lambda t: "[" + ", ".join(row(x) for x in t) + "]"
    quantiles = "[" + ", ".join(
        "[" + ", ".join(repr(x) for x in scatter.skew_t_quantiles(a, b)) + "]::DOUBLE[]" for a, b in zip(m.tail_a, m.tail_b, strict=True)
    ) + "]"
    k = "' || k || '"  # the number of the draw, inside of the stream's name
    core, tail, kind = (f"scatter.{x}.{k}" for x in ("core", "tail", "kind"))
    return (
        f"WITH q AS (SELECT unnest([1, 2, 3, 4]) AS mb, unnest({quantiles}) AS t), "
        f"p AS (SELECT mb, unnest(range(0, {scatter.QUANTILES})) AS place, unnest(t[1:{scatter.QUANTILES}]) AS low, unnest(t[2:{scatter.QUANTILES + 1}]) AS high FROM q), "
        f"b AS (SELECT *, {_digit(i, m.mag_edges)} AS mb, {_digit('redshift', m.z_edges)} AS zb FROM {source('redshift', i)}), "
        f"c AS (SELECT row_id, redshift, mb, k, {table(m.bias)}[mb][zb] + {table(m.sigma)}[mb][zb] * {normal_sql(core, 42)} AS core, "
        f"{draw_sql(tail, 42)} * {scatter.QUANTILES} AS u, {draw_sql(kind, 42)} < {row(m.tail_share)}[mb] AS tail, "
        f"{row(m.tail_loc)}[mb] AS loc, {row(m.tail_scale)}[mb] AS scale FROM b, range(0, {scatter.DRAWS}) r(k)), "
        "d AS (SELECT row_id, k, redshift + CASE WHEN tail THEN loc + scale * (low + (high - low) * (u - floor(u))) ELSE core END AS x "
        "FROM c JOIN p ON c.mb = p.mb AND floor(c.u)::BIGINT = p.place) "
        f"SELECT row_id, round(coalesce(arg_min(x, k) FILTER (x BETWEEN 0 AND 6), least(6.0, greatest(0.0, arg_max(x, k)))), 6) AS photoz_mock FROM d GROUP BY row_id"
    )


@query("scatter_full", _scatter_full_sql())
def scatter_full(spark, d):
    return rounded(scatter.scatter(catalog(spark, d, columns=["redshift", i]), "row_id", i, "redshift"), "photoz_mock")


def _igm(spark: SparkSession, d: str, **more) -> DataFrame:
    c = catalog(spark, d, columns=["redshift", "mag_u_lsst", g])
    cfg = igm.IGMConfig({"mag_u_lsst": rates.FILTERS["u"], g: rates.FILTERS["g"]}, **more)
    return rounded(igm.igm_extinction(c, cfg), "mag_u_lsst", g)


def _igm_tau_sql(redshifts: str) -> str:
    """CTEs that end in tau (z, w, t): optical depths at the filters' wavelengths for the redshifts of a query."""
    lines = ", ".join("(" + ", ".join(f"{float(v)!r}::DOUBLE" for v in row.split()) + ")" for row in igm.LINES.split("\n") if row)
    forest = (
        "CASE WHEN s < 2.2 AND y < s THEN 0.325 * (pow(y, 1.2) - pow(s, -0.9) * pow(y, 2.1)) "
        "WHEN s >= 2.2 AND s < 5.7 AND y < 2.2 THEN 0.0255 * pow(s, 1.6) * pow(y, 2.1) + 0.325 * pow(y, 1.2) - 0.25 * pow(y, 2.1) "
        "WHEN s >= 2.2 AND s < 5.7 AND y < s THEN 0.0255 * (pow(s, 1.6) * pow(y, 2.1) - pow(y, 3.7)) "
        "WHEN s >= 5.7 AND y < 2.2 THEN 0.000522 * pow(s, 3.4) * pow(y, 2.1) + 0.325 * pow(y, 1.2) - 0.0314 * pow(y, 2.1) "
        "WHEN s >= 5.7 AND y < 5.7 THEN 0.000522 * pow(s, 3.4) * pow(y, 2.1) + 0.218 * pow(y, 2.1) - 0.0255 * pow(y, 3.7) "
        "WHEN s >= 5.7 AND y < s THEN 0.000522 * (pow(s, 3.4) * pow(y, 2.1) - pow(y, 5.5)) ELSE 0.0 END"
    )
    damped = (
        "CASE WHEN s < 3 AND y < s THEN 0.211 * s * s - 0.0766 * pow(s, 2.3) * pow(y, -0.3) - 0.135 * y * y "
        "WHEN s >= 3 AND y < 3 THEN 0.634 + 0.047 * pow(s, 3) - 0.0178 * pow(s, 3.3) * pow(y, -0.3) - 0.135 * y * y - 0.291 * pow(y, -0.3) "
        "WHEN s >= 3 AND y < s THEN 0.047 * pow(s, 3) - 0.0178 * pow(s, 3.3) * pow(y, -0.3) - 0.0292 * pow(y, 3) ELSE 0.0 END"
    )
    # Below the wavelength of the (first) largest value, a continuum's depth is that value.
    return (
        f"ln AS (SELECT * FROM (VALUES {lines}) v(l, f1, f2, f3, d1, d2)), "
        "ws AS (SELECT 3000.0::DOUBLE + 10 * k AS w FROM range(0, 301) r(k)), "
        "zs AS (SELECT DISTINCT z, 1 + z AS s FROM (" + redshifts + ")), "
        "te AS (SELECT w, w / l AS x, CASE WHEN w / l < 2.2 THEN f1 * pow(w / l, 1.2) WHEN w / l < 5.7 THEN f2 * pow(w / l, 3.7) ELSE f3 * pow(w / l, 5.5) END + "
        "CASE WHEN w / l < 3 THEN d1 * pow(w / l, 2.0) ELSE d2 * pow(w / l, 3.0) END AS term FROM ws, ln WHERE w / l > 1), "
        "cu AS (SELECT w, x, sum(term) OVER (PARTITION BY w ORDER BY x) AS total FROM te), "
        f"co AS (SELECT z, s, w, {forest} AS f, {damped} AS d FROM (SELECT z, s, w, w / 911.8::DOUBLE AS y FROM zs, ws)), "
        "tp AS (SELECT z, max(f) AS f, max(d) AS d FROM co GROUP BY z), "
        "fw AS (SELECT co.z, min(w) FILTER (co.f = tp.f) AS wf, min(w) FILTER (co.d = tp.d) AS wd FROM co JOIN tp ON co.z = tp.z GROUP BY co.z), "
        "li AS (SELECT zw.z, zw.w, coalesce(cu.total, 0.0) AS t FROM (SELECT z, s, w FROM zs, ws) zw "
        "ASOF LEFT JOIN cu ON zw.w = cu.w AND zw.s > cu.x), "
        "tau AS (SELECT co.z, co.w, li.t + CASE WHEN co.w < fw.wf THEN tp.f ELSE co.f END + CASE WHEN co.w < fw.wd THEN tp.d ELSE co.d END AS t "
        "FROM co JOIN li ON co.z = li.z AND co.w = li.w JOIN tp ON co.z = tp.z JOIN fw ON co.z = fw.z)"
    )


def _igm_sql(interpolate: bool) -> str:
    """Shares of a power-law spectrum that pass, summed over wavelengths, as magnitudes."""
    (w, tu), (_, tg) = rates.FILTERS["u"], rates.FILTERS["g"]
    ratio = -2.5 * math.log10(igm._mean_wavelength(w, tu) / igm._mean_wavelength(w, tg))
    lo, hi, n = 1.5, 4.0, 100
    cat = f"cat AS {source('redshift', 'mag_u_lsst', g)}, "
    curve = lambda c, s: f"exp(-pow(w - {c}::DOUBLE, 2) / {2.0 * s * s!r}::DOUBLE)"
    if interpolate:
        step = f"(SELECT {lo}::DOUBLE + k * {(hi - lo) / (n - 1)!r}::DOUBLE AS z, k FROM range(0, {n}) r(k))"
        start = f"WITH {cat} gr AS {step}, " + _igm_tau_sql("SELECT z FROM gr")
        at = f"((redshift - {lo}::DOUBLE) / {hi - lo!r}::DOUBLE * {n - 1})"
        rows = (
            f"gt AS (SELECT k, w, exp(-t) AS p FROM tau JOIN gr ON tau.z = gr.z), "
            f"ro AS (SELECT *, least(floor({at})::BIGINT, {n - 2}) AS k, {at} - least(floor({at})::BIGINT, {n - 2}) AS f FROM cat WHERE redshift >= {lo} AND redshift <= {hi}), "
            "tr AS (SELECT row_id, a.w, a.p * (1 - f) + b.p * f AS p, beta FROM "
            f"(SELECT *, (mag_u_lsst - {g}) / {ratio!r}::DOUBLE - 2 AS beta FROM ro) r JOIN gt a ON a.k = r.k JOIN gt b ON b.k = r.k + 1 AND b.w = a.w)"
        )
    else:
        start = f"WITH {cat}" + _igm_tau_sql("SELECT redshift AS z FROM cat")
        rows = (
            "tr AS (SELECT row_id, w, exp(-t) AS p, beta FROM "
            f"(SELECT *, (mag_u_lsst - {g}) / {ratio!r}::DOUBLE - 2 AS beta FROM cat) c JOIN tau ON tau.z = c.redshift)"
        )
    share = lambda c, s: f"sum(p * exp((beta + 1) * ln(w)) * {curve(c, s)}) / sum(exp((beta + 1) * ln(w)) * {curve(c, s)})"
    shift = lambda c: f"CASE WHEN coalesce({c}, 0) > 0 THEN -2.5 * log10({c}) ELSE 'inf'::DOUBLE END"
    return (
        f"{start}, {rows}, sh AS (SELECT row_id, {share(3700.0, 200.0)} AS u, {share(4800.0, 350.0)} AS g FROM tr GROUP BY row_id) "
        f"SELECT cat.row_id, round(mag_u_lsst + {shift('u')}, 6) AS mag_u_lsst, round({g} + {shift('g')}, 6) AS {g} FROM cat LEFT JOIN sh ON cat.row_id = sh.row_id"
    )


query("igm_grid", _igm_sql(True))(lambda spark, d: _igm(spark, d))
query("igm_exact", _igm_sql(False))(lambda spark, d: _igm(spark, d, interpolate=False))


# --- blending ---

_LINK = 1.0 / 3600.0


def fof_sql(inner: str, ctes: str = "") -> str:
    """CTEs that end in grp (row_id, group_id): closure of pairs at most an arcsecond apart."""
    sep = (
        "degrees(2 * asin(sqrt(least(1.0, pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2)))))"
    )
    return (
        f"WITH RECURSIVE {ctes} c AS {inner}, s AS (SELECT row_id, ra, dec, CAST(floor((dec + 90.0) / {_LINK * 1.001!r}) AS BIGINT) AS strip FROM c), "
        "t AS (SELECT row_id, ra, dec, unnest([strip - 1, strip, strip + 1]) AS strip FROM s), "
        f"pr AS (SELECT a.row_id AS x, b.row_id AS y FROM t a JOIN s b USING (strip) WHERE a.row_id <> b.row_id AND abs(a.ra - b.ra) < 0.001 AND {sep} <= {_LINK!r}), "
        "reach AS (SELECT x, y FROM pr UNION SELECT reach.x, pr.y FROM reach JOIN pr ON reach.y = pr.x), "
        "grp AS (SELECT c.row_id, least(c.row_id, coalesce(min(y), c.row_id)) AS group_id FROM c LEFT JOIN reach ON c.row_id = reach.x GROUP BY c.row_id)"
    )


@query("fof_groups", f"{fof_sql(source('ra', 'dec'))} SELECT row_id, group_id FROM grp")
def fof_groups(spark, d):
    return blending.friends_of_friends(catalog(spark, d, columns=["ra", "dec"])).select("row_id", "group_id")


_BLEND_IN = ["ra", "dec", "redshift", *MAGS]
_BLEND_OUT = ["ra", "dec", *MAGS, "redshift", "z_brightest", "z_weighted", "z_mean", "z_stdev"]


def blend_sql(inner: str) -> str:
    f = lambda m: f"pow(10.0::DOUBLE, -0.4::DOUBLE * ({m} - 14.0))"
    ref = f("mag_i_lsst")
    best = f"arg_max({{'p': {pixel_sql(nside=128)}, 'z': redshift}}, {{'f': {ref}, 'i': -row_id}})"
    mags = ", ".join(f"-2.5::DOUBLE * log10(sum({f(m)})) + 14.0 AS {m}" for m in MAGS)
    return (
        f"SELECT group_id, avg(ra) AS ra, avg(dec) AS dec, {best}.p AS hpx_idx, {mags}, {best}.z AS redshift, count(*) AS n_obj, "
        f"max({ref}) AS brightest_flux, sum({ref}) AS total_flux, {best}.z AS z_brightest, sum(redshift * {ref}) / sum({ref}) AS z_weighted, "
        "avg(redshift) AS z_mean, coalesce(stddev_samp(redshift), 0.0) AS z_stdev FROM c JOIN grp USING (row_id) GROUP BY group_id"
    )


_BLEND_SQL = (
    f"{fof_sql(source(*_BLEND_IN))}, bl AS ({blend_sql('c')}) SELECT group_id, n_obj, CAST(hpx_idx AS BIGINT) AS hpx_idx, "
    f"round(brightest_flux, 9) AS brightest_flux, round(total_flux, 9) AS total_flux, {', '.join(r6(c, c) for c in _BLEND_OUT)} FROM bl"
)


def _blend_view(df: DataFrame) -> DataFrame:
    flux = [F.round(c, 9).alias(c) for c in ("brightest_flux", "total_flux")]
    return df.select("group_id", "n_obj", "hpx_idx", *flux, *[F.round(c, 6).alias(c) for c in _BLEND_OUT])


@query("blend_merge", _BLEND_SQL)
def blend_merge(spark, d):
    return _blend_view(blending.unrecognized_blends(catalog(spark, d, columns=_BLEND_IN))["output"])


# --- pipelines ---


def pipeline_config(spark: SparkSession, **more) -> pipelines.PipelineConfig:
    return pipelines.PipelineConfig(
        dust=dust_map(spark),
        error_models={"lsst": pipelines.ErrorModel(_LSST)},
        selectors={"GAMA": spec_config(spark), "DESI_BGS": spec_config(spark)},
        **more,
    )


def observed_sql(inner: str) -> str:
    return dust_sql(errors_sql(dust_sql(inner, "+"), _LSST), "-")


@query(
    "pipe_phot_errors",
    f"SELECT row_id, {', '.join(r6(c, c) for c in _ERR_COLS)} FROM {observed_sql(source(*MAGS, 'ra', 'dec'))}",
)
def pipe_phot_errors(spark, d):
    out = pipelines.apply_phot_errors(pipeline_config(spark)).run(catalog(spark, d, columns=[*MAGS, "ra", "dec"]))["deredden"]
    return rounded(out, *_ERR_COLS)


@query(
    "pipe_spec_select",
    f"SELECT 'GAMA' AS survey, row_id FROM {source(*PHOT)} WHERE {GAMA_SQL} UNION ALL SELECT 'DESI_BGS', row_id FROM {source(*PHOT)} WHERE {BGS_SQL}",
)
def pipe_spec_select(spark, d):
    made = pipelines.spectroscopic_selection(pipeline_config(spark)).run(catalog(spark, d, columns=PHOT))
    parts = [t.select(F.lit(n.removeprefix("select_")).alias("survey"), "row_id") for n, t in made.items()]
    return reduce(DataFrame.union, parts)


@query("pipe_blending", _BLEND_SQL)
def pipe_blending(spark, d):
    return _blend_view(pipelines.blend_catalog(pipeline_config(spark)).run(catalog(spark, d, columns=_BLEND_IN))["blend"])


def _truth_sql() -> str:
    start = fof_sql(dust_sql(source(*_BLEND_IN), "+"))
    merged = f"(SELECT group_id AS row_id, * FROM ({blend_sql('c')}))"
    return (
        f"{start}, bl AS (SELECT * FROM {merged}), ob AS (SELECT * FROM {dust_sql(errors_sql('bl', _LSST), '-')}) "
        f"SELECT 'GAMA' AS survey, row_id, n_obj FROM ob WHERE {GAMA_SQL} UNION ALL SELECT 'DESI_BGS', row_id, n_obj FROM ob WHERE {BGS_SQL}"
    )


@query("pipe_truth_to_observed", _truth_sql())
def pipe_truth_to_observed(spark, d):
    cfg = pipeline_config(spark, blend=blending.BlendConfig())
    made = pipelines.truth_to_observed(replace(cfg)).run(catalog(spark, d, columns=_BLEND_IN))
    parts = [t.select(F.lit(n.split("_", 1)[1].removesuffix("_lsst")).alias("survey"), "row_id", "n_obj") for n, t in made.items() if n.startswith("select_")]
    return reduce(DataFrame.union, parts)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

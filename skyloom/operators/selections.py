"""Selections of galaxies as spectroscopic surveys make them.

A survey is a predicate over magnitude columns, and for some a success rate looked up by
magnitude, redshift or colour, against keyed draws. All are lazy column expressions: a
selection is one scan, but for an exact-n downsample and the percentile cut.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.binning import search_left, search_left_even
from skyloom.functions.draws import uniform
from skyloom.functions.interp import Curve, linear, quadratic
from skyloom.functions.numeric import between, gt, is_finite, lt, no_nan, require
from skyloom.operators.sampling import chosen_ids, mark

BANDS = ("u", "g", "r", "i", "z", "y")
COLUMNS = {b: f"mag_{b}_lsst" for b in BANDS} | {"redshift": "redshift"}


@dataclass(frozen=True)
class Rates:
    """Success rates of the surveys; see :mod:`skyloom.sources.rates` for synthetic ones."""

    deep2: list[float] = field(default_factory=list)  # by r, 18.9 to 24.1
    vvds_i: list[float] = field(default_factory=list)  # by i, 17 to 24
    vvds_bright: tuple[list[float], list[float]] = ((), ())  # (z, rate), i <= 22.5
    vvds_deep: tuple[list[float], list[float]] = ((), ())
    zcosmos: DataFrame | None = None  # iy (i-band bin), ix (redshift bin), rate
    hsc: DataFrame | None = None  # iy (i-band bin), ix (colour bin), rate


@dataclass(frozen=True)
class SpecConfig:
    row_id: str = "row_id"
    colnames: dict[str, str] = field(default_factory=lambda: dict(COLUMNS))
    nondetect_val: float = float("inf")
    downsample: bool = True
    #: Count the selected rows at once, which takes a job, to warn if they are fewer than n_tot.
    warn_if_fewer: bool = False
    n_tot: int = 10_000
    seed: int = 42
    percentile_cut: float = 100.0
    drop_rows: bool = True
    #: "all": NaN in any column drops a row; "used": in the survey's columns only, so that others aren't read.
    nan_check: str = "all"
    rates: Rates | None = None

    def validate(self) -> SpecConfig:
        if self.n_tot < 0:
            raise ValueError("n_tot must not be negative")
        if not 0 <= self.percentile_cut <= 100:
            raise ValueError("percentile_cut must be between 0 and 100")
        if self.nan_check not in ("all", "used"):
            raise ValueError("nan_check must be 'all' or 'used'")
        return self

    def col(self, name: str) -> Column:
        return F.col(self.colnames[name])

    def draw(self, stream: str) -> Column:
        return uniform(F.col(self.row_id), self.seed, stream)

    def need(self, *names: str) -> Rates:
        if self.rates is None or any(not _given(getattr(self.rates, n)) for n in names):
            raise ValueError(f"success rates are missing: {', '.join(names)}")
        return self.rates


def _given(x) -> bool:
    return x is not None and (isinstance(x, DataFrame) or (len(x) > 0 and all(not isinstance(p, (list, tuple)) or len(p) for p in x)))


def usable(df: DataFrame, cfg: SpecConfig) -> Column:
    """No NaN in the row, and every configured magnitude finite and detected."""
    mags = [cfg.colnames[b] for b in BANDS if b in cfg.colnames]
    ok = no_nan(df, None if cfg.nan_check == "all" else list(cfg.colnames.values()))
    for m in mags:
        c = F.col(m)
        ok = ok & is_finite(c) & (c != F.lit(float(cfg.nondetect_val)))
    return ok


# --- predicates on colours and magnitudes ---


def gama(c: SpecConfig) -> Column:
    return lt(c.col("r"), 19.87)


def boss(c: SpecConfig) -> Column:
    g, r, i = c.col("g"), c.col("r"), c.col("i")
    gr, ri = g - r, r - i
    c_parallel = 0.7 * gr + 1.2 * (ri - 0.18)
    c_perp = ri - gr / 4.0 - 0.18
    d_perp = ri - gr / 8.0
    lowz = between(r, 16, 20) & lt(F.abs(c_perp), 0.2) & lt(r, 13.35 + c_parallel / 0.3)
    cmass = between(i, 17.5, 20.1) & gt(d_perp, 0.55) & lt(i, 19.98 + 1.6 * (d_perp - 0.7)) & lt(ri, 2)
    return lowz | cmass


def deep2_cut(c: SpecConfig) -> Column:
    g, r, i = c.col("g"), c.col("r"), c.col("i")
    gr, ri = g - r, r - i
    return between(r, 18.5, 24.1) & (lt(gr, 2.45 * ri - 0.2976) | gt(ri, 1.1) | lt(gr, 0.5))


def deep2_lsst_cut(c: SpecConfig) -> Column:
    g, r, i = c.col("g"), c.col("r"), c.col("i")
    b, rr, ii = g + 0.35 * (g - r), r - 0.30 * (r - i), i - 0.50 * (r - i)
    br, ri = b - rr, rr - ii
    return between(rr, 18.5, 24.1) & (lt(br, 2.45 * ri - 0.2976) | gt(ri, 1.1) | lt(br, 0.33))


def vvds_cut(c: SpecConfig) -> Column:
    return between(c.col("i"), 17.5, 24.0)


def zcosmos_cut(c: SpecConfig) -> Column:
    return between(c.col("i"), 15.0, 22.5)


def hsc_cut(c: SpecConfig) -> Column:
    return between(c.col("i"), 13, 26) & between(c.col("g") - c.col("z"), -2, 6)


def desi_lrg(c: SpecConfig) -> Column:
    g, r, z, w1 = c.col("g"), c.col("r"), c.col("z"), c.col("W1")
    rw = r - w1
    faint = gt(rw, 1.8 * (w1 - 17.14)) & gt(rw, w1 - 16.33)
    return lt(z, 21.60) & gt(z - w1, 0.8 * (r - z) - 0.6) & (gt(g - w1, 2.9) | gt(rw, 1.8)) & (faint | gt(rw, 3.3))


def desi_elg_lop(c: SpecConfig) -> Column:
    g, r, z = c.col("g"), c.col("r"), c.col("z")
    gr, rz = g - r, r - z
    return between(g, 20, 24.1) & gt(rz, 0.15) & lt(gr, 0.5 * rz + 0.1) & lt(gr, -1.2 * rz + 1.3)


def desi_bgs(c: SpecConfig) -> Column:
    return lt(c.col("r"), 19.5)


# --- success rates ---

# The bins of the published success rates.
DEEP2_CENTERS = [18.9 + 0.2 * k + 0.1 for k in range(26)]
VVDS_CENTERS = [17.25 + 0.5 * k for k in range(14)]
ZCOSMOS_I = (18.0, 0.01464226, 301)
ZCOSMOS_Z = (0.0, 0.00587002, 239)
HSC_I, HSC_GZ = (13.0, 26.0, 201), (-2.0, 6.0, 201)


def deep2_curve(rates: Rates) -> Curve:
    return quadratic(DEEP2_CENTERS, rates.deep2, below=rates.deep2[0], above=0.0)


def vvds_curves(rates: Rates) -> tuple[Curve, Curve, Curve]:
    zb, rb = rates.vvds_bright
    zd, rd = rates.vvds_deep
    return (
        quadratic(VVDS_CENTERS, rates.vvds_i, below=rates.vvds_i[0], above=0.0),
        quadratic(zb, rb, below=rb[0], above=1.0),
        quadratic(zd, rd, below=rd[0], above=0.0),
    )


def deep2_success(c: SpecConfig) -> Column:
    """By r, also where the cut is on transformed magnitudes."""
    return c.draw("deep2") < deep2_curve(c.need("deep2")).column(c.col("r"))


def vvds_success(c: SpecConfig) -> Column:
    by_i, bright, deep = vvds_curves(c.need("vvds_i", "vvds_bright", "vvds_deep"))
    i, z = c.col("i"), c.col("redshift")
    second = F.when(i <= 22.5, bright.column(z)).otherwise(deep.column(z))
    return (c.draw("vvds.i") < by_i.column(i)) & (c.draw("vvds.z") < second)


def even_edges(spec: tuple[float, float, int]) -> tuple[float, float, int]:
    lo, hi, n = spec
    return lo, (hi - lo) / (n - 1), n


def grid_rate(df: DataFrame, grid: DataFrame, y: Column, x: Column, y_edges: tuple, x_edges: tuple) -> DataFrame:
    """Add __iy, __ix and __rate (0 outside the grid). Edges are (first, step, number).

    The grid has (number of bins)^2 rows at most, fixed by its edges, so it is broadcast.
    """
    bins = df.withColumns({"__iy": search_left_even(y, *y_edges) - 1, "__ix": search_left_even(x, *x_edges) - 1})
    cells = grid.select(F.col("iy").cast("int").alias("__iy"), F.col("ix").cast("int").alias("__ix"), F.col("rate").alias("__rate"))
    return bins.join(F.broadcast(cells), ["__iy", "__ix"], "left").withColumn("__rate", F.coalesce("__rate", F.lit(0.0)))


def _zcosmos(df: DataFrame, c: SpecConfig) -> tuple[DataFrame, Column]:
    out = grid_rate(df, c.need("zcosmos").zcosmos, c.col("i"), c.col("redshift"), ZCOSMOS_I, ZCOSMOS_Z)
    return out, zcosmos_cut(c) & (c.draw("zcosmos") <= F.col("__rate"))


def _hsc(df: DataFrame, c: SpecConfig) -> tuple[DataFrame, Column]:
    gz = c.col("g") - c.col("z")
    out = grid_rate(df, c.need("hsc").hsc, c.col("i"), gz, even_edges(HSC_I), even_edges(HSC_GZ))
    keep = hsc_cut(c) & (c.draw("hsc") <= F.col("__rate"))
    if c.percentile_cut != 100:
        # Over all rows of a cell, before any cut: one pre-aggregated groupBy, and at most 202^2 rows back.
        z = c.col("redshift")
        cells = out.groupBy("__iy", "__ix").agg(F.percentile(z, c.percentile_cut / 100.0).alias("__max_z"))
        out = out.join(F.broadcast(cells), ["__iy", "__ix"])
        keep = keep & ~gt(z, F.col("__max_z"))
    return out, keep


Survey = Callable[[DataFrame, SpecConfig], tuple[DataFrame, Column]]


def _cut(*parts: Callable[[SpecConfig], Column]) -> Survey:
    def run(df: DataFrame, c: SpecConfig) -> tuple[DataFrame, Column]:
        out = parts[0](c)
        for p in parts[1:]:
            out = out & p(c)
        return df, out

    return run


SURVEYS: dict[str, Survey] = {
    "GAMA": _cut(gama),
    "BOSS": _cut(boss),
    "DEEP2": _cut(deep2_cut, deep2_success),
    "DEEP2_LSST": _cut(deep2_lsst_cut, deep2_success),
    "VVDSf02": _cut(vvds_cut, vvds_success),
    "zCOSMOS": _zcosmos,
    "HSC": _hsc,
    "DESI_LRG": _cut(desi_lrg),
    "DESI_ELG_LOP": _cut(desi_elg_lop),
    "DESI_BGS": _cut(desi_bgs),
}


def register(name: str, predicate: Callable[[SpecConfig], Column]) -> None:
    """Add a survey of your own: a function from configuration to a boolean column."""
    SURVEYS[name] = _cut(predicate)


def select(df: DataFrame, survey: str, cfg: SpecConfig = SpecConfig()) -> DataFrame:
    """The rows that a survey selects, or all rows with flag 0 or 1.

    With ``downsample``, exactly n_tot of the selected rows are drawn; if fewer are
    selected, all of them stay, and with ``warn_if_fewer`` a warning says so.
    """
    cfg.validate()
    names = dict(cfg.colnames)
    if survey == "DESI_LRG" and "W1" not in names:
        cfg = SpecConfig(**{**cfg.__dict__, "colnames": names | {"W1": "W1"}})
    require(df, [cfg.row_id, *cfg.colnames.values()])
    if survey not in SURVEYS:
        raise ValueError(f"no survey {survey}; there are {', '.join(SURVEYS)}")
    out, keep = SURVEYS[survey](df, cfg)
    keep = usable(df, cfg) & keep
    if cfg.downsample:
        chosen = chosen_ids(out.where(keep), cfg.row_id, cfg.n_tot, cfg.seed, "downsample")
        if cfg.warn_if_fewer and out.where(keep).limit(cfg.n_tot).count() < cfg.n_tot:
            warnings.warn(f"{survey}: fewer than {cfg.n_tot} rows are selected; all are kept", stacklevel=2)
        if cfg.drop_rows:
            return out.join(chosen, cfg.row_id, "left_semi").select(df.columns)
        return mark(out, chosen, cfg.row_id, "__kept").select(*df.columns, F.col("__kept").cast("int").alias("flag"))
    if cfg.drop_rows:
        return out.where(keep).select(df.columns)
    return out.select(*df.columns, F.coalesce(keep, F.lit(False)).cast("int").alias("flag"))


# --- DESI, physical thresholds ---


@dataclass(frozen=True)
class PhysicalThreshold:
    """Keep rows whose ``threshold_col`` exceeds a curve of the redshift."""

    threshold_col: str
    curve: Curve
    redshift_col: str = "redshift"
    desi_type: str = "lrg"
    drop_rows: bool = True

    @classmethod
    def from_table(cls, table: DataFrame, threshold_col: str, **more) -> PhysicalThreshold:
        """The curve through the points (z, thresh) of a table, which is small by nature."""
        require(table, ["z", "thresh"])
        points = table.select("z", "thresh").orderBy("z").collect()
        return cls(threshold_col, linear([p["z"] for p in points], [p["thresh"] for p in points]), **more)


def desi_physical(df: DataFrame, cfg: PhysicalThreshold) -> DataFrame:
    for name in (cfg.threshold_col, cfg.redshift_col):
        if name not in df.columns:
            raise ValueError(f"column {name} not in the table")
    keep = gt(F.col(cfg.threshold_col), cfg.curve.column(F.col(cfg.redshift_col)))
    return df.where(keep) if cfg.drop_rows else df.withColumn("flag", F.coalesce(keep, F.lit(False)).cast("int"))


def bin_left(v: Column, edges: list[float]) -> Column:
    """Bin number (from 0) of a value by edges of any spacing; -1 under the first."""
    return search_left(v, edges) - 1

"""Photometric errors: signal-to-noise from depth, extended sources, keyed noise.

The noise-to-signal ratio follows Ivezic et al. (2019), section 3.2: with x = 10^(0.4 (m - m5)),
nsr^2 = (0.04 - gamma) x + gamma x^2, plus a systematic floor. Extended sources have it
scaled by the square root of aperture over PSF area. Noise is drawn in flux.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.draws import normal
from skyloom.functions.numeric import INF, require

LSST_BANDS = ("u", "g", "r", "i", "z", "y")


def _per_band(bands, *values) -> dict[str, float]:
    return dict(zip(bands, values, strict=True))


@dataclass(frozen=True)
class ErrorParams:
    """Parameters of an error model. A band's depth is ``m5`` if given, else it comes from the observing conditions."""

    # Ivezic et al. (2019), table 2, and the survey's nominal visits.
    bands: tuple[str, ...] = LSST_BANDS
    rename: dict[str, str] = field(default_factory=dict)
    tvis: float = 30.0
    years: float = 10.0
    visits_per_year: dict[str, float] = field(default_factory=lambda: _per_band(LSST_BANDS, 5.6, 8.0, 18.4, 18.4, 16.0, 16.0))
    gamma: dict[str, float] = field(default_factory=lambda: _per_band(LSST_BANDS, 0.038, 0.039, 0.039, 0.039, 0.039, 0.039))
    airmass: float = 1.2
    cm: dict[str, float] = field(default_factory=lambda: _per_band(LSST_BANDS, 23.09, 24.42, 24.44, 24.32, 24.16, 23.73))
    msky: dict[str, float] = field(default_factory=lambda: _per_band(LSST_BANDS, 22.99, 22.26, 21.20, 20.48, 19.60, 18.61))
    theta: dict[str, float] = field(default_factory=lambda: _per_band(LSST_BANDS, 0.81, 0.77, 0.73, 0.71, 0.69, 0.68))
    km: dict[str, float] = field(default_factory=lambda: _per_band(LSST_BANDS, 0.491, 0.213, 0.126, 0.096, 0.069, 0.170))
    #: Depth of one visit, five standard deviations.
    m5: dict[str, float] = field(default_factory=dict)
    sigma_sys: float = 0.005
    #: Fainter than so many standard deviations is a non-detection.
    sigma_limit: float = 0.0
    #: Non-detections get ``nd_value`` ("flag"), or the magnitude and error at the limit ("limit").
    nd_mode: str = "flag"
    nd_value: float = INF
    #: Take the absolute value of a negative flux.
    abs_flux: bool = False
    #: Errors belong to the noisy magnitudes; else to the true ones.
    decorrelate: bool = True
    #: The approximation for high signals: noise is normal in magnitudes, and its width is the error.
    high_snr: bool = False
    #: Factors of the bands' errors.
    scale: dict[str, float] = field(default_factory=dict)
    #: Where error columns stand: "after" their magnitude, at the "end", or "alone", with no other column but the row id.
    err_place: str = "end"
    extended: str = "point"  # or "auto", "gaap"
    major: str = "major"
    minor: str = "minor"
    gaap_min: float = 0.7
    gaap_max: float = 2.0
    seed: int = 42
    row_id: str = "row_id"

    def validate(self) -> ErrorParams:
        if self.extended not in ("point", "auto", "gaap"):
            raise ValueError("extended must be 'point', 'auto' or 'gaap'")
        if self.nd_mode not in ("flag", "limit"):
            raise ValueError("nd_mode must be 'flag' or 'limit'")
        if self.nd_mode == "limit" and self.sigma_limit <= 0:
            raise ValueError("nd_mode 'limit' needs a positive sigma_limit")
        if self.err_place not in ("after", "end", "alone"):
            raise ValueError("err_place must be 'after', 'end' or 'alone'")
        if any(x < 0 for x in self.scale.values()):
            raise ValueError("scale must not be negative")
        for name in ("visits_per_year", "gamma", "theta"):
            if missing := set(self.bands) - set(getattr(self, name)):
                raise ValueError(f"{name} lacks bands {sorted(missing)}")
        if self.years <= 0 or self.tvis <= 0:
            raise ValueError("years and tvis must be positive")
        return self

    def mag(self, band: str) -> str:
        return self.rename.get(band, band)


def _depths(bands: tuple[str, ...], m5: tuple[float, ...], theta: tuple[float, ...], **more) -> ErrorParams:
    """Presets that state the depth of the finished survey."""
    ones = dict.fromkeys(bands, 1.0)
    return ErrorParams(
        bands=bands,
        years=1.0,
        visits_per_year=ones,
        gamma=dict.fromkeys(bands, 0.04),
        theta=_per_band(bands, *theta),
        m5=_per_band(bands, *m5),
        cm={},
        msky={},
        km={},
        **more,
    )


# Examples of depths of point sources at five standard deviations, near what the missions have announced, and
# none of a certain release: the wide, deep and ultra-deep Roman presets are one magnitude less and one and two more
# than Roman's own by assumption, Euclid's deep one two more. Give the depths of a release in their place, with
# ``preset`` or ``register_model``.
ROMAN, EUCLID = ("Y", "J", "H", "F"), ("Y", "J", "H")
ROMAN_THETA, EUCLID_THETA = (0.14, 0.17, 0.21, 0.25), (0.53, 0.54, 0.55)
PRESETS: dict[str, ErrorParams] = {
    "LSSTErrorModel": ErrorParams(),
    "RomanErrorModel": _depths(ROMAN, (26.9, 26.95, 26.9, 26.25), ROMAN_THETA),
    "RomanWideErrorModel": _depths(ROMAN, (25.9, 25.95, 25.9, 25.25), ROMAN_THETA),
    "RomanMediumErrorModel": _depths(ROMAN, (26.9, 26.95, 26.9, 26.25), ROMAN_THETA),
    "RomanDeepErrorModel": _depths(ROMAN, (27.9, 27.95, 27.9, 27.25), ROMAN_THETA),
    "RomanUltraDeepErrorModel": _depths(ROMAN, (28.9, 28.95, 28.9, 28.25), ROMAN_THETA),
    "EuclidErrorModel": _depths(EUCLID, (24.0, 24.2, 23.9), EUCLID_THETA),
    "EuclidWideErrorModel": _depths(EUCLID, (24.0, 24.2, 23.9), EUCLID_THETA),
    "EuclidDeepErrorModel": _depths(EUCLID, (26.0, 26.2, 25.9), EUCLID_THETA),
}


def register_model(name: str, params: ErrorParams) -> None:
    """Add an error model of your own, or replace one, by name."""
    PRESETS[name] = params.validate()


def preset(name: str, **overrides) -> ErrorParams:
    if name not in PRESETS:
        raise ValueError(f"no error model {name}; there are {', '.join(PRESETS)}")
    return replace(PRESETS[name], **overrides)


#: A condition of a band: a number, or a column with a number for every row.
Condition = float | Column


def _lit(x: Condition) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def visit_depth(p: ErrorParams, band: str, over: dict[str, Condition] | None = None) -> Column:
    """m5 of a visit: as stated, or from zeropoint, sky, seeing, exposure time and airmass."""
    o = over or {}
    stated = o.get("m5")
    default = _lit(p.m5[band]) if band in p.m5 else None
    if default is None:
        default = (
            F.lit(p.cm[band])
            + 0.5 * (_lit(o.get("msky", p.msky[band])) - 21.0)
            + 2.5 * F.log10(F.lit(0.7) / _lit(o.get("theta", p.theta[band])))
            + 1.25 * F.log10(_lit(o.get("tvis", p.tvis)) / 30.0)
            - _lit(o.get("km", p.km[band])) * (_lit(o.get("airmass", p.airmass)) - 1.0)
        )
    return default if stated is None else F.coalesce(_lit(stated), default)


def coadd_depth(p: ErrorParams, band: str, over: dict[str, Condition] | None = None) -> Column:
    o = over or {}
    visits = _lit(o.get("nVisYr", p.visits_per_year[band])) * _lit(o.get("nYrObs", p.years))
    return visit_depth(p, band, over) + 1.25 * F.log10(visits)


def relative_flux(mag: Column, depth: Column) -> Column:
    """Flux at the depth over the flux: 10^(0.4 (m - m5))."""
    return F.pow(F.lit(10.0), 0.4 * (mag - depth))


def noise_to_signal(x: Column, gamma: Condition, p: ErrorParams, area: Column | None = None) -> Column:
    """The noise-to-signal ratio at relative flux x."""
    g = _lit(gamma)
    random = x * ((0.04 - g) + g * x)
    if area is not None:
        random = random * area
    floor = p.sigma_sys if p.high_snr else math.pow(10.0, p.sigma_sys / 2.5) - 1.0
    return F.sqrt(random + floor * floor)


def error_of(nsr: Column, p: ErrorParams) -> Column:
    """The magnitude error of a noise-to-signal ratio."""
    return nsr if p.high_snr else 2.5 * F.log10(1.0 + nsr)


def limiting(p: ErrorParams, band: str, depth: Column, gamma: Condition, scale: float) -> tuple[Column, Column]:
    """Magnitude and error at ``sigma_limit`` standard deviations of a point source, without the systematic floor.

    With r = 1 / (sigma_limit x scale), x solves (0.04 - gamma) x + gamma x^2 = r^2.
    """
    g, r = _lit(gamma), 1.0 / p.sigma_limit / max(scale, 1e-300)
    linear = F.lit(0.04) - g
    x = F.when(g > 0, (-linear + F.sqrt(linear * linear + 4.0 * g * r * r)) / (2.0 * g)).otherwise(r * r / linear)
    return depth + 2.5 * F.log10(x), error_of(F.lit(1.0 / p.sigma_limit), p)


def area_ratio(p: ErrorParams, theta: Condition) -> Column | None:
    """Aperture area over PSF area of an extended source; None for point sources.

    "auto": the axes times 2.5 and the PSF width in quadrature (van den Busch et al. 2020);
    "gaap": the axes and the width, held between the least and the largest aperture (Kuijken et al. 2019).
    """
    if p.extended == "point":
        return None
    psf = _lit(theta) / 2.355
    k = 2.5 if p.extended == "auto" else 1.0

    def axis(c: str) -> Column:
        a = F.sqrt(psf * psf + (k * F.col(c)) * (k * F.col(c)))
        if p.extended == "gaap":
            least = F.greatest(psf, F.lit(p.gaap_min / 2.355))
            a = F.greatest(least, F.least(F.greatest(F.lit(p.gaap_max), least), a))
        return a

    return axis(p.major) * axis(p.minor) / (psf * psf)


def add_errors(
    df: DataFrame, p: ErrorParams, conditions: dict[str, dict[str, Condition]] | None = None, noiseless: bool = False
) -> DataFrame:
    """Replace every band's magnitude by a noisy one and add ``<magnitude>_err``.

    The noise is normal in flux; a flux that isn't positive, and a signal under the limit, is a
    non-detection. Errors belong to the noisy magnitudes. With ``noiseless``, magnitudes stay and
    errors are the expected ones. ``conditions`` has a number or column for a band's m5,
    nVisYr, nYrObs, gamma, msky, theta, km, tvis or airmass. The fields of :class:`ErrorParams`
    change each of these.
    """
    p.validate()
    require(df, [p.row_id, *[p.mag(b) for b in p.bands]])
    # One projection a step, so that what a step uses several times is computed once.
    bands = {b: (p.mag(b), (conditions or {}).get(b, {})) for b in p.bands}
    nd = F.lit(float(p.nd_value))

    def ratios(t: DataFrame) -> DataFrame:
        return t.withColumns({f"__x_{b}": relative_flux(F.col(m), coadd_depth(p, b, o)) for b, (m, o) in bands.items()})

    def nsr(b: str) -> Column:
        o = bands[b][1]
        own = noise_to_signal(F.col(f"__x_{b}"), o.get("gamma", p.gamma[b]), p, area_ratio(p, o.get("theta", p.theta[b])))
        return own * float(p.scale[b]) if b in p.scale else own

    def observed(b: str, m: str) -> Column:
        noise = normal(F.col(p.row_id), p.seed, f"err.{m}")
        return F.col(m) + nsr(b) * noise if p.high_snr else 1.0 + nsr(b) * noise

    out = ratios(df)
    if not noiseless:
        out = out.withColumns({f"__seen_{b}": observed(b, m) for b, (m, _) in bands.items()})
        if not p.decorrelate:  # before the magnitudes change
            out = out.withColumns({f"{m}_err": error_of(nsr(b), p) for b, (m, _) in bands.items()})

        def magnitude(b: str, m: str) -> Column:
            seen = F.col(f"__seen_{b}")
            if p.high_snr:
                return seen
            flux = F.abs(seen) if p.abs_flux else seen
            return F.when(flux > 0, F.col(m) - 2.5 * F.log10(flux)).otherwise(nd)

        out = out.withColumns({m: magnitude(b, m) for b, (m, _) in bands.items()})
        if p.decorrelate:
            out = ratios(out)
    if noiseless or p.decorrelate:
        out = out.withColumns({f"{m}_err": error_of(nsr(b), p) for b, (m, _) in bands.items()})
    flags = {}
    for b, (m, o) in bands.items():
        lost = ~(F.abs(F.col(m)) < F.lit(INF)) | F.isnan(F.col(m))
        mag, err = nd, nd
        if p.sigma_limit > 0:
            lost = lost | (F.col(f"{m}_err") > (1 / p.sigma_limit if p.high_snr else 2.5 * math.log10(1 + 1 / p.sigma_limit)))
            if p.nd_mode == "limit":
                mag, err = limiting(p, b, coadd_depth(p, b, o), o.get("gamma", p.gamma[b]), p.scale.get(b, 1.0))
        flags[m] = F.when(lost, mag).otherwise(F.col(m))
        flags[f"{m}_err"] = F.when(lost, err).otherwise(F.col(f"{m}_err"))
    out = out.withColumns(flags)
    errors = [f"{m}_err" for m, _ in bands.values()]
    own = [c for c in df.columns if c not in errors]
    if p.err_place == "alone":
        return out.select(p.row_id, *errors)
    if p.err_place == "after":
        mags = {m for m, _ in bands.values()}
        return out.select(*[x for c in own for x in ((c, f"{c}_err") if c in mags else (c,))])
    return out.select(*own, *errors)

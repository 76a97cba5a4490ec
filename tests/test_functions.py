import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import binning, draws, dust, interp, numeric, sky


def column(spark, expr, values, name="v"):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"i long, {name} double")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_draws_are_keyed_and_uniform(spark):
    df = spark.range(5000).select("id", draws.uniform(F.col("id"), 42, "s").alias("u"), draws.normal(F.col("id"), 42, "n").alias("n"))
    a = {r.id: (r.u, r.n) for r in df.collect()}
    b = {r.id: (r.u, r.n) for r in df.repartition(17).collect()}
    assert a == b
    u, n = np.array(list(a.values())).T
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    assert abs(n.mean()) < 0.06 and abs(n.std() - 1) < 0.05
    other = spark.range(5000).select("id", draws.uniform(F.col("id"), 43, "s").alias("u"))
    assert {r.id: r.u for r in other.collect()} != {i: x for i, (x, _) in a.items()}


def test_nan_compares_false(spark):
    v = F.col("v")
    values = [1.0, math.nan, math.inf, -math.inf]
    assert column(spark, numeric.gt(v, 0), values) == [True, False, True, False]
    assert column(spark, numeric.lt(v, 2), values) == [True, False, False, True]
    assert column(spark, numeric.is_finite(v), values) == [True, False, False, False]
    logs = column(spark, numeric.log10(v), [100.0, 0.0, -1.0])
    assert logs[:2] == [2.0, -math.inf] and math.isnan(logs[2])
    d = column(spark, numeric.divide(v, F.lit(0.0)), [1.0, -1.0, 0.0])
    assert d[:2] == [math.inf, -math.inf] and math.isnan(d[2])
    assert math.isnan(column(spark, numeric.clip(v, 0, 1), [math.nan])[0])


def test_bins_at_edges(spark):
    edges = [0.0, 1.0, 2.0]
    values = [-1.0, 0.0, 0.5, 1.0, 2.0, 3.0]
    v = F.col("v")
    assert column(spark, binning.search_left(v, edges), values) == np.searchsorted(edges, values).tolist()
    assert column(spark, binning.digitize(v, edges), values) == np.digitize(values, edges).tolist()
    step = 0.01464226
    grid = 18 + step * np.arange(301)
    tricky = [*grid, *np.nextafter(grid, 99), *np.nextafter(grid, 0), 0.0, 99.0]
    assert column(spark, binning.search_left_even(v, 18.0, step, 301), tricky) == np.searchsorted(grid, tricky).tolist()


def test_curves(spark):
    line = interp.linear([1.0, 0.0, 2.0], [3.0, 1.0, 4.0])
    x = [-1.0, 0.0, 0.5, 1.0, 1.5, 3.0]
    want = [-1.0, 1.0, 2.0, 3.0, 3.5, 5.0]
    assert np.allclose(line(x), want)
    assert np.allclose(column(spark, line.column(F.col("v")), x), want)
    xs = np.linspace(0, 5, 9)
    parabola = interp.quadratic(xs, 2 + xs - 0.3 * xs**2, below=7.0, above=0.0)
    at = np.linspace(0, 5, 41)
    assert np.allclose(parabola(at), 2 + at - 0.3 * at**2)
    wave = interp.quadratic(xs, np.sin(xs), below=7.0, above=0.0)
    assert np.allclose(wave(xs), np.sin(xs)) and np.abs(wave(at) - np.sin(at)).max() < 0.05
    assert np.allclose(column(spark, wave.column(F.col("v")), [-0.1, 0.0, 2.2, 5.0, 5.1]), [7.0, 0.0, wave([2.2])[0], np.sin(5), 0.0])
    steps = np.array(wave.knots[1:-1])
    assert np.allclose(wave(steps - 1e-9), wave(steps + 1e-9), atol=1e-6)


@pytest.mark.parametrize("nside", [1, 2, 4, 8, 16, 128])
def test_healpix_centers_round_trip(spark, nside):
    n = 12 * nside * nside
    pix = np.arange(n) if n < 4000 else np.random.default_rng(0).choice(n, 3000, replace=False)
    lon, lat = sky.pix2ang_ring(pix, nside)
    df = spark.createDataFrame([(int(p), float(a), float(b)) for p, a, b in zip(pix, lon, lat, strict=True)], "p long, a double, b double")
    x, y = sky.pixel_centers(F.col("p"), nside)
    got = df.select("p", sky.ang2pix_ring(F.col("a"), F.col("b"), nside).alias("q"), "a", "b", x.alias("x"), y.alias("y")).collect()
    assert all(r.p == r.q and abs(r.a - r.x) < 1e-9 and abs(r.b - r.y) < 1e-9 for r in got)


def test_healpix_known_pixels(spark):
    at = {(90.0, 0.0): 1440, (45.0, 45.0): 427, (90.0, 90.0): 1520, (0.0, 0.0): 0, (180.0, 0.0): 3068}
    for (theta, phi), want in at.items():
        pix = spark.range(1).select(sky.ang2pix_ring(F.lit(phi), F.lit(90.0 - theta), 16)).first()[0]
        assert pix == want, (theta, phi)
    bad = spark.range(1).select(sky.ang2pix_ring(F.lit(0.0), F.lit(91.0), 16), sky.ang2pix_ring(F.lit(math.nan), F.lit(0.0), 16)).first()
    assert bad[0] is None and bad[1] is None
    for nside in (0, 3, -4):
        with pytest.raises(ValueError):
            sky.ang2pix_ring(F.lit(0.0), F.lit(0.0), nside)


def test_dust_law_goldens(spark):
    got = column(spark, dust.ccm_a_over_ebv(F.col("v")), [10000.0, 2000.0, 1428.0, 1000.0, 4500.0])
    assert np.allclose(got, [1.2524, 8.81183, 8.62025, 16.2389, 3.9925], atol=1e-2)
    with pytest.raises(Exception, match="outside"):
        column(spark, dust.ccm_a_over_ebv(F.col("v")), [500.0])
    assert column(spark, dust.ccm_a_over_ebv(F.col("v"), strict=False), [500.0]) == [None]


def test_effective_wavelength(spark):
    w = np.linspace(3000, 6000, 301)
    t = np.exp(-((w - 4500) ** 2) / 1800)
    df = spark.createDataFrame(list(zip(w.tolist(), t.tolist(), strict=True)), "wavelength double, transmission double")
    assert abs(dust.lambda_effective(df).first()[0] - 4500) < 1e-6
    arrays = df.agg(F.collect_list("wavelength").alias("w"), F.collect_list("transmission").alias("t"))
    assert abs(arrays.select(dust.lambda_effective_arrays(F.col("w"), F.col("t"))).first()[0] - 4500) < 1e-6

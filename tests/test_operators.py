import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import blending, degraders, errors, grid, igm, obscond, photometry, sampling, scatter, selections, shapes
from skyloom.sources import catalogs, rates
from skyloom.sources.catalog_view import catalog

SF = "/root/testdata/sf0.001"
MAGS = [f"mag_{b}_lsst" for b in "ugrizy"]


@pytest.fixture(scope="module")
def cat(spark):
    held = catalog(spark, SF).persist()
    yield held
    held.unpersist(blocking=True)  # else other modules' plans read the cache in place of the files


def cfg(**more):
    return selections.SpecConfig(**({"downsample": False} | more))


# --- photometry ---


def test_flux_round_trip_and_errors(spark):
    df = spark.createDataFrame([(1.0, 1.0, 10.0), (2.0, 0.0, 1.0), (3.0, -5.0, 1.0)], "id double, u_gaap1p0Flux double, u_gaap1p0FluxErr double")
    rows = photometry.flux_to_mag(df, "u", copy_cols={"key": "id"}).collect()
    assert rows[0].mag_u_lsst == pytest.approx(31.4) and rows[0].mag_err_u_lsst == pytest.approx(10 / (0.4 * math.log(10)))
    assert all(math.isnan(r.mag_u_lsst) for r in rows[1:]) and [r.key for r in rows] == [1.0, 2.0, 3.0]
    with pytest.raises(IndexError):
        photometry.FluxColumns(["a"], []).validate()
    with pytest.raises(IndexError):
        photometry.FluxColumns(["a"], ["b"], [1.0, 2.0]).validate()
    same = photometry.as_fluxes(df, photometry.FluxColumns(["u_gaap1p0Flux"], ["u_gaap1p0FluxErr"], is_flux=True))
    assert [r[0] for r in same.collect()] == [1.0, 0.0, -5.0]


def test_hyperbolic(spark, cat):
    smooth = photometry.hyperbolic_smoothing(cat)
    assert smooth.count() == 6
    out = photometry.hyperbolic_magnitudes(cat, smooth, keep=["row_id", "mag_i_lsst"])
    bright = out.where("mag_i_lsst < 18").agg(F.max(F.abs(F.col("mag_i_lsst") - F.col("mag_hyp_i_lsst")))).first()[0]
    assert bright < 0.05
    with pytest.raises(Exception, match="no smoothing parameters for: mag_y_lsst"):
        photometry.hyperbolic_magnitudes(cat, smooth.where("filter != 'mag_y_lsst'")).collect()


def test_redden_and_deredden(spark, cat):
    from skyloom.plans.registry import dust_map

    d = dust_map(spark)
    from dataclasses import replace

    there = photometry.redden(cat, replace(d, copy_all_cols=True))
    assert there.columns == cat.columns
    back = photometry.deredden(there, d).join(cat.select("row_id", F.col("mag_u_lsst").alias("u0")), "row_id")
    assert back.agg(F.max(F.abs(F.col("u0") - F.col("mag_u_lsst")))).first()[0] < 1e-9
    assert there.join(cat.select("row_id", F.col("mag_u_lsst").alias("u0")), "row_id").where("mag_u_lsst <= u0").count() == 0


def test_shapes(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 0.5), (3.0, 0.0)], "size double, ellipticity double")
    rows = shapes.major_ellipticity(df).collect()
    assert [r.minor for r in rows] == pytest.approx([0.0, 2 / 3, 3.0])
    rows = shapes.size_ellipticity(df).collect()
    assert math.isinf(rows[0].major) and rows[1].major * rows[1].minor == pytest.approx(4.0)
    arc = shapes.major_ellipticity(df, axes=shapes.Axes("a", "b", True)).collect()
    assert arc[1].a == pytest.approx(0.4)
    m = spark.createDataFrame([(0.2, 0.1, 0.4), (0.2, 0.0, 0.5), (0.1, 1.0, 0.1)], "shape_xx double, shape_xy double, shape_yy double")
    rows = shapes.moments(m).collect()
    assert rows[1].major == pytest.approx(math.sqrt(0.5)) and math.isnan(rows[2].minor)
    b = spark.createDataFrame([(1.0, 0.5, 0.2, 0.7)], "size_bulge_true double, size_disk_true double, bulge_to_total_ratio double, ellipticity_true double")
    r = shapes.bulge_disk(b).first()
    assert r.major * r.minor == pytest.approx(0.36)


# --- selections ---


@pytest.mark.parametrize("survey", list(selections.SURVEYS))
def test_surveys_select_some_rows_and_flag_the_same(spark, cat, survey):
    c = cfg(rates=rates.rates(spark))
    kept = selections.select(cat, survey, c)
    assert kept.columns == cat.columns
    n = kept.count()
    assert 0 < n < cat.count()
    flagged = selections.select(cat, survey, cfg(rates=rates.rates(spark), drop_rows=False))
    assert flagged.count() == cat.count() and flagged.agg(F.sum("flag")).first()[0] == n
    assert selections.select(cat.repartition(7), survey, c).agg(F.sum("row_id")).first() == kept.agg(F.sum("row_id")).first()


def test_edges_are_strict(spark):
    base = {m: 20.0 for m in MAGS} | {"redshift": 0.5}
    rows = [{**base, "row_id": k, "mag_r_lsst": v} for k, v in enumerate([19.87, 19.8699, 19.5, 19.4999, math.nan, math.inf, -math.inf])]
    df = spark.createDataFrame(rows, "row_id long, redshift double, " + ", ".join(f"{m} double" for m in MAGS))
    assert [r.row_id for r in selections.select(df, "GAMA", cfg()).collect()] == [1, 2, 3]
    assert [r.row_id for r in selections.select(df, "DESI_BGS", cfg()).collect()] == [3]
    other = df.withColumn("unused", F.when(F.col("row_id") == 3, float("nan")).otherwise(1.0))
    assert selections.select(other, "DESI_BGS", cfg()).count() == 0
    assert selections.select(other, "DESI_BGS", cfg(nan_check="used")).count() == 1
    assert selections.select(df, "GAMA", cfg(nondetect_val=19.5)).count() == 2


def test_medians_are_exact(spark, monkeypatch):
    """Against sorted values, with parts and rows so few that several rounds are needed."""
    rng = np.random.default_rng(3)
    cases = {
        "even": rng.normal(size=4000),
        "odd": rng.normal(size=3999).tolist() + [None],
        "far": np.concatenate((rng.normal(size=3998), [1e300, -1e300])),
        "ties": np.repeat([1.0, 2.0], 2000),
        "one": np.full(4000, 7.0),
        "nan": np.where(np.arange(4000) < 1000, np.nan, rng.exponential(size=4000)),
        "inf": np.where(np.arange(4000) < 2500, np.inf, 1.0),
        "none": [None] * 4000,
    }
    rows = list(zip(*[[None if x is None else float(x) for x in v] for v in cases.values()], strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cases))
    want = []
    for v in cases.values():
        own = np.array([x for x in v if x is not None and not np.isnan(x)])
        want.append(float(np.median(own)) if len(own) else None)
    for parts, kept in ((4096, 20_000), (16, 10), (2, 3)):
        monkeypatch.setattr(photometry, "MEDIAN_PARTS", parts)
        monkeypatch.setattr(photometry, "MEDIAN_ROWS", kept)
        assert photometry.exact_medians(df, list(cases)) == want


def test_error_model_fields(spark, cat):
    """Each field of the parameters changes what it says."""
    mags = {b: f"mag_{b}_lsst" for b in "ugrizy"}
    base = errors.preset("LSSTErrorModel", rename=mags)
    run = lambda **more: errors.add_errors(cat.select("row_id", *mags.values()), errors.preset("LSSTErrorModel", rename=mags, **more))
    by = lambda df, c: {r.row_id: r[c] for r in df.select("row_id", c).collect()}
    plain, true = by(run(), "mag_u_lsst_err"), by(cat, "mag_u_lsst")
    # scale multiplies the noise-to-signal ratio; without correlation errors belong to true magnitudes
    expected = by(errors.add_errors(cat, base, noiseless=True), "mag_u_lsst_err")
    assert by(run(decorrelate=False), "mag_u_lsst_err")[1] == pytest.approx(expected[1], rel=1e-12) != plain[1]
    nsr = lambda err: 10 ** (err / 2.5) - 1
    twice = by(run(decorrelate=False, scale={"u": 2.0}), "mag_u_lsst_err")
    assert nsr(twice[1]) == pytest.approx(2 * nsr(expected[1]), rel=1e-9)
    # high signals: errors are the ratios themselves, with the floor as it stands
    high = by(run(high_snr=True, decorrelate=False, sigma_sys=0.0), "mag_u_lsst_err")
    low = by(run(decorrelate=False, sigma_sys=0.0), "mag_u_lsst_err")
    assert high[1] == pytest.approx(nsr(low[1]), rel=1e-9)
    # no flux below 0 is lost, and non-detections get the limit
    assert all(math.isfinite(x) for x in by(run(abs_flux=True), "mag_u_lsst").values())
    limit = errors.preset("LSSTErrorModel", rename=mags, sigma_limit=5.0, nd_mode="limit", sigma_sys=0.0)
    found = errors.add_errors(cat, limit).select("row_id", "mag_u_lsst", "mag_u_lsst_err").collect()
    faint = max(r.mag_u_lsst for r in found)
    assert max(r.mag_u_lsst_err for r in found) <= 2.5 * math.log10(1.2) + 1e-12
    assert sum(r.mag_u_lsst == faint for r in found) > 10 and all(math.isfinite(r.mag_u_lsst) for r in found)
    at = spark.createDataFrame([(1, faint)], "row_id long, mag_u_lsst double")
    one = errors.preset("LSSTErrorModel", bands=("u",), rename=mags, sigma_sys=0.0)
    assert errors.add_errors(at, one, noiseless=True).first().mag_u_lsst_err == pytest.approx(2.5 * math.log10(1.2), rel=1e-9)
    # places of the columns
    assert run(err_place="after").columns[:3] == ["row_id", "mag_u_lsst", "mag_u_lsst_err"]
    assert run(err_place="alone").columns == ["row_id", *[f"{m}_err" for m in mags.values()]]
    for bad in ({"nd_mode": "x"}, {"nd_mode": "limit"}, {"err_place": "x"}, {"scale": {"u": -1.0}}):
        with pytest.raises(ValueError):
            run(**bad)
    errors.register_model("Mine", errors.preset("EuclidErrorModel", years=2.0))
    assert errors.preset("Mine", seed=3).years == 2.0 and errors.preset("Mine", seed=3).seed == 3
    del errors.PRESETS["Mine"]
    assert true


def test_rows_at_one_position_make_no_pairs(spark, monkeypatch):
    """A place that many rows share is one point, so pairs don't grow with its square."""
    rows = [(i, 10.0, 0.0) for i in range(3000)] + [(5000, 10.0001, 0.0), (5001, 370.0, -0.0), (5002, 50.0, 5.0), (5003, float("nan"), 1.0), (5004, float("nan"), 1.0), (5005, None, None)]
    df = spark.createDataFrame(rows, "row_id long, ra double, dec double")
    seen = []
    plain = blending.close_pairs
    monkeypatch.setattr(blending, "close_pairs", lambda d, c: seen.append(plain(d, c).count()) or plain(d, c))
    got = {r.row_id: r.group_id for r in blending.friends_of_friends(df).collect()}
    assert seen == [1] and len(got) == len(rows)
    assert {got[i] for i in [*range(3000), 5000, 5001]} == {0} and all(got[i] == i for i in (5002, 5003, 5004, 5005))
    sized = blending.BlendConfig(match_size=True)
    with pytest.raises(ValueError, match="columns"):
        blending.friends_of_friends(df, sized)
    with pytest.raises(TypeError):
        blending.BlendConfig(match_shape=1).validate()


def test_weights_are_cumulated_in_parts(spark, cat, monkeypatch):
    """The same pixels whatever the parts; uneven and zero weights; as many draws as rows."""
    from skyloom.plans.registry import obs_conditions

    cfg = obs_conditions(spark)
    df = cat.select("row_id", "mag_i_lsst")
    want = {r.row_id: (r.pixel, r.ra, r.decl) for r in obscond.assign_pixels(df, cfg).collect()}
    assert len(want) == cat.count()
    monkeypatch.setattr(obscond, "PART_PIXELS", 100)
    assert {r.row_id: (r.pixel, r.ra, r.decl) for r in obscond.assign_pixels(df, cfg).collect()} == want
    import dataclasses

    nothing = dataclasses.replace(cfg, weight=cfg.weight.withColumn("value", F.lit(0.0)))
    with pytest.raises(ValueError, match="positive weight"):
        obscond.assign_pixels(df, nothing)
    plan = obscond.assign_pixels(df, cfg)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_a_large_sample_is_cut_by_counts(spark, cat, monkeypatch):
    """The same rows as a top-n, and only one part of the draws is put in order."""
    want = {n: {r.row_id for r in sampling.chosen_ids(cat, "row_id", n, 5, "s").collect()} for n in (0, 1, 300, 10**6)}
    monkeypatch.setattr(sampling, "TOP_N", -1)
    for parts in (7, 65_536):
        monkeypatch.setattr(sampling, "PARTS", parts)
        for n, ids in want.items():
            made = sampling.chosen_ids(cat, "row_id", n, 5, "s")
            assert {r.row_id for r in made.collect()} == ids
            assert n == 10**6 or len(ids) == n


def test_downsample(spark, cat):
    a = selections.select(cat, "GAMA", selections.SpecConfig(n_tot=20))
    assert a.count() == 20
    b = {r.row_id for r in selections.select(cat.repartition(5), "GAMA", selections.SpecConfig(n_tot=20)).collect()}
    assert b == {r.row_id for r in a.collect()}
    assert b != {r.row_id for r in selections.select(cat, "GAMA", selections.SpecConfig(n_tot=20, seed=1)).collect()}
    flags = selections.select(cat, "GAMA", selections.SpecConfig(n_tot=20, drop_rows=False))
    assert flags.agg(F.sum("flag")).first()[0] == 20
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        few = selections.SpecConfig(n_tot=10**6, warn_if_fewer=True)
        assert selections.select(cat, "GAMA", few).count() == selections.select(cat, "GAMA", cfg()).count()
    assert any("fewer" in str(w.message) for w in seen)


def test_configuration_errors(spark, cat):
    for bad in (selections.SpecConfig(n_tot=-1), cfg(percentile_cut=101.0), cfg(nan_check="no")):
        with pytest.raises(ValueError):
            selections.select(cat, "GAMA", bad)
    with pytest.raises(ValueError, match="missing"):
        selections.select(cat, "DEEP2", cfg())
    with pytest.raises(ValueError, match="columns"):
        selections.select(cat.drop("mag_r_lsst"), "GAMA", cfg())
    with pytest.raises(ValueError, match="no survey"):
        selections.select(cat, "XYZ", cfg())
    selections.register("mine", lambda c: c.col("r") < 20)
    assert selections.select(cat, "mine", cfg()).count() == cat.where("mag_r_lsst < 20").count()
    del selections.SURVEYS["mine"]


def test_physical_threshold(spark, tmp_path):
    z = np.linspace(0.1, 1.0, 10)
    mass = [11, 12, 13, 14, 11.5, 12.5, 13.5, 10, 14.5, 11]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(z, mass, strict=True)], "redshift double, m double")
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(0.0, 11.0), (1.0, 13.0)], "z double, thresh double").write.parquet(path)
    t = selections.PhysicalThreshold.from_table(catalogs.threshold_table(spark, path), "m")
    got = {r.m for r in selections.desi_physical(df, t).collect()}
    assert got == {float(m) for a, m in zip(z, mass, strict=True) if m > 11 + 2 * a}
    flags = selections.desi_physical(df, selections.PhysicalThreshold("m", t.curve, drop_rows=False))
    assert flags.count() == 10 and flags.agg(F.sum("flag")).first()[0] == len(got)
    with pytest.raises(ValueError, match="zz"):
        selections.desi_physical(df, selections.PhysicalThreshold("zz", t.curve))
    with pytest.raises(ValueError):
        catalogs.threshold_table(spark, f"{path}-none")
    bad = spark.createDataFrame([(0.0, 1.0)], "redshift double, value double")
    with pytest.raises(ValueError):
        selections.PhysicalThreshold.from_table(bad, "m")


# --- degraders ---


def test_inv_redshift(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, -1.0, math.nan, 0.5, *[2.0] * 2000])], "id long, redshift double")
    kept = {r.id for r in degraders.inv_redshift_incompleteness(df, 1.0, "id").collect()}
    assert {0, 3} <= kept and not kept & {1, 2}
    assert abs(len(kept) - 2 - 1000) < 120
    with pytest.raises(ValueError):
        degraders.inv_redshift_incompleteness(df, -1.0, "id")


def test_line_confusion(spark):
    df = spark.createDataFrame([(0.01 * i, i) for i in range(100)], "redshift double, id long")
    out = degraders.line_confusion(df, 3727.0, 5007.0, 0.1, "id")
    both = out.join(df.withColumnRenamed("redshift", "was"), "id").collect()
    changed = [r for r in both if r.redshift != r.was]
    assert len(changed) == 10
    assert all(r.redshift == pytest.approx((1 + r.was) * 3727 / 5007 - 1) and r.redshift >= 0 for r in changed)
    for bad in ((-1.0, 1.0, 0.1), (1.0, -1.0, 0.1), (1.0, 1.0, 1.1)):
        with pytest.raises(ValueError):
            degraders.line_confusion(df, *bad, "id")
    with pytest.raises(ValueError, match="only"):
        degraders.line_confusion(df, 3727.0, 5007.0, 0.9, "id")


def test_grid_selection_errors_and_exact_numbers(spark, cat):
    ratios = spark.range(4).selectExpr("cast(id div 2 as int) iy", "cast(id % 2 as int) ix", "0.5e0 ratio")
    c = grid.GridConfig(ratios, 2, 2, "mag_i_lsst", "mag_g_lsst", (0.0, 100.0), (0.0, 100.0), color_redshift_cut=False)
    n = cat.count()
    assert abs(grid.grid_selection(cat, c).count() - n // 2) <= 1
    from dataclasses import replace

    flags = grid.grid_selection(cat, replace(c, drop_rows=False))
    assert flags.count() == n and abs(flags.agg(F.sum("flag")).first()[0] - n // 2) <= 1
    assert grid.grid_selection(cat, replace(c, x_limits=(0.0, 1.0))).count() == 0
    for bad in ({"redshift_cut": -1.0}, {"percentile_cut": 101.0}, {"color_redshift_cut": True}):
        with pytest.raises(ValueError):
            grid.grid_selection(cat, replace(c, **bad))


# --- noise ---


def test_errors_shrink_with_brightness_and_are_unbiased(spark, cat):
    p = errors.preset("LSSTErrorModel", rename={b: f"mag_{b}_lsst" for b in "ugrizy"})
    out = errors.add_errors(cat, p)
    assert out.columns == cat.columns + [f"{m}_err" for m in MAGS]
    both = out.select("row_id", F.col("mag_i_lsst").alias("m"), F.col("mag_i_lsst_err").alias("e")).join(cat.select("row_id", F.col("mag_i_lsst").alias("t")), "row_id")
    pdf = both.where("t < 24").toPandas()
    pull = (pdf.m - pdf.t) / pdf.e
    assert abs(pull.mean()) < 4 / math.sqrt(len(pull)) and 0.85 < pull.std() < 1.15
    assert pdf[pdf.t < 20].e.mean() < pdf[pdf.t > 23].e.mean()
    again = errors.add_errors(cat.repartition(9), p).agg(F.sum("mag_u_lsst")).first()[0]
    assert again == pytest.approx(out.agg(F.sum("mag_u_lsst")).first()[0], rel=1e-9)
    quiet = errors.add_errors(cat, p, noiseless=True)
    assert quiet.agg(F.sum("mag_u_lsst")).first()[0] == pytest.approx(cat.agg(F.sum("mag_u_lsst")).first()[0])
    from dataclasses import replace

    lost = errors.add_errors(cat, replace(p, sigma_limit=5.0, nd_value=99.0))
    assert lost.where("mag_u_lsst = 99").count() > 0
    wide = errors.add_errors(cat.selectExpr("*", "size major", "size minor"), replace(p, extended="gaap"), noiseless=True)
    assert wide.agg(F.avg("mag_i_lsst_err")).first()[0] > quiet.agg(F.avg("mag_i_lsst_err")).first()[0]
    with pytest.raises(ValueError):
        errors.preset("none")
    with pytest.raises(ValueError):
        replace(p, extended="x").validate()


def test_every_preset_runs(spark):
    for name, p in errors.PRESETS.items():
        df = spark.createDataFrame([(1, *[22.0] * len(p.bands))], ["row_id", *p.bands])
        r = errors.add_errors(df, p, noiseless=True).first()
        assert all(0 < r[f"{b}_err"] < 1 for b in p.bands), name


def test_observing_conditions(spark, cat):
    from dataclasses import replace

    from skyloom.plans.registry import obs_conditions

    c = obs_conditions(spark)
    out = obscond.with_conditions(cat, c)
    assert {"pixel", "mag_i_lsst_err"} <= set(out.columns) and out.count() == cat.count()
    pixels = {r.pixel for r in out.select("pixel").distinct().collect()}
    assert -99 in pixels and len(pixels) > 2
    bare = cat.drop("ra", "dec")
    drawn = obscond.with_conditions(bare, c)
    assert {"ra", "decl", "pixel"} <= set(drawn.columns) and drawn.count() == cat.count()
    again = obscond.assign_pixels(drawn.drop("pixel").withColumnRenamed("decl", "dec"), c).select("row_id", F.col("pixel").alias("p"))
    assert drawn.join(again, "row_id").where("pixel != p").count() == 0
    assert "pixel" not in obscond.with_conditions(cat, replace(c, maps={})).columns
    bad = [{"nside": 3}, {"nside": -1}, {"maps": {"nothing": 1.0}}, {"maps": {"m5": {}}}, {"maps": {"m5": 1.0}}, {"mask": None}]
    for b in bad:
        with pytest.raises(ValueError):
            replace(c, **b).validate()
    for b in ({"years": 5}, {"maps": {"airmass": "x"}}, {"maps": {"m5": {"i": "x"}}}):
        with pytest.raises(TypeError):
            replace(c, **b).validate()


def test_scatter(spark, cat):
    out = scatter.scatter(cat, "row_id", "mag_i_lsst", "redshift")
    pdf = out.select("redshift", "photoz_mock").toPandas()
    assert pdf.photoz_mock.between(0, 6).all()
    d = pdf.photoz_mock - pdf.redshift
    assert abs(d.median()) < 0.02 and 0.02 < d.std() < 0.6
    odd = spark.createDataFrame([(1, math.nan, 1.0), (2, 20.0, -1.0), (3, 20.0, 9.0)], "row_id long, mag_i double, z double")
    got = {r.row_id: r.photoz_mock for r in scatter.scatter(odd, "row_id").collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and got[3] == 6.0
    q = np.array(scatter.skew_t_quantiles(2.0, 2.0))
    assert q[len(q) // 2] == pytest.approx(0, abs=1e-3) and (np.diff(q) > 0).all()
    # a = b = nu / 2 is Student's t with nu degrees of freedom: quantile of 0.75 for nu = 4
    assert q[3 * len(q) // 4] == pytest.approx(0.7407, abs=2e-3)


def test_igm(spark, cat):
    w = rates.FILTERS["u"][0]
    tau = igm.OpticalDepth(w)
    for z in (0.5, 1.5, 2.5, 5.0):
        t = tau(np.array([z]))[0]
        assert (t >= 0).all() and (t[w > (1 + z) * 1216] == 0).all()
    # Lyman alpha forest alone just under the line: A x^p
    at = np.array([1215.67 * 2.9])
    x = at / 1215.67
    first = 2.354e-3 * x**3.7 + 1.617e-4 * x**2
    others = [1025.72, 972.537]
    assert igm.optical_depth(at, 2.0)[0] >= first[0] and others
    conf = igm.IGMConfig({"mag_u_lsst": rates.FILTERS["u"], "mag_g_lsst": rates.FILTERS["g"]}, out_of_grid="exact")
    from dataclasses import replace

    near = igm.igm_extinction(cat, conf).select("row_id", F.col("mag_u_lsst").alias("a"))
    exact = igm.igm_extinction(cat, replace(conf, interpolate=False)).select("row_id", F.col("mag_u_lsst").alias("b"))
    both = near.join(exact, "row_id").join(cat, "row_id")
    assert both.where("a < mag_u_lsst - 1e-9").count() == 0
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 0.05
    dark = igm.igm_extinction(cat.where("redshift < 1.4"), replace(conf, out_of_grid="inf"))
    assert dark.where(F.col("mag_u_lsst") < float("inf")).count() == 0
    with pytest.raises(ValueError):
        replace(conf, filters={}).validate()


# --- blending ---


def brute_groups(rows, link):
    """Closure of pairs by comparing all rows."""
    label = {i: i for i, _, _ in rows}
    rad = math.radians

    def near(a, b):
        h = math.sin(rad(b[2] - a[2]) / 2) ** 2 + math.cos(rad(a[2])) * math.cos(rad(b[2])) * math.sin(rad(b[1] - a[1]) / 2) ** 2
        return math.degrees(2 * math.asin(math.sqrt(min(1, h)))) <= link / 3600

    pairs = [(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if near(a, b)]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


@pytest.mark.parametrize("where", ["patch", "wrap", "pole", "south", "sphere"])
def test_friends_of_friends(spark, where):
    r = np.random.default_rng(3)
    n = 250
    if where == "patch":
        ra, dec, link = r.uniform(0, 0.02, n), r.uniform(0, 0.02, n), 2.0
    elif where == "wrap":
        ra, dec, link = r.uniform(-0.01, 0.01, n) % 360, r.uniform(59.99, 60.0, n), 2.0
    elif where == "pole":
        ra, dec, link = r.uniform(0, 360, n), 90 - np.abs(r.normal(0, 0.01, n)), 4.0
    elif where == "south":
        ra, dec, link = r.uniform(0, 360, n), -90 + np.abs(r.normal(0, 0.01, n)), 4.0
    else:
        ra, dec, link = r.uniform(0, 360, n), np.degrees(np.arcsin(r.uniform(-1, 1, n))), 3 * 3600.0
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(ra, dec, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, ra double, dec double")
    got = {x.row_id: x.group_id for x in blending.friends_of_friends(df, blending.BlendConfig(linking_length=link)).collect()}
    want = brute_groups(rows, link)
    assert got == want and len(set(want.values())) < n


@pytest.mark.parametrize("gathered", [10**6, 0])
def test_crowded_points_make_few_links(spark, monkeypatch, gathered):
    """Links are about as many as the points where each has hundreds of partners; groups are as by comparing all."""
    monkeypatch.setattr(blending, "GATHERED", gathered)
    r = np.random.default_rng(5)
    n = 600
    clump = r.integers(0, 4, (2, n)) * 3.1e-4  # four by four clumps, 1.1 arcsec apart, and bridges between some
    ra, dec = 10 + clump[0] + r.normal(0, 8e-6, n), clump[1] + r.normal(0, 8e-6, n)
    ra[:40], dec[:40] = 10 + r.uniform(0, 0.02, 40), r.uniform(-0.01, 0.01, 40)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(ra, dec, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, ra double, dec double")
    assert blending.close_pairs(df, blending.BlendConfig()).count() < 2 * n
    got = {x.row_id: x.group_id for x in blending.friends_of_friends(df).collect()}
    assert got == brute_groups(rows, 1.0)


def test_crowded_cells_are_halved():
    """Two cells of many points: one pair near enough is found, and none if all lie farther apart."""
    r = np.random.default_rng(1)
    n, link = 20_000, 1 / 3600
    ra, dec = 10 + r.normal(0, 1e-7, 2 * n), r.normal(0, 1e-7, 2 * n)
    ra[n:] += link + 4e-6
    near = blending._Near(ra, dec, blending._unit(ra, dec), link)
    i, j = np.arange(n), np.arange(n, 2 * n)
    assert not near.sets(i, j)
    ra[-1] = ra[:n].max() + link * 0.99
    near = blending._Near(ra, dec, blending._unit(ra, dec), link)
    assert near.sets(i, j) and near.sets(j, i)


def test_unrecognized_blends(spark, cat):
    out = blending.unrecognized_blends(cat)
    merged, comp = out["output"], out["components"]
    assert comp.count() == cat.count() and {"row_id", "group_id", "hpx_idx"} == set(comp.columns)
    assert merged.count() == comp.select("group_id").distinct().count()
    assert merged.agg(F.sum("n_obj")).first()[0] == cat.count()
    assert merged.where("n_obj = 1 and z_stdev != 0").count() == 0
    with pytest.raises(ValueError):
        blending.BlendConfig(linking_length=0).validate()
    with pytest.raises(ValueError):
        blending.BlendConfig(ref_band="x").validate()


# --- sources ---


def test_source_sample(spark, cat):
    a = catalogs.source_sample(cat, 50, "row_id")
    assert a.columns == list(catalogs.DEFAULT_QUANTITIES) and a.count() == 50
    assert a.where("mag_i_lsst >= 26.5").count() == 0
    assert catalogs.source_sample(cat, 5, "row_id", ["redshift"], None).columns == ["redshift"]
    with pytest.raises(ValueError, match="only"):
        catalogs.source_sample(cat, 10**6, "row_id")


def test_text_tables(spark, tmp_path):
    (tmp_path / "f.res").write_text("# curve\n3000 0.5\n\n 3010   1.0 # top\n")
    curve = catalogs.filter_curve(spark, f"file://{tmp_path}/f.res")
    w, t = catalogs.curve_arrays(curve)
    assert w.tolist() == [3000.0, 3010.0] and t.tolist() == [0.5, 1.0]
    with pytest.raises(FileNotFoundError):
        catalogs.filter_curve(spark, f"file://{tmp_path}/none.res")
    assert catalogs.matrix_table(spark, np.eye(2)).count() == 4
    with pytest.raises(ValueError):
        catalogs.matrix_table(spark, np.zeros(3))
    with pytest.raises(ValueError):
        catalogs.read_catalog(spark, "x", "fits")
    catalogs.register_reader("range", lambda s, p: s.range(int(p)))
    assert catalogs.read_catalog(spark, "7", "range").count() == 7
    del catalogs.READERS["range"]

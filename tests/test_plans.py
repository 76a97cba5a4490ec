import pytest
from pyspark.sql import functions as F

from skyloom.operators import blending, selections
from skyloom.plans import pipelines, registry
from skyloom.sources import rates
from skyloom.sources.catalog_view import catalog
from skyloom.streaming.stateless import run_stream, select_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


#: Cheap queries of every kind; all of them are compared at a larger scale by the driver.
COMPARED = ["source_sample", "hyperbolic_smoothing", "redden", "moments_ab", "spec_boss", "spec_vvds", "spec_zcosmos", "grid_selection", "line_confusion", "obs_condition", "fof_groups"]


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_oracle(spark, duck, name):
    a = registry.QUERIES[name](spark, SF).toPandas()
    b = duck.sql(registry.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b) > 0
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind == "f":
            assert ((a[c] == b[c]) | ((a[c] - b[c]).abs() < 2e-6)).all(), c  # infinities are equal
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_all_queries_have_oracles():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_filters_and_columns_reach_the_scan(spark):
    df = catalog(spark, SF)
    cfg = selections.SpecConfig(downsample=False, nan_check="used")
    spark.conf.set("spark.sql.maxMetadataStringLength", 20_000)  # lists aren't cut short
    plan = selections.select(df, "DESI_BGS", cfg).select("row_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(mag_r_lsst,19.5)" in plan
    assert "shape_xx" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("parallel", [False, True])
@pytest.mark.parametrize("blend", [False, True])
def test_truth_to_observed_wiring(spark, parallel, blend):
    cfg = registry.pipeline_config(spark, parallel=parallel, blend=blending.BlendConfig() if blend else None, models_to_select=("lsst",))
    p = pipelines.truth_to_observed(cfg)
    assert p.describe() == pipelines.truth_to_observed(cfg).describe()
    assert ("blend" in p.steps) == blend
    assert {"select_GAMA_lsst", "select_DESI_BGS_lsst"} <= set(p.steps)
    assert p.steps["errors_lsst"][1] == (("blend",) if blend else ("redden",))
    if not blend:
        made = p.run(catalog(spark, SF, columns=["ra", "dec", "redshift", *registry.MAGS]))
        assert made["select_DESI_BGS_lsst"].count() > 0


def test_pipeline_errors():
    p = pipelines.Pipeline().add("a", lambda t: t, "input")
    with pytest.raises(ValueError):
        p.add("a", lambda t: t, "input")
    with pytest.raises(ValueError):
        p.add("b", lambda t: t, "nothing")


def test_phot_errors_in_series_and_parallel(spark):
    for parallel in (False, True):
        p = pipelines.apply_phot_errors(registry.pipeline_config(spark, parallel=parallel))
        made = p.run(catalog(spark, SF, columns=["ra", "dec", *registry.MAGS]))
        out = made["deredden_lsst" if parallel else "deredden"]
        assert {f"{m}_err" for m in registry.MAGS} <= set(out.columns)


def test_stream_gives_the_rows_of_a_batch(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    catalog(spark, SF).repartition(4).write.parquet(path)
    cfg = selections.SpecConfig(downsample=False, rates=rates.rates(spark))
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    for survey in ("BOSS", "DEEP2", "zCOSMOS"):
        out = f"file://{tmp_path}/{survey}"
        q = run_stream(stream, lambda s, n=survey: select_stream(s, n, cfg), out, f"{out}-checkpoint")
        assert q.awaitTermination(120)
        got = spark.read.parquet(out).agg(F.count("row_id"), F.sum("row_id")).first()
        assert got == selections.select(batch, survey, cfg).agg(F.count("row_id"), F.sum("row_id")).first()
    with pytest.raises(ValueError):
        select_stream(stream, "GAMA", selections.SpecConfig())
    with pytest.raises(ValueError):
        select_stream(stream, "HSC", selections.SpecConfig(downsample=False, percentile_cut=50.0))

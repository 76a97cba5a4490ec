"""A deterministic galaxy catalog over the rows of a table, in arithmetic that SQL shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.draws import uniform
from skyloom.sources.shared import materialize

SEED = 7
#: Columns as formulas of draws u(stream) and of columns before them: valid in Spark SQL and in DuckDB.
FORMULAS = {
    "redshift": "3.0e0 * u(z)",
    "mag_i_lsst": "16.0e0 + 10.0e0 * u(i)",
    "mag_r_lsst": "mag_i_lsst + 1.2e0 * u(ri)",
    "mag_g_lsst": "mag_r_lsst + 1.4e0 * u(gr) + 0.2e0 * redshift - 0.2e0",
    "mag_u_lsst": "mag_g_lsst + 0.8e0 * u(ug) + 0.3e0",
    "mag_z_lsst": "mag_i_lsst - 0.6e0 * u(iz)",
    "mag_y_lsst": "mag_z_lsst - 0.3e0 * u(zy)",
    "W1": "mag_z_lsst - 1.0e0 - 2.0e0 * u(w1)",
    "ra": "10.0e0 + 0.4e0 * u(ra)",
    "dec": "-0.2e0 + 0.4e0 * u(dec)",
    "size": "0.5e0 + 2.0e0 * u(size)",
    "ellipticity": "0.95e0 * u(ell)",
    "size_bulge_true": "0.2e0 + u(sb)",
    "size_disk_true": "0.4e0 + 1.5e0 * u(sd)",
    "size_true": "0.3e0 + 2.0e0 * u(st)",
    "size_minor_true": "size_true * (0.2e0 + 0.8e0 * u(sm))",
    "bulge_to_total_ratio": "u(bt)",
    "shape_xx": "0.2e0 + u(xx)",
    "shape_yy": "0.2e0 + u(yy)",
    "shape_xy": "0.3e0 * u(xy) - 0.15e0",
    "log_mass": "10.0e0 + 5.0e0 * u(mass)",
    "mag_err_u_lsst": "0.01e0 + 0.2e0 * u(eu)",
    "mag_err_g_lsst": "0.01e0 + 0.2e0 * u(eg)",
    "mag_err_r_lsst": "0.01e0 + 0.2e0 * u(er)",
    "mag_err_i_lsst": "0.01e0 + 0.2e0 * u(ei)",
    "mag_err_z_lsst": "0.01e0 + 0.2e0 * u(ez)",
    "mag_err_y_lsst": "0.01e0 + 0.2e0 * u(ey)",
}


def _ordered(names: list[str]) -> list[str]:
    """The columns asked for and those they need, in the order of formulas."""
    need = set(names)
    for n in reversed(list(FORMULAS)):
        if n in need:
            need |= {m for m in FORMULAS if m != n and m in FORMULAS[n]}
    return [n for n in FORMULAS if n in need]


def derived(spark: SparkSession, sf_dir: str, table: str = "orders", key: str = "o_orderkey", columns: list[str] | None = None) -> DataFrame:
    """row_id and the columns asked for (all by default), a row for every row of the table, as a lazy view."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("row_id"))
    names = columns or list(FORMULAS)
    for n in _ordered(names):
        text, draws = FORMULAS[n], {}
        for part in text.split("u(")[1:]:
            draws[part.split(")")[0]] = None
        for s in draws:
            df = df.withColumn(f"__{s}", uniform(F.col("row_id"), SEED, s))
            text = text.replace(f"u({s})", f"__{s}")
        df = df.withColumn(n, F.expr(text)).drop(*[f"__{s}" for s in draws])
    return df.select("row_id", *names)


#: Tables of the present session.
_written: dict[tuple[str, str, str], DataFrame] = {}


def catalog(spark: SparkSession, sf_dir: str, table: str = "orders", key: str = "o_orderkey", columns: list[str] | None = None) -> DataFrame:
    """The derived catalog as a stored table, written once a session and table to the shared folder.

    Operators get a table as users have it: a scan that columns and filters are pushed into.
    """
    at = (spark.sparkContext.applicationId, sf_dir, table)
    if at not in _written:
        for old in [k for k in _written if k[0] != at[0]]:
            del _written[old]
        # As many files as cores, so that scans of the table use all of them.
        spread = derived(spark, sf_dir, table, key).repartition(spark.sparkContext.defaultParallelism)
        _written[at] = materialize(spread, f"catalog-{table}")
    return _written[at].select("row_id", *(columns or list(FORMULAS)))


def draw_sql(stream: str, seed: int, row_id: str = "row_id", first: int = 1) -> str:
    """A keyed draw in DuckDB's SQL, from the digest's hex digits from ``first`` on."""
    return f"(('0x' || substr(md5(CAST({row_id} AS VARCHAR) || '|{seed}|{stream}'), {first}, 8))::BIGINT / 4294967296.0::DOUBLE)"


def catalog_sql(table: str = "orders", key: str = "o_orderkey", columns: list[str] | None = None) -> str:
    """The same catalog as a DuckDB query."""
    names = columns or list(FORMULAS)
    out = f"SELECT CAST({key} AS BIGINT) AS row_id FROM {table}"
    for n in _ordered(names):
        text = FORMULAS[n]
        for part in text.split("u(")[1:]:
            s = part.split(")")[0]
            text = text.replace(f"u({s})", draw_sql(s, SEED))
        out = f'SELECT *, {text} AS "{n}" FROM ({out})'
    chosen = ", ".join(f'"{n}"' for n in names)
    return f"SELECT row_id, {chosen} FROM ({out})"

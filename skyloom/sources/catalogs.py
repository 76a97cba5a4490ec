"""Readers of catalogs and of the small tables that operators look values up in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.numeric import require
from skyloom.operators.sampling import sample_n

DEFAULT_FILTERS = ("mag_i_lsst < 26.5",)
DEFAULT_QUANTITIES = ("redshift", *(f"mag_{b}_lsst" for b in "ugrizy"), "size_true", "size_minor_true")

#: Formats by name; a function from (session, path) to a table.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": lambda s, p: s.read.parquet(p),
    "orc": lambda s, p: s.read.orc(p),
    "json": lambda s, p: s.read.json(p),
    "csv": lambda s, p: s.read.option("header", True).option("inferSchema", True).csv(p),
}


def register_reader(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[name] = reader


def read_catalog(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no reader {kind}; there are {', '.join(READERS)}")
    return READERS[kind](spark, path)


def source_sample(
    catalog: DataFrame,
    n_samples: int,
    row_id: str,
    quantities: Sequence[str] = DEFAULT_QUANTITIES,
    filters: Sequence[str] | None = DEFAULT_FILTERS,
    seed: int = 42,
) -> DataFrame:
    """Exactly ``n_samples`` rows that pass the filters (SQL texts), without replacement, with these columns in this order.

    Asking for more rows than pass is an error. Filters and columns reach the scan.
    """
    require(catalog, [row_id, *quantities])
    rows = catalog
    for f in filters or ():
        rows = rows.where(F.expr(f))
    rows = rows.select(row_id, *[q for q in quantities if q != row_id])
    found = rows.limit(n_samples).count()
    if found < n_samples:
        raise ValueError(f"{n_samples} rows are asked for, but only {found} pass the filters")
    return sample_n(rows, row_id, n_samples, seed, "source").select(*quantities)


def text_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A text file of numbers in white-space columns, with ``#`` comments, as doubles. Missing files are an error of the scan."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).where("v != ''")
    parts = F.split("v", r"\s+")
    return lines.select(*[parts[i].cast("double").alias(c) for i, c in enumerate(columns)])


def filter_curve(spark: SparkSession, path: str) -> DataFrame:
    """Wavelength and transmission of a filter file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(f"there is no filter file {path}")
    return text_table(spark, path, ["wavelength", "transmission"])


def curve_arrays(curve: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A filter curve as arrays on the driver; curves have a few thousand points."""
    rows = curve.orderBy("wavelength").toPandas()
    return rows["wavelength"].to_numpy(float), rows["transmission"].to_numpy(float)


def matrix_table(spark: SparkSession, matrix: np.ndarray, value: str = "rate") -> DataFrame:
    """A matrix as rows (iy, ix, value)."""
    m = np.asarray(matrix, float)
    if m.ndim != 2:
        raise ValueError("a matrix has two dimensions")
    rows = [(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, f"iy int, ix int, {value} double")


def threshold_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with z and thresh."""
    try:
        table = spark.read.parquet(path)
    except Exception as e:
        raise ValueError(f"the threshold table {path} can't be read") from e
    require(table, ["z", "thresh"])
    return table

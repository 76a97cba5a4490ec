"""Helpers that several operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stands for a null doc_id where a key is needed: it sorts before every id, and
#: rows without an id count as one document of that id.
NULL_ID = -(2**63)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs
    in one process, as in tests, a temporary folder is made and set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="skyloom-")
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts lineage: a lost executor costs a read, not a recomputation.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def gapless_rank(df: DataFrame, group: str, order: list[str], out: str, buckets: int) -> DataFrame:
    """Number the rows of every group from 0 without gaps, whatever a group's size.

    Rows of a group are dealt to ``buckets`` parts by a hash of ``order``, numbered
    inside each part, and shifted by the sizes of the parts before. The table of shifts
    has at most (groups x buckets) rows, so callers with a bounded number of groups may
    have it broadcast; no task ever holds a whole group. The order of numbers is (part,
    ``order``): it depends on the rows alone, not on how they are partitioned.
    """
    cut = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(group, "__part").orderBy(*order)
    numbered = cut.withColumn("__at", F.row_number().over(inside) - 1)
    return (
        numbered.join(F.broadcast(shifts), [group, "__part"])
        .withColumn(out, (F.col("__at") + F.col("__shift")).cast("long"))
        .drop("__part", "__at", "__shift")
    )

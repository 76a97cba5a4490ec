"""Exact-n samples without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.draws import uniform


#: Up to so many rows, a sample is a plain top-n; beyond, the cut is found in PARTS equal parts of the draws first.
TOP_N, PARTS = 100_000, 65_536


def chosen_ids(df: DataFrame, row_id: str, n: int, seed: int, stream: str, where: Column | None = None) -> DataFrame:
    """The ids of exactly n rows (or of all, if fewer): the least draws, ties by id.

    A small n is a top-n, which keeps n rows a task and merges them. A large one first counts the
    rows by PARTS equal parts of the draws (as many counts at most come to the driver): rows in
    the parts below the cut are taken by a filter, and only the cut's part, a PARTS-th of the
    rows, is put in order.
    """
    rows = df if where is None else df.where(where)
    ids = rows.select(F.col(row_id), uniform(F.col(row_id), seed, stream).alias("__u"))
    if n <= TOP_N:
        return ids.orderBy("__u", row_id).limit(n).select(row_id)
    part = F.floor(F.col("__u") * PARTS).cast("int")
    counts = ids.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    below = 0
    for r in counts:
        if below + r["n"] > n:
            rest = ids.where(part == r["p"]).orderBy("__u", row_id).limit(n - below)
            return ids.where(part < r["p"]).union(rest).select(row_id)
        below += r["n"]
    return ids.select(row_id)


def sample_n(df: DataFrame, row_id: str, n: int, seed: int, stream: str = "sample") -> DataFrame:
    return df.join(chosen_ids(df, row_id, n, seed, stream), row_id, "left_semi").select(df.columns)


def mark(df: DataFrame, ids: DataFrame, row_id: str, name: str) -> DataFrame:
    """Add a boolean column: whether the row's id is among ``ids``."""
    flagged = ids.select(F.col(row_id), F.lit(True).alias(name))
    return df.join(flagged, row_id, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))

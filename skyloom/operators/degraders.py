"""Spectroscopic degraders: inverse-redshift incompleteness and line confusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.draws import uniform
from skyloom.functions.numeric import gt, require
from skyloom.operators.sampling import chosen_ids, mark


def inv_redshift_incompleteness(
    df: DataFrame, pivot_redshift: float, row_id: str, redshift: str = "redshift", seed: int = 42, drop_rows: bool = True
) -> DataFrame:
    """Keep a row with chance clip(pivot / z, 0, 1): always at z = 0, never below 0 or for NaN.

    With ``drop_rows`` false, all rows stay and get flag 0 or 1.
    """
    if pivot_redshift < 0:
        raise ValueError("pivot_redshift must not be negative")
    require(df, [row_id, redshift])
    z = F.col(redshift)
    chance = F.when(z == 0, 1.0).when(z < 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.lit(float(pivot_redshift)), z))))
    keep = F.coalesce(~F.isnan(z) & (uniform(F.col(row_id), seed, "inv_redshift") <= chance), F.lit(False))
    return df.where(keep) if drop_rows else df.withColumn("flag", keep.cast("int"))


def line_confusion(
    df: DataFrame,
    true_wavelen: float,
    wrong_wavelen: float,
    frac_wrong: float,
    row_id: str,
    redshift: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Give exactly int(frac x rows) redshifts the value of a misread line.

    Rows are drawn among those that stay above z = 0 (z > wrong / true - 1); too few of
    these is an error. The redshift column is the first one unless it is named.
    """
    if true_wavelen < 0 or wrong_wavelen < 0:
        raise ValueError("wavelengths must not be negative")
    if not 0 <= frac_wrong <= 1:
        raise ValueError("frac_wrong must be between 0 and 1")
    name = redshift or df.columns[0]
    require(df, [row_id, name])
    eligible = gt(F.col(name), wrong_wavelen / true_wavelen - 1)
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(eligible).alias("m")).first()
    n = int(frac_wrong * counts["n"])
    if n > counts["m"]:
        raise ValueError(f"{n} rows are to be changed, but only {counts['m']} can be")
    ids = chosen_ids(df, row_id, n, seed, "line_confusion", eligible)
    z = F.col(name)
    wrong = (1.0 + z) * true_wavelen / wrong_wavelen - 1.0
    return mark(df, ids, row_id, "__wrong").withColumn(name, F.when(F.col("__wrong"), wrong).otherwise(z)).select(df.columns)

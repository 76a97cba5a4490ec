"""Row-wise operators on streams.

Predicates, projections and noise are column expressions with keyed draws, so a stream
gives the rows that a batch over the same input gives, in any micro-batches. Exact samples,
percentile cuts and blending need all rows and are refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skyloom.operators import selections


def select_stream(stream: DataFrame, survey: str, cfg: selections.SpecConfig) -> DataFrame:
    """A selection on a stream; ``downsample`` and a percentile cut aren't possible."""
    if cfg.downsample:
        raise ValueError("an exact number of rows can't be drawn from a stream: set downsample=False")
    if cfg.percentile_cut != 100:
        raise ValueError("percentiles of a cell need all rows: set percentile_cut=100")
    return selections.select(stream, survey, replace(cfg))


def run_stream(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply a row-wise step and append Parquet files, exactly once, until the input is used up."""
    return (
        step(stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )

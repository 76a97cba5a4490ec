"""Random draws keyed on a row's id.

A draw depends on (id, seed, stream) alone, so results don't change with partitioning,
order or repeated tasks, and SQL can state them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(row_id: Column, seed: int, stream: str | Column) -> Column:
    return F.md5(F.concat_ws("|", row_id.cast("string"), F.lit(str(seed)), stream if isinstance(stream, Column) else F.lit(stream)))


def _draw(digest: Column, first: int) -> Column:
    """8 hex digits of a digest, over 2^32."""
    return F.conv(F.substring(digest, first, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(row_id: Column, seed: int, stream: str | Column) -> Column:
    """A draw from [0, 1): the first 8 hex digits of an md5, over 2^32."""
    return _draw(_digest(row_id, seed, stream), 1)


def normal(row_id: Column, seed: int, stream: str | Column) -> Column:
    """A standard normal draw by the Box-Muller transform of two uniforms of one md5; u = 0 counts as 2^-33."""
    digest = _digest(row_id, seed, stream)
    u1, u2 = F.greatest(_draw(digest, 1), F.lit(2.0**-33)), _draw(digest, 9)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)

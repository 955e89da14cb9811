"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from spanforge.session import checkpointed as cut

__all__ = ["cut", "cut_small", "packed"]

#: Rows of a table of ids that one task takes.
ROWS = 200_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as so many narrow rows need, at most: small tables don't make a file for each of all shuffle partitions."""
    return df.coalesce(max(1, math.ceil(rows / ROWS)))


def cut_small(df: DataFrame) -> DataFrame:
    """df, a table of narrow rows, cut and packed."""
    df = cut(df)
    return packed(df, df.count())

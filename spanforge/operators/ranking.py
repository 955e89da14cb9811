"""Places of rows in an order, over all rows of a group, without any task that holds a whole group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import checkpointed

#: Rows of one range.
ROWS = 500_000


def ranked(df: DataFrame, by: Sequence[Column | str], within: Sequence[str] = (), out: str = "rank", rows: int = ROWS) -> DataFrame:
    """df with out, long: each row's place, from 0, in the order of `by` among the rows that are equal in `within`.

    Rows are dealt by ranges of (within, by) and sorted there; the counts of each range, summed over the ranges before it, give
    where a range begins. So a group of any size is spread over as many tasks as its rows need, and what is summed is one
    row for each range and group in it. Ties get places of their own; which of them comes first is set by where the rows
    lie in df. Nulls come first, as Spark sorts them, and count as equal in `within`. An empty df gives no rows.

    The rows are written twice to the shared folder, as ranges are drawn from a sample and have to stay as they are: hand in
    narrow rows and join what is wide.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in by]
    kept = checkpointed(df.withColumn("__row", F.monotonically_increasing_id()))
    ranges = max(1, math.ceil(kept.count() / rows))
    keys = [*(F.col(c) for c in within), *order, F.col("__row")]
    # A row's number tells its range (the upper bits) and its place there (the lower 33).
    placed = checkpointed(kept.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("__row").withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    groups = [F.col(c).alias(f"__in{k}") for k, c in enumerate(within)]
    starts = placed.groupBy(F.col("__range").alias("__of"), *groups).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*(f"__in{k}" for k in range(len(within)))).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__of", "__first", *(f"__in{k}" for k in range(len(within))), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__range") == F.col("__of")
    for k, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"__in{k}"))
    joined = placed.join(starts, same)
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__at") - F.col("__first") + F.col("__before")).alias(out))

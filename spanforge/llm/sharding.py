"""Sharding by jump consistent hashing.

A row's shard is a function of its key and of the number of shards alone: from shard 0 the key, as the seed of a linear
congruential generator, jumps ahead to the next shard that would have taken it when shards were added one by one, and the
last jump that stays below the number of shards counts. There is no ring table, nothing to fit and nothing to shuffle;
with one more shard, about one row in (shards + 1) moves, and only into the new one.

Slots number the rows of a shard without gaps, ordered by key, size and checksum of the text, by ranges and prefix counts
(``spanforge.operators.ranking``), so that no task holds a whole shard, however many rows share a key.

Defined cases: keys of integer types are taken as they are, others by their xxhash64; a null key counts as 0, and so does the
checksum of a null text, whose size is 8; equal keys share a shard, repeated rows too, each with a slot of its own; an empty
table gives an empty result; texts of any length are measured inside their row; other columns are ignored by the report and
kept, whatever their names, by ``with_shard`` and ``write_shards``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from spanforge.operators.ranking import ranked

SHARDS = 24
MULTIPLIER = 2862933555777941757
#: Rows of one output file.
FILE_ROWS = 500_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    if shards < 1:
        raise ValueError("there has to be a shard")
    state = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        state[moving] = state[moving] * np.uint64(MULTIPLIER) + np.uint64(1)
        ahead = np.floor((out[moving] + 1) * (2.0**31 / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1)))
        inside = ahead < shards
        moving = moving[inside]
        out[moving] = ahead[inside].astype(np.int64)
    return out


def _hashed(df: DataFrame, key: str) -> Column:
    column = F.col(f"`{key}`")
    whole = isinstance(df.schema[key].dataType, IntegralType)
    return F.coalesce(column.cast("long"), F.lit(0).cast("long")) if whole else F.when(column.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(column))


def with_shard(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, out: str = "shard") -> DataFrame:
    """df with the shard of each row, int; no shuffle."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards), dtype="int32")

    return df.withColumn(out, shard(_hashed(df, key)))


def write_shards(df: DataFrame, folder: str, key: str = "doc_id", shards: int = SHARDS, rows: int = FILE_ROWS) -> None:
    """The rows of df as parquet below folder, one folder `shard=<n>` for each shard, in files of about so many rows.

    Rows are dealt by ranges of (shard, hash of the key, the row's number), so a shard or key with most of the rows is spread
    over as many tasks and files as the others together. The new column replaces none: a column named shard is an error.
    """
    if "shard" in df.columns:
        raise ValueError("df has a column named shard")
    files = max(shards, -(-df.count() // rows))
    numbered = with_shard(df, key, shards).withColumn("__row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(files, "shard", F.xxhash64(F.col(f"`{key}`")), "__row")
    dealt.drop("__row").write.partitionBy("shard").parquet(folder)


def shard_report(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: where each row goes, and where with one more shard."""
    body = F.coalesce(F.encode(F.col(f"`{text}`"), "UTF-8"), F.lit(b""))
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = with_shard(with_shard(rows, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    slots = ranked(placed, ["doc_id", "size", "text_crc32"], within=["shard"], out="slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

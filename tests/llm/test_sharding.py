"""Jump hashing against its definition, one key at a time, and what shards promise."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm.sharding import jump, shard_report, with_shard, write_shards


def one(key, shards):
    state, at, ahead = key % 2**64, -1, 0
    while ahead < shards:
        at = ahead
        state = (state * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return at


def test_jump_by_definition():
    keys = np.array([*range(-50, 200), 2**63 - 1, -(2**63), 10**15], np.int64)
    for shards in (1, 2, 24, 25, 1000):
        assert jump(keys, shards).tolist() == [one(int(k), shards) for k in keys]
    with pytest.raises(ValueError):
        jump(keys, 0)


def test_growth_moves_rows_into_the_new_shard_only():
    keys = np.arange(50_000)
    for shards in (1, 7, 24, 99):
        old, new = jump(keys, shards), jump(keys, shards + 1)
        moved = old != new
        assert (new[moved] == shards).all() and abs(moved.mean() - 1 / (shards + 1)) < 0.02
    sizes = np.bincount(jump(keys, 24))
    assert len(sizes) == 24 and sizes.max() < 1.15 * sizes.mean() and sizes.min() > 0.85 * sizes.mean()


def test_report(spark):
    rows = [(k, f"text {k} é") for k in range(300)] + [(7, "same")] * 200 + [(None, "null id"), (None, None), (900, None), (901, ""), (902, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(1)).withColumn("__row", F.lit(2))
    got = shard_report(df).collect()
    assert len(got) == len(rows)
    raw = lambda t: (t or "").encode()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted((False, i, len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t in rows if i is not None)
    assert all(r["law"] == "key" and r["shard"] == one(r["doc_id"] or 0, 24) and r["grown_shard"] == one(r["doc_id"] or 0, 25) for r in got)
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"])
    for s in range(24):
        own = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [order(r) for r in own] == sorted(order(r) for r in own)
    assert shard_report(df.limit(0)).count() == 0


def test_text_keys_and_files(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i % 90}", i) for i in range(900)] + [(None, -1)], "name string, n int")
    got = with_shard(df, "name", 5).collect()
    assert len({(r["name"], r["shard"]) for r in got}) == 91 and {r["shard"] for r in got} == set(range(5))
    write_shards(df, f"{tmp_path}/out", "name", 5, rows=100)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["name"] or "", r["n"], r["shard"]) for r in back) == sorted((r["name"] or "", r["n"], r["shard"]) for r in got)
    with pytest.raises(ValueError):
        write_shards(with_shard(df, "name"), f"{tmp_path}/no", "name")

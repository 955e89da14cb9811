"""Lines of parents of any length, cycles among them, and the orders of listings."""

import random

from pyspark.sql import functions as F

from spanforge.operators.sessions import RECENCY, STORE, TEXT, depths, lineage, listing


def brute(parents):
    out = {}
    for node in parents:
        seen, at = [node], node
        while parents.get(at) is not None and parents[at] in parents and parents[at] not in seen:
            at = parents[at]
            seen.append(at)
        up = parents[at]
        if up is None:
            out[node] = (at, len(seen) - 1, "root")
        elif up not in parents:
            out[node] = (up, len(seen), "orphan")
        else:
            cycle = seen[seen.index(up):]
            out[node] = (min(cycle), None, "cycle" if node in cycle else "under cycle")
    return out


def lines_of(spark, parents):
    df = spark.createDataFrame(list(parents.items()), "session_id string, parent_id string")
    return {r["session_id"]: (r["root_id"], r["depth"], r["kind"]) for r in lineage(df).collect()}


def test_small_graphs(spark):
    rng = random.Random(1)
    for n in (1, 12, 60):
        names = [f"n{k:03d}" for k in range(n)]
        parents = {x: rng.choice([None, "gone", *rng.sample(names, min(n, 6))]) for x in names}
        assert lines_of(spark, parents) == brute(parents)
    assert lines_of(spark, {"a": "a"}) == {"a": ("a", None, "cycle")}
    assert lineage(spark.createDataFrame([], "session_id string, parent_id string")).count() == 0


def test_long_line_and_cycle(spark):
    parents = {f"c{k:05d}": f"c{k - 1:05d}" if k else None for k in range(5000)}
    parents |= {f"r{k}": f"r{(k + 1) % 37}" for k in range(37)} | {"tail": "r5", "tail2": "tail"}
    got = lines_of(spark, parents)
    assert all(got[f"c{k:05d}"] == ("c00000", k, "root") for k in range(5000))
    assert all(got[f"r{k}"] == ("r0", None, "cycle") for k in range(37)) and got["tail2"] == ("r0", None, "under cycle")
    small = spark.createDataFrame([("a", None), ("b", "a"), ("b", "a"), ("x", "gone")], "session_id string, parent_id string")
    assert sorted(map(tuple, depths(small).collect())) == [("a", "a", 0), ("b", "a", 1)]


def test_listing_orders(spark):
    rows = [("k1", "s1", "2024-01-01T00:00:01Z"), ("k2", "s2", "2024-01-01T00:00:01.5Z"), ("k3", "s3", ""), ("k4", "s4", "2024-01-01T00:00:01Z"), ("k5", "s5", "garbage"), ("k6", "s6", "2024-01-02T00:00:00Z")]
    df = spark.createDataFrame(rows, "session_key string, session_id string, ended_at string").withColumn("ended_ts", F.expr("try_to_timestamp(ended_at)")).withColumn("title", F.lit("t"))
    order = lambda o: [r["session_key"] for r in sorted(listing(df, o).collect(), key=lambda r: r["position"])]
    assert order(RECENCY) == ["k6", "k2", "k1", "k4", "k3", "k5"]
    assert order(STORE) == ["k6", "k2", "k4", "k1", "k5", "k3"]
    assert order(TEXT) == ["k5", "k6", "k1", "k4", "k2", "k3"]  # as text, 'Z' follows '.'
    assert listing(df.limit(0)).count() == 0

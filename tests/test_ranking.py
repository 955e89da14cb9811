"""Places in an order, compared with sorting in Python."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators.ranking import ranked


@pytest.mark.parametrize("rows", [7, 100_000])
def test_places(spark, rows):
    rng = random.Random(rows)
    data = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([None, *range(20)]), k) for k in range(500)]
    df = spark.createDataFrame(data, "g string, v int, k int").repartition(5)
    got = ranked(df, [F.desc("v"), "k"], within=["g"], rows=rows).collect()
    for g in ("a", "b", None):
        want = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [r["k"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == [r[2] for r in want]
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(len(want)))


def test_ties_and_whole_table(spark):
    df = spark.range(1000).select(F.lit(1).alias("x"))
    assert sorted(r["at"] for r in ranked(df, ["x"], out="at", rows=50).collect()) == list(range(1000))
    assert ranked(df.limit(0), ["x"], within=["x"]).count() == 0

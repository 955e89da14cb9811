"""The tiled covariance against exact fractions, and the whitened rows against their definition."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import whitening
from spanforge.llm.whitening import fit_whitening, product, vectors, whiten, whitening_report, whole


def ints(vector):
    return [math.floor(1024 * c) + 100_000 for c in vector]


def covariance(rows):
    """Of integer rows, by fractions."""
    n, d = len(rows), len(rows[0])
    means = [Fraction(sum(r[i] for r in rows), n) for i in range(d)]
    return [[sum((r[i] - means[i]) * (r[j] - means[j]) for r in rows) / n for j in range(d)] for i in range(d)]


def data(rng, n, d, scale=1.0):
    hidden = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(n)]
    mix = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    return [[float(np.float32(scale * (sum(h[k] * mix[k][j] for k in range(4)) + rng.gauss(0, 0.3)))) for j in range(d)] for h in hidden]


@pytest.mark.parametrize("d, width, scale", [(7, 3, 1.0), (12, 4, 1.0), (5, 32, 1.0), (6, 2, 3e5)])
def test_covariance_is_exact(spark, monkeypatch, d, width, scale):
    monkeypatch.setattr(whitening, "ROWS", 40)
    rows = data(random.Random(d), 300, d, scale)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(5)
    model = fit_whitening(df, width=width, components=d)
    want = covariance([ints(v) for v in rows])
    assert model.n == 300 and model.trace == float(sum(want[k][k] for k in range(d)))
    values, _ = np.linalg.eigh(np.array([[float(v) for v in r] for r in want]))
    assert np.array_equal(values[::-1], model.values)  # the same matrix, to the last bit, gives the same values


def test_report(spark):
    rng = random.Random(3)
    rows = data(rng, 500, 10)
    rows += [rows[0]] * 200  # one very frequent vector
    bad = [None, [], [1.0] * 9 + [None], [1.0] * 9 + [float("nan")], [float("inf")] * 10, [1.0] * 9, [3e38] * 10]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows + bad)] + [(5, rows[1]), (None, rows[2])], "vec_id long, embedding array<float>").repartition(7).withColumn("n", F.lit("clash")).withColumn("v", F.lit(1))
    rows = [*rows, rows[1], rows[2]]
    got = whitening_report(df).collect()
    assert len(got) == len(rows) * 8 and {r["component"] for r in got} == set(range(1, 9))
    x = [ints(v) for v in rows]
    n, sums = len(x), [sum(r[i] for r in x) for i in range(10)]
    want = np.array([[float(v) for v in r] for r in covariance(x)])
    values, found = np.linalg.eigh(want)
    deviations = {k: sum((n * v - s) ** 2 for v, s in zip(x[k], sums, strict=True)) for k in range(700)}
    assert all(r["deviation"] == deviations[r["vec_id"]] and r["n"] == n for r in got if r["vec_id"] not in (None, 5))
    assert sorted({r["deviation"] for r in got if r["vec_id"] == 5}) == sorted({deviations[1], deviations[5]})
    for c in range(8):
        e, u = values[9 - c], found[:, 9 - c]
        mine = {r["vec_id"]: r for r in got if r["component"] == c + 1}
        w = {k: float((np.array(x[k]) - np.array(sums) / n) @ u / math.sqrt(e)) for k in range(700)}
        sign = 1 if w[3] * mine[3]["whitened"] > 0 else -1
        assert all(abs(sign * w[k] - mine[k]["whitened"]) < 1e-8 for k in w if k != 5)
        assert abs(mine[0]["explained"] - e / np.trace(want)) < 1e-12
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    out = whiten(df, fit_whitening(df)).collect()
    assert len(out) == len(rows) + len(bad) and sum(r["whitened"] is None for r in out) == len(bad)
    mine = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    assert all(abs(r["whitened"][2] - mine[r["vec_id"], 3]) < 1e-12 for r in out if r["whitened"] and r["vec_id"] not in (None, 5))


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        assert whitening_report(spark.createDataFrame(rows, schema)).collect() == []
    flat = whitening_report(spark.createDataFrame([(k, [float(k), 1.0, 2.0]) for k in range(5)], schema)).collect()
    assert len(flat) == 5 and all(abs(r["explained"] - 1) < 1e-12 for r in flat)


def test_products_of_large_entries():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(1 << 40), 1 << 40, (50, 3)) for _ in range(2))
    assert whole(product(a, b)).reshape(3, 3).tolist() == (a.astype(object).T @ b.astype(object)).tolist()


def test_vectors_of_slices():
    import pyarrow as pa

    column = pa.array([[1.0, 2.0], None, [None, 1.0], [3.0, -0.5], []], pa.list_(pa.float32())).slice(1)
    rows, lengths, entries = vectors(column)
    assert rows.tolist() == [2] and lengths.tolist() == [2] and entries.tolist() == ints([3.0, -0.5])


def test_deviations_beyond_a_long(spark):
    rows = [(k, [float(k) * 3e5 / 30, 0.0]) for k in range(30)]
    got = whitening_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [ints(v)[0] for _, v in rows]
    want = {k: (30 * x[k] - sum(x)) ** 2 for k in range(30)}
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 2**63 else None) for r in got) and any(r["deviation"] is None for r in got) and any(r["deviation"] for r in got)

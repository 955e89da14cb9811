"""Whitening of embeddings by a tiled covariance.

Entries c become integers x = floor(1024 * c) + 100000. Rows are packed into row blocks and each of these into column blocks of
``WIDTH`` dimensions. A pair of column blocks is a tile; a column block goes to each of its tiles under the key (row block, tile), the
shuffle brings the two of a key together, and a task multiplies them and sums by tile. Two more rounds sum what the tasks
have by tile, so no task takes more than the partial sums of a few hundred others. The driver gets the tiles alone, assembles the
covariance and takes its eigenvectors: d * d numbers for d dimensions, whatever the number of rows.

All sums are exact. Values are centred before they are multiplied, by the integer m next to the mean, y = x - m; what is left
of the mean, less than one half, is taken off by fractions of integers: V = (n * sum(y y') - sum(y) sum(y)') / n^2. Products of
doubles are used only while their sums stay below 2^53, larger entries are split, and sums are kept in two 64-bit limbs. So
the covariance is the correctly rounded one, and doesn't depend on how rows are dealt.

Defined cases: rows whose vector is null, or holds null or non-finite entries, take no part, nor do empty vectors; vectors of another length than most
(of the smaller of two that are as frequent) take no part, nor do those with an entry of 2^29 (536 million) or more in size, whose
sums of products could pass what limbs hold; null and repeated ids count like others; components without variance (eigenvalue at most 1e-13 of the trace) are left
out, so one row alone, or equal rows only, give no rows, as an empty table does. A deviation beyond 2^63 - 1 is null. Other columns are ignored by the
report and kept by ``whiten``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
#: Dimensions of a column block, rows of a row block, and into how many tasks the partial sums of one tile are dealt in the first round.
WIDTH, ROWS, FAN = 32, 4096, 64
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 29)
LIMB = 60
EXACT = float(1 << 53)
FLAT = 1e-13


def vectors(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, entries): which rows of an Arrow list column take part, their lengths, and x of all their entries in a row.

    size: the length that vectors must have."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    known = np.asarray(column.is_valid())
    lengths = np.where(known, lengths, 0)
    entries = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    good = np.abs(entries) < LARGEST
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~good)])
    fit = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    if size is not None:
        fit &= lengths == size
    mine = np.repeat(fit, lengths)
    return np.flatnonzero(fit), lengths[fit], np.floor(entries[mine] * SCALE).astype(np.int64) + SHIFT


def limbs(values: np.ndarray) -> np.ndarray:
    """64-bit integers as two limbs: value = high * 2^60 + low, 0 <= low < 2^60."""
    return np.stack([values >> LIMB, values & ((1 << LIMB) - 1)])


def add(total: np.ndarray, values: np.ndarray, shift: int = 0) -> np.ndarray:
    """total, as limbs, plus values * 2^shift."""
    total[0] += values >> (LIMB - shift)
    return normal(total, (values & ((1 << (LIMB - shift)) - 1)) << shift)


def normal(total: np.ndarray, low: np.ndarray) -> np.ndarray:
    total[1] += low
    total[0] += total[1] >> LIMB
    total[1] &= (1 << LIMB) - 1
    return total


def whole(total: np.ndarray) -> np.ndarray:
    """Limbs as Python's integers."""
    return total[0].astype(object) * (1 << LIMB) + total[1].astype(object)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b of integer matrices, exactly, as limbs."""
    largest = float(max(np.abs(a).max(initial=0), 1)) * float(max(np.abs(b).max(initial=0), 1)) * max(len(a), 1)
    multiply = lambda p, q: (p.T.astype(np.float64) @ q.astype(np.float64)).astype(np.int64).ravel()
    if largest < EXACT:
        return limbs(multiply(a, b))
    (a1, a0), (b1, b0) = ((m >> 20, m & ((1 << 20) - 1)) for m in (a.astype(np.int64), b.astype(np.int64)))
    out = limbs(multiply(a0, b0))
    add(out, multiply(a1, b0), 20)
    add(out, multiply(a0, b1), 20)
    return add(out, multiply(a1, b1), 40)


def _summed(df: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """Rows (keys, data), data two limbs for each of some numbers, summed by key as they pass, within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for key, data in zip(names, batch.column("data"), strict=True):
                part = np.frombuffer(data.as_buffer(), "<i8").reshape(2, -1)
                if key in totals:
                    totals[key][0] += part[0]
                    normal(totals[key], part[1])
                else:
                    totals[key] = part.copy()
        if totals:
            yield pa.RecordBatch.from_arrays([*(pa.array([t[k] for t in totals], pa.int32()) for k in range(len(keys))), pa.array([v.astype("<i8").tobytes() for v in totals.values()], pa.binary())], names=[*keys, "data"])

    return df.mapInArrow(run, schema)


def _totals(df: DataFrame, keys: list[str]) -> dict[tuple, np.ndarray]:
    """The sums of all of df by key, as Python's integers; one row for each key comes to the driver."""
    schema = ", ".join(f"{k} int" for k in keys) + ", data binary"
    salted = df.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    first = _summed(salted.repartition(*keys, "salt").drop("salt"), keys, schema)
    last = _summed(first.repartition(*keys), keys, schema)
    return {tuple(r[k] for k in keys): whole(np.frombuffer(r["data"], "<i8").reshape(2, -1)) for r in last.collect()}


def _sums(df: DataFrame, vector: str) -> tuple[int, int, list[int]]:
    """(dimensions, rows, exact sum of x by dimension) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            _, lengths, entries = vectors(batch.column(0))
            edges = np.cumsum(lengths)
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                x = entries[((edges[own] - size)[:, None] + np.arange(size)).ravel()].reshape(-1, size)
                sums = np.concatenate([[len(own)], x.sum(axis=0)])
                totals[size] = add(totals[size], sums) if size in totals else limbs(sums)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in totals.values()], pa.binary())], names=["size", "data"])

    found = _totals(df.select(F.col(f"`{vector}`").alias("v")).mapInArrow(run, "size int, data binary"), ["size"])
    if not found:
        return 0, 0, []
    size, sums = min(((s[0], v) for s, v in found.items()), key=lambda t: (-t[1][0], t[0]))
    return size, int(sums[0]), [int(v) for v in sums[1:]]


def _narrow(y: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    top = np.abs(y).max(initial=0)
    return y.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")


def _tiles(df: DataFrame, vector: str, size: int, middle: np.ndarray, width: int) -> dict[tuple, np.ndarray]:
    """The exact sums of products of all pairs of dimensions of y, by tile."""
    edges = list(range(0, size, width))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Row blocks, cut into column blocks, each under the keys of its tiles."""
        task, count = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []

        def pack(y: np.ndarray) -> pa.RecordBatch:
            nonlocal count
            rows = []
            for c, at in enumerate(edges):
                data = _narrow(y[:, at : at + width])
                for o in range(len(edges)):
                    rows.append((min(c, o), max(c, o), c, data.itemsize, data.tobytes()))
            n, count = count, count + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([task * (1 << 32) + n] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.int32()) for k in range(4)), pa.array([r[4] for r in rows], pa.binary())],
                names=["block", "a", "b", "side", "bytes", "data"])

        for batch in batches:
            _, _, entries = vectors(batch.column(0), size)
            held.append(entries.reshape(-1, size) - middle)
            while sum(map(len, held)) >= ROWS:
                y = np.concatenate(held)
                yield pack(y[:ROWS])
                held = [y[ROWS:]]
        if sum(map(len, held)):
            yield pack(np.concatenate(held))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The two column blocks of a key follow each other; products are summed by tile."""
        totals: dict[tuple[int, int], np.ndarray] = {}
        waiting: tuple[tuple, np.ndarray] | None = None
        for batch in batches:
            for r in range(batch.num_rows):
                block, a, b, side, many = (batch.column(k)[r].as_py() for k in ("block", "a", "b", "side", "bytes"))
                y = np.frombuffer(batch.column("data")[r].as_buffer(), f"<i{many}").reshape(-1, min(width, size - side * width))
                if side < b:
                    waiting = (block, a, b), y
                    continue
                if a < b and (waiting is None or waiting[0] != (block, a, b)):
                    raise ValueError("a column block has no partner")
                part = product(waiting[1] if a < b else y, y)
                if (a, b) in totals:
                    totals[a, b][0] += part[0]
                    normal(totals[a, b], part[1])
                else:
                    totals[a, b] = part
        if totals:
            yield pa.RecordBatch.from_arrays([*(pa.array([t[k] for t in totals], pa.int32()) for k in (0, 1)), pa.array([v.astype("<i8").tobytes() for v in totals.values()], pa.binary())], names=["a", "b", "data"])

    cut = df.select(F.col(f"`{vector}`").alias("v")).mapInArrow(blocks, "block long, a int, b int, side int, bytes int, data binary")
    dealt = cut.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b", "side")
    return _totals(dealt.mapInArrow(multiply, "a int, b int, data binary"), ["a", "b"])


@dataclass(frozen=True)
class Whitening:
    """A fitted model: d numbers, and d for each component."""

    size: int  # dimensions
    n: int  # rows that were fitted on
    middle: np.ndarray  # the integer next to the mean of each dimension
    rest: tuple[int, ...]  # n * mean - n * middle, exactly
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # eigenvectors, as columns
    trace: float

    def project(self, y: np.ndarray) -> np.ndarray:
        """Rows of x - middle, whitened."""
        rest = np.array([r / self.n for r in self.rest])
        return (y - rest) @ self.vectors / np.sqrt(self.values)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2, for rows of x - middle."""
        top = (self.n * int(np.abs(y).max(initial=0)) + max((abs(r) for r in self.rest), default=0)) ** 2 * max(self.size, 1)
        if top < 1 << 63:
            return ((self.n * y - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        sums = ((self.n * y.astype(object) - np.array(self.rest, object)) ** 2).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in sums]


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, width: int = WIDTH) -> Whitening | None:
    """The mean and the leading components of all rows that take part; None where there are none."""
    size, n, sums = _sums(df, vector)
    if not n:
        return None
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    products = np.zeros((size, size), object)
    for (a, b), data in _tiles(df, vector, size, np.array(middle, np.int64), width).items():
        rows, columns = slice(a * width, min(size, (a + 1) * width)), slice(b * width, min(size, (b + 1) * width))
        products[rows, columns] = data.reshape(rows.stop - rows.start, -1)
        products[columns, rows] = products[rows, columns].T
    exact = n * products - np.outer(np.array(rest, object), np.array(rest, object))
    covariance = np.array([[v / (n * n) for v in row] for row in exact], np.float64)
    values, found = np.linalg.eigh(covariance)
    trace = sum(exact[k, k] for k in range(size)) / (n * n)
    leading = [k for k in range(size - 1, -1, -1) if values[k] > FLAT * trace][:components]
    found = found[:, leading]
    found = found * np.where(found[np.abs(found).argmax(axis=0), range(len(leading))] < 0, -1.0, 1.0) if leading else found
    return Whitening(size, n, np.array(middle, np.int64), tuple(rest), values[leading], found, trace)


def _placed(batch: pa.RecordBatch, vector: str, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    rows, _, entries = vectors(batch.column(vector), model.size)
    return rows, entries.reshape(-1, model.size) - model.middle


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest entry, without its sign, of the whitened rows' covariance minus the identity; sums of each task come to the driver in rounds."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            w = model.project(_placed(batch, "v", model)[1])
            total += np.concatenate([w.sum(axis=0)[:, None], w.T @ w], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = df.select(F.col(f"`{vector}`").alias("v")).mapInArrow(run, "sums array<double>")
    row = parts.select(*(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(k * (k + 1)))).first()
    sums = np.array([v or 0.0 for v in row]).reshape(k, k + 1) / model.n
    return float(np.abs(sums[:, 1:] - np.outer(sums[:, 0], sums[:, 0]) - np.eye(k)).max(initial=0.0))


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", out: str = "whitened") -> DataFrame:
    """df with the whitened vector, array<double>; null for rows that take no part. No shuffle; the model goes with the task."""

    @F.pandas_udf("array<double>")
    def project(values: pd.Series) -> pd.Series:
        rows, _, entries = vectors(pa.array(values, pa.list_(pa.float64())), model.size)
        found: list[list[float] | None] = [None] * len(values)
        for r, w in zip(rows.tolist(), model.project(entries.reshape(-1, model.size) - model.middle).tolist(), strict=True):
            found[r] = w
        return pd.Series(found, dtype=object)

    return df.withColumn(out, project(F.col(f"`{vector}`").cast("array<double>")))


REPORT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening_report(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each row that takes part, on each component."""
    model = fit_whitening(df, vector, components)
    k = 0 if model is None else len(model.values)
    if model is None or not k:
        return df.sparkSession.createDataFrame([], REPORT)
    error = identity_error(df, model, vector)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, y = _placed(batch, "v", model)
            if not len(rows):
                continue
            many = len(rows) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(many, model.n)),
                 pa.array([d for d in model.deviations(y) for _ in range(k)], pa.int64()), pa.array(model.project(y).ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(many, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).mapInArrow(run, REPORT)

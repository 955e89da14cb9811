"""Exact top-k search by inner product, with multi-resolution segment statistics.

Every component x becomes floor(64 * x). Vectors are cut into segments; with the mean and the deviation of each
segment, Euclidean distance has the lower bound sum of m * ((mean - mean')^2 + (dev - dev')^2) over segments of length
m, and as the norms are known, a lower bound of the distance is an upper bound of the inner product:
sum of m * (mean * mean' + dev * dev'). Resolutions go from coarse to fine: for a block of rows and a block of queries
the bounds of the coarsest are taken first, and only pairs that may still be among a query's k best go on to the
next and at last to the exact product.

Queries are the rows whose id is divisible by ``EVERY``, against all rows in blocks. Blocks of rows are dealt to slices
and blocks of queries to groups, whose numbers grow with the data; every slice meets every group in a tile of its own, which
holds ``SLICE`` rows and ``GROUP`` queries on average. A task goes through one block of queries at a time with the k best
of each query so far, so memory is bounded by the blocks and what leaves a task by its queries. The last step keeps
the k best of each query over all slices.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, neither do rows with a null
id; vectors of another length than the query's are no candidates; an empty vector scores 0 with other empty ones; ties
go to the smaller id; repeated ids are separate candidates (only the query's own id is left out); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, EVERY = 20, 20
#: Rows of a block of candidates and of a block of queries.
ROWS, QUERIES = 4096, 2048
#: Rows and queries of a tile.
SLICE, GROUP = 1 << 20, 1 << 16
#: Segments at each resolution, where the length allows.
RESOLUTIONS = (4, 8, 16)
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Whether a vector has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, size, ints: the rows that take part, with integer components (as doubles, which are exact)."""
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).select(
        "id", F.size("v").alias("size"), F.transform("v", lambda x: F.floor(x * 64).cast("double")).alias("ints"))


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """size, n, ids, data: rows of one length packed into blocks, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def pack(size: int) -> pa.RecordBatch:
            ids, parts = held.pop(size)
            ids, data = np.concatenate(ids), np.concatenate(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([data.astype("<f8").tobytes()], pa.binary())],
                names=["size", "n", "ids", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                sizes = part.column("size").to_numpy()
                ids = part.column("id").to_numpy()
                flat = part.column("ints").flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                for size in np.unique(sizes).tolist():
                    chosen = np.flatnonzero(sizes == size)
                    where = ((ends[chosen] - size)[:, None] + np.arange(size)[None, :]).ravel()
                    own = held.setdefault(size, ([], []))
                    own[0].append(ids[chosen])
                    own[1].append(flat[where])
                    if sum(map(len, own[0])) >= most:
                        yield pack(size)
        for size in list(held):
            yield pack(size)

    return rows.mapInArrow(run, "size int, n int, ids binary, data binary")


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, each times the root of the segment's length."""
    bounds = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = np.empty((len(x), 2 * segments))
    for s in range(segments):
        part = x[:, bounds[s] : bounds[s + 1]]
        root = np.sqrt(part.shape[1])
        out[:, s] = part.mean(axis=1) * root
        out[:, segments + s] = part.std(axis=1) * root
    return out


class Best:
    """The k best candidates of each query so far, by score, then by smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.levels = [segment_statistics(x, s) for s in RESOLUTIONS if s < x.shape[1]]
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.zeros((len(ids), k), np.int64)

    def add(self, ids: np.ndarray, y: np.ndarray) -> None:
        top = max(np.abs(self.x).max(initial=0), 1) * max(np.abs(y).max(initial=0), 1) * max(self.x.shape[1], 1)
        if top >= EXACT:
            self._add_large(ids, y)
            return
        slack = 1e-6 + 1e-9 * top
        levels = [segment_statistics(y, s) for s in RESOLUTIONS if s < y.shape[1]]
        for at in range(0, len(self.ids), 64):  # in strips, so that bounds stay in the cache
            strip = slice(at, at + 64)
            least = self.scores[strip, -1][:, None]
            alive: np.ndarray | None = None
            if np.isfinite(least).all():
                for q, r in zip((level[strip] for level in self.levels), levels, strict=True):
                    columns = np.arange(len(ids)) if alive is None else alive
                    may = (q @ r[columns].T >= least - slack).any(axis=0)
                    alive = columns[may]
                    if not len(alive):
                        break
            columns = np.arange(len(ids)) if alive is None else alive
            if len(columns):
                self._keep(strip, ids[columns], self.x[strip] @ y[columns].T)

    def _keep(self, strip: slice, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(self.ids[strip][:, None] == ids[None, :], -np.inf, scores)
        for row, own in zip(range(*strip.indices(len(self.ids))), scores, strict=True):
            may = np.flatnonzero((own >= self.scores[row, -1]) & (own > -np.inf))
            if len(may):
                if len(may) > 4 * self.k:  # the k best by score and all that tie with the last of them
                    cut = np.partition(own[may], len(may) - self.k)[len(may) - self.k]
                    may = may[own[may] >= cut]
                s, i = np.concatenate([self.scores[row], own[may]]), np.concatenate([self.found[row], ids[may]])
                order = np.lexsort((i, -s))[: self.k]
                self.scores[row], self.found[row] = s[order], i[order]

    def _add_large(self, ids: np.ndarray, y: np.ndarray) -> None:
        """Components whose products doubles can't hold exactly: Python's integers."""
        ours, theirs = [[int(v) for v in r] for r in self.x], [[int(v) for v in r] for r in y]
        if not hasattr(self, "large"):
            self.large: list[list[tuple[int, int]]] = [[] for _ in self.ids]
        for k, row in enumerate(ours):
            got = [(-sum(a * b for a, b in zip(row, other, strict=True)), int(i)) for i, other in zip(ids, theirs, strict=True) if i != self.ids[k]]
            self.large[k] = sorted(self.large[k] + got)[: self.k]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for k, q in enumerate(self.ids.tolist()):
            got = [(int(s), i) for s, i in zip(self.scores[k].tolist(), self.found[k].tolist(), strict=True) if s > -np.inf]
            got += [(-s, i) for s, i in getattr(self, "large", [[]] * (k + 1))[k]]
            for s, i in sorted(got, key=lambda t: (-t[0], t[1]))[: self.k]:
                yield q, i, max(min(s, 2**63 - 1), -(2**63))


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, slice_rows: int = SLICE, group_rows: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the largest inner product for every query."""
    session = df.sparkSession
    rows = prepared(df, key, vector)
    # Counted before vectors are looked at, so from the column of ids alone.
    n = df.select(F.count("*").alias("rows"), F.count(F.when(F.col(key) % every == 0, 1)).alias("queries")).first()
    slices = max(1, int(session.conf.get("spark.sql.shuffle.partitions")), math.ceil(n["rows"] / slice_rows))
    groups = max(1, math.ceil(n["queries"] / group_rows))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    dealt = lambda count: F.pmod(F.xxhash64("ids"), F.lit(count).cast("long"))
    packed = _blocks(rows, ROWS).select("size", "ids", "data", dealt(slices).alias("slice"), each(groups).alias("group"))
    asked = _blocks(rows.where(F.col("id") % every == 0), QUERIES).select("size", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), dealt(groups).alias("group"), each(slices).alias("slice"))
    pairs = packed.join(asked, ["slice", "group", "size"]).select("size", "q_ids", "q_data", "ids", "data").sortWithinPartitions("q_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, name = None, None

        def done(b: Best) -> pa.RecordBatch:
            got = list(b.rows())
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in got], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                size = batch.column("size")[r].as_py()
                q = batch.column("q_ids")[r].as_buffer()
                if best is None or (size, q) != name:
                    if best is not None:
                        yield done(best)
                    ids = np.frombuffer(q, "<i8")
                    best, name = Best(ids, np.frombuffer(batch.column("q_data")[r].as_buffer(), "<f8").reshape(len(ids), size), k), (size, q)
                ids = np.frombuffer(batch.column("ids")[r].as_buffer(), "<i8")
                best.add(ids, np.frombuffer(batch.column("data")[r].as_buffer(), "<f8").reshape(len(ids), size))
        if best is not None:
            yield done(best)

    partial = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

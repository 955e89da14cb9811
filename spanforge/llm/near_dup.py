"""MinHash near-dedup with HyperMinHash: banded candidates, collision-corrected estimates, verification on full sets.

A document's set is its distinct shingles of ``width`` words (lower-cased A-Z, split at ASCII white space); with fewer
words, the whole sequence as one; without words, empty, and linked with nothing. Two documents are linked where
100 * (shared) >= percent * (union); components are what links reach.

1. One row per document: size, 128-bit digest and registers of its set. Documents of equal sets are one class, and only
   one of each class, the smallest id, goes on ("node").
2. Nodes that share a band are candidates. First each node is compared with one other: the least of the leaders (least nodes)
   of its buckets. Pairs whose estimate lies clearly below the threshold are dropped; the others are verified on
   the sets of their whole texts, and components are made of the links.
3. ``ROUNDS`` times, in each bucket that still holds several components, one node of each is compared with one of the largest.
4. What is left is settled exactly: nodes that such buckets tie together are dealt in blocks, every two of which meet in one
   task, which estimates all pairs of different components and verifies the likely ones on their sets; of the links that it finds it
   gives no more than join its own nodes. So groups of copies cost a pair for each node, and only what resembles much without being linked
   is compared all with all.

Nothing is capped: every pair that shares a band is either linked through others, estimated, or verified. With
the default bands, a pair at the threshold shares none in about 3 of a million cases.

Defined cases: null and empty texts have no shingles and stay alone; ties go to the smaller id; rows that repeat an id are each
reported and follow their own text, and where that id leads a class, the links of all its texts join; other columns are ignored; an empty
table gives an empty result; rows whose id is null are reported alone, without a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.bytescan import mix, shingles, texts, word_hashes
from spanforge.llm.components import components
from spanforge.llm.hyperminhash import BANDS, REGISTERS, bands, estimate, minima, registers
from spanforge.llm.shared import cut, cut_small

WIDTH, PERCENT = 5, 80
#: How far below the threshold an estimate may lie: about four standard deviations of the estimate at 0.85.
MARGIN = 0.13
#: Rounds in which components of a bucket are compared by one node each.
ROUNDS = 2
#: Nodes of a block, pairs of one node that a task verifies, and sets' values that are counted at once.
BLOCK, DEALT, COLUMNS = 256, 256, 4096


def shingle_set(raw: np.ndarray | None, width: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(raw), width)) if raw is not None and len(raw) else np.zeros(0, np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = int(np.count_nonzero(np.isin(a, b, assume_unique=True)))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sketches(df: DataFrame, width: int) -> DataFrame:
    """doc_id, n, f1, f2, regs: size, digest and registers of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, f, g, regs = [], [], [], []
                with np.errstate(over="ignore"):
                    for raw in texts(part.column("text")):
                        own = shingle_set(raw, width)
                        n.append(len(own))
                        f.append(int(own.sum().astype(np.int64)) if len(own) else 0)
                        g.append(int(mix(own + np.uint64(0x9E3779B97F4A7C15)).sum().astype(np.int64)) if len(own) else 0)
                        regs.append(registers(minima(own)).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int32()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.array(regs, pa.binary())],
                    names=["doc_id", "n", "f1", "f2", "regs"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n int, f1 long, f2 long, regs binary")


def _band_rows(nodes: DataFrame) -> DataFrame:
    """bucket, node: a row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                yield pa.RecordBatch.from_arrays([pa.array(bands(rows).ravel()), pa.array(np.repeat(part.column("node").to_numpy(), BANDS))], names=["bucket", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "bucket long, node long")


def _likely(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs whose estimate does not lie clearly below the threshold."""
    side = lambda c: held.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}"))
    least = percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
                good = estimate((a == b).sum(axis=1), part.column("n_a").to_numpy(), part.column("n_b").to_numpy()) >= least
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(good)), part.column("b").filter(pa.array(good))], names=["a", "b"])

    sized = pairs.join(side("b"), "b").join(side("a"), "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, held: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: the pairs whose sets are similar enough. The texts of b move to those of a, so a node with many partners should be a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                good = []
                for x, y in zip(texts(part.column("t_a")), texts(part.column("t_b")), strict=True):
                    if last is None or not np.array_equal(x, last):  # rows come sorted by a
                        own = shingle_set(x, width)
                    last = x
                    good.append(linked(own, shingle_set(y, width), percent))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / DEALT).alias("parts"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    moved = dealt.join(held.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b")
    firsts = shares.join(held.select(F.col("node").alias("a"), F.col("text").alias("t_a")), "a")
    firsts = firsts.select("a", "t_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return moved.hint("merge").join(firsts, ["a", "part"]).select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long").distinct()


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, node, c: the rows of buckets with nodes of several components."""
    placed = members.join(found.withColumnRenamed("component", "c"), "node", "left").select("bucket", "node", F.coalesce("c", "node").alias("c"))
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where(F.col("low") != F.col("high")).select("bucket")
    return placed.join(mixed, "bucket")


def _stars(opened: DataFrame) -> DataFrame:
    """a, b: for each component of each bucket but the largest, its least node and that of the largest; of these pairs one for each node."""
    each = opened.groupBy("bucket", "c").agg(F.count("*").alias("k"), F.min("node").alias("b"))
    main = each.groupBy("bucket").agg(F.max(F.struct("k", "c", "b")).alias("m")).select("bucket", F.col("m.c").alias("main"), F.col("m.b").alias("a"))
    return each.join(main, "bucket").where(F.col("c") != F.col("main")).groupBy("b").agg(F.max(F.struct("k", "a"))["a"].alias("a")).select("a", "b")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values every two different sets share, counted some values at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[place] > 1
    owner, place = owner[several], np.unique(place[several], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        i, j = np.searchsorted(place, (low, low + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[i:j], place[i:j] - low] = 1
        out += has @ has.T
    return out


def _in_blocks(opened: DataFrame, held: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links that join all nodes of different components that buckets tie together and that are similar enough."""
    first = opened.groupBy("bucket").agg(F.min("node").alias("a"))
    tied = components(opened.join(first, "bucket").select("a", F.col("node").alias("b")).distinct())
    nodes = opened.select("node", "c").distinct().join(tied.withColumnRenamed("component", "tie"), "node")
    nodes = cut_small(nodes)
    sizes = nodes.groupBy("tie").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = nodes.join(sizes, "tie").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = placed.select("node", "c", "tie", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    least = percent / 100 - MARGIN

    def run(table: pa.Table) -> pa.Table:
        ids, classes, n = (table.column(c).to_numpy() for c in ("node", "c", "n"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        likely = np.zeros((len(ids), len(ids)), bool)
        for k in range(len(ids)):
            likely[k] = (estimate((regs == regs[k]).sum(axis=1), n, np.full(len(n), n[k])) >= least) & (classes != classes[k])
        use = np.flatnonzero(likely.any(axis=1))
        if not len(use):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        raw = [x for k, x in enumerate(texts(table.column("text"))) if likely[k].any()]
        size = n[use].astype(float)
        shared = shared_counts([shingle_set(x, width) for x in raw])
        x, y = np.nonzero(np.triu(likely[np.ix_(use, use)] & (100 * shared >= percent * (size[:, None] + size - shared)), 1))
        # Of the links of this block, those that join components not yet joined here.
        root = {int(c): int(c) for c in classes}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for i, j in zip(use[x].tolist(), use[y].tolist(), strict=True):
            p, q = top(int(classes[i])), top(int(classes[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})

    return dealt.join(held.select("node", "n", "regs", "text"), "node").groupBy("tie", "low", "high").applyInArrow(run, "a long, b long")


def _merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """node, component after further links: only the components that these join are looked at again."""
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    ends = cut_small(more.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b")))
    joined = components(ends.select("c_a", "c_b").distinct(), "c_a", "c_b").select(F.col("node").alias("component"), F.col("component").alias("least"))
    fresh = ends.select(F.col("a").alias("node"), F.col("c_a").alias("component")).union(ends.select("b", "c_b")).distinct()
    every = found.union(fresh.join(found, "node", "left_anti"))
    return every.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def link_classes(df: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Sketches of all documents, and f1, f2, rep, component for each class of equal sets."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    rows = cut(sketches(docs, width))
    classes = cut(rows.where(F.col("n") > 0).groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n", "regs")).alias("r")).select("f1", "f2", F.col("r.doc_id").alias("node"), "r.n", "r.regs"))
    banded = _band_rows(classes)
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where(F.col("leader") != F.col("last"))
    members = cut(banded.join(buckets.select("bucket", "leader"), "bucket"))
    # The texts of nodes that have candidates, with their sketches.
    near = classes.select("node", "n", "regs").join(members.select("node").distinct(), "node")
    held = cut(docs.select(F.col("doc_id").alias("node"), "text").join(near, "node"))
    tried = cut_small(_likely(members.where(F.col("node") != F.col("leader")).groupBy(F.col("node").alias("b")).agg(F.min("leader").alias("a")).select("a", "b"), held, percent))
    found = cut_small(components(cut_small(_verified(tried, held, width, percent))))
    members = members.select("bucket", "node")
    for _ in range(ROUNDS):
        pairs = cut_small(_stars(_open(members, found)).join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        likely = cut_small(_likely(pairs, held, percent))
        links = cut_small(_verified(likely, held, width, percent))
        tried = tried.union(pairs)
        if not links.isEmpty():
            found = cut_small(_merged(found, links))
    opened = cut_small(_open(members, found))
    if not opened.isEmpty():
        links = cut_small(_in_blocks(opened, held, width, percent))
        if not links.isEmpty():
            found = cut_small(_merged(found, links))
    merged = classes.join(found, "node", "left").select("f1", "f2", F.col("node").alias("rep"), F.coalesce("component", "node").alias("component"))
    return rows, cut(merged)


def near_duplicates(df: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: whether a document is the smallest of its component."""
    rows, classes = link_classes(df, width, percent)
    empty = rows.where(F.col("n") == 0).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = rows.where(F.col("n") > 0).join(classes, ["f1", "f2"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
    nameless = df.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return full.unionByName(empty).unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""Quality classifier by importance resampling: two hashed n-gram models, and a Gumbel top-k draw by their ratio.

The target is the text of rows labelled good, the raw model that of all documents. Both are generative bag-of-n-gram
models over ``BUCKETS`` hashed unigrams and bigrams, with add-``SMOOTHING``. The log-weight of a document is the sum of
log(target / raw) over its n-grams. Adding independent Gumbel noise and keeping the k largest draws k documents without
replacement in proportion to their weights; the noise is a keyed hash of the id, so that a draw can be repeated.

Labels are learned from ``FIT_ROWS`` good rows at most (those with the least hashes), a documented bound; the raw model
counts every document and every n-gram. Both count tables have ``BUCKETS`` entries whatever the input.

Defined cases: null and empty texts have no n-grams and log-weight 0; without good labels all weights are 0, so the
draw is uniform; rows that repeat an id share its noise, ties go to the smaller id; other columns are ignored; an empty
table gives an empty result. Texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.bytescan import PRIME, mix, texts, word_hashes
from spanforge.llm.shared import cut

BUCKETS = 1 << 14
SMOOTHING = 1.0
FIT_ROWS = 60_000
#: The share of documents that is drawn.
SHARE = 0.5
SEED = 29


def buckets_of(raw: np.ndarray | None) -> np.ndarray:
    """The bucket of each unigram and bigram of a text."""
    w = word_hashes(raw) if raw is not None and len(raw) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        pairs = mix(w[:-1] * PRIME + w[1:]) if len(w) > 1 else w[:0]
    return (np.concatenate([w, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts: an array of BUCKETS entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in texts(batch.column(text)):
                total += np.bincount(buckets_of(raw), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.float64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) for each bucket; 0 everywhere without a target."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log(p) - np.log(q)


def good_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text of the rows that stand for the target."""
    chosen = (
        labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")  # FIT_ROWS ids at most


def weigh(df: DataFrame, ratio: np.ndarray, text: str = "text", out: str = "log_weight") -> DataFrame:
    """df with column out: the log-weight of each text."""
    shared = df.sparkSession.sparkContext.broadcast(ratio)
    names = [c for c in df.columns if c != out]
    schema = df.select(*names).withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = pa.array([float(own[buckets_of(raw)].sum()) for raw in texts(batch.column(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), got], names=[*names, out])

    return df.select(*names).mapInArrow(run, schema)


def gumbel(key: str = "doc_id", seed: int = SEED):
    """Standard Gumbel noise by a keyed hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def resample(documents: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, noisy (log-weight plus noise), selected (whether it is drawn) for every document."""
    target = bucket_counts(good_rows(documents, labels))
    raw = bucket_counts(documents)
    weighed = weigh(documents.select("doc_id", "text"), log_ratio(target, raw)).select("doc_id", "log_weight", (F.col("log_weight") + gumbel(seed=seed)).alias("noisy"))
    weighed = cut(weighed)  # 24 bytes a document; the passes below read it again and again
    bound = _bound(weighed, share)
    if bound is None:
        return weighed.withColumn("selected", F.lit(False))
    noisy, last = bound
    beyond = (F.col("noisy") > noisy) | ((F.col("noisy") == noisy) & (F.col("doc_id") <= last))
    return weighed.withColumn("selected", F.coalesce(beyond, F.lit(False)))


def _bound(weighed: DataFrame, share: float) -> tuple[float, int] | None:
    """The noisy weight and id of the last row that is drawn: the k-th in order, found by counting, never by a sort of all rows in one place.

    Each pass counts the rows in 4,096 intervals between two values and goes on in the interval with the k-th; what
    remains after at most six passes, or as soon as few rows remain, is ordered by itself.
    """
    rows = weighed.select("noisy", "doc_id").where(F.col("noisy").isNotNull() & F.col("doc_id").isNotNull())
    first = rows.agg(F.count("*").alias("n"), F.min("noisy").alias("low"), F.max("noisy").alias("high")).first()
    k = int(first["n"] * share)
    if k <= 0:
        return None
    low, high, n = first["low"], first["high"], first["n"]
    inside = (F.col("noisy") >= low) & (F.col("noisy") <= high)
    for _ in range(6):
        if n <= 1000 or high <= low:
            break
        width = (high - low) / 4096
        place = F.least(F.floor((F.col("noisy") - low) / width), F.lit(4095))
        counted = rows.where(inside).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("noisy").alias("low"), F.max("noisy").alias("high")).orderBy(F.desc("place")).collect()
        for r in counted:  # 4,096 rows at most
            if r["n"] >= k:
                low, high, n = r["low"], r["high"], r["n"]
                break
            k -= r["n"]
        inside = (F.col("noisy") >= low) & (F.col("noisy") <= high)
    last = rows.where(inside).orderBy(F.desc("noisy"), "doc_id").limit(k).agg(F.min(F.struct(F.col("noisy"), (-F.col("doc_id")).alias("negated"))).alias("last")).first()["last"]
    return last["noisy"], -last["negated"]

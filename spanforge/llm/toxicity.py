"""Toxicity: maximal-scoring segments of token log-odds, calibrated by extreme-value statistics.

1. Term counts (documents that hold a term, by label) of the fitting rows; log-odds with an informative Dirichlet
   prior, which shrinks each term towards its overall frequency. Terms are words and their beginnings of four to six letters; those that
   are significantly toxic keep their log-odds, all other words share one negative score.
2. A linear-time scan (Ruzzo and Tompa) finds every maximal-scoring segment of a text.
3. A segment of score S in a text of n words has the expected number n * exp(-lambda * S) of chance segments as good
   (Karlin and Altschul), with lambda from the clean rows. The best segment's and the number of significant ones give a
   probability by a logistic curve, fitted on rows that took no part in step 1.

Labels are learned from rows whose crc32(doc_id) mod 4 is not ``HELD_OUT`` only, and from ``FIT_ROWS`` of these at
most (those with the least hashes), a documented bound which also bounds what is broadcast: the terms
kept are all significant ones of the toxic rows among these, however many rows are scored. Every row is scored on its whole text.

Defined cases: null and empty texts have no segment and get the score that stands for no evidence; without labels of
both kinds all scores are 0; several labels of one document count as toxic if any is; repeated rows are each scored;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 2
FIT_ROWS = 60_000
MIN_DOCS = 3
MIN_Z = 3.0
#: Least log-odds of a toxic term, and in how many surroundings it must stand.
MIN_ODDS, MIN_PLACES = 1.5, 6
#: Weight of the prior, in documents, and the chance segments that a significant one may expect.
PRIOR, SIGNIFICANT = 10.0, 0.05
THRESHOLD = 0.3
#: The score of a word that is not among the toxic terms, and the words that a document is taken to have at least.
OTHER, LEAST_WORDS = -0.05, 50
STEMS = (4, 5, 6)
PIECE = 1 << 20
FLUSH = 400_000
WORD = re.compile(r"[^\W\d_]+")


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4


def words(text: str) -> Iterator[list[str]]:
    """The words of a text in order, in pieces."""
    at, n = 0, len(text)
    while at < n:
        stop = min(n, at + PIECE)
        while stop < n and text[stop].isalpha():
            stop += 1
        yield WORD.findall(text[at:stop].lower())
        at = stop


def stems(word: str) -> list[str]:
    """The beginnings that count as terms beside the word itself."""
    return [f"{word[:n]}*" for n in STEMS if len(word) > n]


@dataclass
class ToxicModel:
    """What is broadcast: scores of the toxic terms, the score of all other words, lambda, and the logistic curve."""

    scores: dict[str, float] = field(default_factory=dict)
    other: float = OTHER
    rate: float = 1.0
    weights: tuple[float, ...] = ()

    def hits(self, text: str | None) -> tuple[list[tuple[int, float]], int]:
        """The places and scores of toxic terms, and the number of words."""
        out, n, get = [], 0, self.scores.get
        for part in words(text or ""):
            for k, w in enumerate(part):
                s = get(w)
                if s is None and len(w) > STEMS[0]:
                    s = get(w[:4] + "*") or get(w[:5] + "*") or get(w[:6] + "*")
                if s is not None:
                    out.append((n + k, s))
            n += len(part)
        return out, n

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Every maximal-scoring segment (first word, past the last word, score), and the number of words."""
        found, n = self.hits(text)
        return maximal_segments(found, self.other), n

    def features(self, text: str | None) -> tuple[float, float]:
        segs, n = self.segments(text)
        if not segs:
            return 0.0, 0.0
        bits = [self.rate * s - math.log(n) for _, _, s in segs]  # -log of the expected number
        good = sum(b >= -math.log(SIGNIFICANT) for b in bits)
        return min(max(max(bits), 0.0), 40.0) / 10, math.log1p(good)

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        x, y = self.features(text)
        return 1 / (1 + math.exp(-(self.weights[0] + self.weights[1] * x + self.weights[2] * y)))


def maximal_segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence whose elements score other, save for the hits, in linear time."""
    stack: list[list] = []  # first, past the last, sum before, sum after, the nearest below with a lesser sum before
    total, seen = 0.0, 0
    for place, score in hits:
        total += other * (place - seen)
        seen = place + 1
        if score <= 0:
            total += score
            continue
        new = [place, place + 1, total, total + score, -1]
        total += score
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def _term_counts(fit: DataFrame) -> DataFrame:
    """term, pos, neg, places: fitting rows of either label that hold the term, and a count (to 32) of the different words before it in toxic ones.

    Counted by partition before the shuffle. A term from a group of copies has many rows but few words before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        places: defaultdict[str, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            terms = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64()), pa.array([places.get(t, 0) for t in terms], pa.int64())],
                names=["term", "pos", "neg", "places"])
            places.clear()
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
                own: set[str] = set()
                bad, last = toxic.as_py(), ""
                for part in words(text.as_py() or ""):
                    own.update(part)
                    if bad:
                        for w in part:
                            bit = 1 << (crc32(last.encode()) & 31)
                            places[w] |= bit
                            for stem in stems(w):
                                places[stem] |= bit
                            last = w
                own.update([stem for w in own for stem in stems(w)])
                counts[1 if bad else 0].update(own)
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield flush()
        yield flush()

    return fit.select("text", "toxic").mapInArrow(run, "term string, pos long, neg long, places long").groupBy("term").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bit_count(F.bit_or("places")).alias("places"))


def _toxic_terms(counts: DataFrame, n_pos: int, n_neg: int) -> DataFrame:
    """term, score, clean: log-odds under the Dirichlet prior of the significantly toxic terms, and their clean rate."""
    prior = PRIOR * (F.col("pos") + F.col("neg")) / F.lit(float(n_pos + n_neg))
    pos, neg = F.col("pos") + prior, F.col("neg") + prior
    total_pos, total_neg = n_pos + PRIOR, n_neg + PRIOR
    odds = F.log(pos / (total_pos - pos + 1)) - F.log(neg / (total_neg - neg + 1))
    z = odds / F.sqrt(1 / pos + 1 / neg)
    return (
        counts.where((F.col("pos") >= MIN_DOCS) & (F.col("places") >= MIN_PLACES))
        .select("term", odds.alias("score"), z.alias("z"), (neg / total_neg).alias("clean"))
        .where((F.col("z") >= MIN_Z) & (F.col("score") > MIN_ODDS))
        .orderBy(F.desc("z"), "term")
    )


def _lambda(scores: np.ndarray, chances: np.ndarray, other: float) -> float:
    """The positive root of E[exp(lambda * score)] = 1 over the clean rows' words."""
    rest = max(0.0, 1.0 - chances.sum())

    def excess(x: float) -> float:
        return float((chances * np.exp(x * scores)).sum() + rest * math.exp(x * other) - 1)

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression with a small ridge, by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic, fold: the labelled rows to learn from, FIT_ROWS of them at most."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic")).alias("toxic"))
        .select("doc_id", (F.col("toxic") > 0).alias("toxic"), fold(F.col("doc_id")).alias("fold"))
        .where(F.col("fold") != HELD_OUT)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # FIT_ROWS rows of 17 bytes at most


def fit_toxicity(documents: DataFrame, labels: DataFrame) -> ToxicModel:
    """The model. Terms come from two of the three folds of fitting rows, the curve from the third."""
    rows = fit_rows(documents, labels)
    learn = rows.where(F.col("fold") != 3)
    sizes = learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    n = {bool(r["toxic"]): r["n"] for r in sizes}
    if not n.get(True) or not n.get(False):
        return ToxicModel()
    terms = _toxic_terms(_term_counts(learn), n[True], n[False]).collect()  # terms of the toxic rows among FIT_ROWS
    model = ToxicModel(scores={r["term"]: min(r["score"], 8.0) for r in terms})
    if terms:
        # A clean document holds a term with this chance, so a clean word is the term with less than a LEAST_WORDS-th of it.
        chances = np.array([r["clean"] for r in terms]) / LEAST_WORDS
        scores = np.array([model.scores[r["term"]] for r in terms])
        model.other = min(OTHER, -2 * float((chances * scores).sum()))  # the scan needs scores that fall on clean text
        model.rate = _lambda(scores, chances, model.other)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [own.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column("toxic")], names=["x", "y", "toxic"])

    got = rows.where(F.col("fold") == 3).select("text", "toxic").mapInArrow(run, "x double, y double, toxic boolean")
    table = got.groupBy(F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "toxic").agg(F.count("*").alias("n")).collect()  # FIT_ROWS rows at most
    if table:
        count = [r["n"] for r in table]
        x = np.repeat(np.array([[r["x"], r["y"]] for r in table]), count, axis=0)
        y = np.repeat(np.array([float(r["toxic"]) for r in table]), count)
        model.weights = _logistic(x, y)
    return model


def score_toxicity(df: DataFrame, model: ToxicModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """df with column out: the probability that a text is toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c != out]
    schema = df.select(*names).withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = pa.array([own.score(t.as_py()) for t in part.column(text)], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), got], names=[*names, out])

    return df.select(*names).mapInArrow(run, schema)


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit_toxicity(documents, labels)
    scored = score_toxicity(documents.select("doc_id", "text"), model, out="score")
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

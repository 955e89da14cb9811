"""Fitted operators against plain recomputations of their counts, odds and weights, and their defined cases."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import resampling, topk, toxicity


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(150)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 80))]
        if i % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["scumbags", "scumbag", "vile"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    # Repeated labels, one without a document, one without a value, and a repeated document.
    return [*rows, rows[7]], [*labels, (3, 0), (3, 1), (9000, 1), (4, None)]


def plain_words(text):
    return toxicity.WORD.findall(text.lower())


def test_toxic_terms_by_brute_force(spark, corpus):
    rows, labels = corpus
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    marked: dict[int, int] = {}
    for i, y in labels:
        if y is not None:
            marked[i] = max(marked.get(i, 0), y)
    counts, n, before = (Counter(), Counter()), [0, 0], {}
    for i, text in rows:
        fold = crc32(str(i).encode()) % 4
        if i not in marked or fold in (2, 3):
            continue
        w, y = plain_words(text), marked[i]
        n[y] += 1
        terms = lambda x: {x, *(x[:k] + "*" for k in (4, 5, 6) if len(x) > k)}
        counts[y].update(set().union(*map(terms, w)))
        if y:
            for last, x in zip(["", *w], w):
                for t in terms(x):
                    before.setdefault(t, set()).add(crc32(last.encode()) & 31)
    want = {}
    for t in counts[1]:
        pos, neg = counts[1][t], counts[0][t]
        prior = 10 * (pos + neg) / (n[0] + n[1])
        p, q = pos + prior, neg + prior
        odds = math.log(p / (n[1] + 10 - p + 1)) - math.log(q / (n[0] + 10 - q + 1))
        if pos >= 3 and len(before[t]) >= 6 and odds / math.sqrt(1 / p + 1 / q) >= 3 and odds > 1.5:
            want[t] = min(odds, 8.0)
    assert want and {"vile", "scum*"} <= set(want) and set(model.scores) == set(want)
    assert all(abs(model.scores[t] - s) < 1e-9 for t, s in want.items())
    # Scores from all stretches of words: the best, and how many maximal ones are significant.
    for _, text in rows[:40]:
        w = plain_words(text)
        each = [next((model.scores[t] for t in (x, *(x[:k] + "*" for k in (4, 5, 6) if len(x) > 4)) if t in model.scores), model.other) for x in w]
        best = max(sum(each[a:b]) for a in range(len(w)) for b in range(a + 1, len(w) + 1))
        x, y = model.features(text)
        assert abs(x - (min(max(model.rate * best - math.log(len(w)), 0), 40) / 10 if best > 0 else 0)) < 1e-9
        assert abs(model.score(text) - 1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * x + model.weights[2] * y)))) < 1e-12


def test_toxicity_of_long_texts_and_nothing(spark, corpus):
    long = " ".join(["scumbag", "Abcdefgh"] * 200_000)
    assert [w for part in toxicity.words(long) for w in part] == plain_words(long)
    rows, labels = corpus
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.toxicity_report(docs, marked).where("doc_id = 7").count() == 2
    assert toxicity.toxicity_report(docs.where("false"), marked).count() == 0


def test_weights_by_brute_force(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame([*rows, (9001, None), (9002, "")], "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    got = resampling.resample(docs, marked, share=0.3).collect()
    grams = lambda text: Counter(resampling.buckets_of(np.frombuffer(text.encode(), np.uint8)).tolist())
    good = {i for i, y in labels if y == 1}
    target, raw = Counter(), Counter()
    for i, text in rows:
        raw.update(grams(text))
        if i in good:
            target.update(grams(text))
    size = resampling.BUCKETS
    ratio = lambda b: math.log((target[b] + 1) / (sum(target.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size))
    want = {i: sum(k * ratio(b) for b, k in grams(text).items()) for i, text in rows[:60]} | {9001: 0.0, 9002: 0.0}
    weights = {r["doc_id"]: r["log_weight"] for r in got}
    assert all(abs(weights[i] - w) < 1e-6 for i, w in want.items())
    # The rows of a repeated id share text and noise here, and are drawn together.
    assert len({(r["noisy"], r["selected"]) for r in got if r["doc_id"] == 7}) == 1
    drawn = [r["noisy"] for r in got if r["selected"]]
    assert int(0.3 * len(got)) <= len(drawn) <= int(0.3 * len(got)) + 1 and min(drawn) >= max(r["noisy"] for r in got if not r["selected"])


def test_topk_in_many_tiles(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)], "vec_id long, embedding array<double>").repartition(9)
    rows = lambda d: {tuple(r) for r in d.select("query_id", "rank", "vec_id", "score").collect()}
    whole = rows(topk.nearest(df))
    assert len(whole) == 20 * 20 and rows(topk.nearest(df, slice_rows=16, group_rows=3)) == whole
    assert topk.nearest(df.where(F.lit(False))).count() == 0

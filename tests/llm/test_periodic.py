"""Runs against brute force over all periods and places."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import periodic
from spanforge.llm.periodic import collapse, find_runs, periodic_runs, planted, run_report


def brute(w):
    """Every stretch in which words q apart are identical; the smallest q of each."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        at = 0
        while at + q < len(w):
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end > at and end + q - at >= max(6, 4 * q):
                found.setdefault((at, end + q - at), q)
            at = end + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequence(rng):
    """Repetitions inside repetitions, over few words or many."""
    k = rng.choice([1, 2, 2, 3, 5, 30])
    w = [rng.randrange(k) for _ in range(rng.randrange(90))]
    if rng.random() < 0.6:
        n, w = len(w), []
        while len(w) < n:
            w += [rng.randrange(k) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 8)
        if rng.random() < 0.6:
            w = w + [99] * rng.randrange(2) + w + [rng.randrange(k)] + w
    return w


def test_runs_by_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        own = [sequence(rng) for _ in range(rng.randrange(1, 7))]
        assert find_runs([np.array(w, np.int64) for w in own]) == [brute(w) for w in own]


def test_factors_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        w = sequence(rng)
        if not w:
            continue
        s = periodic.Suffixes(np.array(w), np.array([0, len(w)]))
        length, source = periodic.previous_factors(s)

        def common(i, j, w=w):
            k = 0
            while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            return k

        for i in range(len(w)):
            assert length[i] == max((common(i, j) for j in range(i)), default=0)
            assert source[i] < i and (source[i] == -1 if not length[i] else common(i, int(source[i])) == length[i])


def test_long_sequences():
    assert find_runs([np.zeros(50_000, np.int64)]) == [[(0, 50_000, 1)]]
    nested = ([1, 2] * 5 + [3]) * 2000
    runs = find_runs([np.array(nested)])[0]
    assert (0, 22_000, 11) in runs and len(runs) == 2001


def plain(doc_id, text, plant):
    w = (text or "").encode().split()
    w = planted(doc_id, w) if plant else w
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    assert kept == b" ".join(collapse(w, runs))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(kept))


def test_report(spark, monkeypatch):
    monkeypatch.setattr(periodic, "WORDS", 500)
    rng = random.Random(8)
    names = ["a", "B", "b", "é", "c,", "日本", "d d", "x y"]
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "go " * 7, "go go go go go", "Go go " * 5] + [" ".join(names[v % len(names)] for v in sequence(rng)) for _ in range(300)]
    texts += [" ".join(str(rng.randrange(9)) for _ in range(rng.randrange(400))) for _ in range(100)] + ["ab " * 30_000]
    rows = list(enumerate(texts)) + [(3, "z " * 9), (3, "z " * 9), (None, "z " * 9), (-5, "y " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("runs", F.lit("clash")).withColumn("best", F.lit(1))
    got = run_report(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = lambda rows: sorted(map(repr, rows))
    last = len(texts) - 1
    assert short(tuple(r) for r in got.collect() if r["doc_id"] != last) == short(plain(i, t, True) for i, t in rows if i != last)
    found = {r["doc_id"]: r for r in periodic_runs(df).collect()}
    assert [tuple(r) for r in found[last]["runs"]] == [(0, 30_000, 1)] and found[last]["collapsed"] == "ab"
    assert found[0]["runs"] == [] and found[0]["collapsed"] == "" and found[4]["collapsed"] == "go" and found[5]["collapsed"] == "go go go go go"
    assert run_report(df.limit(0)).count() == 0


def test_planted_tails():
    words = [str(k).encode() for k in range(100)]
    for i in range(200):
        got = planted(i, words)
        assert len(got) == 100 and set(got) <= set(words) and (got == words or brute(got) or len(set(got)) > 20)

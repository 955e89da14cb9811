"""What a document can lose and still hold an item, by brute force; and results that don't depend on the index."""

import itertools
import random

import numpy as np
import pytest

from spanforge.llm import decontamination as d
from tests.llm.test_operators import WORDS, prose, shingle_set


def overlap(item, text):
    own = shingle_set(item, 5)
    have = shingle_set(text, 5) if len(item.split()) >= 5 else {tuple(text.split()[k : k + len(item.split())]) for k in range(len(text.split()))}
    return len(own & have) / len(own)


@pytest.mark.parametrize("n_words", [5, 6, 7, 9, 12, 14])
def test_most_lost_by_brute_force(n_words):
    rng = np.random.default_rng(n_words)
    places = n_words - 4
    for lacking in range(places + 1):
        weights = rng.random(n_words - 1) ** 3
        most = 0.0
        for gone in itertools.combinations(range(places), lacking):
            lost = [p for p in range(n_words - 1) if set(range(max(0, p - 3), min(p, places - 1) + 1)) <= set(gone)]
            most = max(most, float(weights[lost].sum()))
        assert abs(d.most_lost(weights, n_words, lacking) - most) < 1e-12
    assert d.LONG and d.most_lost(np.ones(9999 + 4), 9999 + 5, 10) <= 13


def test_rare_words_changed(spark):
    """An item that shares most of its words with many others, in a text that has changed what is its own."""
    rng = random.Random(5)
    head, tail = prose(rng, 30), prose(rng, 30)
    items = [(k, f"{head} " + " ".join(f"own{k}x{j}" for j in range(6)) + f" {tail}") for k in range(400)]
    items += [(1000 + k, prose(rng, 40)) for k in range(20)]
    w = items[0][1].split(" ")
    w[31], w[35] = "changed", "words"
    text = prose(rng, 80) + " " + " ".join(w) + " " + prose(rng, 50)
    assert 0.8 <= overlap(items[0][1], text) < 0.9
    want = sorted(k for k, t in items if 10 * len(shingle_set(t, 5) & shingle_set(text, 5)) >= 8 * len(shingle_set(t, 5)))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for some in (items, items[:1] + items[400:]):
        bench = spark.createDataFrame(some, "item_id long, text string")
        got = d.leak_report(docs, bench).first()
        assert got["items"] == ",".join(str(k) for k in want if k in dict(some)) and "0" in got["items"].split(",")


@pytest.mark.parametrize("most", [20_000, 4])
def test_any_number_of_indexes_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(d, "INDEX_ITEMS", most)
    rng = random.Random(6)
    base = prose(rng, 25)
    items = [(k, (base + " " + prose(rng, rng.choice([3, 12]))) if k % 3 else prose(rng, rng.choice([1, 2, 4, 5, 9, 40]))) for k in range(21)]
    items += [(50, items[4][1]), (51, "la la la la la la la la la"), (52, None), (4, items[4][1])]
    texts = []
    for _ in range(150):
        w = prose(rng, 20).split(" ")
        for _, t in rng.sample(items[:21], 2):
            own = t.split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            cut = rng.randrange(len(own)) if rng.random() < 0.3 else 0  # in two places, far apart
            w = own[cut:] + w + prose(rng, rng.choice([5, 300])).split(" ") + own[:cut]
        texts.append(" ".join(w))
    texts += ["so la la la la la la", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in d.leak_report(docs, bench).collect()}
    held = {k: t for k, t in items if t}
    for i, text in enumerate(texts):
        want = sorted(k for k, t in held.items() if text and overlap(t, text) >= 0.8 - 1e-12)
        assert got[i] == ",".join(map(str, want)), i
    assert any("," in x for x in got.values())

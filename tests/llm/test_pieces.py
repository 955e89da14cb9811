"""The encoder against an agenda by brute force, and what merge-dropout varies by."""

import random
from collections import Counter

import numpy as np
import pytest

from spanforge.llm import pieces
from tests.llm.test_operators import docs_of


@pytest.fixture(scope="module")
def model():
    return pieces.model(pieces.MODEL)


def plain_agenda(m, text, rate, seed, document):
    """All ids of a text: each stretch as a list of strings, the best candidate looked for afresh at every step."""
    other = {0, 1, 2, *m.bytes.values()}
    vocabulary = {p: i for i, p in enumerate(m.pieces) if i not in other}
    chars = [None if c == pieces.MARK else c.replace(" ", pieces.MARK) for c in " " + text] if text else []
    inside = {p[k : k + 2] for p in vocabulary for k in range(len(p) - 1)}
    stretches, at = [], 0
    for k in range(1, len(chars) + 1):
        if k == len(chars) or chars[k] is None or chars[k - 1] is None or chars[k - 1] + chars[k] not in inside:
            stretches.append((at, chars[at:k]))
            at = k
    out = []
    for at, symbols in stretches:
        with np.errstate(over="ignore"):
            key = pieces.mix(np.array([pieces.Encoder(m, rate, seed).key(document)], np.uint64) + np.uint64(at) * pieces.GOLDEN)
        symbols, refused, n = list(symbols), set(), 0
        while True:
            begins = np.cumsum([0, *(len(s or " ") for s in symbols)]).tolist()
            found = [
                (int(m.rank[vocabulary[a + b]]), begins[k], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
                if a and b and a + b in vocabulary and (begins[k], begins[k + 1], begins[k + 2]) not in refused]
            if not found:
                break
            _, _, k = min(found)
            n += 1
            if pieces.skipped(key, n - 1, rate)[0]:
                refused.add((begins[k], begins[k + 1], begins[k + 2]))
            else:
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        for s in symbols:
            out += [vocabulary[s]] if s in vocabulary else [m.bytes[b] for b in (s or pieces.MARK).encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.4, 1.0])
def test_ids_are_those_of_the_plain_agenda(model, rate):
    rng = random.Random(5)
    letters = "aeinorst" * 3 + "ABZ.,-\n\t 1290éß語🙂▁" + " " * 6
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["", " ", "   a", "international understanding of the counter-revolutionaries", "a" * 200 + "in" * 60, " " * 130 + "x"]
    got, counts = pieces.Encoder(model, rate, 17).batch(texts, list(range(len(texts))))
    edges = np.cumsum([0, *counts])
    for k, t in enumerate(texts):
        assert got[edges[k] : edges[k + 1]].tolist() == plain_agenda(model, t, rate, 17, k), t
    assert pieces._texts(model, got, counts, np.ones(len(texts), bool)).to_pylist() == texts


def test_chunks_and_neighbours_change_nothing(model, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 9))) for _ in range(400)) + "x" * 300 for _ in range(8)]
    whole, counts = pieces.Encoder(model, 0.1, 17).batch(texts, list(range(8)))
    each = [pieces.encode(model, t, 0.1, 17, k) for k, t in enumerate(texts)]
    assert whole.tolist() == [i for x in each for i in x]
    monkeypatch.setattr(pieces, "CHUNK", 100)
    small, again = pieces.Encoder(model, 0.1, 17).batch(texts, list(range(8)))
    assert small.tolist() == whole.tolist() and again.tolist() == counts.tolist()


@pytest.mark.parametrize("word", ["information", "understanding", "international-relationships"])
def test_long_words_vary_by_document(model, word):
    assert len({tuple(pieces.encode(model, word, 0.1, 17, k)) for k in range(300)}) > 5


@pytest.mark.parametrize("word", ["the", "information"])
def test_words_vary_by_place(model, word):
    n = 2000
    ids = pieces.encode(model, " ".join([word] * n), 0.1, 17, 5)
    assert pieces.decode(model, ids) == " ".join([word] * n) and len(ids) > 1.05 * n * len(pieces.encode(model, word))
    assert len({pieces.decode(model, ids[k : k + 3]) for k in range(len(ids) - 2)}) > 3


def test_candidates_are_skipped_at_the_rate(model):
    got = Counter(len(pieces.encode(model, "in", 0.3, 17, k)) for k in range(4000))
    plain = len(pieces.encode(model, "in"))
    assert plain == 1 and sum(n for size, n in got.items() if size > 1) / 4000 > 0.3  # one of several candidates is enough


def test_a_very_long_text_and_a_very_long_word(model):
    rng = random.Random(7)
    text = " ".join(rng.choice(["the", "of", "nation", "zq9"]) for _ in range(150_000)) + "q" * 20_000 + "in" * 3000
    ids = pieces.encode(model, text, 0.1, 17, 1)
    assert pieces.decode(model, ids) == text


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", "y"), (2, None, "z"), (3, "", "z")], "doc_id long, text string, token_ids string")
    got = pieces.decode_pieces(pieces.encode_pieces(df)).collect()
    assert got[0] == got[1] and got[0]["decoded"] == "a b" and got[2]["decoded"] == "c"
    assert got[3]["token_ids"] is None and got[3]["decoded"] is None and got[4]["token_ids"] == [] and got[4]["decoded"] == ""
    both = pieces.encode_pieces(df, decoded="decoded").collect()
    assert both == got
    assert pieces.piece_report(df.limit(0)).collect() == [] and pieces.encode_pieces(docs_of(spark, [])).collect() == []
    report = {r["doc_id"]: r for r in pieces.piece_report(df).collect()}
    assert report[2]["n_tokens"] == 0 and all(r["lossless"] for r in report.values())

"""The other operators against brute force, exact round trips, or held-out accuracy, and the special cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import decontamination, html_blocks, near_dup, passages, pieces, resampling, topk, toxicity
from spanforge.llm.bytescan import shingles, word_hashes
from spanforge.llm.components import components

WORDS = [a + b + c for a in ("ba", "ko", "ri", "mu", "se") for b in ("n", "l", "st", "r") for c in ("a", "o", "ing", "er", "ul")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, texts, extra=True):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumn("regs", F.lit("clash")).withColumn("n", F.lit(0)) if extra else df


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")


def own_words(text):
    return [w for w in words(text) if w]


def shingle_set(text, width):
    w = own_words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_word_hashes_split_and_fold():
    raw = lambda s: np.frombuffer(s.encode(), np.uint8)
    assert word_hashes(raw("Ab\tcd  \n é")).tolist() == word_hashes(raw("ab cd é")).tolist() and len(word_hashes(raw(" \n"))) == 0
    assert len(shingles(word_hashes(raw("a b")), 5)) == 1 and len(np.unique(word_hashes(raw(" ".join(WORDS))))) == len(WORDS)
    assert len(word_hashes(raw("y" * (1 << 21) + " z"))) == 2


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (900, 800), (900, 850)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[900] == got[850] == 800 and 7 in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(spark, width, percent):
    rng = random.Random(width)
    texts = [None, "", "  ", "one", "one two", "ONE two", "one"] + [prose(rng, 80) for _ in range(10)]
    base = prose(rng, 120).split(" ")
    for _ in range(60):  # a large group of near copies, not all of them linked with each other
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    texts += [texts[20]] * 20
    sets = [shingle_set(t, width) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs_of(spark, texts), width, percent).collect()}
    assert {i: got[i]["component_id"] for i in got} == {i: root(i) for i in range(len(texts))}
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (root(i) == i) for i in got)


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(docs_of(spark, []).where("false")).count() == 0


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)] + [(400, None), (401, [float("nan")] * 16), (402, [1.0, None] * 8), (420, [0.5] * 16), (440, [0.5] * 3), (441, [0.25] * 3)]
    rows += [(460 + i, [0.5] * 16) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    good = [(i, np.floor(64 * np.array(v))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:20]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    assert {tuple(r) for r in topk.nearest(df).select("query_id", "rank", "vec_id", "score").collect()} == want
    assert topk.nearest(df.where("false")).count() == 0


def test_topk_beyond_doubles(spark):
    rows = [(0, [1e12, -1.0]), (1, [1e12 + 1, 3.0]), (2, [1e12, 2.0])]
    got = [tuple(r) for r in topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").select("vec_id", "rank").collect()]
    assert got == [(1, 1), (2, 2)]


def test_segments_are_maximal():
    rng = random.Random(1)
    for _ in range(200):
        hits = sorted({rng.randrange(40) for _ in range(rng.randrange(1, 12))})
        scores = [(p, float(rng.randrange(1, 6))) for p in hits]
        flat = [-1.0] * 41
        for p, s in scores:
            flat[p] = s
        got = toxicity.maximal_segments(scores, -1.0)

        def split(lo, hi):  # by definition: the best segment, then what lies on either side
            best = max(((sum(flat[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            return [] if best is None or best[0] <= 0 else [*split(lo, best[3]), best, *split(best[4], hi)]

        assert [round(s[2], 6) for s in got] == [round(s[0], 6) for s in split(0, 41)]


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    bad, rows, labels = ["vile", "scumbag", "wretch"], [], []
    for i in range(1200):
        w = prose(rng, rng.randrange(30, 120)).split(" ")
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1 if toxic else 0))
    rows += [(5000, None), (5001, "")]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(9)), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity_report(docs, marked).join(marked, "doc_id", "left").collect()
    held = [r for r in got if r["held_out"] and r["toxic"] is not None]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] >= 5000)
    assert toxicity.toxicity_report(docs, marked.where("false")).where("score > 0").count() == 0


def test_passages_by_brute_force(spark):
    rng = random.Random(4)
    shared, near = prose(rng, 60), prose(rng, 80)
    edited = near.split(" ")
    edited[40] = "changed"
    texts = [prose(rng, 150) for _ in range(12)] + [prose(rng, 30) + " " + shared + " " + prose(rng, k) for k in (10, 40, 90)] + [prose(rng, 20) + " " + near, " ".join(edited) + " " + prose(rng, 33), None, "", "short text"]
    texts += [texts[0]] * 3 + [shared[:200]]
    got = {r["doc_id"]: r for r in passages.passage_report(docs_of(spark, texts)).collect()}
    runs = {}
    for i, t in enumerate(texts):
        w = own_words(t)
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {i for s in runs.values() if len(s) > 1 for i in s} | {15, 16}
    assert {i for i, r in got.items() if r["n_passages"]} == want and len(got) == len(texts)
    for i, t in enumerate(texts):
        w, spans = own_words(t), [tuple(map(int, s.split(":"))) for s in got[i]["spans"].split(",") if s]
        assert all(any(a <= k and k + 50 <= b for a, b in spans) for k in range(len(w) - 49) if len(runs[tuple(w[k : k + 50])]) > 1)
    assert got[12]["class_id"] == got[13]["class_id"] == got[14]["class_id"] == 12 and got[16]["class_id"] == 15 and got[0]["first_doc"] == 20


def test_compact_windows_are_a_cartesian_tree():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 60, 200):
        h = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        for low, places, high in passages.compact_windows(h, 5):
            assert high - low >= 5 and (h[low:high].min() == h[places]).all()
            assert low == 0 or h[low - 1] < h[places[0]]
            assert high == n or h[high] < h[places[0]]


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(5, 40))) for i in range(150)] + [(500, "single"), (501, "?!")]
    index = decontamination.Index(items)
    for _ in range(60):
        text = " ".join(items[rng.randrange(150)][1] for _ in range(3)) + " " + prose(rng, 30)
        terms = np.unique(np.searchsorted(index.terms, [t for t in decontamination.terms_of(decontamination.words_of(decontamination.raw_of(text))).tolist() if t in set(index.terms.tolist())]))
        full = np.zeros(len(index.ids))
        for t in terms:
            full[index.postings[t].items] += index.postings[t].adds
        for least in (0.1, 0.5, 0.9):
            assert set(index.retrieve(terms.tolist(), least)) == {k for k, s in enumerate(full) if s >= least - 1e-9}
    assert [x[0] for x in index.leaks(decontamination.words_of(decontamination.raw_of("so Single, it is")))] == [500]


def test_leaks(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, 30) + ". " + prose(rng, 8) + ".") for i in range(40)] + [(90, None), (91, "")] + [(95, prose(rng, 400))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    half = " ".join(items[3][1].split(" ")[:20])
    texts = [prose(rng, 50) + " " + items[0][1].upper().replace(" ", "\n") + " " + prose(rng, 500), half + " " + prose(rng, 90), None, "", prose(rng, 300), items[42][1] + items[5][1]]
    got = {r["doc_id"]: r["items"] for r in decontamination.leak_report(docs_of(spark, texts), bench).collect()}
    assert got == {0: "0", 1: "", 2: "", 3: "", 4: "", 5: "5,95"}
    assert decontamination.leak_report(docs_of(spark, texts), bench.where("false")).where("contaminated").count() == 0


def test_resampling(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join("junk%d" % rng.randrange(9) for _ in range(60))) for i in range(600)] + [(900, None), (901, "")]
    labels = [(i, 1 if i % 3 else 0) for i in range(0, 300)]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = resampling.resample(docs, marked, share=0.5).collect()
    order = sorted(got, key=lambda r: (-r["noisy"], r["doc_id"]))
    assert [r["selected"] for r in order] == [True] * 301 + [False] * 301
    assert sum(r["selected"] for r in got if r["doc_id"] % 3 == 0 and r["doc_id"] < 600) <= 5 and all(r["log_weight"] == 0 for r in got if r["doc_id"] >= 900)
    again = resampling.resample(docs.repartition(7), marked, share=0.5).collect()
    assert {r["doc_id"] for r in again if r["selected"]} == {r["doc_id"] for r in got if r["selected"]}
    assert resampling.resample(docs.where("false"), marked).count() == 0


def test_html():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>A &amp; B</h1><p>One  \n two<br>three<p>Four <b>five</p><form>Send</form><aside>Side</aside><div class='comments'><p>Nice</div><script>if (a<b) {}</script></article><footer>&copy; x</footer>"
    assert html_blocks.main_text(page) == "A & B\n\nOne two three\n\nFour five"
    assert html_blocks.main_text(None) == html_blocks.main_text("") == html_blocks.main_text("<p hidden>x</p>") == ""
    assert html_blocks.main_text('<article><p>cut off <a href="x') == "cut off"
    assert html_blocks.main_text("<article><p>a<!-- b --> c &lt;d&gt; &#233;</article>") == "a c <d> é"
    assert html_blocks.tree().decide((1, 1.0, 1, 1.0, 1, 1.0, 0)) == 0


def test_html_report(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é x</article>"), (2, "v", None)], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in html_blocks.page_report(df).collect()} == {1: ("é x", 3), 2: ("", 0)}


@pytest.fixture(scope="module")
def model():
    return pieces.model(pieces.MODEL)


def test_pieces_without_dropout_are_the_models_own(model):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(9)
    for t in ["", " ", "  lead trail  ", "a  b\n\n\tc É½ 日本 😀\r\n", "x" * 300] + [prose(rng, 40) + "?! ñandú" for _ in range(40)]:
        assert pieces.encode(model, t) == own.encode(t)


def test_pieces_round_trip_and_vary(model):
    rng = random.Random(10)
    texts = ["▁ a ▁▁b", "", "\x00  ", "é" * 50, " ", "  "] + [prose(rng, 30) for _ in range(20)]
    forms = set()
    for seed in range(4):
        e = pieces.Encoder(model, 0.3, seed)
        for v in range(2):
            ids = [e.encode(t, v) for t in texts]
            assert [pieces.decode(model, x) for x in ids] == texts
            forms.add(str(ids))
    assert len(forms) >= 4
    assert pieces.Encoder(model, 0.3, 1).encode(texts[-1]) == pieces.Encoder(model, 0.3, 1).encode(texts[-1])
    pair = model.of_char[[ord("i"), ord("n")]].tolist()
    dropped = sum(pieces.by_heap(model, list(pair), k, 0.3) == pair for k in range(4000)) / 4000
    assert abs(dropped - 0.3) < 0.04


def test_piece_report(spark):
    got = {r["doc_id"]: r for r in pieces.piece_report(docs_of(spark, [None, "", "hello world"])).collect()}
    assert [(got[i]["n_tokens"] > 0, got[i]["lossless"]) for i in range(3)] == [(False, True), (False, True), (True, True)]

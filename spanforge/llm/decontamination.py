"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage by block-max WAND.

The terms are pairs of neighbouring words (a single word, for items of one word): words are lower-cased runs of letters
and digits. Document frequencies and lengths are those of the items of an index. A document holds an item if it has at least
``LEAST_OVERLAP`` of the item's five-word shingles. An item's threshold is the least score that such a document can have: the item's own score without the most that
can be lost with the other shingles (``most_lost``; a pair is lost only with all shingles that hold it). Postings are divided by it, so one threshold, 1, fits all items, and
whatever frequencies an index has, every item that a document holds is retrieved: results don't depend on how items are spread over indexes.

Each document is queried as a whole; block-max WAND returns every item at or above the threshold, with no limit on their number, and most documents have none.
Those that have any are queried by passages that overlap by half, at least twice as long as the longest item, for the score of the best one.

What is retrieved is verified: the share of the item's five-word shingles that the document has, for the item as a whole
(which decides), its question (all but the last sentence) and its answer (the last sentence).

Items are spread over indexes by length class and size: each has at most ``INDEX_ITEMS`` items and about
``INDEX_CHARS`` characters (a single longer item has its own), which bounds what is broadcast; a larger benchmark makes more
indexes, and each document is queried against all of them in turn. No rows of documents are moved.

Defined cases: null and empty texts, and items without words, match nothing; items of fewer than five words count as one
shingle, found wherever these words follow one another; equal items are all reported, a repeated item id counts once; repeated documents are each reported; other columns
of the documents are carried along, unless named as the result; empty tables give no leaks. Texts are used whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.bytescan import PRIME, PUNCTUATION, fold_latin, mix, shingles, texts, word_hashes

WIDTH = 5
LEAST_OVERLAP = 0.8
#: Scores are sums of doubles; a document at the threshold counts. Items of more shingles have a plainer bound of what can be lost.
SLACK, LONG = 1e-9, 4000
K1, B = 1.2, 0.75
BLOCK = 64
SHORTEST = 64
INDEX_ITEMS, INDEX_CHARS = 20_000, 16_000_000
LEAK = "array<struct<item_id:bigint,score:double,overlap:double,question:double,answer:double>>"


def words_of(raw: np.ndarray | None) -> np.ndarray:
    if raw is None or not len(raw):
        return np.zeros(0, np.uint64)
    return word_hashes(fold_latin(raw), PUNCTUATION)


def terms_of(words: np.ndarray) -> np.ndarray:
    """The pairs of neighbouring words, in order."""
    with np.errstate(over="ignore"):
        return mix(words[:-1] * PRIME + words[1:]) if len(words) > 1 else words[:0]


def raw_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer of an item: its last sentence is the answer."""
    cuts = [m.end() for m in re.finditer(r"[.?!:\n]\s+(?=\S)", text)]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, "")


def shingled(words: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct shingles of an item or a part of it, and their width: fewer words than WIDTH are one shingle."""
    return np.unique(shingles(words, WIDTH)), min(WIDTH, len(words))


def spare(words: np.ndarray) -> int:
    """How many places of an item's shingles a document may lack that still has LEAST_OVERLAP of the distinct ones."""
    _, times = np.unique(shingles(words, WIDTH), return_counts=True)
    may = len(times) - (8 * len(times) + 9) // 10
    return int(np.sort(times)[::-1][:may].sum())


def most_lost(weights: np.ndarray, n_words: int, lacking: int) -> float:
    """The most weight of pairs (by place) that a text of so many words can lose if it lacks so many shingles (by place).

    Pair p is lost if every shingle that holds it is lacking: those that begin at p - 3 to p, where there are such. Place by place, best[r, k] is the most that is lost with k
    lacking so far and the last r of them in a row, 4 standing for more. Before the first place and after the last there is none that could be had.
    """
    places = n_words - WIDTH + 1
    if lacking <= 0 or places < 1:
        return 0.0
    if lacking >= places:
        return float(weights.sum())
    if places > LONG:
        return float(np.sort(weights)[::-1][:lacking].sum() + weights[-3:].sum())  # but for the last three, each lost pair has a lacking place of its own
    full = WIDTH - 1
    best = np.full((full + 1, lacking + 1), -np.inf)
    best[full, 0] = 0.0
    for s in range(places):
        after = np.full_like(best, -np.inf)
        after[0] = best.max(axis=0)
        after[1:full, 1:] = best[: full - 1, :-1]
        after[full, 1:] = np.maximum(best[full - 1, :-1], best[full, :-1]) + weights[s]
        best = after
    ends = np.concatenate([[0.0], np.cumsum(weights[::-1][: full - 1]), [weights[-3:].sum()]])  # what a row of 0 to 4 at the end loses besides
    return float((best.max(axis=1) + ends).max())


@dataclass
class Postings:
    """The items of one term by number, what each adds, and the most that any of a block of them adds."""

    items: np.ndarray
    adds: np.ndarray
    lasts: np.ndarray  # the last item of each block
    tops: np.ndarray  # the most in each block
    top: float


class Index:
    """An inverted index of test items, with normalized BM25 scores."""

    def __init__(self, items: list[tuple[int, str]]):
        kept = [(i, w, t) for i, t in items if len(w := words_of(raw_of(t)))]
        self.ids = [i for i, _, _ in kept]
        self.shingles = [shingled(w) for _, w, _ in kept]
        self.parts = [tuple(shingled(words_of(raw_of(p))) for p in parts_of(t)) for _, _, t in kept]
        self.longest = max((len(w) for _, w, _ in kept), default=0)
        self.passage = 2 * max(SHORTEST, self.longest)
        own = [Counter((terms_of(w) if len(w) > 1 else w).tolist()) for _, w, _ in kept]
        self.single = any(len(w) == 1 for _, w, _ in kept)
        lengths = [sum(c.values()) for c in own]
        mean = sum(lengths) / len(lengths) if lengths else 1.0
        seen: Counter[int] = Counter(t for c in own for t in c)
        adds: defaultdict[int, list[tuple[int, float]]] = defaultdict(list)
        self.least = np.zeros(len(kept))  # each item's threshold, as a share of its own score
        for k, (count, length, (_, w, _)) in enumerate(zip(own, lengths, kept, strict=True)):
            score = {t: math.log(1 + (len(own) - seen[t] + 0.5) / (seen[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean)) for t, n in count.items()}
            total = sum(score.values())
            weights = np.array([score[t] / count[t] for t in (terms_of(w) if len(w) > 1 else w).tolist()])
            self.least[k] = max((total - most_lost(weights, len(w), spare(w))) / total, SLACK)
            for t, s in score.items():
                adds[t].append((k, s / total / self.least[k]))
        self.terms = np.array(sorted(adds), np.uint64)
        self.postings = [self._postings(adds[t]) for t in self.terms.tolist()]
        self.tops = np.array([p.top for p in self.postings])

    @staticmethod
    def _postings(pairs: list[tuple[int, float]]) -> Postings:
        items, adds = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        starts = np.arange(0, len(items), BLOCK)
        lasts = items[np.minimum(starts + BLOCK, len(items)) - 1]
        return Postings(items, adds, lasts, np.maximum.reduceat(adds, starts), float(adds.max()))

    def retrieve(self, terms: list[int], least: float = 1.0) -> dict[int, float]:
        """Every item whose score for these terms (by number) is at least the threshold: block-max WAND."""
        lists = [self.postings[t] for t in terms]
        cursors = [[int(p.items[0]), 0, p] for p in lists]  # the current item, its place, the postings
        found: dict[int, float] = {}
        slack = SLACK
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2].top
                if bound >= least - slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            ahead = cursors[: pivot + 1]
            bound, until = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 62
            for _, _, p in ahead:
                b = int(np.searchsorted(p.lasts, item))
                if b < len(p.tops):
                    bound += float(p.tops[b])
                    until = min(until, int(p.lasts[b]) + 1)
            if bound < least - slack:
                target = max(until, item + 1)  # no item before the end of these blocks can reach the threshold
            elif ahead[0][0] == item:
                score = sum(float(p.adds[place]) for _, place, p in ahead)
                if score >= least - slack:
                    found[item] = score
                target = item + 1
            else:
                target = item
            for c in ahead:
                if c[0] < target:
                    c[1] = int(np.searchsorted(c[2].items, target))
                    c[0] = int(c[2].items[c[1]]) if c[1] < len(c[2].items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def candidates(self, words: np.ndarray) -> dict[int, float]:
        """Every item that a text retrieves, with the score of its best passage, as a share of the item's own."""
        terms = terms_of(words)
        if self.single:
            terms = np.concatenate([terms, words])  # the pairs, then the words: places are taken from either
        if not len(terms) or not len(self.terms):
            return {}
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == terms)
        if not len(hit):
            return {}
        number = at[hit]
        every = np.unique(number)
        if self.tops[every].sum() < 1 - SLACK:
            return {}
        items = self.retrieve(every.tolist())
        return self._best_passages(items, number, hit % max(1, len(words) - 1) if self.single else hit) if items else {}

    def _best_passages(self, items: dict[int, float], number: np.ndarray, place: np.ndarray) -> dict[int, float]:
        """Of each of these items, the best score that a passage has, as a share of the item's own."""
        best = dict.fromkeys(items, 0.0)
        for shift in (0, self.passage // 2):  # two rows of passages, which overlap by half
            which = (place + shift) // self.passage
            order = np.argsort(which, kind="stable")
            for own in np.split(number[order], np.flatnonzero(np.diff(which[order])) + 1):
                score: Counter[int] = Counter()
                for p in (self.postings[t] for t in np.unique(own).tolist()):
                    for item in best:
                        at = int(np.searchsorted(p.items, item))
                        if at < len(p.items) and p.items[at] == item:
                            score[item] += float(p.adds[at]) * float(self.least[item])
                for item, s in score.items():
                    best[item] = max(best[item], s)
        return best

    def leaks(self, words: np.ndarray) -> list[tuple[int, float, float, float, float]]:
        """item_id, score, and the overlaps (whole, question, answer) of the items that a text holds."""
        found = self.candidates(words)
        if not found:
            return []
        have: dict[int, np.ndarray] = {}

        def common(part: tuple[np.ndarray, int]) -> int:
            own, width = part
            if not len(own):
                return 0
            if width not in have:
                have[width] = np.unique(shingles(words, width))
            return int(np.isin(own, have[width]).sum())

        def share(part: tuple[np.ndarray, int]) -> float:
            return common(part) / len(part[0]) if len(part[0]) else 0.0

        out = []
        for item in sorted(found):
            own = self.shingles[item]
            shared = common(own)
            if 10 * shared >= 8 * len(own[0]):
                out.append((self.ids[item], found[item], shared / len(own[0]), *(share(p) for p in self.parts[item])))
        return out


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The indexes of all items, one at a time, by length class and within the bounds."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    n_words = F.size(F.split("text", r"[\x00-/:-@\[-`{-\x7f]+")).cast("double")
    level = F.greatest(F.lit(0), F.ceil(F.log(8.0, n_words / SHORTEST))).cast("int")
    leveled = rows.withColumn("level", level)
    for r in leveled.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).orderBy("level").collect():
        shards = max(1, math.ceil(max(r["n"] / INDEX_ITEMS, r["chars"] / INDEX_CHARS)))
        for k in range(shards):
            part = leveled.where((F.col("level") == r["level"]) & (F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)).orderBy("item_id")
            yield Index([(x["item_id"], x["text"]) for x in part.select("item_id", "text").collect()])  # within INDEX_ITEMS and INDEX_CHARS


def find_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks") -> DataFrame:
    """documents with column out: the test items that each text holds."""
    names = [c for c in documents.columns if c != out]
    df = documents.select(*names).withColumn(out, F.array().cast(LEAK))
    schema = T.StructType([*documents.select(*names).schema.fields, T.StructField(out, df.schema[out].dataType)])
    for index in indexes(benchmark):
        shared = df.sparkSession.sparkContext.broadcast(index)
        df = df.mapInArrow(_finder(shared, names, text, out), schema)
    return df


def _finder(shared, names: list[str], text: str, out: str):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
    fields = [kind.value_type.field(k).name for k in range(kind.value_type.num_fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            got = []
            for raw, before in zip(texts(batch.column(text)), batch.column(out).to_pylist(), strict=True):
                own = index.leaks(words_of(raw)) if raw is not None and len(raw) else []
                got.append(before + [dict(zip(fields, x, strict=True)) for x in own])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(got, kind)], names=[*names, out])

    return run


def leak_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids, comma-joined), overlap (the largest)."""
    found = find_leaks(documents.select("doc_id", "text"), benchmark)
    ids = F.array_sort(F.transform("leaks", lambda x: x["item_id"]))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"),
        F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("items"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["overlap"])), F.lit(0.0)).alias("overlap"))

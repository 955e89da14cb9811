"""Periodic runs of words, and texts with their repetitions collapsed.

A run is a stretch of consecutive words with smallest period q, of max(6, 4 * q) words or more, that no neighbouring word
extends with period q. They are found document by document, many documents at once:

1. Words become numbers. Suffixes are sorted by doubling: those that still share their first h words are sorted by what
   follows after h words. Only suffixes that are still tied are touched, and the ranks that they have at each h are kept, as two
   suffixes of one rank share h words.
2. From the suffix array, the common prefixes of neighbours, found with the kept ranks, give the longest previous factor of every place: a
   list in suffix order loses its places from the last to the first, and a place's neighbours at that time are
   the best of all earlier places. These factors cut the text into Lempel-Ziv blocks.
3. A run that touches the border of two blocks has a period below a third of their lengths together: for each border and such period, the matching
   words before and after (again by ranks) give the run, as in Main's extensions.
4. What lies inside a block is a copy of what lies inside its earlier occurrence. Runs are kept in buckets by start; each block, from left to
   right, copies the buckets of its source.

So work grows with n log n words, whatever a text repeats. A task holds one group of documents at a time, of ``WORDS`` words or one longer text;
its memory is a few hundred bytes for each word, and for texts that repeat for long 12 bytes more for each doubling.

Defined cases: null and empty texts, and texts of white space, have no words, no runs and an empty collapsed text; words are compared as
they are, by bytes; null, repeated and clashing ids don't matter, as each row is taken by itself; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and its period so many times.
LEAST, TIMES = 6, 4
#: Words of a group of documents.
WORDS = 200_000

Run = tuple[int, int, int]  # start, length, period
Words = list[bytes]


class Suffixes:
    """The sorted suffixes of several sequences, and how much any two places of one sequence have in common."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        """values: the numbers of all sequences, one after the other; starts: where each begins, and the end of all."""
        n = len(values)
        self.n = n
        lengths = np.diff(starts)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        end = np.repeat(starts[1:], lengths)
        # The rank of a suffix: how many suffixes are surely before it, those of earlier sequences too.
        order = np.lexsort((values, owner))
        new = np.ones(n, bool)
        new[1:] = (values[order[1:]] != values[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.owner = owner
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # h, the tied places, their ranks
        tied = self._tied(rank, np.arange(n))
        self.repeated = tied  # places whose word occurs again in the sequence
        h = 1
        while len(tied):
            self.levels.append((h, tied.astype(np.int32), rank[tied].astype(np.int32)))
            after = tied + h
            inside = after < end[tied]
            follow = np.zeros(len(tied), np.int64)
            follow[inside] = rank[after[inside]] + 1
            old = rank[tied]
            by = np.lexsort((follow, old))
            a, b = old[by], follow[by]
            group = np.ones(len(by), bool)
            group[1:] = a[1:] != a[:-1]
            first = np.maximum.accumulate(np.where(group, np.arange(len(by)), 0))
            split = group.copy()
            split[1:] |= b[1:] != b[:-1]
            rank[tied[by]] = a + np.maximum.accumulate(np.where(split, np.arange(len(by)), 0)) - first
            tied = self._tied(rank, tied)
            h *= 2
        self.rank = rank

    def _tied(self, rank: np.ndarray, places: np.ndarray) -> np.ndarray:
        many = np.bincount(rank[places], minlength=self.n)
        return places[many[rank[places]] > 1]

    def _same(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the h words from places i and from j are the same; False for places that are none."""
        _, places, ranks = self.levels[level]
        a, b = (np.minimum(np.searchsorted(places, x), len(places) - 1) for x in (i, j))
        return (places[a] == i) & (places[b] == j) & (ranks[a] == ranks[b])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same, for i and j in one sequence; 0 for places that are none."""
        out = np.zeros(len(i), np.int64)
        going = np.arange(len(i))
        for level in range(len(self.levels) - 1, -1, -1):
            same = self._same(level, i[going] + out[going], j[going] + out[going])
            out[going[same]] += self.levels[level][0]
        return out

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to and with i and j are the same."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            h = self.levels[level][0]
            x, y = i - out - h + 1, j - out - h + 1
            fit = (x >= 0) & (y >= 0)
            fit[fit] = self._same(level, x[fit], y[fit]) & (self.owner[x[fit]] == self.owner[i[fit]]) & (self.owner[y[fit]] == self.owner[j[fit]])
            out[fit] += h
        return out


def previous_factors(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) of the longest stretch from each place that also begins earlier in its sequence; 0 and -1 where there is none."""
    length, source = np.zeros(s.n, np.int64), np.full(s.n, -1, np.int64)
    places = s.repeated
    if not len(places):
        return length, source
    order = places[np.argsort(s.rank[places])]  # the suffix array, without words that occur once
    common = np.zeros(len(order) + 1, np.int64)
    common[1:-1] = np.where(s.owner[order[1:]] == s.owner[order[:-1]], s.ahead(order[1:], order[:-1]), 0)
    at = np.empty(s.n, np.int64)
    at[order] = np.arange(len(order))
    # Neighbours in suffix order among places not yet taken; common[k] is what k shares with the one before it.
    shared, held = common.tolist(), order.tolist()
    before, after = list(range(-1, len(held) - 1)), list(range(1, len(held) + 1))
    for place, k in zip(places[::-1].tolist(), at[places[::-1]].tolist(), strict=True):
        p, q = before[k], after[k]
        left, right = shared[k], shared[q]
        if left >= right:
            if left:
                length[place], source[place] = left, held[p]
            shared[q] = right
        else:
            length[place], source[place] = right, held[q]
            shared[q] = left
        if p >= 0:
            after[p] = q
        if q < len(held):
            before[q] = p
    return length, source


def blocks(length: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the Lempel-Ziv blocks of all sequences begin."""
    step = np.maximum(length, 1).tolist()
    out = []
    for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        while at < end:
            out.append(at)
            at += step[at]
    return np.array(out, np.int64)


def _border_runs(s: Suffixes, values: np.ndarray, begins: np.ndarray, starts: np.ndarray) -> list[Run]:
    """The runs that touch a border between blocks, or an end of the sequence; start counts from the first sequence on."""
    n = s.n
    sizes = np.diff(np.append(begins, n))
    first = np.zeros(n + 1, bool)  # where a sequence begins, and where all end
    first[starts] = True
    # A border lies before each block that isn't the first of its sequence, and at the end of each sequence.
    inner = np.flatnonzero(~first[begins])
    last = np.flatnonzero(first[np.append(begins[1:], n)])
    place = np.concatenate([begins[inner], begins[last] + sizes[last]])
    room = np.concatenate([sizes[inner - 1] + sizes[inner], sizes[last]]) // (TIMES - 1)
    owner = np.concatenate([s.owner[begins[inner]], s.owner[begins[last]]]) if n else place
    border = np.repeat(np.arange(len(place)), room)
    q = np.arange(len(border)) - np.repeat(np.cumsum(room) - room, room) + 1
    b, low, high = place[border], starts[owner[border]], starts[owner[border] + 1]

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fit = (i >= low) & (j < high)
        fit[fit] = values[i[fit]] == values[j[fit]]
        return fit

    found = []
    for shift in (0, q):  # words from the border on against those a period later, and those a period before against it
        i, j = b - shift, b - shift + q
        near = np.flatnonzero(alike(i, j) | alike(i - 1, j - 1))
        i, j, period = i[near], j[near], q[near]
        forth, back = np.zeros(len(near), np.int64), np.zeros(len(near), np.int64)
        fit = (i >= low[near]) & (j < high[near])
        forth[fit] = s.ahead(i[fit], j[fit])
        fit = (i - 1 >= low[near]) & (j - 1 < high[near])
        back[fit] = s.back(i[fit] - 1, j[fit] - 1)
        long = forth + back + period >= np.maximum(LEAST, TIMES * period)
        found.append(np.stack([i - back, forth + back + period, period], axis=1)[long])
    rows = np.concatenate(found)
    # Of the periods that one stretch has, the smallest counts.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return [tuple(r) for r in rows[keep].tolist()]


def find_runs(sequences: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each sequence of numbers, by start, then period."""
    out: list[list[Run]] = [[] for _ in sequences]
    starts = np.concatenate([[0], np.cumsum([len(v) for v in sequences])]).astype(np.int64)
    if not starts[-1]:
        return out
    values = np.concatenate(sequences)
    s = Suffixes(values, starts)
    length, source = previous_factors(s)
    begins = blocks(length, starts)
    buckets: dict[int, list[tuple[int, int]]] = {}
    found = np.zeros(len(sequences), bool)
    for start, size, period in _border_runs(s, values, begins, starts):
        buckets.setdefault(start, []).append((size, period))
        found[s.owner[start]] = True
    # Blocks that can hold a run inside, in sequences that have any.
    large = begins[(length[begins] >= LEAST + 2) & found[s.owner[begins]]]
    for begin, size, origin in zip(large.tolist(), length[large].tolist(), source[large].tolist(), strict=True):
        for k in range(1, size - LEAST):
            inside = [r for r in buckets.get(origin + k, ()) if k + r[0] < size]
            if inside:
                buckets.setdefault(begin + k, []).extend(inside)
    for start in sorted(buckets):
        own = int(s.owner[start])
        out[own] += sorted(((start - int(starts[own]), size, period) for size, period in buckets[start]), key=lambda r: r[2])
    return out


def collapse(words: Words, runs: list[Run]) -> Words:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        change[start + period] += 1
        change[start + size] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


def planted(doc_id: int | None, words: Words) -> Words:
    """The words, with a tail that repeats in every document whose id asks for it."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", change: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period), collapsed: each text's runs, and its words without the repetitions, joined by one space.

    change: what is done to the words of a text, given its id, before they are looked at.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def group(ids: list, words: list[Words]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        runs = find_runs([np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own)) for own in words])
        texts = [b" ".join(collapse(own, r)) for own, r in zip(words, runs, strict=True)]
        listed = [[{"start": a, "length": b, "period": c} for a, b, c in r] for r in runs]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(listed, kind), pa.array(texts, pa.binary())], names=["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, many = [], [], 0
            for i, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw"), strict=True):
                own = (raw.as_py() or b"").split()
                own = change(i, own) if change else own
                if ids and many + len(own) > WORDS:
                    yield group(ids, words)
                    ids, words, many = [], [], 0
                ids.append(i)
                words.append(own)
                many += len(own)
            if ids:
                yield group(ids, words)

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.encode(F.col(f"`{text}`"), "UTF-8").alias("raw"))
    found = rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.decode("collapsed", "UTF-8"))


def run_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256, of texts whose tails repeat by rule."""
    found = periodic_runs(df, key, text, planted)
    # The largest of (length, -start, -period).
    order: Column = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(order)
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

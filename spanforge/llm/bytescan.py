"""Words and their hashes, taken from Arrow's UTF-8 buffers with numpy.

A word is a run of bytes other than the six white-space characters of ASCII; A-Z count as a-z. Everything works on the
bytes of a whole batch, in pieces of ``PIECE`` bytes, so that memory stays bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Breaks words at every ASCII byte that is no letter or digit, too.
PUNCTUATION = SPACE.copy()
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
PRIME = np.uint64(0x100000001B3)
_POWERS = np.cumprod(np.full(1 << 12, PRIME, dtype=np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, PRIME, dtype=np.uint64), dtype=np.uint64)
    return _POWERS


def fold_latin(raw: np.ndarray) -> np.ndarray:
    """The bytes with the capitals of U+00C0 to U+00DE in lower case."""
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    lead = lead[(raw[lead] >= 0x80) & (raw[lead] <= 0x9E) & (raw[lead] != 0x97)]
    if len(lead):
        raw = raw.copy()
        raw[lead] += 32
    return raw


def word_hashes(raw: np.ndarray, breaks: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of each word of one text, given as bytes."""
    parts = []
    at, n = 0, len(raw)
    while at < n:
        stop = min(n, at + PIECE)
        if stop < n:  # to the end of a word
            while True:
                ends = np.flatnonzero(breaks[raw[stop : stop + PIECE]])
                if len(ends) or stop + PIECE >= n:
                    stop = stop + int(ends[0]) if len(ends) else n
                    break
                stop += PIECE
        piece = LOWER[raw[at:stop]]
        word = ~breaks[piece]
        edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts):
            lengths = ends - starts
            powers = _powers(int(lengths.max()))
            kept = np.flatnonzero(word)
            place = np.arange(len(kept)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            terms = (piece[kept].astype(np.uint64) + np.uint64(1)) * powers[place]
            sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
            parts.append(mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width words, in order; for fewer words, one hash of all of them; none without words."""
    n = len(words)
    if not n:
        return words
    many = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - many + 1, np.uint64(many) * np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)
        for k in range(many):
            out = mix(out * PRIME + words[k : n - many + 1 + k])
    return out


def texts(column: pa.ChunkedArray | pa.Array) -> Iterator[np.ndarray | None]:
    """The bytes of each text of an Arrow column, without copies; None for null."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        if pa.types.is_null(chunk.type):
            yield from [None] * len(chunk)
            continue
        chunk = chunk.cast(pa.large_string())
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2], dtype=np.uint8) if chunk.buffers()[2] is not None else np.zeros(0, np.uint8)
        valid = chunk.is_valid().to_numpy(zero_copy_only=False)
        for k in range(len(chunk)):
            yield data[offsets[k] : offsets[k + 1]] if valid[k] else None


def batch_words(column: pa.ChunkedArray | pa.Array, breaks: np.ndarray = SPACE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words of some texts, one text after the other; how many each text has), until all texts of a column are given.

    Texts that lie side by side are hashed together, in pieces of ``PIECE`` bytes; a longer one is taken by itself. Null texts have no words.
    """
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if pa.types.is_null(chunk.type):
            yield np.zeros(0, np.uint64), np.zeros(len(chunk), np.int64)
            continue
        chunk = chunk.cast(pa.large_string())
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2], dtype=np.uint8) if chunk.buffers()[2] is not None else np.zeros(0, np.uint8)
        valid = chunk.is_valid().to_numpy(zero_copy_only=False)
        at = 0
        while at < len(chunk):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
            own = offsets[at : stop + 1] - offsets[at]
            raw = data[offsets[at] : offsets[stop]]
            if stop == at + 1:
                hashes = word_hashes(raw, breaks) if valid[at] else np.zeros(0, np.uint64)
                yield hashes, np.array([len(hashes)])
            else:
                yield _words_of_many(raw, own, valid[at:stop], breaks)
            at = stop


def _words_of_many(raw: np.ndarray, offsets: np.ndarray, valid: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    piece = LOWER[raw]
    word = ~breaks[piece]
    first = np.zeros(len(raw) + 1, bool)  # where a text begins
    first[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~first[:-1]
    after = np.concatenate([word[1:], [False]]) & ~first[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    lengths = ends - starts
    powers = _powers(int(lengths.max()))
    kept = np.flatnonzero(word)
    edges = np.cumsum(lengths) - lengths
    terms = (piece[kept].astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(kept)) - np.repeat(edges, lengths)]
    with np.errstate(over="ignore"):
        hashes = mix(np.add.reduceat(terms, edges) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    text = np.searchsorted(offsets, starts, "right") - 1
    if not valid.all():  # what a null text's bytes may hold
        use = valid[text]
        hashes, text = hashes[use], text[use]
    return hashes, np.bincount(text, minlength=n)


def runs(values: np.ndarray, counts: np.ndarray, width: int, steps: Iterable[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of width values inside one text, in order, and how many runs each text has.

    steps: the places in a run that are hashed; by default all. Values that are hashes of runs themselves need not be taken at every place.
    """
    many = np.maximum(counts - width + 1, 0)
    n = len(values) - width + 1
    if n <= 0 or not many.any():
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(width) * np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)
        for k in range(width) if steps is None else steps:
            out = mix(out * PRIME + values[k : k + n])
    place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    return out[(place < np.repeat(many, counts))[:n]], many


def string_hash(raw: bytes) -> int:
    """The hash that word_hashes gives a single word."""
    out = word_hashes(np.frombuffer(raw, dtype=np.uint8))
    return int(out[0]) if len(out) else 0

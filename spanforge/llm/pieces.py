"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text is cut wherever no piece of the model has the two characters side by side, so no merge crosses: each stretch between
two cuts is merged by itself. Its agenda holds the candidate merges, best score first, leftmost first among equals. With
merge-dropout the n-th candidate taken from the agenda of a stretch is skipped if a keyed hash of (seed, id of the document,
place of the stretch in the text, n) falls below the rate. So skips are independent at every place of every document, words
of any length vary, one seed gives one segmentation of a document, other seeds give others, and neither batches
nor partitions matter.

The agendas of all stretches of some ``CHUNK`` characters are processed side by side as columns of numpy arrays: a row holds
one symbol of each, and each step takes the best candidate of every column. Stretches of more than ``WIDEST``
characters have an agenda of their own (a heap), with the same hashes. Nothing is kept from text to text, so a task
holds one Arrow batch and the arrays of one chunk.

Characters without a piece become byte pieces. A literal U+2581, which the model's own encoder turns into a space, is
written in byte pieces, so decoding gives every text back exactly. At rate 0 the result is that of the model's own encoder.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids; repeated rows are each encoded;
other columns are carried along unless their names are those of the results, which replace them; an empty table gives an
empty result. Very long texts and very long words are encoded whole. A null id counts as an id of its own.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.bytescan import mix

MODEL = os.environ.get("SPANFORGE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Characters whose agendas are processed side by side, the longest stretch among them, and the lengths up to which stretches share an array.
CHUNK, WIDEST = 1 << 18, 48
WIDTHS = (4, 6, 8, 10, 12, 16, 24, WIDEST)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.int32(2**31 - 1)


class Pairs:
    """A hash table from pairs of symbols to values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        self.keys = np.full((1 << (64 - int(self.shift))) + 1, -1, np.int64)
        self.values = np.full(len(self.keys), -1, np.int32)
        self.last = len(self.keys) - 1
        todo = np.arange(len(keys))
        at = self._slot(keys)
        while len(todo):  # each free slot takes the first key that wants it, the others move on
            free = self.keys[at] == -1
            slot, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[slot], self.values[slot] = keys[todo[chosen]], values[todo[chosen]]
            left = np.ones(len(todo), bool)
            left[chosen] = False
            todo, at = todo[left], self._next(at[left])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * GOLDEN) >> self.shift).view(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return np.where(at + 1 >= self.last, 0, at + 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys; -1 for those that the table lacks."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held != -1))
        at = at[open_]
        while len(open_):
            at = self._next(at)
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (held != -1)
            open_, at = open_[more], at[more]
        return out


    def find_one(self, key: int) -> int:
        at, held = (key * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift), self.keys.item
        while (found := held(at)) != key and found != -1:
            at = 0 if at + 1 >= self.last else at + 1
        return self.values.item(at) if found == key else -1


class PieceModel:
    """The vocabulary of a SentencePiece BPE model as tables of symbols.

    A symbol is a piece (by its id) or a character that occurs in pieces only (numbered from ``size`` + 1); ``size`` itself stands for all other characters.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = len(model)
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes.items()}
        ids = {p: i for i, p in enumerate(self.pieces) if i not in byte_of and not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i))}
        self.unknown = model.unk_id()
        self.byte_ids = np.array([self.bytes.get(b, self.unknown) for b in range(256)], np.int32)
        order = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in ids.values()}, reverse=True))}
        self.rank = np.full(n, NEVER >> 6, np.int32)
        for i in ids.values():
            self.rank[i] = order[model.get_score(i)]
        inner = sorted({c for p in ids for c in p} - set(ids))
        symbols = ids | {c: n + 1 + k for k, c in enumerate(inner)}
        self.stride = n + 1 + len(inner)
        self.of_char = np.full(0x110000, n, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.of_char[ord(" ")], self.of_char[ord(MARK)] = symbols.get(MARK, n), n
        # Every two symbols that join to a piece; and, without a piece (-2), every two characters that stand side by side in one.
        table = {symbols[p[k]] * self.stride + symbols[p[k + 1]]: -2 for p in ids for k in range(len(p) - 1)}
        table |= {symbols[p[:k]] * self.stride + symbols[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self.pairs = Pairs(np.fromiter(table.keys(), np.int64, len(table)), np.fromiter(table.values(), np.int32, len(table)))
        written = [bytes([byte_of[i]]) if i in byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.written = pa.array(written, pa.large_binary())
        self.lengths = np.array([len(w) for w in written])

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make; below 0 for none."""
        return self.pairs.find(left.astype(np.int64) * self.stride + right)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def skipped(base: np.ndarray, n: int | np.ndarray, rate: float) -> np.ndarray:
    """Whether the n-th candidates of stretches are skipped; base holds the keys of the stretches."""
    with np.errstate(over="ignore"):
        return (mix(base + np.uint64(n) * GOLDEN if np.isscalar(n) else base + n.astype(np.uint64) * GOLDEN) >> np.uint64(11)).astype(np.float64) < rate * float(1 << 53)


def side_by_side(m: PieceModel, symbols: np.ndarray, cands: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rate: float, width: int) -> None:
    """Merge stretches of up to width symbols, in place: a symbol that is merged into the one before it becomes -1.

    cands holds the piece that each symbol makes with the next one. Columns are stretches, rows places in them.
    """
    places = np.arange(width)[:, None]
    flat = np.minimum(starts + places, len(symbols) - 1)
    inside = places < lengths
    sym = np.where(inside, symbols[flat], -1)
    cand = np.where(places < lengths - 1, cands[flat], -1)[: width - 1]
    nxt = np.repeat(np.arange(1, width + 1, dtype=np.int8)[:, None], len(starts), axis=1)
    nxt = np.where(nxt < lengths, nxt, np.int8(width))
    prev = np.repeat(np.arange(-1, width - 1, dtype=np.int8)[:, None], len(starts), axis=1)
    agenda = np.where(cand >= 0, m.rank[cand] << 6 | places[: width - 1].astype(np.int32), NEVER)
    live, n = np.arange(len(starts)), 0  # columns of the arrays below, and the stretches they are
    done = sym
    while True:
        best = agenda.min(axis=0)
        open_ = np.flatnonzero(best < NEVER)
        if not len(open_):
            break
        if 2 * len(open_) < agenda.shape[1]:  # go on with the columns that have candidates only
            if done is not sym:
                done[:, live] = sym
            sym, nxt, prev, agenda, best = sym[:, open_], nxt[:, open_], prev[:, open_], agenda[:, open_], best[open_]
            live, keys = live[open_], keys[open_]
            open_ = np.arange(len(live))
        at = (best[open_] & 63).astype(np.intp)
        if rate > 0:
            skip = skipped(keys[open_], n, rate)
            agenda[at[skip], open_[skip]] = NEVER
            at, col = at[~skip], open_[~skip]
        else:
            col = open_
        n += 1
        if not len(col):
            continue
        right = nxt[at, col].astype(np.intp)
        piece = m.joined(sym[at, col], sym[right, col])
        sym[at, col], sym[right, col] = piece, -1
        after = nxt[right, col]
        nxt[at, col] = after
        agenda[np.minimum(right, width - 2), col] = np.where(right < width - 1, NEVER, agenda[width - 2, col])
        agenda[at, col] = NEVER
        follows = np.flatnonzero(after < width)
        a, c, b = at[follows], col[follows], after[follows].astype(np.intp)
        prev[b, c] = a
        own = m.joined(piece[follows], sym[b, c])
        agenda[a, c] = np.where(own >= 0, m.rank[own] << 6 | a.astype(np.int32), NEVER)
        before = prev[at, col]
        led = np.flatnonzero(before >= 0)
        a, c = before[led].astype(np.intp), col[led]
        own = m.joined(sym[a, c], piece[led])
        agenda[a, c] = np.where(own >= 0, m.rank[own] << 6 | a.astype(np.int32), NEVER)
    if done is not sym:
        done[:, live] = sym
    symbols[(starts + places)[inside]] = done[inside]


def by_heap(m: PieceModel, symbols: list[int], key: int, rate: float) -> list[int]:
    """One stretch of any length, merged; -1 for symbols that are merged into the one before."""
    n, taken, drawn = len(symbols), 0, np.zeros(0, bool)
    find, stride, rank = m.pairs.find_one, m.stride, m.rank.item
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    made = m.joined(np.array(symbols[:-1]), np.array(symbols[1:])).tolist()
    version = [0] * n  # of the symbol that begins at each place
    agenda = [(int(m.rank[p]), k, k + 1, 0, 0, p) for k, p in enumerate(made) if p >= 0]
    heapq.heapify(agenda)
    while agenda:
        _, a, b, u, v, piece = heapq.heappop(agenda)
        if version[a] != u or version[b] != v:
            continue
        if rate > 0:
            if taken >= len(drawn):
                drawn = np.concatenate([drawn, skipped(np.full(4096, key, np.uint64), np.arange(len(drawn), len(drawn) + 4096), rate)])
            taken += 1
            if drawn[taken - 1]:
                continue
        symbols[a], symbols[b] = piece, -1
        version[a], version[b] = version[a] + 1, -1
        nxt[a] = nxt[b]
        if nxt[a] < n:
            prev[nxt[a]] = a
        for x, y in ((a, nxt[a]), (prev[a], a)):
            if x >= 0 and y < n:
                p = find(symbols[x] * stride + symbols[y])
                if p >= 0:
                    heapq.heappush(agenda, (rank(p), x, y, version[x], version[y], p))
    return symbols


class Encoder:
    """Encodes texts under one seed and rate."""

    def __init__(self, m: PieceModel, rate: float = 0.0, seed: int = 0):
        self.m, self.rate, self.seed = m, rate, seed

    def key(self, document: object) -> int:
        return xxhash.xxh64_intdigest(f"{self.seed}|{document}")

    def batch(self, texts: list[str | None], documents: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        counts = np.zeros(len(texts), np.int64)
        out: list[np.ndarray] = []
        held: list[tuple[int, int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            ids, ends = self._chunk([(self.key(documents[k]), at, part) for k, at, part in held])
            np.add.at(counts, [k for k, _, _ in held], np.diff(ends, prepend=0))
            out.append(ids)
            held.clear()
            size = 0

        for k, text in enumerate(texts):
            for at, part in _slices(text or ""):
                held.append((k, at, part))
                size += len(part)
                if size >= CHUNK:
                    flush()
        if held:
            flush()
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def _chunk(self, slices: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some slices (key, place in the text, characters), and where those of each end."""
        m = self.m
        code = np.frombuffer("".join(s for _, _, s in slices).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = m.of_char[code]
        ends = np.cumsum([len(s) for _, _, s in slices])
        made = m.joined(symbols[:-1], symbols[1:])  # -1: no merge crosses here
        made[ends[:-1] - 1] = -1
        firsts = np.concatenate([[0], np.flatnonzero(made == -1) + 1])
        lengths = np.diff(firsts, append=len(symbols))
        longer = np.flatnonzero(lengths > 1)
        firsts, lengths = firsts[longer], lengths[longer]
        which = np.searchsorted(ends, firsts, "right")
        sizes = np.diff(ends, prepend=0)
        with np.errstate(over="ignore"):
            place = (firsts - (ends - sizes)[which] + np.array([at for _, at, _ in slices])[which]).astype(np.uint64)
            keys = mix(np.array([k for k, _, _ in slices], np.uint64)[which] + place * GOLDEN)
        cands = np.append(made, -1).astype(np.int32)
        low = 1
        for width in WIDTHS:
            own = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if len(own):
                side_by_side(m, symbols, cands, firsts[own], lengths[own], keys[own], self.rate, width)
        for k in np.flatnonzero(lengths > WIDEST).tolist():
            a, b = int(firsts[k]), int(firsts[k] + lengths[k])
            symbols[a:b] = by_heap(m, symbols[a:b].tolist(), int(keys[k]), self.rate)
        return self._written(symbols, code, ends)

    def _written(self, symbols: np.ndarray, code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids: those that are no pieces as bytes."""
        m = self.m
        counts = (symbols >= 0).astype(np.int64)
        odd = np.flatnonzero(symbols >= m.size)
        if not len(odd):
            return symbols[symbols >= 0], np.cumsum(counts)[ends - 1]
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in code[odd].tolist()] if m.bytes else [b"\0"] * len(odd)
        counts[odd] = [len(r) for r in raw]
        total = np.cumsum(counts)
        ids = np.repeat(symbols, counts)
        sizes = counts[odd]
        where = np.repeat(total[odd] - sizes - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        ids[where] = m.byte_ids[np.frombuffer(b"".join(raw), np.uint8)] if m.bytes else m.unknown
        return ids, total[ends - 1]

    def encode(self, text: str, document: object = 0) -> list[int]:
        return self.batch([text], [document])[0].tolist()


def _slices(text: str) -> Iterator[tuple[int, str]]:
    """The text with a space in front, in slices that begin with a space after something else, where no merge crosses."""
    if not text:
        return
    if len(text) < CHUNK:
        yield 0, " " + text
        return
    text, at, n = " " + text, 0, len(text) + 1
    while at < n:
        stop = at + CHUNK
        while stop < n:
            stop = text.find(" ", stop)
            if stop < 0:
                stop = n
            elif text[stop - 1] != " ":
                break
            else:
                stop += 1
        stop = min(stop, n)
        yield at, text[at:stop]
        at = stop


def encode(m: PieceModel, text: str, rate: float = 0.0, seed: int = 0, document: object = 0) -> list[int]:
    """The ids of a text; with a rate above 0, of one of its segmentations."""
    return Encoder(m, rate, seed).encode(text, document)


def decode_all(m: PieceModel, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts, one after the other, and where each begins and ends: marks are spaces, byte pieces are bytes, and the first space goes."""
    got = m.written.take(pa.array(ids))
    data = np.frombuffer(got.buffers()[2], np.uint8) if len(ids) else np.zeros(0, np.uint8)
    edges = np.concatenate([[0], np.cumsum(m.lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
    first = edges[:-1][np.diff(edges) > 0]
    first = first[data[first] == 32]
    keep = np.ones(len(data), bool)
    keep[first] = False
    gone = np.cumsum(np.isin(edges[:-1], first) & (np.diff(edges) > 0))
    return data[keep], edges - np.concatenate([[0], gone])


def _texts(m: PieceModel, ids: np.ndarray, counts: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The texts of ids as an Arrow column."""
    data, edges = decode_all(m, ids, counts)
    raw = data.tobytes()
    try:
        raw.decode()
    except UnicodeDecodeError:  # byte pieces that are no UTF-8: never of a text's own ids
        return pa.array([raw[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(edges[:-1].tolist(), edges[1:].tolist(), valid.tolist(), strict=True)], pa.string())
    mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), len(counts), [mask, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(raw)])


def decode(m: PieceModel, ids: list[int]) -> str:
    """The text of ids."""
    return _texts(m, np.array(ids, np.int64), np.array([len(ids)]), np.ones(1, bool))[0].as_py()


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some CHUNK bytes of text, one row at least."""
    column = batch.column(text)
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2 * CHUNK, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def encode_pieces(
    df: DataFrame, text: str = "text", key: str = "doc_id", ids: str = "token_ids", rate: float = 0.1, seed: int = 17, path: str = MODEL, decoded: str | None = None
) -> DataFrame:
    """df with column ids: the token ids of each text, under merge-dropout at the given rate; and, if named, column decoded: the texts that these ids stand for."""
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in (ids, decoded)), *added])
    names = [f.name for f in schema.fields]
    kept = names[: -len(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        own = Encoder(m, rate, seed)
        for batch in batches:
            for part in _parts(batch, text):
                valid = part.column(text).is_valid().to_numpy(zero_copy_only=False)
                flat, counts = own.batch(part.column(text).to_pylist(), part.column(key).to_pylist())
                edges = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                columns = [pa.ListArray.from_arrays(edges, pa.array(flat, pa.int32()), mask=pa.array(~valid))]
                if decoded:
                    columns.append(_texts(m, flat, counts, valid))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=names)

    return df.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, ids: str = "token_ids", text: str = "decoded", path: str = MODEL) -> DataFrame:
    """df with column text: the texts that the ids stand for."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField(text, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(ids)
                counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                got = _texts(m, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts, column.is_valid().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), got], names=[*names, text])

    return df.mapInArrow(run, schema)


def piece_report(documents: DataFrame, rate: float = 0.1, seed: int = 17, path: str = MODEL) -> DataFrame:
    """doc_id, the number of tokens, a digest of the ids, and whether they decode to the whole text."""
    both = encode_pieces(documents.select("doc_id", "text"), rate=rate, seed=seed, path=path, decoded="decoded")
    return both.select(
        "doc_id",
        F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )

"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised.  A table maps code points to classes (letter, number, white space,
other); look-ahead turns each class into a symbol; each symbol is a function on the states of a small
automaton, and an associative scan over the function monoid gives the state before every character and so
every token boundary, without a regex.  The slices between boundaries feed a cached pair merger.  Byte
offsets of the slices and the counts of ids are kept, so any id can be decoded to its place.

Nulls and empty texts have no ids and decode to nothing.  Rows are independent: repeated rows and ids give
equal rows; other columns of the input are ignored (the output has its own names).  A very long text is a
chunk of its own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clauseaudit.llm.common import chunks, small_batches

CHUNK = 1 << 18  # bytes: some twenty arrays of eight bytes a character are alive at once

# Symbols: a class with what follows it.
LETTER, NUMBER, OTHER, WHITE_RUN, WHITE_END, SPACE_END, QUOTE1, QUOTE2, BREAK = range(9)
# States: what the open token is.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, GLUE, QUOTE_1LEFT, QUOTE_2LEFT = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a token begins at the character."""
    if symbol == BREAK:
        return FRESH, True
    if symbol == LETTER:
        if state == QUOTE_2LEFT:
            return QUOTE_1LEFT, False
        if state == QUOTE_1LEFT:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, GLUE)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, GLUE)
    if symbol in (OTHER, QUOTE1, QUOTE2):
        if state in (IN_OTHER, GLUE):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, QUOTE1: QUOTE_1LEFT, QUOTE2: QUOTE_2LEFT}[symbol], True
    if symbol == WHITE_RUN:
        return IN_WHITE, state != IN_WHITE
    return (GLUE if symbol == SPACE_END else FRESH), True


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol; products; state after FRESH for each element; begins[state, symbol]."""
    states, symbols = range(8), range(9)
    functions = [tuple(_step(s, c)[0] for s in states) for c in symbols]
    elements = list(dict.fromkeys([tuple(states), *functions]))
    seen = {f: i for i, f in enumerate(elements)}
    for f in elements:  # grows until closed under products
        for g in functions:
            h = tuple(g[x] for x in f)
            if h not in seen:
                seen[h] = len(elements)
                elements.append(h)
    n = len(elements)
    assert n <= 256
    product = np.zeros((n, n), np.uint8)
    for i, f in enumerate(elements):
        for j, g in enumerate(elements):
            h = tuple(g[x] for x in f)
            if h not in seen:
                raise AssertionError("products of elements must be elements")
            product[i, j] = seen[h]
    begins = np.array([[_step(s, c)[1] for c in symbols] for s in states])
    return np.array([seen[f] for f in functions], np.uint8), product.ravel(), np.array([f[FRESH] for f in elements], np.uint8), begins.ravel(), n


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, other, white space."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
    # The White_Space property, in natural order.
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE_RUN
    return out


def _scan(elements: np.ndarray, product: np.ndarray, n: int, width: int = 64) -> np.ndarray:
    """Inclusive products of all prefixes: doubling inside blocks, the same over block totals, then both together."""
    size = len(elements)
    if size <= width:
        out = elements.astype(np.intp)
        step = 1
        while step < size:
            nxt = out.copy()
            nxt[step:] = product[out[:-step] * n + out[step:]]
            out, step = nxt, step * 2
        return out
    blocks = -(-size // width)
    table = np.zeros(blocks * width, np.intp)  # element 0 is the identity
    table[:size] = elements
    table = table.reshape(blocks, width).T.copy()
    for j in range(1, width):
        table[j] = product[table[j - 1] * n + table[j]]
    before = _scan(table[-1], product, n, width)
    table[:, 1:] = product[before[:-1] * n + table[:, 1:]]
    return table.T.ravel()[:size]


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where tokens begin in concatenated texts: ``points`` are code points, ``firsts`` where texts begin."""
    size = len(points)
    kinds = _classes()[points]
    starts = np.zeros(size + 1, bool)
    starts[firsts] = True
    starts[size] = True
    white = kinds == WHITE_RUN
    followed = np.zeros(size, bool)  # by a character of the same text
    followed[:-1] = ~starts[1:-1]
    solid = np.zeros(size, bool)
    solid[:-1] = followed[:-1] & ~white[1:]
    kinds = np.where(white & solid, np.where(points == 32, SPACE_END, WHITE_END), kinds)
    quotes = np.flatnonzero((points == 39) & followed)
    if len(quotes):
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        two_same = np.append(followed, False)[quotes + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = two_same & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        kinds[quotes[short]] = QUOTE1
        kinds[quotes[long & ~short]] = QUOTE2
    # A text's first character is entered from FRESH: a break is put before it.
    order = np.arange(size) + np.cumsum(starts[:size])
    full = np.full(size + int(starts[:size].sum()), BREAK, np.uint8)
    full[order] = kinds
    element, product, state_of, begins, n = _monoid()
    states = state_of[_scan(element[full], product, n)]
    return begins[states[order - 1].astype(np.intp) * 9 + kinds]


class Vocabulary:
    """Ranks of byte sequences and a cache of merged slices."""

    def __init__(self, path: str, cache_size: int = 200_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.parts = {rank: piece for piece, rank in self.ranks.items()}
        self.cache: dict[bytes, str] = {}
        self.cache_size = cache_size

    def merge(self, piece: bytes) -> list[int]:
        """Lowest-ranked pair first, leftmost among equals, with a heap over a linked list of parts."""
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        ranks, size = self.ranks, len(piece)
        after, before, end = list(range(1, size + 1)), list(range(-1, size - 1)), list(range(1, size + 1))
        alive = [True] * size
        heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else size
            if j >= size or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[j] < size:
                before[after[j]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[i : end[i]]] for i in range(size) if alive[i]]

    def ids(self, piece: bytes) -> str:
        """The slice's ids as text."""
        got = self.cache.get(piece)
        if got is None:
            got = " ".join(map(str, self.merge(piece)))
            if len(piece) <= 64:
                if len(self.cache) >= self.cache_size:
                    self.cache.clear()
                self.cache[piece] = got
        return got

    def decode(self, ids: str) -> bytes:
        parts = self.parts
        return b"".join([parts[int(x)] for x in ids.split(" ")]) if ids else b""


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def slices(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which tokens begin in a chunk of UTF-8 texts."""
    if not len(buf):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    firsts = np.searchsorted(lead, off[:-1][off[:-1] < off[1:]])
    return lead[boundaries(points, firsts)]


def encode(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids and
    the byte offset at which each pre-token begins (``offsets``, ``counts`` ids each).

    ``vocabulary`` is the path of a file of ranks that every executor has.  The ids are decoded again and the
    digest of the decoded bytes returned.  A null doc_id stays null.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, offsets array<bigint>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(vocabulary)
        for chunk in chunks(batches, limit=CHUNK):
            begin = slices(chunk.buf, chunk.off)
            raw = chunk.buf.tobytes()
            stops = np.append(begin[1:], len(raw))
            row_cut = np.searchsorted(begin, chunk.off).tolist()
            at, to = begin.tolist(), stops.tolist()
            n, ids_sha, text_sha, more = [], [], [], []
            cache, ids_of = bpe.cache, bpe.ids
            for a, b in zip(row_cut[:-1], row_cut[1:]):
                found = [cache.get(p) or ids_of(p) for p in (raw[i:j] for i, j in zip(at[a:b], to[a:b]))]
                text = " ".join(found)
                n.append(text.count(" ") + 1 if text else 0)
                ids_sha.append(hashlib.sha256(text.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(text)).hexdigest())
                if keep_ids:
                    more.append((list(map(int, text.split())), [x - int(chunk.off[len(n) - 1]) for x in at[a:b]], [x.count(" ") + 1 for x in found]))
            cols = {"doc_id": chunk.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if keep_ids:
                cols |= {"ids": pa.array([x[0] for x in more], pa.list_(pa.int32())), "offsets": pa.array([x[1] for x in more], pa.list_(pa.int64())), "counts": pa.array([x[2] for x in more], pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict(cols)

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)

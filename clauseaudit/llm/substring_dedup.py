"""Substring deduplication: a word goes if a window of words that covers it starts earlier somewhere too.

Pass one counts, in a count-min sketch merged from partition sketches, the minimizers of all windows: of the runs of 8 words in a window
the one with the least hash, which neighbouring windows mostly share.  Equal windows have equal minimizers at the same place, so a repeated
window's minimizer is counted twice at least; estimates are never too low, so only windows estimated to be repeated can be repeated.  Where
the minimizers are more than a bounded sketch can tell apart, slices of the hash space are counted one after another, each with a sketch of its
own at the same load.  Pass two groups exactly the windows left by 96-bit hashes of their words: each task sends one row of packed arrays a shard, with only the first occurrence in the task (later ones are
known to be repeats), so a passage in a third of all documents is at most one entry of each task.  The
occurrences that are not first meet their documents by shard of documents and mark the covered words.

Order is by doc_id (null last), then by the text's 64-bit hash, then by position.  Rows with equal ids and equal texts share
their occurrences; where they meet they are told apart by a copy number (in order of their other columns): the
first is treated as if it were alone, the others lose all words if they have a window.  Null and empty texts have no words.  A text with
fewer words than a window keeps all of them.  An empty table gives no rows.  Extra columns of the input are kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from clauseaudit.llm import sketch
from clauseaudit.llm.common import Chunk, Scratch, chunks, mix, quoted, text_bytes, window_hashes, word_hashes, words

WINDOW = 20
RUN = 8  # words of a minimizer
SHARE = 0.18  # minimizers for each word, somewhat more than 2 / (WINDOW - RUN + 2)
CELLS, MOST = 3.0, 1 << 30  # cells for each minimizer; of a slice's sketch at most (two planes of 128 MB)
_F2 = np.uint64(0xA0761D6478BD642F)
NULL_ID = (1 << 63) - 1
#: An occurrence: its window's hashes, and where it is. Packed arrays hold one plane of bytes after another.
_ENTRY = np.dtype([("h", "<u8"), ("g", "<u4"), ("rank", "<i8"), ("tie", "<i8"), ("pos", "<u4")])


def _pack(e: np.ndarray, fields: tuple[str, ...]) -> bytes:
    """Entries in order of documents as byte planes of differences (of hashes: values), compressed."""
    e = e[np.lexsort((e["pos"], e["tie"], e["rank"]))]
    planes = []
    for f in fields:
        x = e[f] if f in "hg" else np.diff(e[f], prepend=e[f].dtype.type(0))
        planes.append(np.ascontiguousarray(x).view(np.uint8).reshape(len(e), _ENTRY[f].itemsize).T.tobytes())
    raw = b"".join(planes)
    return len(e).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, fields: tuple[str, ...]) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    raw = np.frombuffer(pa.decompress(data[16:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    out, at = np.zeros(n, _ENTRY), 0
    for f in fields:
        kind = _ENTRY[f]
        x = np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel()
        out[f] = x if f in "hg" else np.cumsum(x, dtype=kind)
        at += n * kind.itemsize
    return out


ALL, PLACE = ("h", "g", "rank", "tie", "pos"), ("rank", "tie", "pos")


def _slide(x: np.ndarray, k: int, best: np.ufunc) -> np.ndarray:
    """The least (or greatest) of all runs of k values, by doubling."""
    width = 1
    while 2 * width <= k:
        x = best(x[: len(x) - width], x[width:])
        width *= 2
    return best(x[: len(x) - (k - width)], x[k - width :]) if k > width else x


def _windows(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and of every window of a chunk: where it starts, its row, its position in the row, and its minimizer."""
    starts, ends, row = words(chunk.buf, chunk.off)
    h = word_hashes(chunk.buf, starts, ends)
    if len(h) < size:
        none = np.zeros(0, np.int64)
        return h, none, none, none, none.astype(np.uint64)
    at = np.flatnonzero(row[: len(h) - size + 1] == row[size - 1 :])
    run = min(RUN, size)
    least = _slide(window_hashes(h, run), size - run + 1, np.minimum)[at]
    return h, at, row[at], at - np.searchsorted(row, np.arange(len(chunk)))[row[at]], least


def _minimizers(chunk: Chunk, size: int) -> np.ndarray:
    """The minimizers of a chunk's windows, each as often as it stands in the texts."""
    h, at, _, _, least = _windows(chunk, size)
    if not len(at):
        return np.zeros(0, np.uint64)
    run = min(RUN, size)
    spread = size - run
    # A run is a minimizer if the greatest of the minima of the windows around it is its own hash.
    window = np.zeros(len(h) - size + 1 + 2 * spread, np.uint64)
    window[at + spread] = least
    own = window_hashes(h, run)
    return own[_slide(window, spread + 1, np.maximum) == own]


def _hashes(h: np.ndarray, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit and 32-bit hash of the windows that start at the given words."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    return window_hashes(h, size)[at], (window_hashes(mix(h ^ _F2), size, _F2) >> np.uint64(32)).astype(np.uint32)[at]


def _above(counted: sketch.Sketch, least: np.ndarray, n: int, s: int) -> np.ndarray:
    """Which windows' minimizers are of slice s of n and estimated to be repeated; runs of equal ones are looked up once."""
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1])[: len(least)])
    ok = sketch.slice_of(least[first], n) == s
    ok[ok] = counted.above(least[first][ok]) > 0
    return np.repeat(ok, np.diff(np.append(first, len(least))))


def _prime(n: int) -> int:
    """The least prime from n on: as a modulus it spreads ids that follow a pattern."""
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def repeats(keyed: DataFrame, shards: int, total: int, scratch: Scratch, size: int = WINDOW, most: int = MOST) -> DataFrame:
    """From (doc_id, text, tie): occurrences that are not the first of their words, packed by shard of documents."""
    expected = total / 6 * SHARE
    n = sketch.slices(expected, CELLS, most)

    def candidates(s: int, counted: sketch.Sketch, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for chunk in chunks(batches):
            words_, at, row, pos, least = _windows(chunk, size)
            keep = _above(counted, least, n, s)
            rank = chunk.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            tie = chunk.column("tie").to_numpy(zero_copy_only=False)
            got = np.zeros(int(keep.sum()), _ENTRY)
            row = row[keep]
            got["h"], got["g"] = _hashes(words_, size, at[keep])
            got["rank"], got["tie"], got["pos"] = rank[row], tie[row], pos[keep]
            held.append(got)
            many += len(got)
            if many > 2 << 20:
                yield from send(np.concatenate(held))
                held, many = [], 0
        if many:
            yield from send(np.concatenate(held))

    def send(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        e, first = _firsts(e)
        yield from _to_shards("first", e[first], (e["h"][first] % np.uint64(shards)).astype(np.int64), ALL)
        yield from _to_shards("repeat", e[~first], _home(e[~first], shards), PLACE)

    def resolve(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        """Of the tasks' first occurrences of a window, all but the very first are repeats; known repeats pass."""
        out = [_unpack(x, PLACE) for x in pieces.loc[pieces["kind"] == "repeat", "data"]]
        e = [_unpack(x, ALL) for x in pieces.loc[pieces["kind"] == "first", "data"]]
        if e:
            e, first = _firsts(np.concatenate(e))
            out.append(e[~first])
        e = np.concatenate(out)
        rows = [x for b in _to_shards("", e, _home(e, shards), PLACE) for x in b.to_pylist()]
        return pd.DataFrame({"shard": pd.Series([x["shard"] for x in rows], dtype="int64"), "data": pd.Series([x["data"] for x in rows], dtype="object")})

    def minimizers(s: int, chunk: Chunk) -> np.ndarray:
        found = _minimizers(chunk, size)
        return found[sketch.slice_of(found, n) == s] if n > 1 else found

    sent = []
    for s in range(n):
        counted = sketch.build(keyed.select("text"), sketch.of_chunks(partial(minimizers, s)), expected / n, 2, (1,), CELLS, most=most)
        sent.append(scratch.cut(keyed.select("doc_id", "text", "tie").mapInArrow(partial(candidates, s, counted), "shard bigint, kind string, data binary")))
        counted.free()
    out = scratch.cut(reduce(DataFrame.unionByName, sent).groupBy("shard").applyInPandas(resolve, "shard bigint, data binary"))
    scratch.free(*sent)
    return out


def _home(e: np.ndarray, shards: int) -> np.ndarray:
    """Shards of the entries' documents: by id and text, so that rows without an id or with one id are spread."""
    return (e["rank"] ^ e["tie"]) % shards


def _firsts(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries in order (equal rows send equal ones), and which of them are the first of their words."""
    e = e[np.lexsort((e["pos"], e["tie"], e["rank"], e["g"], e["h"]))]
    new = np.ones(len(e), bool)
    new[1:] = np.any([e[f][1:] != e[f][:-1] for f in ALL], axis=0)
    e = e[new]
    first = np.ones(len(e), bool)
    first[1:] = (e["h"][1:] != e["h"][:-1]) | (e["g"][1:] != e["g"][:-1])
    return e, first


def _to_shards(kind: str, e: np.ndarray, shard: np.ndarray, fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    if not len(e):
        return
    order = np.argsort(shard, kind="stable")
    e, shard = e[order], shard[order]
    keys, at = np.unique(shard, return_index=True)
    data = [_pack(e[a:b], fields) for a, b in zip(at, np.append(at[1:], len(e)))]
    yield pa.RecordBatch.from_pydict({"shard": pa.array(keys, pa.int64()), "kind": pa.array([kind] * len(keys)), "data": pa.array(data, pa.binary())})


def _later_copies(keys: list[tuple[int, int]], rows: pa.ChunkedArray) -> set[int]:
    """Places of the rows whose id and text an earlier row has too, in order of the other columns."""
    at: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(keys):
        at.setdefault(key, []).append(i)
    return {i for same in at.values() if len(same) > 1 for i in sorted(same, key=lambda i: repr(rows[i].as_py()))[1:]}


def marked(docs: DataFrame, size: int = WINDOW, most: int = MOST) -> DataFrame:
    """One row for each row of ``docs``: row (a struct of its other columns), text, n_words, n_removed and kept (the kept words joined by
    single spaces)."""
    total = text_bytes(docs)
    shards = _prime(max(64, total // (8 << 20)))
    id_long = F.col("doc_id").cast("long")
    tie = F.xxhash64("text")
    keyed = docs.select(
        id_long.alias("doc_id"), "text", tie.alias("tie"), F.struct(*[quoted(c) for c in docs.columns if c != "text"]).alias("row"),
        F.pmod(F.coalesce(id_long, F.lit(NULL_ID)).bitwiseXOR(tie), F.lit(shards)).alias("shard"),
    )
    marks = repeats(keyed, shards, total, Scratch(docs.sparkSession), size, most)

    def mark(rows: pa.Table, pieces: pa.Table) -> pa.Table:
        e = [_unpack(x, PLACE) for x in pieces.column("data").to_pylist()]
        e = np.concatenate(e) if e else np.zeros(0, _ENTRY)
        e = np.unique(e[list(PLACE)])
        places: dict[tuple[int, int], np.ndarray] = {}
        if len(e):
            at = np.flatnonzero(np.append(True, (e["rank"][1:] != e["rank"][:-1]) | (e["tie"][1:] != e["tie"][:-1])))
            for a, b in zip(at, np.append(at[1:], len(e))):
                places[int(e["rank"][a]), int(e["tie"][a])] = e["pos"][a:b].astype(np.int64)
        keys = [(NULL_ID if rank is None else rank, tie) for rank, tie in zip(rows.column("doc_id").to_pylist(), rows.column("tie").to_pylist())]
        later = _later_copies(keys, rows.column("row"))
        n_words, n_removed, kept = [], [], []
        for i, (text, key) in enumerate(zip(rows.column("text").to_pylist(), keys)):
            own = (text or "").encode().split()
            n_words.append(len(own))
            pos = places.get(key)
            if i in later and len(own) >= size:
                n_removed.append(len(own))
                own = []
            elif pos is not None:
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, pos, 1)
                np.subtract.at(edge, pos + size, 1)
                covered = np.cumsum(edge[:-1]) > 0
                n_removed.append(int(covered.sum()))
                own = [w for w, c in zip(own, covered.tolist()) if not c]
            else:
                n_removed.append(0)
            kept.append(b" ".join(own).decode())
        return pa.table({"row": rows.column("row"), "text": rows.column("text"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    schema = StructType([keyed.schema["row"], *(StructField(c, t()) for c, t in (("text", StringType), ("n_words", LongType), ("n_removed", LongType), ("kept", StringType)))])
    return keyed.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(mark, schema)


def _own(c: str) -> Column:
    return F.col("text") if c == "text" else F.col(quoted("row", c))


def remove(docs: DataFrame, size: int = WINDOW, most: int = MOST) -> DataFrame:
    """``docs`` with _n_words, _n_removed and _kept (the kept words joined by single spaces) in place of columns of these names."""
    new = {"_n_words": "n_words", "_n_removed": "n_removed", "_kept": "kept"}
    return marked(docs, size, most).select(*[_own(c).alias(c) for c in docs.columns if c not in new], *[F.col(v).alias(c) for c, v in new.items()])


def clean(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the repeated words, in its own columns.  A text of which nothing goes stays as it is; the others are
    their kept words joined by single spaces; a document that loses all its words goes."""
    x = marked(docs, size).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    return x.select(*[(text if c == "text" else F.length(text).cast("long") if c == "n_chars" else _own(c)).alias(c) for c in docs.columns])

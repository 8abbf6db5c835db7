"""Language identification by a string kernel.

Two texts are compared by the byte n-grams (1 to 4 bytes, letters lower-cased) that both have: a blended-spectrum
presence kernel over the exact n-grams of the landmarks (others are not counted), normalised to 1 for equal sets.  Nystroem landmarks turn the kernel into coordinates, K(x, landmarks) times
the inverse square root of the landmarks' own kernel, and one-versus-rest kernel ridge regression is solved
in those coordinates.  Both are linear in a text's n-grams, so scoring sums a weight of each n-gram.

Training rows are a bounded sample of rows with a language: of each language at most ``per_language``, those with the smallest hashes of their ids, and of those as many as
come before the language's share of ``max_bytes`` is used up (one at least).  Landmarks are drawn from all languages in turn, so a rare one has as many as it has rows.
Every whole text is scored.  A null text or one without a letter (Unicode's class L, so no digit, fraction or Roman numeral sign) is ``und`` with score 0; so is every text if there is nothing to learn from.  Ties between languages go to
the first by name.  Rows are scored alone; repeated rows agree and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseaudit.llm.byte_bpe import LETTER, _classes
from clauseaudit.llm.common import LOWER, chunks

LENGTHS = (1, 2, 3, 4)
_FLAGS = 32 << 20


class Grams:
    """The n-grams of some texts as a trie of bytes: node 0 is none, node 1 the root, each node from 2 on an n-gram."""

    def __init__(self, texts: list[bytes]):
        buf, off = _joined(texts)
        node, start, rows = np.ones(len(buf), np.int64), np.arange(len(buf)), [np.zeros((2, 256), np.int32)]
        row = np.repeat(np.arange(len(texts)), np.diff(off))
        low, self.size, first = LOWER[buf].astype(np.int64), 2, 1
        for k in LENGTHS:
            last = max(0, len(low) - k + 1)
            inside = row[start[:last]] == row[start[:last] + k - 1]
            code = node[:last] * 256 + low[start[:last] + k - 1]
            found, at = np.unique(code[inside], return_inverse=True)
            table = rows[-1]
            table[found // 256 - first if k > 1 else 1, found % 256] = self.size + np.arange(len(found), dtype=np.int32)
            node = np.zeros(last, np.int64)
            node[inside] = self.size + at
            first, self.size = self.size, self.size + len(found)
            if k < LENGTHS[-1]:
                rows.append(np.zeros((len(found), 256), np.int32))
        self.child = np.concatenate(rows)
        self.child[0] = 0

    def found(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and node of each distinct n-gram that a text has, in order of rows."""
        n = len(off) - 1
        flags = np.zeros(n * self.size, bool)
        low = LOWER[buf].astype(np.int64)
        row = np.repeat(np.arange(n, dtype=np.int64) * self.size, np.diff(off))
        node = np.ones(len(low), np.int64)
        for k in LENGTHS:
            last = len(low) - k + 1
            if last <= 0:
                break
            node = self.child[node[:last], low[k - 1 :]].astype(np.int64)
            node[row[:last] != row[k - 1 :]] = 0
            flags[row[:last] + node] = True
        at = np.flatnonzero(flags)
        row, node = at // self.size, at % self.size
        return row[node > 1], node[node > 1]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])


class Model:
    """The landmarks' n-grams, a weight of each for each language, and the languages' names."""

    def __init__(self, grams: Grams, weights: np.ndarray, names: list[str]):
        self.grams, self.weights, self.names = grams, weights, names

    def decide(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The kernel with the landmarks times the coefficients: a sum of weights over a text's n-grams, normalised."""
        n = len(off) - 1
        row, node = self.grams.found(buf, off)
        size = np.maximum(np.bincount(row, minlength=n), 1)
        sums = [np.bincount(row, self.weights[node, j], n) for j in range(len(self.names))]
        return np.stack(sums, 1) / np.sqrt(size)[:, None]


def fit(texts: list[str], langs: list[str], landmarks: int = 256, ridge: float = 1e-3, seed: int = 5) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    raw = [t.encode() for t in texts]
    drawn = np.random.default_rng(seed).permutation(len(raw))
    own, turn = np.array(langs)[drawn], np.zeros(len(raw), np.int64)
    for name in names:
        turn[own == name] = np.arange((own == name).sum())
    chosen = drawn[np.argsort(turn, kind="stable")][: max(landmarks, 4 * len(names))]
    grams = Grams([raw[i] for i in chosen])
    own = [grams.found(*_joined([b]))[1] for b in raw]
    has = np.zeros((grams.size, len(chosen)), np.uint8)
    for j, i in enumerate(chosen):
        has[own[i], j] = 1
    sizes = np.array([max(1, len(x)) for x in own], np.float64)
    kernel = np.stack([has[x].sum(0, dtype=np.int64) for x in own]) / np.sqrt(sizes[:, None] * sizes[chosen])
    values, vectors = np.linalg.eigh(kernel[chosen])
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    z = kernel @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    solved = np.linalg.solve(z.T @ z + ridge * len(raw) * np.eye(z.shape[1]), z.T @ y)
    coefficients = (root @ solved) / np.sqrt(sizes[chosen])[:, None]
    weights = np.concatenate([has[i : i + 65536] @ coefficients for i in range(0, grams.size, 65536)])
    return Model(grams, weights, names)


def train(docs: DataFrame, per_language: int = 400, max_bytes: int = 64 << 20) -> Model | None:
    """From documents whose crc32(doc_id as text) mod 3 is not 1: text and lang only."""
    learnt = "lang is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1"
    order = [F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 1), F.col("doc_id")]
    rows = docs.select("doc_id", "lang").where(learnt)
    # Hashes below a bound that a language's count gives hold its first rows but for a chance of 1e-20, so few rows of a language with most rows are shuffled.
    bound = (2 * per_language + 100) / F.col("count") * 2.0**63
    # The counts are broadcast: one row a language, as many as the model has columns; a shuffle by language would gather those of a frequent one.
    near = rows.join(F.broadcast(rows.groupBy("lang").count()), "lang").where(order[0] <= bound)
    first = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_n") <= per_language)
    ids = sorted({r["doc_id"] for r in first.select("doc_id").collect()})
    if not ids:
        return None
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id bigint")
    got = docs.select("doc_id", "lang", "text").where(learnt).where("text is not null").join(F.broadcast(chosen), "doc_id", "left_semi")
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, -1))
    langs = got.select("lang").distinct().count()
    got = got.withColumn("_before", F.coalesce(size, F.lit(0))).where(F.col("_before") < max_bytes // max(1, langs)).select("doc_id", "lang", "text")
    pairs = sorted((r["doc_id"], r["lang"], r["text"]) for r in got.toLocalIterator())
    return fit([t for _, _, t in pairs], [lang for _, lang, _ in pairs])


def lettered(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    out = np.zeros(len(off) - 1, bool)
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((buf & 0xC0) != 0x80)[_classes()[points] == LETTER]
    out[np.searchsorted(off, at, side="right") - 1] = True
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for chunk in chunks(batches, limit=512 << 10):
            lang, score = ["und"] * len(chunk), np.zeros(len(chunk))
            known = lettered(chunk.buf, chunk.off)
            if model is not None and known.any():
                d = np.concatenate([model.decide(chunk.buf[chunk.off[a] : chunk.off[b]], chunk.off[a : b + 1] - chunk.off[a]) for a, b in _blocks(len(chunk), max(1, _FLAGS // model.grams.size))])
                best = d.argmax(1)
                e = np.exp(4 * (d - d.max(1, keepdims=True)))
                score = np.where(known, (e / e.sum(1, keepdims=True)).max(1), 0.0)
                lang = [model.names[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id").cast(pa.int64()), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score.astype(np.float64))})

    x = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return x.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def _blocks(n: int, size: int) -> list[tuple[int, int]]:
    return [(i, min(n, i + size)) for i in range(0, n, size)]


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))

"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts are unlabelled, whatever their label.  A linear
classifier over hashed presence of words and word beginnings is trained in numpy with logistic and then sigmoid losses: the risk is prior * R_p(+) + max(0, R_u(-) -
prior * R_p(-)), and a step in which the second part is negative climbs it instead.  The class prior is the share of
positives among the labelled training rows.  Training reads a bounded sample: at most ``most_positive`` and
``most_unlabelled`` rows, those with the smallest hashes of their ids.  Scoring covers every whole text.

A feature is learnt only if positives have it clearly more often than unlabelled texts (six standard errors, and 1 % of the positives, three at least).  Sigmoid steps leave the bias
where the logistic ones put it.

Null and empty texts have no words and get the score of the bias alone.  Without positives the score is 0; without a feature that tells, it is the
prior for every text, and ``keep_clean`` drops nothing.  Rows are scored alone, so ties and repeated rows get equal scores; labels are joined after one row for each id is made
(toxic if any says so).  Extra columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from clauseaudit.llm.common import LOWER, chunks, mix, quoted, word_hashes, words

DIMENSIONS = 1 << 18
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STRIP = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of all distinct (row, feature): words (runs of letters and digits, lower-cased) and their first 4, 5 and 6 bytes,
    which inflected forms share."""
    plain = LOWER[_STRIP[buf]]
    starts, ends, row = words(plain, off)
    size = ends - starts
    padded = np.append(plain, np.zeros(8, np.uint8)).astype(np.uint64)
    code, rows, found = np.zeros(len(starts), np.uint64), [row], [word_hashes(plain, starts, ends)]
    for k in range(6):
        code = (code << np.uint64(8)) | padded[starts + k]
        if k >= 3:
            rows.append(row[size > k])
            found.append(mix(code[size > k] + np.uint64(k)))
    both = np.unique(np.concatenate(rows) * DIMENSIONS + (np.concatenate(found) % np.uint64(DIMENSIONS)).astype(np.int64))
    return both // DIMENSIONS, both % DIMENSIONS


class Model:
    def __init__(self, weights: np.ndarray, bias: float, learnt: bool = True):
        self.weights, self.bias, self.learnt = weights, bias, learnt

    def margins(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """Sum of the weights of a text's words, and the bias."""
        return np.bincount(row, self.weights[col], n) + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _blocks(texts: Iterable[str], size: int = 100) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """``features`` of texts, some at a time, with rows counted through, and the number of texts; the texts themselves are not kept."""
    out, held, n = [], [], 0

    def flush() -> None:
        row, col = features(np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]))
        out.append(((row + n - len(held)).astype(np.int32), col.astype(np.int32)))
        held.clear()

    for t in texts:
        held.append(t.encode())
        n += 1
        if len(held) == size or sum(map(len, held)) > 1 << 20:
            flush()
    if held:
        flush()
    return out, n


def fit(positive: Iterable[str], unlabelled: Iterable[str], prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-6, sigmas: float = 6.0) -> Model:
    """Adam on the non-negative risk estimator over all rows of both kinds."""
    (blocks_p, n_p), (blocks_u, n_u) = _blocks(positive), _blocks(unlabelled)
    if not n_p or not n_u:
        return Model(np.zeros(DIMENSIONS), -30.0 if not n_p else 0.0, False)
    # Features that positives have clearly more often than unlabelled texts; others could only be learned by heart.
    share_p, share_u = (sum(np.bincount(col, minlength=DIMENSIONS) for _, col in blocks) / n for blocks, n in ((blocks_p, n_p), (blocks_u, n_u)))
    noise = np.sqrt(share_u * (1 - share_u) / n_p + share_u / n_u + 1e-12)
    useful = (share_p - share_u > sigmas * noise) & (share_p * n_p >= max(3, 0.01 * n_p))
    kept = [[(row[useful[col]], col[useful[col]]) for row, col in blocks] for blocks in (blocks_p, blocks_u)]
    del blocks_p, blocks_u
    (rp, cp), (ru, cu) = ((np.concatenate([x[0] for x in k]), np.concatenate([x[1] for x in k])) for k in kept)
    used, both = np.unique(np.concatenate([cp, cu]), return_inverse=True)
    cp, cu = both[: len(cp)], both[len(cp) :]
    n = len(used)
    if not n:
        return Model(np.zeros(DIMENSIONS), float(np.log(prior / (1 - prior))), False)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        zu = np.bincount(ru, w[cu], n_u) + w[-1]
        zp = np.bincount(rp, w[cp], n_p) + w[-1]
        su, sp = _sigmoid(zu), _sigmoid(zp)
        # First logistic losses, log(1 + e^-z) as positive and log(1 + e^z) as negative, which find their way from anywhere; then
        # sigmoid losses, s(-z) and s(z), which are bounded, so that a prior a little too high does no harm.
        if convex := t <= steps * 2 // 3:
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            du, dp, up = su / n_u, -prior * sp / n_p, -prior * (1 - sp) / n_p
        else:
            negative = su.mean() - prior * sp.mean()
            du, dp, up = su * (1 - su) / n_u, -prior * sp * (1 - sp) / n_p, -prior * sp * (1 - sp) / n_p
        if negative < 0:  # the estimate overfits: step back
            du, dp = -du, -dp
        else:
            dp = dp + up
        g = np.append(np.bincount(cu, du[ru], n) + np.bincount(cp, dp[rp], n), du.sum() + dp.sum())
        g[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(DIMENSIONS)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 8000) -> Model:
    """Fit on the rows of ``docs`` whose crc32(doc_id as text) mod 5 is not 0, a bounded sample of them."""
    by_id = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("crc32(cast(doc_id as string)) % 5 <> 0")
    order = F.xxhash64("doc_id", F.lit(17))
    marked = by_id.where("crc32(cast(doc_id as string)) % 5 <> 0")
    prior = marked.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)).alias("p")).first()["p"] or 0.0
    ids = marked.where("toxic = 1").orderBy(order, "doc_id").limit(most_positive).select("doc_id")
    positive = (r["text"] for r in rows.join(F.broadcast(ids), "doc_id", "left_semi").orderBy(order, "doc_id").limit(most_positive).select("text").toLocalIterator())
    # Unlabelled: any training row, the confirmed ones too, so that its mix is the corpus's.
    ids = rows.select("doc_id").orderBy(order, "doc_id").limit(most_unlabelled).distinct()
    unlabelled = (r["text"] for r in rows.join(F.broadcast(ids), "doc_id", "left_semi").orderBy(order, "doc_id").limit(most_unlabelled).select("text").toLocalIterator())
    return fit(positive, unlabelled, min(max(prior, 1e-4), 1 - 1e-4))


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of all columns of ``docs``) and score, one row for each row."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(held.value[0].astype(np.float64), held.value[1])
        for chunk in chunks(batches):
            row, col = features(chunk.buf, chunk.off)
            score = _sigmoid(m.margins(row, col, len(chunk)))
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(chunk.rows.columns, fields=list(chunk.rows.schema)), pa.array(score)], names=["row", "score"])

    return docs.mapInArrow(run, StructType().add("row", docs.schema).add("score", DoubleType()))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    x = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels)).select("row.doc_id", "score")
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return x.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted to be toxic; all of them if no feature could be learnt."""
    model = train(docs, labels)
    if not model.learnt:
        return docs
    return with_scores(docs, model).where("score < 0.5").select(*[F.col(quoted("row", c)).alias(c) for c in docs.columns])

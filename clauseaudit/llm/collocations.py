"""Phrase collocations by Rabin-Karp fingerprints.

A text is lower-cased (A-Z), cut at ``. , ; : ! ?`` and 0x0A-0x0D into pieces, and those at space and tab into words.  Numpy prefix polynomials over
the words' hashes give the fingerprint of every run of words as one subtraction and one product.  Lengths are counted one after another: a run
can reach ``least`` occurrences only if both runs that are one word shorter did, so the pass over length s sends only those (a bit plane
of the frequent fingerprints of length s - 1 tells; it may let too many through, never too few).  Each task adds up its own occurrences
before (fingerprint, count) is shuffled.

A last pass verifies: inside a chunk the occurrences of a fingerprint are compared, as sequences of words told apart by their bytes, with the
occurrence that the fingerprint points to; those that differ become groups of their own.  Only then are phrases made to text, once a
group, and added up by their text in shards of the fingerprints, together with the least (doc_id, word number) as a pointer to an occurrence.  So the counts are of texts: equal
fingerprints of different phrases cost work but change nothing.

Everything is per language (null: ``und``).  Null and empty texts have no words; repeated rows count as often as they occur; an empty
table gives an empty result.  Extra columns are ignored.  The planes have at most 2^29 bits a row: with more than some 30 million frequent
phrases of one length they let more runs through, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseaudit.llm import sketch
from clauseaudit.llm.common import LOWER, Chunk, Scratch, chunks, mix, small_batches, text_bytes, word_hashes, words

LEAST, LONGEST, TOP = 100, 5, 2000
CHUNK = 1 << 20  # bytes
FLUSH = 1 << 19  # entries
PHRASES = 400_000  # of a task, between two additions
BUCKETS = 64
NO_ID = (1 << 63) - 1
_U = np.uint64
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PLAIN = np.where(_PIECE, 0x20, LOWER).astype(np.uint8)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, _U)
    out[0] = 1
    return np.cumprod(out)


class Runs:
    """Words of a chunk, and fingerprints of their runs inside pieces."""

    def __init__(self, chunk: Chunk):
        self.buf = _PLAIN[chunk.buf]
        self.starts, self.ends, self.row = words(self.buf, chunk.off)
        self.hashes = word_hashes(self.buf, self.starts, self.ends)
        breaks = np.cumsum(_PIECE[chunk.buf], dtype=np.int64)[self.starts]
        new = np.ones(len(self.starts), bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (self.row[1:] != self.row[:-1])
        self.piece = np.cumsum(new)
        size = 1 << max(12, len(self.starts).bit_length())
        self.prefix = np.append(_U(0), np.cumsum(self.hashes * _powers(_BASE, size)[: len(self.starts)]))
        self.shift = _powers(_INVERSE, size)
        self.key = chunk.column("lang_key").to_numpy(zero_copy_only=False).view(_U)[self.row]

    def whole(self, size: int) -> np.ndarray:
        """Whether the run of ``size`` words from each word on lies in one piece."""
        n = max(0, len(self.starts) - size + 1)
        return self.piece[:n] == self.piece[size - 1 :][:n]

    def fingerprints(self, at: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the runs of ``size`` words that begin at words ``at``, by language."""
        return mix((self.prefix[at + size] - self.prefix[at]) * self.shift[at] + self.key[at] * _U(2 * size + 1))


def _sums(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def count_runs(keyed: DataFrame, size: int, shorter: sketch.Sketch | None) -> DataFrame:
    """(fingerprint, n) of the runs of ``size`` words whose two shorter runs may be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def flush() -> pa.RecordBatch:
            keys, n = _sums(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["fingerprint", "n"])

        for chunk in chunks(batches, limit=CHUNK):
            runs = Runs(chunk)
            whole = runs.whole(size)
            if shorter is not None:
                # A shorter run inside a whole one is whole itself.
                at = np.flatnonzero(runs.whole(size - 1))
                ok = np.zeros(len(runs.starts) + 1, bool)
                ok[at] = shorter.above(runs.fingerprints(at, size - 1)) > 0
                whole &= ok[: len(whole)] & ok[1 : len(whole) + 1]
            held.append(_sums(runs.fingerprints(np.flatnonzero(whole), size)))
            many += len(held[-1][0])
            if many >= FLUSH:
                yield flush()
                many = 0
        if many:
            yield flush()

    return keyed.mapInArrow(count, "fingerprint bigint, n bigint").groupBy("fingerprint").agg(F.sum("n").alias("n"))


def plane(frequent: DataFrame, many: int) -> sketch.Sketch:
    """Bit planes of a table of fingerprints."""
    return sketch.build(frequent.select("fingerprint"), lambda batches: (b.column(0).to_numpy(zero_copy_only=False).view(_U) for b in batches), many, 2, (0,), 16)


def _told_apart(runs: Runs) -> np.ndarray:
    """A number for each word: words have the same one if, and only if, their bytes are equal."""
    _, first, number = np.unique(runs.hashes, return_index=True, return_inverse=True)
    size = runs.ends - runs.starts
    differ = size != size[first[number]]
    # Bytes of all words against those of the first word with the same hash.
    same = np.flatnonzero(~differ)
    length = size[same]
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    other = runs.buf[np.repeat(runs.starts[same], length) + inside] != runs.buf[np.repeat(runs.starts[first[number[same]]], length) + inside]
    differ[same[np.repeat(np.arange(len(same)), length)[other]]] = True
    if differ.any():
        fresh: dict[bytes, int] = {}
        for i in np.flatnonzero(differ).tolist():
            number[i] = fresh.setdefault(runs.buf[runs.starts[i] : runs.ends[i]].tobytes(), len(first) + len(fresh))
    return number


def _groups(at: np.ndarray, keys: np.ndarray, word: np.ndarray, lang: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of equal runs: the occurrences they point to (the first in ``at``), their fingerprints and their sizes.  Runs with one fingerprint and different words part."""
    while len(at):
        own, first, group = np.unique(keys, return_index=True, return_inverse=True)
        head = at[first[group]]
        same = lang[at] == lang[head]
        for i in range(size):
            same &= word[at + i] == word[head + i]
        yield at[first], own, np.bincount(group[same], minlength=len(first))
        at, keys = at[~same], keys[~same]


def _strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of byte ranges."""
    off = np.append(0, np.cumsum(ends - starts))
    data = buf[np.repeat(starts - off[:-1], np.diff(off)) + np.arange(off[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data))


def _spaced(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each, and the start and end of each word."""
    length = runs.ends - runs.starts + 1
    stop = np.cumsum(length)
    begin = stop - length
    at = np.repeat(runs.starts - begin, length) + np.arange(int(length.sum()))
    out = np.append(runs.buf, np.uint8(0x20))[at]
    out[stop - 1] = 0x20
    return out, begin, stop - 1


def _added(tables: list[pa.Table]) -> pa.Table:
    """One row for each text: the sum of its counts and its first place."""
    rows = pa.concat_tables(tables).combine_chunks().sort_by([("doc_id", "ascending"), ("word", "ascending")])
    out = rows.group_by(["shard", "lang", "size", "phrase"], use_threads=False).aggregate([("n", "sum"), ("doc_id", "first"), ("word", "first")])
    return out.select(["shard", "lang", "size", "phrase", "n_sum", "doc_id_first", "word_first"]).rename_columns(COLUMNS.names)


COLUMNS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()), ("word", pa.int64())])
PACKED = "shard bigint, rows array<struct<lang:string,size:int,phrase:string,n:bigint,doc_id:bigint,word:bigint>>"


def phrases(keyed: DataFrame, frequent: sketch.Sketch | None, longest: int, shards: int, least: int) -> DataFrame:
    """(lang, size, phrase, n, doc_id, word) of the runs that occur ``least`` times, counted by their text; size 0 counts all words of the language."""

    def of_chunk(chunk: Chunk) -> pa.Table:
        runs = Runs(chunk)
        ids = chunk.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        begin = np.searchsorted(runs.row, np.arange(len(chunk)))
        code = chunk.column("lang").dictionary_encode()
        names, lang = code.dictionary, code.indices.to_numpy()[runs.row]
        n = np.bincount(lang, minlength=len(names))
        none = np.zeros(len(names), np.int64)
        out = [pa.Table.from_arrays([pa.array(none), names, pa.array(none, pa.int32()), pa.array([""] * len(names)), pa.array(n, pa.int64()), pa.array(none + NO_ID), pa.array(none)], schema=COLUMNS)]
        if frequent is None or not len(runs.starts):
            return out[0]
        word, (buf, starts, ends) = _told_apart(runs), _spaced(runs)
        for size in range(1, longest + 1):
            at = np.flatnonzero(runs.whole(size))
            keys = runs.fingerprints(at, size)
            keep = frequent.above(keys) > 0
            at, keys = at[keep], keys[keep]
            # In order of id and place, so that a group points to its first occurrence.
            order = np.lexsort((at - begin[runs.row[at]], ids[runs.row[at]]))
            for head, key, n in _groups(at[order], keys[order], word, lang, size):
                row = runs.row[head]
                texts = _strings(buf, starts[head], ends[head + size - 1])
                columns = [pa.array((key % _U(shards)).astype(np.int64)), names.take(pa.array(lang[head])), pa.array(np.full(len(head), size, np.int32)), texts, pa.array(n, pa.int64()), pa.array(ids[row]), pa.array(head - begin[row])]
                out.append(pa.Table.from_arrays(columns, schema=COLUMNS))
        return pa.concat_tables(out)

    def send(held: list[pa.Table]) -> pa.RecordBatch:
        """One row for each shard with all its phrases."""
        rows = _added(held).sort_by("shard").combine_chunks()
        shard = rows["shard"].to_numpy()
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        body = pa.StructArray.from_arrays([x.combine_chunks() for x in rows.columns[1:]], fields=list(COLUMNS)[1:])
        return pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.ListArray.from_arrays(pa.array(np.append(cut, len(shard)), pa.int32()), body)], names=["shard", "rows"])

    def materialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for chunk in chunks(batches, limit=CHUNK):
            held.append(of_chunk(chunk))
            if sum(map(len, held)) > PHRASES:
                held = [_added(held)]
                if len(held[0]) > PHRASES // 2:
                    yield send(held)
                    held = []
        if held:
            yield send(held)

    def add(pieces: pa.Table) -> pa.Table:
        rows = pa.concat_arrays(pieces.column("rows").chunks).flatten()
        table = pa.Table.from_arrays([pa.array(np.zeros(len(rows), np.int64)), *rows.flatten()], names=COLUMNS.names).cast(COLUMNS)
        found = _added([table]).drop_columns("shard")
        return found.filter(pc.or_(pc.greater_equal(found["n"], least), pc.equal(found["size"], 0)))

    found = keyed.mapInArrow(materialise, PACKED).groupBy("shard").applyInArrow(add, "lang string, size int, phrase string, n bigint, doc_id bigint, word bigint")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, size, phrase, n, doc_id, word): phrases with ``least`` occurrences and more, and a row of size 0 with the number of words of each language."""
    scratch = Scratch(small_batches(docs).sparkSession)
    lang = F.coalesce("lang", F.lit("und"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), "text")
    tables, bits, size, many = [], None, 0, 0
    while size < longest:
        found = scratch.cut(count_runs(keyed, size + 1, bits).where(F.col("n") >= least))
        if bits is not None:
            bits.free()
        bits, more = None, found.count()
        if not more:
            break
        size, many = size + 1, many + more
        tables.append(found)
        if size < longest:
            bits = plane(found, more)
    everything = None
    if tables:
        union = tables[0]
        for t in tables[1:]:
            union = union.unionByName(t)
        everything = plane(union, many)
    shards = max(256, text_bytes(docs) // (4 << 20))
    out = scratch.cut(phrases(keyed, everything, size, shards, least))
    if everything is not None:
        everything.free()
    scratch.free(*[t for t, _ in scratch.held[:-1]])
    return out


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, doc_id and word (an occurrence: the least id, the word's number in its text) of each language's best phrases.

    A phrase of two words and more is scored at its lowest cut; one that always stands inside a longer frequent phrase is left out."""
    found = frequent_phrases(docs, least, longest)
    totals = found.where("size = 0").select("lang", F.col("n").alias("total"))
    parts = F.split("phrase", " ")
    candidates = found.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), "doc_id", "word", parts.alias("ws"))
    counted = found.where("size > 0").select("lang", "phrase", "n")

    def of(part: str, count: str) -> DataFrame:
        return counted.select("lang", F.col("phrase").alias(part), F.col("n").alias(count))

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "doc_id", "word", "k", F.array_join(F.slice("ws", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("ws", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    scored = cuts.join(of("head", "l"), ["lang", "head"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "total", "l", "r")}
    scored = scored.withColumn("p", (wide["a"] * wide["total"]).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("q", wide["l"] * wide["r"])
    best = scored.select("lang", "phrase", "a", "doc_id", "word", F.struct(F.expr("p div q").alias("score"), "k", "l", "r", F.col("total").alias("n")).alias("cut")).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), *[F.first(c).alias(c) for c in ("a", "doc_id", "word")])
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: F.array_join(F.slice("ws", i, s), " "))))
    covered = candidates.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(covered, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    near = kept.withColumn("bucket", F.pmod(F.hash("phrase"), F.lit(BUCKETS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score", "doc_id", "word")


SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, unnest(ps) AS p FROM d),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, s, ws, unnest(range(1, len(ws) - s + 2)) AS i FROM w, range(1, 6) AS r(s) WHERE len(ws) >= s),
f AS MATERIALIZED (SELECT lang, s AS size, array_to_string(ws[i:i + s - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
k AS (SELECT lang, phrase, a, size, ws, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, f1.a AS l, f2.a AS r, t.n, 1000 * k.a * t.n // (f1.a * f2.a) AS score FROM k JOIN t ON t.lang = k.lang
  JOIN f f1 ON f1.lang = k.lang AND f1.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f f2 ON f2.lang = k.lang AND f2.phrase = array_to_string(k.ws[k.k + 1:k.size], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT lang, a, size, ws, unnest(range(2, size)) AS m FROM c WHERE size > 2),
v AS (SELECT lang, a, ws, m, unnest(range(1, size - m + 2)) AS i FROM u),
x AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM v GROUP BY 1, 2)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.longer IS NULL OR x.longer < b.a) q WHERE rank <= 2000"""

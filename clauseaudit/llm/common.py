"""Shared pieces of the text operators: Arrow chunks, word and shingle hashes, cut points.

Everything here runs inside Spark tasks on bounded chunks of rows.  A word is a maximal run of bytes
outside space and 0x09-0x0D; hashes are 64-bit and computed for a whole chunk at once with numpy.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
CHUNK_BYTES = 2 << 20
BATCH_BYTES = 4 << 20  # of an Arrow batch between the JVM and Python
_U = np.uint64
_R1, _R2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, xor and multiply rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _R1) | _U(1)
_BYTE[WHITE] = 0


@lru_cache(maxsize=4)
def _powers(size: int) -> np.ndarray:
    out = np.full(size, _R2, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Chunk:
    """Some rows of an Arrow batch: ``rows`` (a slice of the batch), bytes of the texts and offsets."""

    def __init__(self, rows: pa.RecordBatch, buf: np.ndarray, off: np.ndarray):
        self.rows, self.buf, self.off = rows, buf, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def column(self, name: str) -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut batches into runs of rows of about ``limit`` text bytes; one longer text is a chunk of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        col = pc.fill_null(col.cast(pa.large_string()), "")
        size = len(col)
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + size + 1]
        data = col.buffers()[2]
        buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < size:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield Chunk(batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at])
            at = to
        del batch, col, data, buf
        pa.default_memory_pool().release_unused()


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte offsets) of all words, and the row of each."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    white = WHITE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = np.ones(n, bool)
    first[1:] = white[:-1]
    first |= edge[:n]
    last = np.ones(n, bool)
    last[:-1] = white[1:]
    last |= edge[1:]
    starts = np.flatnonzero(~white & first)
    return starts, np.flatnonzero(~white & last) + 1, np.searchsorted(off, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, then a finaliser."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    body = buf[starts[0] :]
    first = starts - starts[0]
    spans = np.diff(np.append(first, len(body)))
    local = np.arange(len(body)) - np.repeat(first, spans)
    size = 1 << max(12, int(spans.max()).bit_length())
    values = _BYTE[body] * _powers(size)[local]
    return mix(np.add.reduceat(values, first) + (ends - starts).astype(np.uint64) * _R1)


def window_hashes(h: np.ndarray, k: int, factor: np.uint64 = _R1) -> np.ndarray:
    """Polynomial hashes of all runs of k values, by doubling; shorter input gives none."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, at, width, power = None, 0, h, 1, factor
    while True:
        if k & width:
            if out is None:
                out, done = at, width
            else:
                m = len(h) - done - width + 1
                out = out[:m] + at[done : done + m] * _power(factor, done)
                done += width
        width *= 2
        if width > k:
            break
        at = at[: len(at) - width // 2] + at[width // 2 :] * power
        power = _power(power, 2)
    return mix(out[: len(h) - k + 1])


def _power(x: np.uint64, n: int) -> np.uint64:
    return _U(pow(int(x), n, 1 << 64))


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of k-word shingles per row, A-Z lower-cased; fewer words: all of them as one."""
    buf = LOWER[buf]
    starts, ends, row = words(buf, off)
    h = word_hashes(buf, starts, ends)
    runs = window_hashes(h, k)
    cut = np.searchsorted(row, np.arange(len(off)))
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(mix(window_hashes(h[a:b], b - a) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def quoted(*names: str) -> str:
    """The path to a column or field whatever its name holds, dots and backticks too."""
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names.  Only a local master, which has one machine, may name none: it gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


class Scratch:
    """Tables that cut the lineage: written to the shared folder and read back; ``free`` deletes those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/cut-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.held.append((out, path))
        return out

    def free(self, *tables: DataFrame) -> None:
        """Delete the given tables, or all.  Whatever was made of them must have been written."""
        for out, path in [x for x in self.held if not tables or any(x[0] is t for t in tables)]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            self.held = [x for x in self.held if x[0] is not out]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    return Scratch(df.sparkSession).cut(df)


def power_of_two(x: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << math.ceil(math.log2(max(1.0, x)))))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands rows to Python in Arrow batches of about ``BATCH_BYTES`` from now on, if it did not in smaller ones.

    Spark's own bound is 64 MB and 10,000 rows, so a task's whole split was one batch, held by the JVM (twice while its buffers grow) and by Python."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name))
    if given > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one scan with a partial sum."""
    from pyspark.sql import functions as F

    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"])


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge list (a, b): large-star and small-star rounds.

    Each round is two aggregations by node with map-side minima and joins that AQE may split, so a node
    with very many links is no task of its own.  Rounds grow with the logarithm of the longest chain.
    The label is the smallest node.  Nodes are any orderable type; loops and repeats are harmless.
    """
    from pyspark.sql import functions as F

    scratch = Scratch(edges.sparkSession)
    state = scratch.cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    mark = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    if not mark["n"]:
        return state.select(F.col("v").alias("node"), F.col("u").alias("component"))
    while True:
        both = state.select("v", "u").unionByName(state.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        before, state = state, scratch.cut(small)
        scratch.free(before)
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            break
        mark = now
    root = state.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return state.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(root)

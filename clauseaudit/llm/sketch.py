"""Count-min sketches of hashed items, merged from partition sketches.

Row 0 of a sketch has a plane for each threshold; further rows only test the first threshold.  A task collects the cells
of its items, sorted and coded as byte-sized differences, one row for each part of the sketch.  Parts merge by key
with numpy sums; what leaves a part are bit planes: for each threshold, whether a cell's count exceeds it.  They are
written to the shared folder, from which the driver takes some at a time, and broadcast: depth * planes * cells / 8 bytes, cells
being a power of two sized from the input up to ``most``.
So the broadcast is bounded.  What a sketch of ``most`` cells cannot tell apart any more is counted slice by slice (``slices``):
each slice of the hash space has a sketch of its own, at the same load at every size of input, which is freed before the next.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseaudit.llm.common import Chunk, Scratch, chunks, mix, power_of_two

PART = 1 << 20  # cells of a part
FLUSH = 4 << 20  # items
MOST = 1 << 29  # cells: 64 MB a plane
FETCH = 8 << 20  # bytes of planes that the driver takes at once


def pack(cells: np.ndarray) -> bytes:
    """Sorted cells as differences in base 255 with 255 as the sign for more."""
    steps = np.diff(cells, prepend=0)
    out = np.full(len(steps) + int((steps // 255).sum()), 255, np.uint8)
    out[np.cumsum(steps // 255 + 1) - 1] = steps % 255
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    return np.cumsum(a, dtype=np.int64)[a != 255]


def cells_of(items: np.ndarray, row: int, cells: int) -> np.ndarray:
    """Cell of each item in one row of the sketch."""
    return (mix(items + np.uint64(0x632BE59BD9B4E019 * (row + 1) & (1 << 64) - 1)) & np.uint64(cells - 1)).astype(np.int64)


class Sketch:
    def __init__(self, planes: Broadcast, cells: int, depth: int, thresholds: tuple[int, ...]):
        self.planes, self.cells, self.depth, self.thresholds = planes, cells, depth, thresholds

    def above(self, items: np.ndarray) -> np.ndarray:
        """How many of the thresholds the estimate of each item exceeds."""
        out = np.zeros(len(items), np.int8)
        for row in range(self.depth):
            at = cells_of(items, row, self.cells)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            for plane in self.planes.value[row]:
                got = ((plane[byte] >> bit) & 1).astype(np.int8)
                out = out + got if row == 0 else out * got
        return out

    def free(self) -> None:
        """Give the planes back, in the driver and the executors.  What was made with them must have been written."""
        self.planes.destroy()


def slices(expected: float, cells_per_item: float, most: int = MOST) -> int:
    """Into how many slices of the hash space ``expected`` items go, so that each has its cells."""
    return max(1, math.ceil(expected * cells_per_item / most))


def slice_of(items: np.ndarray, n: int) -> np.ndarray:
    """Slice of each item (independent of its cells)."""
    return (mix(items ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n)).astype(np.int64)


def of_chunks(items: Callable[[Chunk], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    """Items of texts, chunk by chunk."""
    return lambda batches: map(items, chunks(batches))


def build(docs: DataFrame, items: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], expected: float, depth: int, thresholds: tuple[int, ...], cells_per_item: float, least: int = 1 << 20, most: int = MOST) -> Sketch:
    """Count ``items`` (arrays of hashes from a task's batches) over all of ``docs``; about ``expected`` are there."""
    cells = power_of_two(expected * cells_per_item, least, most)
    size = min(PART, cells)
    parts = cells // size
    scratch = Scratch(docs.sparkSession)
    limit = thresholds[-1] + 1  # a task's own copies beyond it add nothing

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        everything = np.concatenate(held)
        for row in range(depth):
            at = np.sort(cells_of(everything, row, cells))
            if len(at) > limit:
                keep = np.ones(len(at), bool)
                keep[limit:] = at[limit:] != at[:-limit]
                at = at[keep]
            ends = np.searchsorted(at, np.arange(parts + 1) * size)
            full = np.flatnonzero(np.diff(ends))
            data = [pack(at[ends[p] : ends[p + 1]] - p * size) for p in full]
            yield pa.RecordBatch.from_pydict({"part": pa.array(full + row * parts, pa.int64()), "data": pa.array(data, pa.binary())})

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for found in items(batches):
            held.append(found)
            many += len(held[-1])
            if many >= FLUSH:
                yield from flush(held)
                held, many = [], 0
        if many:
            yield from flush(held)

    def merge(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(size, np.int64)
        for data in pieces["data"]:
            counts += np.bincount(unpack(data), minlength=size)
        row = int(key[0]) // parts
        planes = [np.packbits(counts > t, bitorder="little").tobytes() for t in (thresholds if row == 0 else thresholds[:1])]
        return pd.DataFrame({"part": [int(key[0])], "planes": [planes]})

    merged = scratch.cut(docs.mapInArrow(collect, "part bigint, data binary").groupBy("part").applyInPandas(merge, "part bigint, planes array<binary>"))
    planes = [[np.zeros(cells // 8, np.uint8) for _ in (thresholds if row == 0 else thresholds[:1])] for row in range(depth)]
    # One job for FETCH bytes of planes: toLocalIterator would start one for each partition and merge them one after another.
    step = max(1, FETCH // (size // 8 * len(thresholds)))
    for first in range(0, depth * parts, step):
        for got in merged.where(F.col("part").between(first, first + step - 1)).collect():
            row, part = divmod(got["part"], parts)
            for t, data in enumerate(got["planes"]):
                planes[row][t][part * size // 8 : (part + 1) * size // 8] = np.frombuffer(bytes(data), np.uint8)
    scratch.free()
    return Sketch(docs.sparkSession.sparkContext.broadcast(planes), cells, depth, thresholds)

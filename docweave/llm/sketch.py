"""Count-min sketches as Spark jobs: each task sketches its part sparsely, slices of cells are merged by a shuffle, and
a sketch of bounded size reaches every worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from docweave.llm.common import mix, partitions

SLICE_BITS = 18
#: Items that a task sketches at a time.
FLUSH = 2 << 20
#: Cells a sketch may have, in all its rows: 64 MB at one bit each, 256 MB at four. More items than cells make
#: estimates coarser, never too low.
MOST_BITS = 29


#: Bits of a cell, by how many levels it tells apart; and the cells of a byte, as a power of two.
_WIDTH, _SHIFT = {1: 1, 3: 2, 15: 4}, {1: 3, 2: 2, 4: 1}


@dataclass
class Sketch:
    """``depth`` rows of ``2 ** bits`` cells of ``width`` (1, 2 or 4) bits; kept compressed until a worker needs it."""

    bits: int
    depth: int
    width: int
    packed: bytes

    def levels(self, items: np.ndarray) -> np.ndarray:
        """For each item the least level over the rows: at least the level of its true count."""
        if not hasattr(self, "_cells"):
            self._cells = np.frombuffer(pa.decompress(self.packed, self.depth * self.width << self.bits >> 3, "zstd", asbytes=True), np.uint8)
        shift = _SHIFT[self.width]
        most = np.uint8((1 << self.width) - 1)
        out = np.full(len(items), most, np.uint8)
        for row in range(self.depth):
            at = cells(items, row, self.bits)
            inner = (at & np.uint64((1 << shift) - 1)).astype(np.uint8) * np.uint8(self.width)
            np.minimum(out, self._cells[at >> np.uint64(shift)] >> inner & most, out=out)
        return out


def cells(items: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The items' cells in one row; rows lie one after the other."""
    return (mix(items + np.uint64((row * 2 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(64 - bits)) + np.uint64(row << bits)


def pack_gaps(sorted_cells: np.ndarray) -> bytes:
    """Ascending distinct numbers as their gaps, a byte for each, 255 meaning that many more."""
    gaps = np.diff(sorted_cells.astype(np.int64), prepend=-1) - 1
    whole = gaps // 255
    at = np.cumsum(whole + 1) - 1
    out = np.full(at[-1] + 1 if len(at) else 0, 255, np.uint8)
    out[at] = gaps - whole * 255
    return out.tobytes()


def unpack_gaps(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8)
    last = steps != 255
    return np.cumsum(steps.astype(np.int64) + last)[last] - 1


def sizes(items: int, depth: int, load: float = 0.5) -> int:
    """Bits of a row's cells for about so many items, within MOST_BITS for all rows."""
    need = int(np.ceil(np.log2(max(items, 1) / load))) if items else 0
    return int(min(max(need, SLICE_BITS), MOST_BITS - (depth - 1).bit_length()))


def _sketch(items_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, depth: int) -> Callable:
    schema = pa.schema([("slice", pa.int32()), ("gaps", pa.binary()), ("counts", pa.binary())])

    def flush(items: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(depth):
            found = np.sort(cells(items, row, bits).astype(np.uint32))
            new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
            count = np.minimum(np.diff(np.append(new, len(found))), 65535).astype(np.uint16)
            found = found[new]
            cuts = np.searchsorted(found, np.arange(row << bits >> SLICE_BITS, (row + 1 << bits >> SLICE_BITS) + 1, dtype=np.int64) << SLICE_BITS)
            rows = [(s + (row << bits >> SLICE_BITS), a, b) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            for lo in range(0, len(rows), 512):
                some = rows[lo : lo + 512]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _, _ in some], pa.int32()),
                        pa.array([pack_gaps(found[a:b] & np.uint32((1 << SLICE_BITS) - 1)) for _, a, b in some], pa.binary()),
                        pa.array([pa.compress(count[a:b].tobytes(), "zstd", asbytes=True) for _, a, b in some], pa.binary()),
                    ],
                    schema=schema,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for items in items_of(batch):
                held.append(items)
                n += len(items)
                if n >= FLUSH:
                    yield from flush(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield from flush(np.concatenate(held))

    return run


def _merge(levels: tuple[int, ...]) -> Callable:
    """Rows come sorted by slice; only one slice is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def done() -> pa.RecordBatch:
            level = np.searchsorted(np.array(levels), total, side="right").astype(np.uint8)
            width = _WIDTH[len(levels)]
            level = level.reshape(-1, 1 << _SHIFT[width])
            packed = np.zeros(len(level), np.uint8)
            for i in range(level.shape[1]):
                packed |= level[:, i] << np.uint8(width * i)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed.astype(np.uint8).tobytes()], pa.binary())], names=["slice", "packed"])

        for batch in batches:
            for s, gaps, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != at:
                    if at is not None:
                        yield done()
                    at, total = s, np.zeros(1 << SLICE_BITS, np.int64)
                where = unpack_gaps(gaps)
                total[where] += np.frombuffer(pa.decompress(counts, 2 * len(where), "zstd", asbytes=True), np.uint16)
        if at is not None:
            yield done()

    return run


def count_min(df: DataFrame, items_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], items: int, depth: int = 2, load: float = 0.5, levels: tuple[int, ...] = (2,)) -> Broadcast:
    """Sketches all 64-bit items that ``items_of`` finds in the rows of ``df`` (``items`` is their expected number, for
    sizing) and broadcasts the result, at most ``2 ** MOST_BITS`` cells whatever the input. A cell keeps which of
    ``levels`` (1, 3 or 15 ascending counts) its count has reached. Estimates are never below the true level."""
    spark = df.sparkSession
    width = _WIDTH[len(levels)]
    bits = sizes(items, depth, load)
    parts = df.mapInArrow(_sketch(items_of, bits, depth), "slice int, gaps binary, counts binary")
    parts = parts.repartition(partitions(spark), "slice").sortWithinPartitions("slice")
    packed, size = np.zeros(depth * width << bits >> 3, np.uint8), width << SLICE_BITS >> 3
    merged = parts.mapInArrow(_merge(levels), "slice int, packed binary").toArrow()
    for s, raw in zip(merged["slice"].to_pylist(), merged["packed"], strict=True):
        packed[s * size : (s + 1) * size] = np.frombuffer(raw.as_buffer(), np.uint8)
    return spark.sparkContext.broadcast(Sketch(bits, depth, width, pa.compress(packed.tobytes(), "zstd", asbytes=True)))

"""A count-min sketch whose counters stop at two: which 64-bit keys may occur twice in a table.

Every task writes its sketch as sorted cells by slice (a cell counted twice stands twice); slices of
all tasks are merged to bitmaps of the cells counted twice or more. A key's estimate is the least of
its ROWS cells and never below its count. A sketch has 2 ** bits cells in a row, at most 2 ** MAX_BITS:
with more keys than that it lets more of them pass, and still loses none.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcarank.llm.common import mix, tidy

ROWS, MIN_BITS, MAX_BITS = 4, 20, 28
#: Slices of a sketch row; keys held before a task writes what it has counted.
SLICES, HELD = 16, 1 << 20


#: Bytes taken for a table whose size the optimiser does not know (it says so by a size beyond 2 ** 60).
UNKNOWN = 64 << 20


def table_bytes(df: DataFrame) -> int:
    """The optimiser's size of the table: its files' bytes. It sets sketches' sizes, never results."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else UNKNOWN


def bits_for(df: DataFrame, share: int) -> int:
    """A cell in each row for every ``share`` bytes of the table."""
    return min(MAX_BITS, max(MIN_BITS, (table_bytes(df) // share).bit_length()))


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(keys * np.uint64(2 * row + 1) + np.uint64(0x632BE59BD9B4E019 * (row + 1) & (2**64 - 1)))
    return (h >> np.uint64(64 - bits)).astype(np.uint32)


def _packed(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    per_slice, out = bits - (SLICES.bit_length() - 1), []
    for row in range(ROWS):
        cells = np.sort(_cells(keys, row, bits))
        if len(cells) > 2:
            cells = cells[np.append([True, True], cells[2:] != cells[:-2])]
        cuts = np.searchsorted(cells, np.arange(SLICES + 1, dtype=np.uint64) << np.uint64(per_slice))
        for s in range(SLICES):
            if len(part := cells[cuts[s]:cuts[s + 1]]):
                out.append((row, s, zlib.compress(np.diff(part, prepend=np.uint32(s << per_slice)).astype("<u4").tobytes(), 1)))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()),
                                       pa.array([x[2] for x in out], pa.binary())], names=["row", "slice", "cells"])


def _merged(cells: DataFrame, bits: int) -> DataFrame:
    """One bitmap per row and slice of the cells that were counted at least twice."""
    per_slice = bits - (SLICES.bit_length() - 1)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, s, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4"), dtype=np.uint32)
                c = counts.setdefault((row, s), np.zeros(1 << per_slice, np.uint8))
                c[at] = np.minimum(c[at] + 1, 2)
                c[at[1:][at[1:] == at[:-1]]] = 2
        for (row, s), c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([s], pa.int32()),
                                              pa.array([np.packbits(c >= 2, bitorder="little").tobytes()], pa.binary())], names=["row", "slice", "cells"])

    return cells.repartition(ROWS * SLICES, "row", "slice").mapInArrow(run, "row int, slice int, cells binary")


def seen_twice(source: DataFrame, keys_of: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """The merged sketch of the keys that ``keys_of`` finds in the batches of ``source``: a bitmap for
    each row, at most ROWS * 2 ** MAX_BITS / 8 bytes in all."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for keys in keys_of(batches):
            held.append(keys)
            n += len(keys)
            if n > HELD:
                yield _packed(np.concatenate(held), bits)
                held, n = [], 0
        if n:
            yield _packed(np.concatenate(held), bits)

    bitmap = np.zeros((ROWS, SLICES, (1 << bits) // SLICES // 8), np.uint8)
    for r in _merged(source.mapInArrow(run, "row int, slice int, cells binary"), bits).collect():
        bitmap[r["row"], r["slice"]] = np.frombuffer(bytes(r["cells"]), np.uint8)
    return bitmap.reshape(ROWS, -1)


def maybe_twice(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for row in range(ROWS):
        c = _cells(keys, row, bits)
        ok &= (bitmap[row][c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
    return ok


#: Cells (as bits) of a filter of 64-bit keys: CELLS_EACH for each key, within these bounds.
FILTER_LEAST, FILTER_MOST, CELLS_EACH = 16, 27, 8


def _filter_cells(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64, copy=False) >> np.uint64(64 - bits)).astype(np.int64)


def merged_bitmap(cells: DataFrame, bits: int) -> np.ndarray:
    """Bits of the cells in ``cells`` (slice int, cells binary, as ``packed_cells`` makes them). Slices are merged
    in SLICES tasks; the driver gets 2 ** bits bits."""
    per_slice = bits - (SLICES.bit_length() - 1)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4"), dtype=np.uint32)
                held.setdefault(s, np.zeros(1 << per_slice, bool))[at] = True
        for s, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], names=["slice", "cells"])

    out = np.zeros((SLICES, (1 << per_slice) // 8), np.uint8)
    for r in cells.repartition(SLICES, "slice").mapInArrow(run, "slice int, cells binary").collect():
        out[r["slice"]] = np.frombuffer(bytes(r["cells"]), np.uint8)
    return out.ravel()


def packed_cells(cells: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted distinct cells by slice, as gaps."""
    per_slice = bits - (SLICES.bit_length() - 1)
    cuts = np.searchsorted(cells, np.arange(SLICES + 1, dtype=np.uint64) << np.uint64(per_slice))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    gaps = [zlib.compress(np.diff(cells[cuts[s]:cuts[s + 1]], prepend=np.uint32(s << per_slice)).astype("<u4").tobytes(), 1) for s in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(gaps, pa.binary())], names=["slice", "cells"])


def key_filter(keys: DataFrame, each: int = CELLS_EACH) -> np.ndarray:
    """Bits of the cells that the keys (one long column, spread evenly) fall in: ``each`` cells for each key, 2 ** FILTER_MOST
    at most. It lets all of the keys pass, and few others while there are several cells for each."""
    bits = min(FILTER_MOST, max(FILTER_LEAST, (keys.count() * each).bit_length()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed_cells(np.unique(_filter_cells(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)).astype(np.uint32), bits)

    return merged_bitmap(keys.mapInArrow(run, "slice int, cells binary"), bits)


def has_bit(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)


def passes(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return has_bit(packed, _filter_cells(keys.view(np.uint64), len(packed).bit_length() + 2))

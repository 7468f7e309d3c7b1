"""Helpers that several operators share: Arrow batches in and out, word hashes, bounded caches."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that a per-worker cache may hold before it starts anew.
CACHE_ENTRIES = 200_000
#: Rows a worker gathers before it works on them, and the text bytes after which it stops gathering.
CHUNK_BYTES = 8 << 20
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20


def worker_state(key: str, make: Callable[[], object], small: bool = False) -> object:
    """What a Python worker keeps from task to task (caches, automata): what the operator that it last worked for
    needs, and small tables. The package travels by value, so its own module variables are new in every task;
    this is a module of the worker process instead."""
    held = sys.modules.setdefault("_lcarank_worker", types.ModuleType("_lcarank_worker")).__dict__
    state = held.setdefault("small" if small else "large", {})
    if key not in state:
        if not small:
            state.clear()
        state[key] = make()
    return state[key]


def tidy(fn: Callable) -> Callable:
    """For functions over a task's batches: gives freed memory back to the system at the task's end, since a
    worker may wait idle beside others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends batches of BATCH_BYTES at most to Python workers from now on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def id_and_text(df: DataFrame, id_col: str, text_col: str, binary: bool = True) -> DataFrame:
    """The two columns that an operator reads, as ``id`` and ``text`` (UTF-8 bytes when ``binary``)."""
    text = F.col(f"`{text_col}`").cast("string")
    return small_batches(df).select(F.col(f"`{id_col}`").alias("id"),
                     (text.cast("binary") if binary else text).alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, list]]:
    """(ids, texts) in pieces of about ``most`` bytes of text; a single longer text is a piece alone."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        start, held = 0, 0
        sizes = [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()]
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield ids.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield ids.slice(start), texts.slice(start).to_pylist()


def arrow_rows(df: DataFrame, fn: Callable[[pa.Array, list], dict], schema: str,
               most: int = CHUNK_BYTES) -> DataFrame:
    """``fn(ids, texts)`` over pieces of the (id, text) frame ``df``; it returns columns by name."""
    names = [x.split()[0] for x in _fields(schema)]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, most):
            out = fn(ids, texts)
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    depth, fields, last = 0, [], 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            fields.append(schema[last:i].strip())
            last = i + 1
    return [*fields, schema[last:].strip()]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_spans(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array of bytes, where the words (runs of other bytes than x20 and x09 to x0D)
    start and end in it, and the number of words of each text."""
    buf = np.frombuffer(b" ".join(t or b"" for t in texts) + b" " * 9, np.uint8)
    ends_text = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.empty(0, np.int64)
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    counts = np.diff(np.searchsorted(starts, ends_text), prepend=0) if texts else np.empty(0, np.int64)
    return buf, starts, ends, counts


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, eight bytes at a time, all spans at once."""
    eight = np.lib.stride_tricks.sliding_window_view(buf, 8)
    h = mix((ends - starts).astype(np.uint64))
    which, at = np.flatnonzero(ends > starts), starts[ends > starts]
    while len(which):
        part = np.ascontiguousarray(eight[at]).view("<u8").ravel() & _LOW_BYTES[np.minimum(ends[which] - at, 8)]
        with np.errstate(over="ignore"):
            h[which] = mix(h[which] * np.uint64(0x9E3779B97F4A7C15) ^ part)
        more = ends[which] - at > 8
        which, at = which[more], at[more] + 8
    return h


def hashed_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the number of words of each text."""
    buf, starts, ends, counts = word_spans(texts)
    return hash_spans(buf, starts, ends), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring inputs give unrelated outputs."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes (none if there are fewer): doubling, so that a
    window of k costs about 2 log2 k passes over the array."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        part, size, out, done = mix(words + np.uint64(seed)), 1, None, 0
        while True:
            if k & size:
                piece = part[done:done + n]
                out = piece if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + piece)
                done += size
            if done == k:
                return out
            part = mix(part[:-size] * np.uint64(0x9E3779B97F4A7C15) + part[size:])
            size *= 2


def summed_arrays(parts: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Sums of the float32 arrays in ``parts`` (key int, data binary), one for each key; ``most`` keys at
    most. Each key's arrays are added up in one task as they stream by, and only the sums are collected."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(data.as_buffer(), np.float32)
                if key in sums:
                    sums[key] += x
                else:
                    sums[key] = x.astype(np.float64)
        for key, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["key", "data"])

    merged = parts.repartition(max(1, most), "key").mapInArrow(run, "key int, data binary")
    return {r["key"]: np.frombuffer(bytes(r["data"])) for r in merged.collect()}


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


#: A key that at least one row in this many has is joined by broadcast; there are no more such keys than this.
HOT_SHARE = 1000


def join_once(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each ``key`` once and in ``rows`` (dropped) how many rows have
    it. The hottest keys, at most HOT_SHARE of them, are broadcast, so that their rows stay where they are; the
    rest is an ordinary join. ``table`` should be a written one: it is read three times."""
    total = table.agg(F.sum("rows")).first()[0] or 0
    hot = table.where(F.col("rows") * HOT_SHARE >= total).drop("rows")
    cool = table.where(F.col("rows") * HOT_SHARE < total).drop("rows")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key))


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing will read again."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().getName() == "tables":
                path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

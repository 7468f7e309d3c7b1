"""Removal of passages that occur earlier: a count-min sketch first, exact groups for the rest.

A window is WINDOW consecutive words of one document. Its anchor is the smallest hash among the
GRAM-word sequences inside it, so equal windows have equal anchors, and consecutive windows mostly
share one: a run is the longest row of consecutive windows with one anchor.

1. Sketch. Every task counts the distinct anchors of each document in a count-min sketch (see sketch.py);
   the tasks' sketches are merged. An anchor's estimate is never below the number of documents that hold
   it, hence never below the number of documents that hold any of its windows.
2. Exact groups. Only runs whose anchor is estimated to occur in two documents go on. Runs with equal
   words are grouped first (smallest document of each). Where one anchor has several different runs,
   as at the edges of a passage, the windows of one run of each kind are grouped as well. Windows
   that repeat within a document are found there.

Words are the runs of other bytes than x20 and x09 to x0D. Null and empty texts have no words. A null
document id counts as no earlier document, and such a document loses only what it repeats itself. Rows that share an id do not count as earlier than each
other; each keeps its own result. Texts of any length are worked on whole, one at a time if long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcarank.llm import sketch
from lcarank.llm.common import arrow_rows, as_long, chunks, hashed_words, id_and_text, mix, tidy, window_hashes
from lcarank.session import materialize

WINDOW, GRAM = 20, 8
#: Bytes of the table for each cell in a row of the sketch.
SKETCH_SHARE = 4
PIECE = 1 << 20


class Piece:
    """Words of some texts, their windows and runs. Windows are numbered over all texts; ``doc`` is
    the text of a run, ``first`` its first window, ``at`` the word at which a window starts."""

    def __init__(self, texts: list, window: int = WINDOW, gram: int = GRAM):
        self.texts = texts
        hashes, counts = hashed_words(texts)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        n = np.maximum(counts - window + 1, 0)
        self.window_doc = np.repeat(np.arange(len(texts)), n)
        self.window_base = np.concatenate([[0], np.cumsum(n)])
        self.at = np.arange(n.sum()) - self.window_base[self.window_doc] + self.starts[self.window_doc]
        self.hash = window_hashes(hashes, window)[self.at] if len(self.at) else np.empty(0, np.uint64)
        least, span, want = mix(window_hashes(hashes, gram)), 1, window - gram + 1
        while span < want and len(least) > 1:
            step = min(span, want - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        anchor = least[self.at] if len(self.at) else np.empty(0, np.uint64)
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.window_doc[1:] != self.window_doc[:-1])
        self.first = np.flatnonzero(new)
        self.anchor, self.doc = anchor[self.first], self.window_doc[self.first]
        self.length = np.diff(np.append(self.first, len(anchor)))

    def run_keys(self) -> np.ndarray:
        """Hash of the words of each run."""
        if not len(self.first):
            return np.empty(0, np.uint64)
        offset = np.arange(len(self.hash)) - np.repeat(self.first, self.length)
        with np.errstate(over="ignore"):
            return mix(np.add.reduceat(mix(self.hash ^ mix(offset.astype(np.uint64) + np.uint64(1))), self.first))

    def distinct(self, run: int) -> np.ndarray:
        """Offsets in a run of the windows that no earlier window of the run equals."""
        h = self.hash[self.first[run]:self.first[run] + self.length[run]]
        if len(h) <= WINDOW - GRAM + 1:
            return np.arange(len(h))
        return np.sort(np.unique(h, return_index=True)[1])

    def windows_of(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that ``distinct`` leaves of each run, one run after another, and their number."""
        sizes = self.length[runs].copy()
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[runs], sizes)
        if (long := np.flatnonzero(sizes > WINDOW - GRAM + 1)).size:
            parts = np.split(at, np.cumsum(sizes)[:-1])
            for i in long.tolist():
                parts[i] = self.first[runs[i]] + self.distinct(runs[i])
                sizes[i] = len(parts[i])
            at = np.concatenate(parts)
        return self.hash[at], sizes

    def repeats_inside(self) -> np.ndarray:
        """Windows that equal an earlier window of the same text."""
        with np.errstate(over="ignore"):
            order = np.argsort(mix(self.hash + self.window_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
        h, d = self.hash[order], self.window_doc[order]
        again = np.zeros(len(h), bool)
        again[order[1:]] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        return again

    def kept(self, removed: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, bytes]]:
        """(words, words removed, kept words) of each text; ``removed`` flags windows."""
        edge = np.zeros(self.starts[-1] + 1, np.int32)
        at = self.at[removed]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for i, text in enumerate(self.texts):
            mask = gone[self.starts[i]:self.starts[i + 1]]
            n, words = int(mask.sum()), text.split() if text else []
            if n:
                words = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
            yield len(mask), n, b" ".join(words)


def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Distinct anchors of each document."""
    for _, texts in chunks(batches, PIECE):
        p = Piece(texts)
        order = np.lexsort((p.anchor, p.doc))
        a, d = p.anchor[order], p.doc[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        yield a[new]


RUN = "struct<no:int,anchor:long,key:long>"
_RUN = pa.struct([("no", pa.int32()), ("anchor", pa.int64()), ("key", pa.int64())])


def _kept(words: list[bytes], hashed: bool) -> pa.Array:
    """The kept words, or only their SHA-256 in hexadecimal."""
    return pa.array([w if w is None or not hashed else hashlib.sha256(w).hexdigest().encode() for w in words], pa.binary())


def _row_ids(ids: pa.Array, texts: list) -> np.ndarray:
    """A number for each row from its id and text, to find it again in another scan."""
    return np.array([xxhash.xxh3_64_intdigest(t or b"", xxhash.xxh3_64_intdigest(repr(i).encode())) for i, t in zip(ids.to_pylist(), texts, strict=True)], np.uint64)


def _candidates(source: DataFrame, bitmap: np.ndarray, bits: int, hashed: bool) -> DataFrame:
    """Per document: what is left if only its own repeats go, and the runs that may repeat elsewhere."""
    held = source.sparkSession.sparkContext.broadcast(bitmap)

    def run(ids: pa.Array, texts: list) -> dict:
        p = Piece(texts)
        maybe = np.flatnonzero(sketch.maybe_twice(held.value, p.anchor, bits))
        each = np.bincount(p.doc[maybe], minlength=len(texts)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([
            pa.array((maybe - np.searchsorted(p.doc, p.doc[maybe])).astype(np.int32)), as_long(p.anchor[maybe]), as_long(p.run_keys()[maybe])], fields=list(_RUN)))
        done = list(p.kept(p.repeats_inside()))
        return {
            "id": ids, "rid": as_long(_row_ids(ids, texts)), "n_words": pa.array([x[0] for x in done], pa.int64()), "n_removed": pa.array([x[1] for x in done], pa.int64()),
            "kept": _kept([x[2] for x in done], hashed),
            "runs": runs,
        }

    kind = source.schema["id"].dataType.simpleString()
    return arrow_rows(source, run, f"id {kind}, rid long, n_words long, n_removed long, kept binary, runs array<{RUN}>", PIECE)


def _earlier(held: DataFrame, source: DataFrame, bits: int) -> DataFrame:
    """Per row ``rid``: ``gone``, the runs that stand in an earlier document as a whole (``part`` null)
    or in the windows numbered in ``part``."""
    runs = held.where(F.size("runs") > 0).select("rid", "id", F.explode("runs").alias("run")) \
        .select("rid", "id", "run.no", "run.anchor", "run.key")
    kinds = materialize(runs.groupBy("anchor", "key").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    edges = kinds.join(several, "anchor", "left_semi").select("anchor", "key", "first")

    # Windows are needed of one run for each kind of these anchors only: a sketch rules most others out.
    def anchors_of(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)

    bitmap = held.sparkSession.sparkContext.broadcast(sketch.seen_twice(kinds.select("anchor"), anchors_of, bits))

    @tidy
    def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, PIECE):
            p = Piece(texts)
            some = np.flatnonzero(sketch.maybe_twice(bitmap.value, p.anchor, bits))
            windows, sizes = p.windows_of(some)
            ends = np.concatenate([[0], np.cumsum(8 * sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [as_long(p.anchor[some]), as_long(p.run_keys()[some]), ids.take(pa.array(p.doc[some])),
                 pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(windows.astype("<u8").tobytes())])],
                names=["anchor", "key", "first", "windows"])

    kind = held.schema["id"].dataType.simpleString()
    near = source.mapInArrow(at_edges, f"anchor long, key long, first {kind}, windows binary")
    edges = near.join(edges, ["anchor", "key", "first"], "left_semi").dropDuplicates(["anchor", "key"])

    @tidy
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column(3).to_pylist()], np.int64)
            if not sizes.sum():
                continue
            rows = np.repeat(np.arange(len(sizes)), sizes)
            no = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            windows = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8")
            taken = batch.select([0, 1, 2]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(no.astype(np.int32)), as_long(windows)],
                                             names=["anchor", "key", "first", "no", "window"])

    windows = edges.select("anchor", "key", "first", "windows").mapInArrow(
        unpacked, f"anchor long, key long, first {kind}, no int, window long")
    oldest = windows.groupBy("window").agg(F.min("first").alias("oldest"), F.max("first").alias("newest")).where("oldest < newest")
    part = windows.join(oldest.select("window", "oldest"), "window").where("oldest < first") \
        .groupBy("anchor", "key").agg(F.collect_list("no").alias("part"))
    told = kinds.select("anchor", "key", "first", "last").join(part, ["anchor", "key"], "left").where("first < last or part is not null")
    return runs.select("rid", "id", "no", "anchor", "key").join(told, ["anchor", "key"]) \
        .where("id > first or part is not null") \
        .groupBy("rid").agg(F.collect_list(F.struct("no", F.when(F.col("id") > F.col("first"), F.lit(None)).otherwise(F.col("part")).alias("part"))).alias("gone"))


def _again(source: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, rid, text) of the rows that ``gone`` names, and of the few others that its filter lets pass."""
    bits = source.sparkSession.sparkContext.broadcast(sketch.key_filter(gone.select("rid")))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in chunks([batch]):
                rids = _row_ids(ids, texts)
                ok = sketch.passes(bits.value, rids)
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), as_long(rids[ok]), pa.array([t for t, o in zip(texts, ok.tolist(), strict=True) if o], pa.binary())],
                                                 names=["id", "rid", "text"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, rid long, text binary")


def _finish(opened: DataFrame, id_type: str, hashed: bool) -> DataFrame:
    """Documents with runs to remove, from their texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for ids, texts in chunks([batch], PIECE):
                p = Piece(texts)
                removed = p.repeats_inside()
                base = np.searchsorted(p.doc, np.arange(len(texts)))
                for d, gone in enumerate(batch.column(2).slice(row, len(texts)).to_pylist()):
                    for x in gone:
                        r = base[d] + x["no"]
                        if x["part"] is None:
                            removed[p.first[r]:p.first[r] + p.length[r]] = True
                        else:
                            removed[p.first[r] + p.distinct(r)[x["part"]]] = True
                row += len(texts)
                done = list(p.kept(removed))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()),
                     _kept([x[2] for x in done], hashed)], names=["id", "n_words", "n_removed", "kept"])

    return opened.select("id", "text", "gone").mapInArrow(run, f"id {id_type}, n_words long, n_removed long, kept binary")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None,
                   hashed: bool = False) -> DataFrame:
    """Per row of ``df``: id, ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one
    space (with ``hashed``: ``kept_sha256``, so that texts without repeats are not written down).
    ``bits`` sets the sketch's size."""
    source = id_and_text(df, id_col, text_col)
    bits = bits or sketch.bits_for(df, SKETCH_SHARE)
    found = _candidates(source, sketch.seen_twice(source, anchors, bits), bits, hashed)
    held = materialize(found)
    kind = source.schema["id"].dataType.simpleString()
    gone = materialize(_earlier(held, source, bits))
    opened = _again(source, gone).join(gone, "rid")
    closed = held.join(gone.select("rid"), "rid", "left_anti").select("id", "n_words", "n_removed", "kept")
    kept = F.col("kept").cast("string").alias("kept_sha256" if hashed else "kept")
    return closed.unionByName(_finish(opened, kind, hashed)).select(F.col("id").alias(id_col), "n_words", "n_removed", kept)


def digest(df: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return remove_repeats(df, hashed=True)

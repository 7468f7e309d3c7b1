"""Benchmark decontamination: sorted suffixes of every shard of documents, searched by binary search
for every suffix of the test items.

A shard is a piece of a task's documents. Its suffix array holds the word positions at which a test
suffix could start: a position whose first words are not the first words of any test window cannot
begin a match, so leaving it out loses nothing. Suffixes are compared by their first WINDOW words.
For each test suffix the equal range in the array gives all its verbatim occurrences; occurrences at
consecutive places of one item and one document join into the longest match.

The test items are read in blocks of about BLOCK_BYTES of text, so what is broadcast is bounded; each
block searches all documents. With one block nothing is shuffled.

Words are lower-cased (A-Z only) runs of other bytes than x00-x2F, x3A-x60 and x7B-x7F. A window is
WINDOW consecutive words of an item; an item of fewer words, but not none, is one window. Null and
empty texts have no words. Items without words match nothing; rows that repeat an item_id are parts of
one item, a null item_id is written as an empty string. Repeated documents get a result each.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lcarank.llm.common import arrow_rows, chunks, id_and_text, mix, tidy

WINDOW = 10
BLOCK_BYTES = 8 << 20
PIECE = 4 << 20
#: Words that decide whether a position enters a suffix array, and bits of the table that tells.
HEAD, TABLE_BITS = 3, 20
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


class TestItems:
    """One block of test items: numbered words, the distinct windows and the items that hold them."""

    __test__ = False

    def __init__(self, rows: list[tuple], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        where: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
        for item, text in rows:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for j in range(len(ids) - size + 1 if size else 0):
                where[tuple(ids[j:j + size])].append(("" if item is None else str(item), j))
        self.windows = list(where)
        self.places = list(where.values())
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        low, high = np.zeros((len(where), window), ">u4"), np.full((len(where), window), 0xFFFFFFFF, ">u4")
        for i, w in enumerate(self.windows):
            low[i, :len(w)] = high[i, :len(w)] = w
        self.low, self.high = (x.view(f"S{4 * window}").ravel() for x in (low, high))
        self.heads = []
        for size in range(1, HEAD + 1):
            if own := [w[:size] for w in self.windows if min(len(w), HEAD) == size]:
                table = np.zeros(1 << TABLE_BITS, bool)
                table[_head_cells(np.array(own, np.int64).T)] = True
                self.heads.append((size, table))

    @classmethod
    def of(cls, held) -> TestItems:
        """From a broadcast of ``vars()`` of another."""
        self = cls.__new__(cls)
        self.__dict__ = held.value
        return self

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, 0) for w in words), np.int32, len(words))


def _head_cells(words) -> np.ndarray:
    h = np.zeros(len(words[0]), np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64))
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Shard:
    """Sparse suffix array over the numbered words of some documents; a 0 follows each document."""

    def __init__(self, test: TestItems, texts: list):
        self.test = test
        counts, parts, gap = [], [], np.zeros(1, np.int32)
        for t in texts:
            w = words_of(t)
            counts.append(len(w))
            parts += [test.numbers(w), gap]
        self.counts = np.array(counts, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts + 1)])
        self.words = np.concatenate([*parts, np.zeros(test.window, np.int32)])
        n = self.starts[-1]
        near = np.zeros(n, bool)
        for size, table in test.heads:
            at = np.flatnonzero(self.words[:n])
            for k in range(1, size):
                at = at[self.words[at + k] > 0]
            near[at[table[_head_cells([self.words[at + k] for k in range(size)])]]] = True
        at = np.flatnonzero(near)
        keys = self.words[at[:, None] + np.arange(test.window)]
        # What lies beyond a document's end or an unknown word never matches: cut the suffix there.
        keys[np.cumsum(keys == 0, axis=1) > 0] = 0
        keys = keys.astype(">u4").view(f"S{4 * test.window}").ravel()
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = at[order], keys[order]

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(test window, word position) of every verbatim occurrence."""
        lo = np.searchsorted(self.keys, self.test.low, "left")
        hi = np.searchsorted(self.keys, self.test.high, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        return which, self.suffixes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flags of hit words; distinct (document, window) pairs."""
        which, at = self.occurrences()
        edge = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.test.sizes[which], -1)
        doc = np.searchsorted(self.starts, at, "right") - 1
        pairs = np.unique(doc * len(self.test.sizes) + which) if len(at) else np.empty(0, np.int64)
        return np.cumsum(edge) > 0, pairs // max(1, len(self.test.sizes)), pairs % max(1, len(self.test.sizes))

    def matches(self) -> list[list[tuple]]:
        """Per document: (item, item word, document word, words) of the longest matches."""
        which, at = self.occurrences()
        doc = np.searchsorted(self.starts, at, "right") - 1
        found: list[dict] = [defaultdict(list) for _ in self.counts]
        for w, p, d in zip(which.tolist(), at.tolist(), doc.tolist(), strict=True):
            for item, j in self.test.places[w]:
                found[d][item, p - int(self.starts[d]) - j].append((j, len(self.test.windows[w])))
        out: list[list[tuple]] = []
        for by in found:
            rows = []
            for (item, shift), places in by.items():
                places.sort()
                start, end, last = *places[0][:1], sum(places[0]), places[0][0]
                for j, size in places[1:]:
                    if j > last + 1:
                        rows.append((item, start, start + shift, end - start))
                        start = j
                    end, last = j + size, j
                rows.append((item, start, start + shift, end - start))
            out.append(sorted(rows, key=lambda x: (x[2], x[0], x[1])))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[TestItems]:
    source = id_and_text(benchmark, item_col, text_col)
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for b in range(n):
        part = source if n == 1 else source.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        yield TestItems([(r["id"], bytes(r["text"])) for r in part.where("text is not null").collect()], window)


_HIT = "n_words long, hit array<struct<start:int,end:int>>, items array<string>"


def _one_block(source: DataFrame, test: TestItems) -> DataFrame:
    held = source.sparkSession.sparkContext.broadcast(vars(test))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(ids: pa.Array, texts: list) -> dict:
        shard = Shard(TestItems.of(held), texts)
        flags, docs, windows = shard.hits()
        items: list[set] = [set() for _ in texts]
        for d, w in zip(docs.tolist(), windows.tolist(), strict=True):
            items[d].update(item for item, _ in held.value["places"][w])
        hit: list[list] = []
        for i, s in enumerate(shard.starts[:-1].tolist()):
            if not items[i]:
                hit.append([])
                continue
            f = np.flatnonzero(np.diff(np.concatenate([[0], flags[s:s + shard.counts[i]], [0]])))
            hit.append([{"start": a, "end": b} for a, b in f.reshape(-1, 2).tolist()])
        return {"id": ids, "n_words": pa.array(shard.counts, pa.int64()), "hit": pa.array(hit, span),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                "mark": pa.array([hashlib.sha256(t or b"").digest() for t in texts], pa.binary())}

    kind = source.schema["id"].dataType.simpleString()
    return arrow_rows(source, run, f"id {kind}, {_HIT}, mark binary", PIECE)


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``df``: id, ``n_words``, ``hit`` (disjoint intervals of word numbers, the end
    exclusive) and ``items`` (sorted strings)."""
    source = id_and_text(df, id_col, text_col)
    found = [_one_block(source, test) for test in _blocks(benchmark, item_col, item_text_col, window)]
    if len(found) == 1:
        return found[0].drop("mark").withColumnRenamed("id", id_col)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    # Rows alike in id and text have alike results: count them once and give each its own again.
    merged = every.groupBy("id", "mark").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_set("hit")).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count("*") / len(found)).cast("int").alias("copies"))
    return merged.select(F.col("id").alias(id_col), "n_words", _joined("hit").alias("hit"), "items",
                         F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _joined(hits: pd.Series) -> pd.Series:
    """Overlapping intervals of different blocks as one."""

    def one(spans):
        out: list[dict] = []
        for s in sorted(spans, key=lambda x: x["start"]):
            if out and s["start"] <= out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], s["end"])
            else:
                out.append({"start": s["start"], "end": s["end"]})
        return out

    return hits.map(one)


def longest_matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per longest verbatim match: id, ``item``, ``item_word``, ``doc_word``, ``n_words``."""
    source = id_and_text(df, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    found = None
    for test in _blocks(benchmark, item_col, item_text_col, window):
        held = source.sparkSession.sparkContext.broadcast(vars(test))

        @tidy
        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for ids, texts in chunks(batches, PIECE):
                rows = [(i, *m) for i, ms in enumerate(Shard(TestItems.of(held), texts).matches()) for m in ms]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.string()),
                     *(pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3, 4))],
                    names=["id", "item", "item_word", "doc_word", "n_words"])

        part = source.mapInArrow(run, f"id {kind}, item string, item_word int, doc_word int, n_words int")
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("id", id_col)


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``df`` that hold no window of any item, unchanged. One filter per block, no shuffle."""
    for test in _blocks(benchmark, item_col, item_text_col, window):
        held = df.sparkSession.sparkContext.broadcast(vars(test))

        @F.pandas_udf("boolean")
        def clean(texts, held=held):
            at, out = 0, np.ones(len(texts), bool)
            raw = pa.array([None if t is None else bytes(t) for t in texts], pa.binary())
            for ids, some in chunks([pa.RecordBatch.from_arrays([pa.array(np.arange(len(raw))), raw], names=["id", "text"])], PIECE):
                _, docs, _ = Shard(TestItems.of(held), some).hits()
                out[at + docs] = False
                at += len(some)
            return pd.Series(out)

        df = df.where(clean(F.col(f"`{text_col}`").cast("string").cast("binary")))
    return df


def digest(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The registered query's columns, from ``contamination``."""
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return contamination(df, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

"""Near-duplicate classes by SimHash fingerprints, found by meet-in-the-middle ball hashing.

A document's fingerprint has a bit for each bit of its shingles' hashes, set where over half of the
hashes have it set. Two fingerprints link if at most ``radius`` of their bits differ. Every distinct
fingerprint emits all its variants within half the radius (rounded down); for an odd radius those of an
even number of set bits also emit variants with one more flip, all flips in one half of the word. Two
fingerprints at a distance of r = radius differ in parity if r is odd, and one half of the word holds at
least (r + 1) / 2 of their different bits, so every link meets at a common variant.

Variants are the shuffle key. Whoever meets an inner variant (at most half the radius away) is linked with
its owner by the triangle inequality, so per variant the smallest inner owner is linked with all others:
a star in place of pairs. A variant's group holds distinct fingerprints only, so it is bounded by the ball
(2,081 for a radius of 3) however many copies a text has. Outer variants that no inner one equals are left
out before the shuffle by a filter of at most 2 ** FILTER_BITS cells, which loses none. Colliding pairs are
deduplicated and verified by counting their different bits, then contracted to classes.

Words are runs of other bytes than x20 and x09 to x0D, A-Z in lower case. Shingles are 3 consecutive words joined by
single spaces, repeats included, or all words if there are fewer; their hash is XXH64 (UTF-8, seed 42). Texts
without words (null, empty) have fingerprint zero and link like any other. Repeated rows get a result each; a
null id is in its class but names it only if all its ids are null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcarank.llm import sketch
from lcarank.llm.common import arrow_rows, as_long, id_and_text, join_once, mix, tidy, word_spans
from lcarank.llm.jaccard_join import components
from lcarank.session import materialize

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Cells of the filter of inner variants: at most 2 ** FILTER_BITS, CELLS_EACH for each variant below that.
FILTER_BITS, CELLS_EACH, PROBES = 27, 16, 2
#: Texts taken at once; variants made at once.
PIECE, VARIANTS = 1 << 20, 1 << 18

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (  # FIXED VALUES: the primes of XXH64
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_ONES = np.uint64(0x0101010101010101)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of spans of bytes; ``buf`` has 8 more bytes behind the last span. Spans of one length are hashed together."""
    sizes, out = ends - starts, np.empty(len(starts), np.uint64)
    lanes = np.ndarray((len(buf) - 7,), "<u8", buffer=np.ascontiguousarray(buf).data, strides=(1,))
    order = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable")
    cuts = np.searchsorted(sizes[order].clip(max=32), np.arange(34))
    with np.errstate(over="ignore"):
        for n in range(32):
            which = order[cuts[n]:cuts[n + 1]]
            if not len(which):
                continue
            at = starts[which]
            acc = np.full(len(which), np.uint64(seed) + _P5 + np.uint64(n), np.uint64)
            done = 0
            while n - done >= 8:
                acc = _rotl(acc ^ (_rotl(lanes[at + done] * _P2, 31) * _P1), 27) * _P1 + _P4
                done += 8
            if done < n:
                rest = lanes[at + done]
                if n - done >= 4:
                    acc = _rotl(acc ^ ((rest & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
                    rest, done = rest >> np.uint64(32), done + 4
                for _ in range(n - done):
                    acc = _rotl(acc ^ ((rest & np.uint64(0xFF)) * _P5), 11) * _P1
                    rest = rest >> np.uint64(8)
            acc = (acc ^ (acc >> np.uint64(33))) * _P2
            acc = (acc ^ (acc >> np.uint64(29))) * _P3
            out[which] = acc ^ (acc >> np.uint64(32))
    held = memoryview(buf)
    for i in order[cuts[32]:].tolist():
        out[i] = xxhash.xxh64_intdigest(held[starts[i]:ends[i]], seed)
    return out


def fingerprints(texts: list, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text (UTF-8 bytes or None)."""
    buf, starts, ends, counts = word_spans([t and t.lower() for t in texts])
    out = np.zeros(len(texts), np.uint64)
    if not len(starts):
        return out
    # words joined by one space: each word and the byte behind it
    spaced, keep = buf.copy(), np.zeros(len(buf) + 1, np.int8)
    spaced[ends] = 0x20
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends + 1, -1)
    joined = np.concatenate([spaced[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)], np.zeros(8, np.uint8)])
    sizes = ends - starts
    first = np.cumsum(sizes + 1) - sizes - 1
    behind = first + sizes
    n_shingles = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    offset = np.cumsum(counts) - counts
    begin = np.cumsum(n_shingles) - n_shingles
    word = np.arange(n_shingles.sum()) + np.repeat(offset - begin, n_shingles)
    last = np.minimum(word + shingle - 1, np.repeat(offset + counts - 1, n_shingles))
    h = xxh64_spans(joined, first[word], behind[last])
    # bits are counted in bytes, so in stretches of at most 255 shingles of one text
    some = np.flatnonzero(n_shingles)
    parts = -(-n_shingles[some] // 255)
    begins = np.cumsum(parts) - parts
    at = np.repeat(begin[some], parts) + 255 * (np.arange(parts.sum()) - np.repeat(begins, parts))
    set_ = np.empty((8, 8, len(some)), np.int64)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & _ONES, at)
        set_[:, k] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), begins, axis=0).T
    over = (2 * set_.reshape(64, -1) > n_shingles[some]).astype(np.uint64)
    out[some] = (over << np.arange(64, dtype=np.uint64)[:, None]).sum(axis=0, dtype=np.uint64)
    return out


def inner_masks(radius: int) -> np.ndarray:
    """Flips of at most half the radius."""
    return np.array([sum(1 << i for i in c) for n in range(radius // 2 + 1) for c in combinations(range(64), n)], np.uint64)


def outer_masks(radius: int) -> np.ndarray:
    """For an odd radius the flips of one bit more, within a half of the word."""
    n = (radius + 1) // 2
    halves = [range(32), range(32, 64)] if radius % 2 else []
    return np.array([sum(1 << i for i in c) for half in halves for c in combinations(half, n)], np.uint64)


def _cells(variants: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix(variants * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return [(mix(h + np.uint64(i)) >> np.uint64(64 - bits)).astype(np.uint32) for i in range(PROBES)]


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Fingerprints of the batches, as many at once as make VARIANTS variants."""
    step = max(1, VARIANTS // max(1, width))
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield from (fps[i:i + step] for i in range(0, len(fps), step))


def _odd(x: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(x) & 1).astype(bool)


def _inner_filter(nodes: DataFrame, radius: int, bits: int) -> np.ndarray:
    """Bitmap of the cells of the inner variants that an outer one may equal (they have its parity)."""
    masks, odd = inner_masks(radius), bool((radius + 1) // 2 % 2)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _pieces(batches, len(masks)):
            variants = (fps[:, None] ^ masks).ravel()
            yield sketch.packed_cells(np.unique(np.concatenate(_cells(variants[_odd(variants) == odd], bits))), bits)

    return sketch.merged_bitmap(nodes.select("fp").mapInArrow(count, "slice int, cells binary"), bits)


def _variants(nodes: DataFrame, radius: int, bits: int) -> DataFrame:
    """(variant, fp, inner) of every fingerprint; outer variants only where the filter lets them pass."""
    near, far = inner_masks(radius), outer_masks(radius)
    held = nodes.sparkSession.sparkContext.broadcast(_inner_filter(nodes, radius, bits)) if len(far) else None

    def rows(variants: np.ndarray, fps: np.ndarray, inner: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([as_long(variants), as_long(fps), pa.array(np.full(len(fps), inner))], names=["variant", "fp", "inner"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _pieces(batches, len(near) + len(far)):
            yield rows((fps[:, None] ^ near).ravel(), np.repeat(fps, len(near)), True)
            even = fps[~_odd(fps)]
            if held is not None and len(even):
                variants = (even[:, None] ^ far).ravel()
                at = np.arange(len(variants))
                for i in range(PROBES):
                    at = at[sketch.has_bit(held.value, _cells(variants[at], bits)[i])]
                yield rows(variants[at], even[at // len(far)], False)

    return nodes.select("fp").mapInArrow(run, "variant long, fp long, inner boolean")


def links(nodes: DataFrame, radius: int = RADIUS, bits: int | None = None) -> DataFrame:
    """Links (a, b), a < b, of the distinct fingerprints in ``nodes`` (fp long) whose classes are those of all
    pairs at most ``radius`` bits apart: each variant's smallest inner owner with all others there."""
    if not 0 <= radius <= 7:
        raise ValueError(f"radius {radius}: variants are enumerated for 0 to 7 bits")
    if bits is None:
        most = nodes.count() * len(inner_masks(radius)) * CELLS_EACH
        bits = min(FILTER_BITS, max(16, most.bit_length()))
    hub = F.min(F.when(F.col("inner"), F.col("fp"))).over(Window.partitionBy("variant"))
    met = _variants(nodes, radius, bits).withColumn("hub", hub).where("hub != fp")
    pairs = met.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``df``: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links."""
    source = id_and_text(df, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    docs = materialize(arrow_rows(source, lambda ids, texts: {"id": ids, "fp": as_long(fingerprints(texts, shingle))}, f"id {kind}, fp long", PIECE))
    nodes = materialize(docs.groupBy("fp").agg(F.min("id").alias("own"), F.count("*").alias("rows")))
    labels = components(materialize(links(nodes, radius))).withColumnRenamed("node", "fp")
    named = nodes.join(labels, "fp").groupBy("label").agg(F.min("own").alias("component"))
    linked = labels.join(named, "label").select("fp", "component")
    classes = nodes.join(linked, "fp", "left").select("fp", "rows", F.coalesce("component", "own").alias("component"))
    return join_once(docs, materialize(classes), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           F.col("component").alias("component_id"))

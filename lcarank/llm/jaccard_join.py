"""Near-duplicate classes by a size-aware join of shingle sets of at least a given Jaccard similarity.

Two sets of sizes s and t can link only if they share at least c(s, t) shingles.

* Small sets, up to a boundary, are listed under every subset of the sizes c(s, t) that a partner may
  need: two small sets link only if they are listed under a common subset.
* Large sets scan inverted lists. Shingles have one global order, rarest first (a sketch of document
  counts over the whole table, then the hash); a set stands in the lists of its first
  s - ceil(j s) + 1 shingles, and two linked sets meet in one. Small sets that a large one may link
  with stand in these lists as well.
* The boundary is the size at which the rows listed and scanned, summed over the table's sizes, are
  fewest.

Equal sets are one node. In each list all nodes are compared with two hubs: the node with the most
copies and the smallest. Links found so far make classes; a list is taken up again only for pairs in
different classes, so a group of many near copies costs a few comparisons per member. Pairs are
dropped by size and by parity maps (their distance never exceeds that of the sets), the rest
are verified on the whole sets.

Words are runs of other bytes than x20 and x09 to x0D, A-Z in lower case. Shingles are 3 consecutive words
(a parameter, as the similarity j of 90 %), or the whole text if it has fewer; texts without words (null, empty) have an empty set and no
links. Shingles and sets are identified by 64-bit hashes. Repeated rows get a result each; a null
document id is in its class but never names it, unless all ids are null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lcarank.llm import sketch
from lcarank.llm.common import arrow_rows, chunks, discard, hashed_words, id_and_text, join_once, mix, small_batches, tidy, window_hashes
from lcarank.session import materialize

#: Largest boundary considered, and most subsets of one set.
LIGHT_MAX, SUBSETS_MAX = 40, 1000
SLICES, SKETCH_SHARE, MIN_BITS, MAX_BITS = 16, 1024, 16, 24
PIECE = 1 << 20
#: Bits of a set's parity map, and of its folded form inside joins.
MAP_BITS, FOLDED_BITS = 2048, 256
#: Bytes of the table for each cell in a row of the sketch of list keys.
LIST_SHARE = 8
#: Sets of more shingles are compared by counts of their shingles in COUNTED cells before they move as a whole.
LONG, COUNTED = 1000, 4096
#: Filter cells for each row that goes: few others then need a look.
LOOKED_UP_EACH = 64


@dataclass(frozen=True)
class Rule:
    """Words of a shingle; the least similarity of linked sets in percent."""

    shingle: int = 3
    percent: int = 90

    def fits(self, s: int, t: int) -> bool:
        return 100 * min(s, t) >= self.percent * max(s, t)

    def shared_needed(self, s: int, t: int) -> int:
        """Least overlap of linked sets: 100 o >= percent (s + t - o)."""
        return -(-self.percent * (s + t) // (100 + self.percent))

    def prefix_size(self, s: int) -> int:
        return s - -(-self.percent * s // 100) + 1

    def subset_sizes(self, s: int) -> list[int]:
        """Sizes of the subsets that a small set of s is listed under."""
        return sorted({self.shared_needed(s, t) for t in range(1, 100 * s // self.percent + 1) if self.fits(s, t)})

    def subset_count(self, s: int) -> int:
        return sum(comb(s, c) for c in self.subset_sizes(s))

    def boundary(self, sizes: dict[int, int], scanned: float) -> int:
        """The largest size of small sets. ``sizes``: sets by size up to LIGHT_MAX; ``scanned``: rows that
        a probe of an inverted list reads."""
        best, least = 0, None
        for b in range(LIGHT_MAX + 1):
            if b and self.subset_count(b) > SUBSETS_MAX:
                break
            cost = sum(n * (self.subset_count(s) if s <= b else self.prefix_size(s) * (1 + scanned)) for s, n in sizes.items())
            cost += sum(n * self.prefix_size(s) for s, n in sizes.items() if s <= b and self.fits(s, b + 1))
            if least is None or cost < least:
                best, least = b, cost
        return best


def _sets(texts: list, rule: Rule) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = hashed_words([t and t.lower() for t in texts])
    shingles, sets, at = window_hashes(words, rule.shingle, seed=rule.shingle), [], 0
    for n in counts.tolist():
        if n >= rule.shingle:
            sets.append(np.unique(shingles[at:at + n - rule.shingle + 1]))
        else:
            sets.append(window_hashes(words[at:at + n], n, seed=n) if n else np.empty(0, np.uint64))
        at += n
    return sets


def _name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _survey(source: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """Per document ``id``, ``n`` and ``node`` (null: empty set); per task and slice ``counts``, the
    sketch of how many documents hold the shingles of a cell, at most 255 of each task."""
    names = ["id", "n", "node", "slice", "counts"]
    kind = source.schema["id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type = np.zeros(1 << bits, np.uint32), None
        for ids, texts in chunks(batches, PIECE):
            sets, id_type = _sets(texts, rule), ids.type
            counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) if len(s) else None for s in sets], pa.int64()),
                                              pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if id_type is not None:
            packed = [zlib.compress(x.tobytes(), 1) for x in np.minimum(counts, 255).astype(np.uint8).reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, id_type), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()),
                                              pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names=names)

    return source.mapInArrow(run, f"id {kind}, n long, node long, slice int, counts binary")


def _levels(survey: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """Of each cell the bit length of its count (at most 2 ** MAX_BITS bytes); the count that a tenth
    of the cells in use stay below."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(s, np.zeros((1 << bits) // SLICES, np.uint64))
                sums[s] += np.frombuffer(zlib.decompress(packed), np.uint8)
        for s, x in sums.items():
            used = x[x > 0]
            level = np.ceil(np.log2(x + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([level.tobytes()], pa.binary()),
                                              pa.array([float(np.quantile(used, 0.1)) if len(used) else 0.0])], names=["slice", "level", "low"])

    held, low = np.zeros((SLICES, (1 << bits) // SLICES), np.uint8), [0.0]
    merged = survey.where("counts is not null").select("slice", "counts").repartition(SLICES, "slice")
    for r in merged.mapInArrow(run, "slice int, level binary, low double").collect():
        held[r["slice"]] = np.frombuffer(bytes(r["level"]), np.uint8)
        low.append(r["low"])
    return held.ravel(), float(np.mean(low[1:] or low))


def listings(s: np.ndarray, rule: Rule, levels: np.ndarray, bits: int, light: int) -> np.ndarray:
    """The lists that a set stands in."""
    out, n = [], len(s)
    if n <= light:
        with np.errstate(over="ignore"):
            parts = mix(s)
            whole = parts.sum(dtype=np.uint64)
            for c in rule.subset_sizes(n):
                left = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
                out.append(mix((whole - parts[left].sum(axis=1, dtype=np.uint64)) ^ np.uint64(0xA5A5 + c)))
    if n > light or rule.fits(n, light + 1):
        order = np.argsort(levels[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
        out.append(s[order[:rule.prefix_size(n)]])
    return np.concatenate(out)


def parity_map(s: np.ndarray) -> np.ndarray:
    """One bit for each cell of hashes: whether an odd number of shingles falls in it."""
    return np.packbits((np.bincount((s & np.uint64(MAP_BITS - 1)).astype(np.int64), minlength=MAP_BITS) & 1).astype(np.uint8))


def _listed(source: DataFrame, rule: Rule, levels: np.ndarray, bits: int, light: int) -> DataFrame:
    held = source.sparkSession.sparkContext.broadcast(levels)

    def run(ids: pa.Array, texts: list) -> dict:
        sets = _sets(texts, rule)
        maps = np.array([parity_map(s) for s in sets]).reshape(-1, MAP_BITS // 8)
        folded = np.bitwise_xor.reduce(maps.reshape(len(sets), -1, FOLDED_BITS // 8), axis=1).copy().view("<i8")
        return {"id": ids, "node": pa.array([_name(s) if len(s) else None for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()),
                **{f"m{i}": pa.array(folded[:, i], pa.int64()) for i in range(FOLDED_BITS // 64)},
                "map": pa.array([x.tobytes() for x in maps], pa.binary()),
                "lists": pa.array([listings(s, rule, held.value, bits, light).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))}

    kind = source.schema["id"].dataType.simpleString()
    maps = ", ".join(f"m{i} long" for i in range(FOLDED_BITS // 64))
    return arrow_rows(source, run, f"id {kind}, node long, n int, {maps}, map binary, lists array<long>", PIECE)


def _shared_entries(listed: DataFrame, bits: int) -> DataFrame:
    """(node, list) of the lists that the sketch does not rule out to have two entries."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for part in _parts(batch):
                yield part.column("lists").flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                lists = part.column("lists")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ok = sketch.maybe_twice(held.value, flat.view(np.uint64), bits)
                node = np.repeat(part.column("node").to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(node[ok], pa.int64()), pa.array(flat[ok], pa.int64())], names=["node", "list"])

    rows = listed.select("node", "lists")
    held = listed.sparkSession.sparkContext.broadcast(sketch.seen_twice(rows, keys, bits))
    return rows.mapInArrow(run, "node long, list long")


def _parts(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _near(x: str, y: str, rule: Rule) -> Column:
    """Sizes and folded maps of the sides ``x`` and ``y`` allow a link."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.m{i}").bitwiseXOR(F.col(f"{y}.m{i}"))) for i in range(FOLDED_BITS // 64)), F.lit(0))
    return (100 * F.least(n, m) >= rule.percent * F.greatest(n, m)) & (apart <= _may_differ(n, m, rule))


def _may_differ(n: Column, m: Column, rule: Rule) -> Column:
    return n + m - 2 * F.ceil(rule.percent * (n + m) / (100 + rule.percent))


@F.pandas_udf(T.IntegerType())
def _apart(x: pd.Series, y: pd.Series) -> pd.Series:
    """Bits in which two maps differ."""
    if not len(x):
        return pd.Series([], dtype="int32")
    a, b = (np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1) for s in (x, y))
    return pd.Series(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32))


def _details(listed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Size and maps of the ``nodes`` (one column), a row each; a filter keeps most others from moving."""
    bits = listed.sparkSession.sparkContext.broadcast(sketch.key_filter(nodes))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sketch.passes(bits.value, batch.column(0).to_numpy(zero_copy_only=False))))

    folded = [f"m{i}" for i in range(FOLDED_BITS // 64)]
    rows = listed.select("node", "n", *folded, "map")
    return materialize(rows.mapInArrow(run, f"node long, n int, {', '.join(f'{m} long' for m in folded)}, map binary").dropDuplicates(["node"]))


def _sized_up(pairs: DataFrame, details: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of nodes that sizes and parity maps allow: folded maps first, whole ones for those that are left."""
    folded = details.drop("map")
    near = pairs.join(folded.alias("x"), F.col("a") == F.col("x.node")).join(folded.alias("y"), F.col("b") == F.col("y.node")) \
        .where(_near("x", "y", rule)).select("a", "b", _may_differ(F.col("x.n"), F.col("y.n"), rule).alias("most"))
    maps = details.select("node", "map")
    return near.join(maps.alias("x"), F.col("a") == F.col("x.node")).join(maps.alias("y"), F.col("b") == F.col("y.node")) \
        .where(_apart("x.map", "y.map") <= F.col("most")).select("a", "b")


@F.pandas_udf(T.LongType())
def _counts_apart(x: pd.Series, y: pd.Series) -> pd.Series:
    """By how much two count maps differ, summed over the cells: no more than the sets do. -1 without both maps."""
    out = np.full(len(x), -1, np.int64)
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        if a is not None and b is not None:
            out[i] = np.abs(np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8)).sum()
    return pd.Series(out)


def _counted(s: np.ndarray) -> bytes | None:
    """Shingles in each cell of hashes, 255 at most; None for sets whose parity map says as much."""
    if len(s) <= LONG:
        return None
    return np.minimum(np.bincount((s % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED), 255).astype(np.uint8).tobytes()


def _verified(pairs: DataFrame, nodes: DataFrame, source: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs that link, from the whole sets of one document of each node. The documents are
    found in one scan by a filter of hashed ids; a few others may pass it, and drop out when nodes are
    joined. Long sets move only for pairs whose count maps allow a link."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "id"), "node") \
        .select(F.xxhash64("id").alias("key"))
    held = source.sparkSession.sparkContext.broadcast(sketch.key_filter(wanted))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(sketch.passes(held.value, batch.column(0).to_numpy())))
            for _, texts in chunks([some], PIECE):
                sets = _sets(texts, rule)
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                                                  pa.array([_counted(s) for s in sets], pa.binary()),
                                                  pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "n", "counts", "shingles"])

    sets = materialize(source.select(F.xxhash64("id").alias("key"), "text").mapInArrow(run, "node long, n int, counts binary, shingles array<long>"))
    side = lambda c, *names: sets.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in names))
    counted = pairs.join(side("a", "n", "counts"), "a").join(side("b", "n", "counts"), "b") \
        .where(_counts_apart("a_counts", "b_counts") <= _may_differ(F.col("a_n"), F.col("b_n"), rule)).select("a", "b").distinct()
    both = materialize(counted).join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    found = both.where(100 * shared >= rule.percent * (F.size("a_shingles") + F.size("b_shingles") - shared)).select("a", "b").distinct()
    found = materialize(found)
    discard(sets)
    return found


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the same in a component) of the nodes of the links (a, b). Each round every
    node takes the smallest of its neighbours and itself, and links between the taken ones go on."""
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        ways = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        step = materialize(ways.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")))
        maps.append(step)
        edges = materialize(edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
                            .join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
                            .where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps[0].withColumnRenamed("to", "label")
    for step in maps[1:]:
        labels = labels.join(step.select(F.col("node").alias("label"), "to"), "label", "left") \
            .select("node", F.coalesce("to", "label").alias("label"))
    return materialize(labels)


def _classes(source: DataFrame, df: DataFrame, rule: Rule, bits: int | None = None, light: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of the texts in ``source`` (id, text), made from ``df``: (id, n, node) of every row, and (node, rows, component) of
    every set: the rows that have it, and the smallest id reachable by links."""
    bits = bits or min(MAX_BITS, max(MIN_BITS, (sketch.table_bytes(df) // SKETCH_SHARE).bit_length()))
    survey = materialize(_survey(source, rule, bits))
    levels, scanned = _levels(survey, bits)
    docs = survey.where("counts is null").select("id", "n", "node")
    if light is None:
        sizes = {r["n"]: r["count"] for r in docs.where(f"n between 1 and {LIGHT_MAX}").groupBy("n").count().collect()}
        light = rule.boundary(sizes, scanned)

    listed = materialize(_listed(source, rule, levels, bits, light).where("node is not null"))
    nodes = materialize(listed.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("rows")))
    # Per list and node, once: copies = documents with the set.
    members = materialize(_shared_entries(listed, sketch.bits_for(df, LIST_SHARE)).groupBy("list", "node").agg(F.count("*").alias("copies")))
    rank = F.least("copies", F.lit(32767)) * F.lit(1 << 48) + F.col("node").bitwiseAND(F.lit((1 << 48) - 1))
    hubs = members.groupBy("list").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.max_by("node", rank).alias("hub"))
    with_hub = materialize(members.select("list", "node").join(hubs.where("least < most").drop("most"), "list"))
    ordered = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    pairs = with_hub.select(*ordered("node", "hub")).union(with_hub.select(*ordered("node", "least"))).where("a < b").distinct()
    pairs = materialize(pairs)
    discard(members)
    details = _details(listed, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    links = _verified(materialize(_sized_up(pairs, details, rule)), nodes, source, rule)

    # Lists whose other members are in different classes: the pairs across classes.
    labels = components(links)
    rest = with_hub.where("node != hub and node != least").join(labels, "node", "left") \
        .select("list", "node", F.coalesce("label", "node").alias("label"))
    open_ = rest.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("list")
    left = materialize(rest.join(open_, "list", "left_semi").distinct())
    discard(with_hub, details, pairs)
    details = _details(listed, left.select("node"))
    discard(listed)
    left = materialize(left.join(details.drop("map"), "node"))
    across = left.alias("x").join(left.alias("y"), (F.col("x.list") == F.col("y.list")) & (F.col("x.node") < F.col("y.node"))
                                  & (F.col("x.label") != F.col("y.label")) & _near("x", "y", rule)) \
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    across = materialize(_sized_up(across, details, rule))
    discard(left, details)
    if not across.isEmpty():
        more = _verified(across, nodes, source, rule)
        found = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
        between = materialize(more.join(found[0], "a", "left").join(found[1], "b", "left")
                              .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a != b").distinct())
        if not between.isEmpty():  # classes that the new links join, themselves as nodes
            joined = components(between)
            known = labels.unionByName(joined.select("node", F.col("node").alias("label")).join(labels, "node", "left_anti"))
            labels = materialize(known.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
                                 .select("node", F.coalesce("to", "label").alias("label")))

    named = nodes.join(labels, "node").groupBy("label").agg(F.min("id").alias("component"))
    classes = nodes.join(labels.join(named, "label").select("node", "component"), "node", "left") \
        .select("node", "rows", F.coalesce("component", "id").alias("component"))
    return docs, classes


def similarity_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(),  # noqa: B008
                       bits: int | None = None, light: int | None = None) -> DataFrame:
    """Per row of ``df``: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    docs, classes = _classes(id_and_text(df, id_col, text_col), df, rule, bits, light)
    return join_once(docs.where("node is not null"), materialize(classes), "node") \
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")) \
        .union(docs.where("node is null").select("id", "n", "id"))


def one_of_each(df: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, unchanged, of which one of each class stays: that of the smallest id (null last), of
    rows of one id that of the smallest text hash, and of rows alike in both any one. Texts without words are in
    no class and stay. A filter of the rows that go tells which rows need a look; the others do not move."""
    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    own = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text"))
    docs, classes = _classes(small_batches(df).select(own.alias("id"), text.alias("text")), df, rule)
    rows = docs.where("node is not null").groupBy("id", "node").agg(F.count("*").alias("alike")).join(classes.drop("rows"), "node")
    look = materialize(rows.where("id != component or alike > 1").select(F.col("id").alias("own"), (F.col("id") != F.col("component")).alias("goes")))
    held = df.sparkSession.sparkContext.broadcast(sketch.key_filter(look.select(F.xxhash64("own")), LOOKED_UP_EACH))

    @F.pandas_udf(T.BooleanType())
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(sketch.passes(held.value, key.to_numpy(np.int64)))

    names = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.select(F.struct(*names).alias("row"), own.alias("own")).withColumn("maybe", maybe(F.xxhash64("own")))
    looked = keyed.where("maybe").join(look, "own", "left")
    once = looked.where("not goes").dropDuplicates(["own"])
    kept = keyed.where("not maybe").select("row").unionByName(looked.where("goes is null").select("row")).unionByName(once.select("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in df.columns))

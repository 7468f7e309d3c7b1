"""Hard negatives by exact integer scores from a residue-number-system matrix product.

Components become floor(256 x). Scores of a block of anchors against a block of rows come from matrix
products modulo several small primes: residues are symmetric, and the inner dimension is cut so that
every partial sum is a whole number below 2 ** 24, which float32 holds exactly. Symmetric mixed-radix
digits (Chinese remaindering) give back the signed score. As many primes are taken as the blocks' largest
components need.

Anchors are a stated share of the rows. Rows and anchors are packed into blocks of bounded size; every
block of anchors meets every group of row blocks in an equi-join on the group's number. A first pass keeps
each anchor's best rows of its label (positives), a second one, per anchor and positive, the best rows of
other labels within the window of scores. Both keep the best of a group in the task and merge the groups'
few by anchor, so no list of scores leaves a task.

Rows with a null label, a null vector, or any null or non-finite component take no part (also those of which 256 x
exceeds a double). Vectors of different lengths are compared as if zeros followed the shorter one; an empty vector scores 0
with all. A null id is no anchor, its label stays, and it comes last among ties. Repeated rows are rows
of their own: each is an anchor, and a positive of the others. Scores beyond 62 bits are compared exactly;
if one of them is an anchor's best, the job fails with OverflowError. Labels move by (label + 1) % 10 as in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcarank.llm.common import small_batches, tidy
from lcarank.session import materialize

ANCHOR_EVERY, NOISE_EVERY, POSITIVES, NEGATIVES = 100, 7, 5, 10
#: Window of scores, in percent of the positive's.
LOW, HIGH = 30, 90
#: Rows and bytes of a block; row blocks that one group holds at most.
BLOCK_ROWS, ANCHOR_ROWS, BLOCK_BYTES, GROUP_BLOCKS = 4096, 512, 4 << 20, 64
#: Largest score that int64 arithmetic takes; blocks that may pass it are scored in Python integers.
LONG = 1 << 62


def _primes(below: int = 512) -> list[int]:
    """Odd primes, largest first."""
    return [n for n in range(below - 1, 2, -2) if all(n % k for k in range(3, int(n**0.5) + 1, 2))]


def _symmetric(x: np.ndarray, p: int) -> np.ndarray:
    """Residues in -(p - 1) / 2 .. (p - 1) / 2 of whole numbers."""
    r = np.fmod(x, p)
    half = (p - 1) // 2
    r[r > half] -= p
    r[r < -half] += p
    return r


def _product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a b' modulo p from float32 products of residues."""
    step = max(1, (1 << 24) // ((p - 1) // 2) ** 2)
    total = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, a.shape[1], step):
        part = a[:, k:k + step] @ b[:, k:k + step].T
        total = _symmetric(total + _symmetric(part, p), p) if k else _symmetric(part, p)
    return total


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b`` (float64 whole numbers): int64, or Python integers
    where they may pass 64 bits."""
    most = lambda x: int(np.abs(x).max()) if x.size else 0
    bound = a.shape[1] * most(a) * most(b)
    chosen, product = [], 1
    for p in _primes():
        if product > 2 * bound:
            break
        chosen.append(p)
        product *= p
    if product <= 2 * bound:
        raise OverflowError(f"scores up to {bound} need more primes below 512 than there are")
    residues = [_product_mod(*(_symmetric(x, p).astype(np.float32) for x in (a, b)), p) for p in chosen]
    digits: list[np.ndarray] = []  # score = d0 + p0 (d1 + p1 (d2 + ...)), digits symmetric
    for i, (p, r) in enumerate(zip(chosen, residues, strict=True)):
        d = r.astype(np.int32)
        for q, earlier in zip(chosen[:i], digits, strict=True):
            d = (d - earlier) * pow(q, -1, p) % p
        digits.append(np.where(d > (p - 1) // 2, d - p, d) if i else d)
    out = np.zeros((len(a), len(b)), np.int64 if bound < LONG else object)
    for p, d in zip(reversed(chosen), reversed(digits), strict=True):
        out = out * p + d
    return out


def _first(score: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``n`` allowed columns of each row by score descending, then column."""
    if not allowed.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if score.dtype == object or score.shape[1] <= n:
        row, col = np.nonzero(allowed)
    else:
        lowest = np.iinfo(np.int64).min
        held = np.where(allowed, score, lowest)
        edge = np.partition(held, held.shape[1] - n, axis=1)[:, held.shape[1] - n, None]
        row, col = np.nonzero(allowed & (held >= edge))
    if score.dtype == object:
        order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[row[i], col[i]], col[i])), np.int64)
    else:
        order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    begins = np.searchsorted(row, np.arange(score.shape[0]))
    keep = np.arange(len(row)) - begins[row] < n
    return row[keep], col[keep]


def _rows(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vec) of the rows that take part; labels of every NOISE_EVERY-th id move on by one."""
    rows = small_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                     F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(256 * x) < F.lit(float("inf"))))
    moved = F.when(F.col("id") % NOISE_EVERY == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull()).where(fine).select("id", moved.alias("label"), "vec")


#: A block: its number, rows, dimensions and the type of its components; per row and as bytes whether there is an id, the
#: ids, labels, numbers of the rows and components, and the scores of the rows' positives.
_BLOCK = "block long, n int, dim int, kind string, known binary, ids binary, labels binary, uids binary, data binary, positives array<array<long>>"
_FIELDS = [x.split()[0] for x in _BLOCK.split(", ")]


def _block(number: int, known: np.ndarray, ids: np.ndarray, labels: np.ndarray, uids: np.ndarray, data: np.ndarray, positives: list) -> pa.RecordBatch:
    """One block, its rows by id (null last), then number; components in the smallest type that holds them."""
    order = np.lexsort((uids, ids, ~known))
    most = np.abs(data).max() if data.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    fields = known[order], ids[order], labels[order], uids[order], data[order].astype(kind)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([data.shape[1]], pa.int32()), pa.array([kind]),
         *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in fields),
         pa.array([[positives[i] for i in order.tolist()] if positives else []], pa.list_(pa.list_(pa.int64())))], names=_FIELDS)


class _Block:
    """A block read from row ``i`` of a batch whose columns have a prefix."""

    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str = ""):
        get = lambda name: batch.column(batch.schema.get_field_index(prefix + name))[i].as_py()
        self.known = np.frombuffer(get("known"), bool)
        self.ids, self.labels, self.uids = (np.frombuffer(get(x), np.int64) for x in ("ids", "labels", "uids"))
        self.data = np.frombuffer(get("data"), get("kind")).reshape(get("n"), get("dim")).astype(np.float64)
        self.positives = get("positives")


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of at most ``most`` rows and about BLOCK_BYTES. ``rows``: id, label, vec; or, of anchors, also ``uid``
    and ``positives``, vec being whole numbers already."""
    anchors = "uid" in rows.columns
    columns = ["id", "label", "vec", *(["uid", "positives"] if anchors else [])]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                widest = np.maximum.accumulate(batch.column(2).slice(begin, most).value_lengths().to_numpy(zero_copy_only=False))
                rows_fit = int(np.count_nonzero(widest * np.arange(1, len(widest) + 1) * 8 <= BLOCK_BYTES))
                part = batch.slice(begin, max(1, rows_fit))
                begin += part.num_rows
                ids, vectors = part.column(0), part.column(2)
                dims, flat = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
                data = np.zeros((part.num_rows, int(dims.max())))
                data[np.arange(data.shape[1]) < dims[:, None]] = flat if anchors else np.floor(256 * flat)
                uids = part.column(3).to_numpy(zero_copy_only=False) if anchors else number + np.arange(part.num_rows)
                yield _block(number, ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False),
                             part.column(1).to_numpy(zero_copy_only=False), uids, data, part.column(4).to_pylist() if anchors else [])
                number += part.num_rows

    return rows.select(*columns).mapInArrow(run, _BLOCK)


def _anchors(blocks: DataFrame) -> DataFrame:
    """(uid, id, label, vec) of the anchors in the blocks, a row each."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i)
                ok = b.known & (b.ids % ANCHOR_EVERY == 0)
                yield pa.RecordBatch.from_arrays([pa.array(b.uids[ok]), pa.array(b.ids[ok]), pa.array(b.labels[ok]),
                                                  pa.array(list(b.data[ok]), pa.list_(pa.float64()))], names=["uid", "id", "label", "vec"])

    return blocks.mapInArrow(run, "uid long, id long, label long, vec array<double>")


def _positives(a: _Block, r: _Block, s: np.ndarray) -> Iterator[tuple]:
    """(place, row, column) of the best rows of an anchor's label but itself; place is 0."""
    allowed = (a.labels[:, None] == r.labels) & (a.uids[:, None] != r.uids)
    yield from ((0, row, col) for row, col in zip(*_first(s, allowed, POSITIVES), strict=True))


def _negatives(a: _Block, r: _Block, s: np.ndarray) -> Iterator[tuple]:
    """(place of the positive, row, column) of the best rows of other labels in the positive's window."""
    other = a.labels[:, None] != r.labels
    for place in range(POSITIVES):
        p = [x[place] if len(x) > place else None for x in a.positives]
        low = [1 if x is None else max(-LONG, min(LONG, -(-LOW * x // 100))) for x in p]  # 30 p <= 100 s
        high = [0 if x is None else max(-LONG, min(LONG, HIGH * x // 100)) for x in p]  # 100 s <= 90 p
        window = (s >= np.array(low)[:, None]) & (s <= np.array(high)[:, None])
        yield from ((place, row, col) for row, col in zip(*_first(s, other & window, NEGATIVES), strict=True))


def _fits(x: int) -> int:
    if not -LONG <= x <= LONG:
        raise OverflowError(f"score {x} is beyond 62 bits")
    return x


def _best(anchors: DataFrame, blocks: DataFrame, pick: Callable[[_Block, _Block, np.ndarray], Iterator[tuple]], n: int) -> DataFrame:
    """The first ``n`` rows that ``pick`` finds for each anchor (``uid``) and ``place``: score, id, other (the row's
    number), rank. Every block of anchors meets every group of row blocks."""
    n_blocks = blocks.count()
    groups = max(1, min(n_blocks, 2 * blocks.sparkSession.sparkContext.defaultParallelism), -(-n_blocks // GROUP_BLOCKS))
    side = lambda df, p: df.select(*(F.col(c).alias(p + c) for c in _FIELDS))
    dealt = side(blocks, "r_").withColumn("g", F.pmod(F.xxhash64("r_block"), F.lit(groups)))
    every = side(anchors, "a_").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def flush(held: dict) -> pa.RecordBatch:
        rows = [(uid, place, _fits(-s), None if unknown else i, other) for (uid, place), found in held.items() for s, unknown, i, other in found]
        kinds = {"uid": pa.int64(), "place": pa.int32(), "score": pa.int64(), "id": pa.int64(), "other": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a, held = None, None, {}  # the best so far for one block of anchors, while its group's row blocks pass
        for batch in batches:
            for i in range(batch.num_rows):
                this = batch.column(batch.schema.get_field_index("a_block"))[i].as_py()
                if this != now:
                    if held:
                        yield flush(held)
                    now, a, held = this, _Block(batch, i, "a_"), {}
                r = _Block(batch, i, "r_")
                dim = min(a.data.shape[1], r.data.shape[1])
                s, touched = scores(a.data[:, :dim], r.data[:, :dim]), set()
                for place, row, col in pick(a, r, s):
                    key = int(a.uids[row]), place
                    held.setdefault(key, []).append((-int(s[row, col]), not r.known[col], int(r.ids[col]), int(r.uids[col])))
                    touched.add(key)
                for key in touched:
                    held[key] = sorted(held[key])[:n]
        if held:
            yield flush(held)

    met = every.join(dealt, "g").drop("g").mapInArrow(run, "uid long, place int, score long, id long, other long")
    order = Window.partitionBy("uid", "place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "other")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score."""
    blocks = materialize(_packed(_rows(df, id_col, vector_col, label_col), BLOCK_ROWS))
    anchors = materialize(_anchors(blocks))
    positives = materialize(_best(materialize(_packed(_with(anchors, None), ANCHOR_ROWS)), blocks, _positives, POSITIVES)
                            .select("uid", F.col("rank") - 1, "score", "id").toDF("uid", "place", "positive_score", "positive_id"))
    found = positives.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("found"))
    negatives = _best(materialize(_packed(_with(anchors, found), ANCHOR_ROWS)), blocks, _negatives, NEGATIVES)
    return negatives.join(positives, ["uid", "place"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid") \
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _with(anchors: DataFrame, found: DataFrame | None) -> DataFrame:
    """The anchors with their positives' scores, best first; without any left out once positives are known."""
    if found is None:
        return anchors.withColumn("positives", F.array().cast("array<long>"))
    return anchors.join(found, "uid").withColumn("positives", F.transform("found", lambda x: x["positive_score"])).drop("found")

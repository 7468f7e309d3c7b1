"""Phrase collocations from counting quotient filters of packed word ids.

Words that occur at least LEAST times in a language get dense ids, and an n-gram of up to four of them is
packed into one number. An invertible permutation (a Feistel network) spreads these numbers; the
leading bits of the result are the quotient, the rest is the remainder and kept in full, so a filter loses
nothing. A filter holds its entries sorted: the number of entries of each quotient, their
remainders in as many bytes as they need, and a counter of a byte each, larger ones apart. Tasks cut their
filters into sections of quotients, and each section of all shards is merged as sorted runs. Entries that
reach LEAST are unpacked through the inverse permutation; phrases rarer than that are no candidates
and no part of one.

Dictionaries of up to MOST_WORDS words are broadcast (8 bytes each). Beyond that word ids are their 64-bit hashes, of which
the count of all words has shown that no two are alike (else another seed is taken), and nothing is broadcast.

Everything is per language (null: ``und``). Texts are lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those into words ``[^\\x20\\x09]+``; phrases do not cross pieces. Null and empty texts hold no words; repeated rows count
each time; an empty table gives an empty result. Counts are exact up to 9e16. Words are told apart by 64-bit hashes within a
piece of a task's texts when they are first counted, by their strings afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcarank.llm import sketch
from lcarank.llm.common import as_long, chunks, hash_spans, mix, small_batches, tidy
from lcarank.session import materialize

LEAST, LONGEST, KEPT, COVERED = 30, 4, 2000, 80
#: Words of a broadcast dictionary; n-grams that a task holds before it makes a filter of them.
MOST_WORDS, HELD = 1 << 22, 1 << 20
#: Bytes of the table for each section, and the fewest sections (as bits).
SECTION_BYTES, SECTION_BITS = 1 << 20, 6
PIECE = 1 << 20
_HARD, _SOFT = [*b".,;:!?", *range(0x0A, 0x0E)], [0x20, 0x09]
_ENDS_PIECE, _ENDS_WORD = np.zeros(256, bool), np.zeros(256, bool)
_ENDS_PIECE[_HARD] = True
_ENDS_WORD[_HARD + _SOFT] = True


def _words(texts: list) -> tuple[np.ndarray, ...]:
    """Bytes of all texts, starts and ends of their words, the text and the piece that each word is in."""
    parts = [t.lower() if t else b"" for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n" * 9, np.uint8)
    inside = ~_ENDS_WORD[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    text = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, "right")
    return buf, starts, ends, text, np.cumsum(_ENDS_PIECE[buf], dtype=np.int32)[starts]


def _hashed(langs: list, texts: list, seed: int) -> tuple[np.ndarray, ...]:
    """As ``_words``, with the hash of each word in its language."""
    buf, starts, ends, text, piece = _words(texts)
    known = {lang: xxhash.xxh64_intdigest(lang.encode(), seed) for lang in set(langs)}
    of = np.array([known[lang] for lang in langs], np.uint64)
    return buf, starts, ends, text, piece, mix(hash_spans(buf, starts, ends) ^ of[text])


def _counted_words(source: DataFrame, seed: int) -> DataFrame:
    """(lang, word, hash, n) of every word of every language."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in chunks(batches, PIECE):
            langs = langs.to_pylist()
            buf, starts, ends, text, _, h = _hashed(langs, texts, seed)
            distinct, first, n = np.unique(h, return_index=True, return_counts=True)
            held = buf.tobytes()
            words = [held[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in text[first].tolist()], pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                                              as_long(distinct), pa.array(n.astype(np.int64))], names=["lang", "word", "hash", "n"])

    return source.mapInArrow(run, "lang string, word string, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


class Packing:
    """n-grams of word ids as numbers of two limbs of 2 * width bits (ids of up to 32 bits), or of four of 64,
    and their permutation. A number's ``first`` are its leading 64 bits (all if it has fewer), ``rest`` the others."""

    def __init__(self, width: int):
        if not (8 <= width <= 32 or width == 64):
            raise ValueError(f"ids of {width} bits")
        self.width, self.limbs, self.bits = width, 4 if width == 64 else 2, min(64, 2 * width)
        self.first_bits = min(64, self.limbs * self.bits)
        self.rest_bits = [64] * 3 if width == 64 else [max(0, 2 * self.bits - 64)] if 2 * self.bits > 64 else []

    def _turn(self, limbs: list[np.ndarray], i: int, key: int) -> np.ndarray:
        total = np.full(len(limbs[0]), np.uint64(key), np.uint64)
        for j in range(1, self.limbs):
            total = mix(total + limbs[(i + j) % self.limbs] * np.uint64(0x9E3779B97F4A7C15))
        return limbs[i] ^ (total >> np.uint64(64 - self.bits))

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """``ids``: LONGEST arrays, 0 where an n-gram has ended."""
        w = np.uint64(self.width)
        limbs = list(ids) if self.width == 64 else [ids[0] << w | ids[1], ids[2] << w | ids[3]]
        with np.errstate(over="ignore"):
            for turn in range(2 * self.limbs):
                limbs[turn % self.limbs] = self._turn(limbs, turn % self.limbs, turn + 1)
        if self.bits == 64:
            return limbs[0], limbs[1:]
        b = np.uint64(self.bits)
        if not self.rest_bits:
            return limbs[0] << b | limbs[1], []
        low = np.uint64(self.rest_bits[0])
        return limbs[0] << (np.uint64(64) - b) | limbs[1] >> low, [limbs[1] & ((np.uint64(1) << low) - np.uint64(1))]

    def unpack(self, first: np.ndarray, rest: list[np.ndarray]) -> list[np.ndarray]:
        if self.bits == 64:
            limbs = [first, *rest]
        else:
            b, low = np.uint64(self.bits), np.uint64(self.rest_bits[0] if self.rest_bits else 0)
            mask = (np.uint64(1) << b) - np.uint64(1)
            limbs = [first >> (b - low), (first << low | rest[0] if rest else first) & mask]
        with np.errstate(over="ignore"):
            for turn in reversed(range(2 * self.limbs)):
                limbs[turn % self.limbs] = self._turn(limbs, turn % self.limbs, turn + 1)
        if self.width == 64:
            return limbs
        w, mask = np.uint64(self.width), np.uint64((1 << self.width) - 1)
        return [limbs[0] >> w, limbs[0] & mask, limbs[1] >> w, limbs[1] & mask]


class QuotientFilter:
    """Sorted distinct numbers with their counts."""

    def __init__(self, packing: Packing, first: np.ndarray, rest: list[np.ndarray], counts: np.ndarray):
        self.packing, self.first, self.rest, self.counts = packing, first, rest, counts

    @classmethod
    def of(cls, packing: Packing, first: np.ndarray, rest: list[np.ndarray], counts: np.ndarray | None = None) -> QuotientFilter:
        """From numbers in any order; equal ones add up. Sorted runs one after another are merged as such."""
        order = np.argsort(first, kind="stable")
        ordered = first[order]
        alike = ordered[1:] == ordered[:-1]
        others = [r[order] for r in rest]
        if any((r[1:] != r[:-1])[alike].any() for r in others):  # the leading bits do not tell them apart
            order = np.lexsort((*reversed(rest), first))
            ordered, others = first[order], [r[order] for r in rest]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.empty(0, bool)
        for r in others:
            new[1:] |= r[1:] != r[:-1]
        at = np.flatnonzero(new)
        n = np.diff(at, append=len(order)) if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts
        return cls(packing, ordered[at], [r[at] for r in others], n.astype(np.int64))

    def sections(self, bits: int) -> Iterator[tuple]:
        """(section, entries, quotient bits, runs, remainders, counts, more) for every section in use, of 2 ** bits."""
        shift, n = np.uint64(self.packing.first_bits - bits), len(self.first)
        q = min(self.packing.first_bits, max(bits, n.bit_length() - 1))
        left = self.packing.first_bits - q
        cuts = np.searchsorted(self.first >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[s], cuts[s + 1])
            slots = ((self.first[part] >> np.uint64(left)) - (np.uint64(s) << np.uint64(q - bits))).astype(np.int64)
            runs = np.bincount(slots, minlength=1 << (q - bits)).astype("<u4")
            remainders = [_bytes(x, b) for x, b in ((self.first[part] & np.uint64((1 << left) - 1), left), *((r[part], b) for r, b in zip(self.rest, self.packing.rest_bits, strict=True)))]
            counts = self.counts[part]
            yield (s, len(counts), q, zlib.compress(runs.tobytes(), 1), b"".join(remainders),
                   zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1), counts[counts >= 255].astype("<i8").tobytes())

    @classmethod
    def merged(cls, packing: Packing, section: int, bits: int, rows: list[tuple]) -> QuotientFilter:
        """One section of several filters: (entries, quotient bits, runs, remainders, counts, more) of each."""
        firsts, rests, counts = [], [], []
        for n, q, runs, remainders, few, more in rows:
            left, at = packing.first_bits - q, 0
            parts = []
            for b in (left, *packing.rest_bits):
                size = -(-b // 8) * n
                parts.append(_numbers(remainders[at:at + size], n, b))
                at += size
            run = np.frombuffer(zlib.decompress(runs), "<u4")
            quotient = np.repeat(np.arange(len(run), dtype=np.uint64), run) + (np.uint64(section) << np.uint64(q - bits))
            firsts.append((quotient << np.uint64(left) if left < 64 else np.zeros(n, np.uint64)) | parts[0])
            rests.append(parts[1:])
            c = np.frombuffer(zlib.decompress(few), np.uint8).astype(np.int64)
            c[c == 255] = np.frombuffer(more, "<i8")
            counts.append(c)
        return cls.of(packing, np.concatenate(firsts), [np.concatenate(x) for x in zip(*rests, strict=True)], np.concatenate(counts))


def _bytes(x: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)]).tobytes()


def _numbers(data: bytes, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :-(-bits // 8)] = np.frombuffer(data, np.uint8).reshape(n, -1) if n and bits else 0
    return out.view("<u8").ravel()


def _ngrams(ids: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
    """Ids of all n-grams of 2 to LONGEST words within a piece, as LONGEST arrays; words of id 0 are in none."""
    together = (piece[1:] == piece[:-1]) & (ids[1:] != 0) & (ids[:-1] != 0)
    columns: list[list[np.ndarray]] = [[] for _ in range(LONGEST)]
    at = np.flatnonzero(together)
    for n in range(2, LONGEST + 1):
        for k in range(LONGEST):
            columns[k].append(ids[at + k] if k < n else np.zeros(len(at), np.uint64))
        at = at[at + n - 1 < len(together)]
        at = at[together[at + n - 1]]
    return [np.concatenate(c) for c in columns]


_FILTER = "section int, entries int, quotient int, runs binary, remainders binary, counts binary, more binary"


def _frequent(source: DataFrame, seed: int, packing: Packing, dictionary: np.ndarray | None, bits: int, least: int, held_most: int) -> DataFrame:
    """(ids array<long>, f) of the n-grams of 2 to LONGEST words that occur at least ``least`` times."""
    shared = source.sparkSession.sparkContext.broadcast(dictionary)
    kinds = {"section": pa.int32(), "entries": pa.int32(), "quotient": pa.int32(), "runs": pa.binary(), "remainders": pa.binary(), "counts": pa.binary(), "more": pa.binary()}

    def filtered(held: list[tuple[np.ndarray, list[np.ndarray]]]) -> pa.RecordBatch:
        first = np.concatenate([f for f, _ in held])
        rest = [np.concatenate(r) for r in zip(*(r for _, r in held), strict=True)]
        held.clear()
        rows = list(QuotientFilter.of(packing, first, rest).sections(bits))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    @tidy
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, known = [], 0, shared.value
        for langs, texts in chunks(batches, PIECE):
            *_, piece, ids = _hashed(langs.to_pylist(), texts, seed)
            if known is not None:
                at = np.searchsorted(known, ids)
                found = known[np.minimum(at, len(known) - 1)] == ids if len(known) else np.zeros(len(ids), bool)
                ids = np.where(found, at + 1, 0).astype(np.uint64)
            grams = _ngrams(ids, piece)
            for i in range(0, len(grams[0]), held_most):  # a very long text fills several filters
                held.append(packing.pack([g[i:i + held_most] for g in grams]))
                n += len(held[-1][0])
                if n >= held_most:
                    yield filtered(held)
                    n = 0
        if n:
            yield filtered(held)

    def merge(section: pa.Table) -> pa.Table:
        rows = list(zip(*(section.column(c).to_pylist() for c in list(kinds)[1:]), strict=True))
        total = QuotientFilter.merged(packing, section.column("section")[0].as_py(), bits, rows)
        ok = total.counts >= least
        ids = np.stack(packing.unpack(total.first[ok], [r[ok] for r in total.rest]), axis=1)
        n = (ids != 0).sum(axis=1)
        flat = pa.array(ids[ids != 0].view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
        return pa.Table.from_arrays([lists, pa.array(total.counts[ok])], names=["ids", "f"])

    return source.mapInArrow(shards, _FILTER).groupBy("section").applyInArrow(merge, "ids array<long>, f long")


def _dictionary(words: DataFrame, least: int, most_words: int) -> tuple[DataFrame, np.ndarray | None, Packing]:
    """(id, lang, word, n) of the frequent words; their sorted hashes if they are few enough to broadcast."""
    frequent = words.where(F.col("n") >= least)
    if frequent.count() > most_words:
        return frequent.select(F.col("hash").alias("id"), "lang", "word", "n"), None, Packing(64)
    hashes = np.sort(frequent.select("hash").toArrow().column(0).to_numpy().view(np.uint64))
    shared = words.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(shared.value, batch.column(0).to_numpy().view(np.uint64)) + 1
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *batch.columns[1:]], names=["id", "lang", "word", "n"])

    return frequent.select("hash", "lang", "word", "n").mapInArrow(run, "id long, lang string, word string, n long"), hashes, Packing(max(8, len(hashes).bit_length()))


def _candidates(grams: DataFrame, covered: int) -> DataFrame:
    """(ids, a, l, r, score) of the phrases, by their lowest cut, without those that a longer one covers.
    ``grams``: (ids, f) of all frequent phrases and words."""
    phrases = grams.where(F.size("ids") > 1)
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")) \
        .select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.lit(LONGEST)).alias("rest"))
    cut = cuts.join(grams.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(grams.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest") \
        .withColumn("score", F.expr("cast(a as decimal(38, 0)) * 2000000 div cast(l + r as decimal(38, 0))"))
    lowest = cut.groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c")).select("ids", "c.a", "c.l", "c.r", "c.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1),
                                  lambda n: F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda p: F.slice("ids", p, n))))
    within = phrases.where(F.size("ids") > 2).select(F.explode(inner).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    return lowest.join(within, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, kept: int = KEPT, covered: int = COVERED,
                 most_words: int = MOST_WORDS, held: int = HELD) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first ``kept`` phrases."""
    source = small_batches(df).select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    seed = 0
    while True:
        words = materialize(_counted_words(source, seed))
        if words.groupBy("hash").count().where((F.col("count") > 1) | (F.col("hash") == 0)).isEmpty():
            break
        seed += 1  # two words of one hash
    dictionary, hashes, packing = _dictionary(words, least, most_words)
    dictionary = materialize(dictionary)
    bits = max(SECTION_BITS, (sketch.table_bytes(df) // SECTION_BYTES).bit_length())
    grams = materialize(_frequent(source, seed, packing, hashes, min(bits, packing.first_bits - 8), least, held)
                        .unionByName(dictionary.select(F.array("id").alias("ids"), F.col("n").alias("f"))))
    scored = _candidates(grams, covered).join(dictionary.select(F.col("id").alias("head"), "lang"), F.col("ids")[0] == F.col("head")).drop("head")
    # the first by score and count, with all ties, get their words; then the phrase decides
    tied = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    best = materialize(scored.withColumn("rank", F.rank().over(tied)).where(F.col("rank") <= kept).drop("rank"))
    spelled = best.select("ids", F.posexplode("ids").alias("at", "id")).join(dictionary.select("id", "word"), "id") \
        .groupBy("ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.join(spelled, "ids").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= kept)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

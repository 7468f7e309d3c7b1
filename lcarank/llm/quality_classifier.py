"""Quality classifier without labels: heuristic labellers, expectation-maximisation, a hashed scorer.

1. Labellers look at one figure of a text each and vote good (1), bad (-1) or nothing (0). They overlap
   and contradict each other.
2. The votes of all texts are counted by pattern (at most 3 to the number of labellers). EM over the
   patterns estimates, for good and bad texts, how often each labeller casts each vote, and the share of
   good texts, from where most votes agree. This gives every pattern its posterior.
3. A linear scorer over hashed features (words, word endings, letter case and marks) is fitted to the
   posteriors of all texts: a feature's weight is the log ratio of its shares in good and in bad texts (every
   text counts once); a text's score is the mean weight of its features, mapped to 0..1 by the point
   between the classes at which the expected errors are fewest.

A text is kept unless its score is below 0.5 and its votes do not say good, its votes say bad (posterior
under BAD), or the labeller of insults does. All counts cover the whole table and merge by addition.

Null and empty texts vote bad by length, have no features and score 0. Repeated rows get a result each;
texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcarank.llm.common import arrow_rows, chunks, hash_spans, id_and_text, mix, summed_arrays, tidy, window_hashes, word_spans
from lcarank.session import materialize

FEATURE_BITS, SLICES, BAD = 18, 16, 0.2
EM_ROUNDS, PRIOR = 100, 0.3
#: Usual shares of the votes -1, 0, 1 in good and in bad texts.
GOOD_VOTES, BAD_VOTES = (0.01, 0.3, 0.69), (0.25, 0.3, 0.45)
PIECE = 1 << 20
#: Insults that count against a text (two of them or more).
INSULTS = frozenset(b"""idiot idiots moron morons stupid scum trash worthless disgusting pathetic loser losers imbecile vermin
filth dumb jerk creep garbage hideous clown""".split())

LABELLERS = ("length", "symbols", "marked_words", "bare_words", "capitals", "capital_words", "repeats", "distinct_words",
             "doubled_words", "sentences", "rows", "word_length", "insults", "insult_share")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_UPPER, _LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_LETTER = _flags(bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
_STOP, _MARK, _SYMBOL, _ROW = _flags(b".!?"), _flags(b"#*$%&|<>!~^=_"), _flags(b"#*$%&|<>"), _flags(b"|\t")
_EDGE = _flags(b".,;:!?*%$&#|\"'()").astype(bool)


class Texts:
    """Words of some texts as spans of bytes, and sums over words and texts."""

    def __init__(self, texts: list):
        self.n = len(texts)
        self.buf, self.starts, self.ends, self.counts = word_spans(texts)
        self.doc = np.repeat(np.arange(self.n), self.counts)
        low = self.buf.copy()
        low[(low >= 65) & (low <= 90)] += 32
        self.words = hash_spans(low, self.starts, self.ends)  # in lower case
        starts, ends = self.starts.copy(), self.ends.copy()
        left = np.flatnonzero(_EDGE[low[np.maximum(ends - 1, 0)]] | _EDGE[low[starts]])
        changed = left
        for _ in range(4):
            ends[left] -= (ends[left] > starts[left]) & _EDGE[low[np.maximum(ends[left] - 1, 0)]]
            starts[left] += (ends[left] > starts[left]) & _EDGE[low[starts[left]]]
            left = left[(ends[left] > starts[left]) & (_EDGE[low[np.maximum(ends[left] - 1, 0)]] | _EDGE[low[starts[left]]])]
        self.bare = self.words.copy()  # without marks at their ends
        self.bare[changed] = hash_spans(low, starts[changed], ends[changed])

    def in_words(self, *flags: np.ndarray) -> list[np.ndarray]:
        """Flagged bytes of each word, for up to three kinds of bytes in one sum (21 bits for each)."""
        lanes = sum(f.astype(np.uint64) << np.uint64(21 * i) for i, f in enumerate(flags))
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lanes[self.buf])])
        d = c[self.ends] - c[self.starts]
        return [(d >> np.uint64(21 * i) & np.uint64((1 << 21) - 1)).astype(np.int64) for i in range(len(flags))]

    def per_text(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=x, minlength=self.n)

    def repeated(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the number of different hashes, and of hashes that occur twice or more."""
        key = np.sort(doc.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        alone = new & np.append(new[1:], True)[:len(new)]
        own = (key >> np.uint64(40)).astype(np.int64)
        return np.bincount(own[new], minlength=self.n), np.bincount(own[~alone], minlength=self.n)


_INSULT_HASHES = np.sort(hash_spans(*(lambda b, s, e, _: (b, s, e))(*word_spans(sorted(INSULTS)))))


def _is_insult(hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(_INSULT_HASHES, hashes), len(_INSULT_HASHES) - 1)
    return _INSULT_HASHES[at] == hashes


def votes(texts: list) -> np.ndarray:
    """Texts by labellers: 1 good, -1 bad, 0 nothing."""
    return _votes(Texts(texts))


def _votes(t: Texts) -> np.ndarray:
    n = np.maximum(1, t.counts)
    letters, upper, lower = t.in_words(_LETTER, _UPPER, _LOWER)
    symbols, bars = t.in_words(_SYMBOL, _ROW)
    last = t.buf[np.maximum(t.ends - 1, 0)]
    insults = t.per_text(_is_insult(t.bare))
    capitals = t.per_text(upper) / np.maximum(1, t.per_text(upper + lower))
    shout = t.per_text((upper > 1) & (lower == 0)) / n
    marked = t.per_text(_MARK[last]) / n
    empty = t.per_text(letters == 0) / n
    distinct = t.repeated(t.bare, t.doc)[0] / n
    same = np.zeros(len(t.bare), bool)
    same[1:] = (t.bare[1:] == t.bare[:-1]) & (t.doc[1:] == t.doc[:-1])
    doubled = t.per_text(same) / n
    whole = np.flatnonzero(t.doc[:-4] == t.doc[4:]) if len(t.doc) > 4 else np.empty(0, np.int64)
    repeated = t.repeated(window_hashes(t.bare, 5)[whole], t.doc[whole])[1] / n
    stops = t.per_text(_STOP[last]) / n
    rows = t.per_text(bars) / n
    mean = t.per_text(t.ends - t.starts) / n
    signs = t.per_text(symbols) / n
    say = lambda good, bad: np.where(bad, -1, np.where(good, 1, 0))
    nothing = np.zeros(t.n, bool)
    return np.stack([
        say(t.counts >= 50, t.counts < 3),
        say(signs < 0.02, signs > 0.3),
        say(marked < 0.03, marked > 0.25),
        say(nothing, empty > 0.12),
        say(capitals < 0.2, capitals > 0.45),
        say(nothing, shout > 0.25),
        say((repeated < 0.05) & (t.counts >= 20), repeated > 0.2),
        say(nothing, (distinct < 0.25) & (t.counts >= 20) & (t.counts < 2000) | (distinct < 0.1) & (t.counts >= 2000)),
        say(nothing, (doubled > 0.15) & (t.counts >= 10)),
        say((stops > 0.03) & (stops < 0.4), (stops < 0.015) & (t.counts >= 30)),
        say(nothing, rows > 0.08),
        say((mean >= 3) & (mean <= 10), (mean < 2) | (mean > 20)),
        say(nothing, insults >= 2),
        say(nothing, (insults >= 2) & (insults > 0.003 * n)),
    ], axis=1).astype(np.int8)


def fit_labellers(patterns: dict[tuple[int, ...], int]) -> dict:
    """EM over counted vote patterns. ``good`` and ``bad``: labellers by votes (-1, 0, 1); ``share`` of good
    texts; ``posterior`` of every pattern. Labellers are taken to be better than chance: PRIOR of a class's
    texts count as if they had voted as GOOD_VOTES or BAD_VOTES say."""
    keys = np.array(list(patterns), np.int64).reshape(len(patterns), -1)
    weight = np.array(list(patterns.values()), np.float64)
    p = np.where((keys == -1).any(axis=1), 0.1, 0.9)
    for _ in range(EM_ROUNDS):
        share = float(np.clip((weight * p).sum() / weight.sum(), 0.01, 0.99))
        tables = []
        for q, usual in ((p, GOOD_VOTES), (1 - p, BAD_VOTES)):
            t = np.stack([((keys == v) * (weight * q)[:, None]).sum(axis=0) for v in (-1, 0, 1)], axis=1)
            # A labeller that never votes good or bad has no say there.
            usual = np.array(usual) * (np.stack([(keys == v).any(axis=0) for v in (-1, 0, 1)], axis=1) | [[False, True, False]])
            t += (PRIOR * (weight * q).sum() + 1) * usual / usual.sum(axis=1, keepdims=True) + 1e-3
            tables.append(t / t.sum(axis=1, keepdims=True))
        log = np.log(share) - np.log1p(-share) + sum(np.log(tables[0][i, keys[:, i] + 1]) - np.log(tables[1][i, keys[:, i] + 1]) for i in range(keys.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return {"good": tables[0], "bad": tables[1], "share": share, "posterior": {tuple(k): float(x) for k, x in zip(keys.tolist(), p, strict=True)}}


def cells(t: Texts) -> np.ndarray:
    """Hashed features of the words, two of each: the word in lower case, and its last three bytes with
    whether it is in capitals."""
    upper, lower = t.in_words(_UPPER, _LOWER)
    capital = ((upper > 1) & (lower == 0)).astype(np.uint64)
    tail = hash_spans(t.buf, np.maximum(t.starts, t.ends - 3), t.ends) + (capital << np.uint64(1)) + np.uint64(1)
    return (np.concatenate([mix(t.words), mix(tail)]) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _posteriors(v: np.ndarray, model: dict) -> np.ndarray:
    known = model["posterior"]
    return np.array([known.get(tuple(x), model["share"]) for x in v.tolist()])


def fit(df: DataFrame, text_col: str = "text") -> dict:
    """The model, from all texts."""
    source = df.select(F.lit(0).alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    spark = df.sparkSession

    def vote(ids: pa.Array, texts: list) -> dict:
        return {"votes": pa.array(votes(texts).tolist(), pa.list_(pa.int8()))}

    counted = arrow_rows(source, vote, "votes array<tinyint>", PIECE).groupBy("votes").count()
    patterns = {tuple(r["votes"]): r["count"] for r in counted.collect()}
    if not patterns:
        return {"posterior": {}, "share": 0.5, "weights": np.zeros(1 << FEATURE_BITS, np.float32)}
    model = fit_labellers(patterns)
    held = spark.sparkContext.broadcast(model)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((2, 1 << FEATURE_BITS)), False
        for _, texts in chunks(batches, PIECE):
            t = Texts(texts)
            p, each = _posteriors(_votes(t), held.value), 0.5 / np.maximum(1, t.counts)
            c = cells(t)
            for i, q in enumerate((p, 1 - p)):
                own = (q * each)[t.doc]
                sums[i] += np.bincount(c, weights=np.concatenate([own, own]), minlength=1 << FEATURE_BITS)
            seen = True
        if seen:
            parts = sums.astype(np.float32).reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["key", "data"])

    found = summed_arrays(source.mapInArrow(count, "key int, data binary"), SLICES)
    total = np.concatenate([found[i] for i in range(SLICES)]).reshape(2, -1)
    share = (total + 1e-2) / (total.sum(axis=1, keepdims=True) + 1e-2 * total.shape[1])
    model["weights"] = np.clip(np.log(share[0]) - np.log(share[1]), -4, 4).astype(np.float32)
    return model


def _middle(judged: DataFrame) -> float:
    """The raw score between the classes with the fewest expected errors, to a step of 0.02."""
    rows = judged.groupBy(F.round(F.col("raw") / 0.02).cast("int").alias("step")).agg(F.sum("posterior").alias("good"), F.sum(1 - F.col("posterior")).alias("bad")).collect()
    rows = sorted((r["step"], r["good"], r["bad"]) for r in rows)  # at most 401 steps
    if not rows:
        return 0.0
    good, bad = (np.array([r[i] for r in rows]) for i in (1, 2))
    errors = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum(bad[::-1])[::-1], [0]])
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    steps = np.array([rows[0][0] - 1, *(r[0] for r in rows), rows[-1][0] + 1])
    return float((steps[best] + steps[best + 1]).mean() / 2 * 0.02)


def classify(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``votes`` in the order of LABELLERS, ``posterior``, ``score`` and ``kept``."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(ids: pa.Array, texts: list) -> dict:
        t = Texts(texts)
        v, w = _votes(t), held.value["weights"][cells(t)]
        raw = np.bincount(np.concatenate([t.doc, t.doc]), weights=w, minlength=t.n) / np.maximum(1, 2 * t.counts)
        return {"id": ids, "votes": pa.array(v.tolist(), pa.list_(pa.int8())), "posterior": pa.array(_posteriors(v, held.value), pa.float64()),
                "raw": pa.array(raw, pa.float64()), "empty": pa.array(t.counts == 0)}

    source = id_and_text(df, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    judged = materialize(arrow_rows(source, run, f"id {kind}, votes array<tinyint>, posterior double, raw double, empty boolean", PIECE))
    score = F.when(F.col("empty"), 0.0).otherwise(1 / (1 + F.exp(-4 * (F.col("raw") - _middle(judged.where("not empty"))))))
    rude = F.element_at("votes", LABELLERS.index("insults") + 1) == -1
    kept = ~F.col("empty") & ~rude & (F.col("posterior") >= BAD) & ((score >= 0.5) | (F.col("posterior") >= 0.5))
    return judged.select(F.col("id").alias(id_col), "votes", "posterior", score.alias("score"), kept.alias("kept"))


def digest(df: DataFrame) -> DataFrame:
    return classify(df, fit(df))

"""Language of spans of text: scripts narrow the candidates, word scores and a switching penalty pick
the path.

Learning. From a bounded sample of labelled texts (about SAMPLE of each language, by a hash of the id):
how often each language uses each cell of hashed letter sequences (of ORDERS letters, a word's border
counted as a letter), and which share of a language's letters is of which script.

Prediction. A word's score for a language is the mean-free log-likelihood of its letter sequences,
WEIGHT of it; languages that do not write the script of most of its letters (less than SCRIPT_SHARE
of their own) are out. Words without letters are neutral. The path of languages over the words that
maximises the sum of scores, less SWITCH for every change, labels spans (Viterbi). Where no stretch of
words would repay half a change, the best single language is that path, and the search is left out.
A text's language has the most letters in its path; ``score`` is their share.

Documents without an id are not held out and teach like others. Null texts and texts without letters are ``und`` with score 0. Null languages teach nothing. Ties go
to the language that sorts first. With nothing to learn from, every text is ``und``. Texts of any length are
worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lcarank.llm.common import arrow_rows, chunks, hash_spans, id_and_text, mix, summed_arrays, tidy
from lcarank.llm.scripts import SCRIPTS, code_points, script_table

SAMPLE = 4000
ORDERS = (2, 3, 4)
CELL_BITS = 16
WEIGHT, SWITCH, OUT = 0.5, 6.0, -1e4
SCRIPT_SHARE = 0.01
PIECE = 1 << 20


class Words:
    """Words of some texts: white space ends a word; ``letters`` of each, its ``script`` (0: none). Letter sequences are
    made of the ``distinct`` words only (``inverse``: which one each word is): ``cells`` of the sequences that end in
    their letters, and ``cell_word``, the distinct word of each. A word's border counts as a letter, what lies beyond as none."""

    def __init__(self, texts: list):
        lower = [(t or "").lower() for t in texts]
        points = code_points(" ".join(["", *lower, ""]))
        space = (points == 0x20) | (points >= 9) & (points <= 13) | (points == 0xA0) | (points == 0x3000)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])
        self.counts = np.diff(np.searchsorted(starts, at + 1)) if texts else np.empty(0, np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.counts)])
        padded = np.concatenate([points, np.zeros(2, points.dtype)]).view(np.uint8)
        _, first, self.inverse = np.unique(hash_spans(padded, starts * 4, ends * 4), return_index=True, return_inverse=True)
        # the distinct words one after another, each behind a border
        sizes, self.distinct = (ends - starts)[first] + 1, len(first)
        begin = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(first)), sizes)
        within = np.arange(sizes.sum()) - begin[word]
        own_points = points[starts[first][word] - 1 + within]
        script = script_table()[own_points]
        by = np.bincount(word * (len(SCRIPTS) + 1) + script, minlength=len(first) * (len(SCRIPTS) + 1)).reshape(-1, len(SCRIPTS) + 1)[:, 1:]
        self.distinct_scripts, letters = by, by.sum(axis=1)
        self.distinct_script = np.where(letters > 0, by.argmax(axis=1) + 1, 0)
        self.distinct_letters, self.letters = letters, letters[self.inverse]
        # Letters count as themselves, all else as a border.
        sign = np.where(script > 0, own_points, 0).astype(np.uint64)
        last = np.flatnonzero(script)
        self.cell_word, depth = word[last], within[last]
        self.cells = []
        before = [np.where(k <= depth, sign[np.maximum(last - k, 0)], np.uint64(0)) for k in range(max(ORDERS))]
        for n in ORDERS:
            h = np.full(len(last), n, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + before[k]
            self.cells.append((mix(h) >> np.uint64(64 - CELL_BITS)).astype(np.int64))

    def texts(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: languages, log-probabilities of cells, scripts. Bounded by the number of languages."""
    labelled = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")) \
        .where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}
    rate = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, SAMPLE / sizes[lang]))))
    picked = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)
    number = {lang: i for i, lang in enumerate(langs)}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(langs), len(ORDERS) << CELL_BITS), np.float64)
        scripts = np.zeros((len(langs), len(SCRIPTS)), np.float64)
        for batch in batches:
            at, own = 0, [number[x] for x in batch.column(1).to_pylist()]
            for ids, texts in chunks([batch.select([2, 0])], PIECE):
                w = Words(texts)
                lang = np.array(own[at:at + len(texts)], np.int64)[w.texts()]
                at += len(texts)
                for i in set(lang.tolist()):
                    times = np.bincount(w.inverse[lang == i], minlength=w.distinct)
                    for k, c in enumerate(w.cells):
                        cells[i, k << CELL_BITS:(k + 1) << CELL_BITS] += np.bincount(c, weights=times[w.cell_word], minlength=1 << CELL_BITS)
                    scripts[i] += times @ w.distinct_scripts
        for i in range(len(langs)):
            if scripts[i].any():
                data = np.concatenate([cells[i], scripts[i]]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["key", "data"])

    cells = np.zeros((len(langs), len(ORDERS) << CELL_BITS))
    scripts = np.zeros((len(langs), len(SCRIPTS)))
    for i, x in summed_arrays(picked.select("text", "lang", "id").mapInArrow(run, "key int, data binary"), len(langs)).items():
        cells[i], scripts[i] = x[:cells.shape[1]], x[cells.shape[1]:]
    tables = cells.reshape(len(langs), len(ORDERS), -1)
    logs = np.log((tables + 0.1) / (tables.sum(axis=2, keepdims=True) + 0.1 * tables.shape[2]))
    logs -= logs.mean(axis=0)
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    writes = np.concatenate([np.ones((1, len(langs)), bool), (share >= SCRIPT_SHARE).T])
    writes[~writes.any(axis=1)] = True
    return {"langs": langs, "logs": np.ascontiguousarray(logs.transpose(1, 2, 0)).astype(np.float32), "writes": writes}


def word_scores(w: Words, model: dict) -> np.ndarray:
    """Words by languages; each distinct word is scored once."""
    out = np.zeros((w.distinct, len(model["langs"])))
    total = np.zeros((len(w.cell_word), len(model["langs"])), np.float32)
    for table, cells in zip(model["logs"], w.cells, strict=True):
        total += table[cells]
    if len(total):
        first = np.flatnonzero(np.diff(w.cell_word, prepend=-1))
        out[w.cell_word[first]] = np.add.reduceat(total, first, axis=0) * (WEIGHT / len(ORDERS))
    out[~model["writes"][w.distinct_script]] += OUT
    out -= out.max(axis=1, keepdims=True) if out.size else 0
    out[w.distinct_letters == 0] = 0
    return out[w.inverse]


def best_path(scores: np.ndarray) -> np.ndarray:
    """Viterbi over one text: the language of every word."""
    n, k = scores.shape
    back = np.empty((n, k), np.int16)
    value = scores[0].copy()
    for i in range(1, n):
        top = int(value.argmax())
        move = value[top] - SWITCH > value
        back[i] = np.where(move, top, np.arange(k))
        value = np.where(move, value[top] - SWITCH, value) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = int(value.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def best_paths(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, path: np.ndarray) -> None:
    """``best_path`` of several texts (their words from ``starts`` on) at once, written to ``path``: all texts take their
    i-th word together, the longest first."""
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    if not len(starts):
        return
    k, offset = scores.shape[1], np.cumsum(counts) - counts
    back = np.empty((int(counts.sum()), k), np.int16)
    value, own = scores[starts].copy(), np.arange(k, dtype=np.int16)
    longer = np.searchsorted(-counts, -np.arange(int(counts[0])), "left")  # texts of more than i words
    for i in range(1, int(counts[0])):
        a = longer[i]
        v = value[:a]
        top = v.argmax(axis=1)
        best = v[np.arange(a), top] - SWITCH
        move = best[:, None] > v
        back[offset[:a] + i] = np.where(move, top[:, None], own)
        value[:a] = np.where(move, best[:, None], v) + scores[starts[:a] + i]
    now = value.argmax(axis=1)
    for i in range(int(counts[0]) - 1, 0, -1):
        a = longer[i]
        path[starts[:a] + i] = now[:a]
        now[:a] = back[offset[:a] + i, now[:a]]
    path[starts] = now


def _rises(gains: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of every text (its words from ``starts`` on): the largest sum of consecutive gains."""
    run = np.cumsum(gains)
    text = np.zeros(len(gains), np.int64)
    text[starts[1:]] = 1
    text = np.cumsum(text)
    run -= (run[starts] - gains[starts])[text]  # from 0 in every text
    # Lower each text by more than any text ranges over, so that the running minimum starts anew in it.
    lower = text * (run.max() - run.min() + 1.0)
    low = np.minimum.accumulate(run - lower) + lower
    before = np.concatenate([[0.0], low[:-1]])
    before[starts] = 0.0
    return np.maximum.reduceat(run - np.minimum(before, 0.0), starts)


def paths(w: Words, model: dict) -> np.ndarray:
    """The language of every word of all texts."""
    scores, doc = word_scores(w, model), w.texts()
    if not len(doc):
        return np.empty(0, np.int64)
    has = w.counts > 0
    sums = np.zeros((len(w.counts), scores.shape[1]))
    sums[has] = np.add.reduceat(scores, w.base[:-1][has], axis=0)
    single = sums.argmax(axis=1)
    path = single[doc]
    # The most that a stretch of words gains in any other language: the largest rise of the running sum. A path
    # of m switches has m + 1 such stretches at most, so none pays if each gains less than SWITCH / 2.
    own = scores[np.arange(len(doc)), path]
    most = np.zeros(len(w.counts))
    starts = w.base[:-1][has]
    for lang in range(scores.shape[1]):
        most[has] = np.maximum(most[has], np.where(single[has] == lang, 0, _rises(scores[:, lang] - own, starts)))
    worth = most >= SWITCH / 2
    best_paths(scores, w.base[:-1][worth], w.counts[worth], path)
    return path


SPAN = "struct<start:int,end:int,lang:string>"


def label_spans(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``spans`` (words from start to before end, and their language), ``lang`` and ``score``."""
    held = df.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(ids: pa.Array, texts: list) -> dict:
        m = held.value
        w = Words(texts)
        path = paths(w, m) if m["langs"] else np.empty(0, np.int64)
        spans, langs, scores = [], [], []
        for d in range(len(texts)):
            own, letters = path[w.base[d]:w.base[d + 1]], w.letters[w.base[d]:w.base[d + 1]]
            if not m["langs"] or not letters.sum():
                spans.append([])
                langs.append("und")
                scores.append(0.0)
                continue
            cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]).tolist()
            spans.append([{"start": a, "end": b, "lang": m["langs"][own[a]]} for a, b in zip(cut[:-1], cut[1:], strict=True)])
            by = np.bincount(own, weights=letters, minlength=len(m["langs"]))
            langs.append(m["langs"][int(by.argmax())])
            scores.append(float(by.max() / by.sum()))
        return {"id": ids, "spans": pa.array(spans, span), "lang": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}

    source = id_and_text(df, id_col, text_col, binary=False)
    kind = source.schema["id"].dataType.simpleString()
    return arrow_rows(source, run, f"id {kind}, spans array<{SPAN}>, lang string, score double", PIECE).withColumnRenamed("id", id_col)


def digest(df: DataFrame) -> DataFrame:
    """The registered query's columns; documents whose id has remainder 0 teach nothing."""
    model = learn(df.where(~held_out()))
    return label_spans(df, model).select("doc_id", held_out().alias("held_out"), F.col("lang").alias("lang_pred"), "score",
                                         F.size("spans").alias("n_spans"))

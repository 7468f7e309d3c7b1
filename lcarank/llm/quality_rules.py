"""Quality rules: how public tokenizers take a text.

Figures of a text: characters per token (fertility), the share of byte-fallback tokens and the entropy of its
tokens in bits under a vocabulary with byte fallback, and characters per token under a second, multilingual
byte-level one (spread). Their middle and spread (median and median absolute deviation, of figures rounded to
thousandths, so that they do not depend on how rows are dealt out) are taken over the whole table for each
language (the language column) and each half octave of token counts, since entropy grows with length. A text
is rejected if a figure lies BAND spreads from the middle: fertility on either side, byte share above,
entropy below (mixed languages raise it). SPREAD keeps bands from closing where texts are alike. Copies of a
text count once in a language's statistics (by a 64-bit hash of the text) and are judged one by one; near
copies count each.

A language of fewer than LEAST texts, or none (null), is judged by its script, that of most of the text's letters:
the text has to lie within the bands of some language of LEAST texts that is mostly written in it. Where the
script has none, all its texts have a band together; with fewer than LEAST of them there is no evidence, and they stay.

Cells (language and half octave) of fewer than LEAST texts take bands as a function of length.
Neighbouring such cells of a language are put together, from short to long, until they have LEAST
texts. With the full cells they are knots at their median log2 of tokens; between knots the middle
runs straight. Below the first knot entropy runs straight to 0 at one token (it is concave, so the
line lies under clean texts); the other figures stay as they are, and beyond the last knot all
do. The spread is the knot's own, taken about that line, or the larger one of the two knots beside;
for texts shorter than a knot, all but entropy spread with the square root of the ratio of
tokens. Sizes that a language has no text of are filled in the same way.

Base rules: fewer than LEAST_WORDS words, or more than REPEATED percent of the words in 5-word windows
that occur twice or more in the text.

Words are runs of other bytes than x20 and x09 to x0D. Null and empty texts have no words and no
tokens, and fail the base rules. Repeated rows get a result each; rows are never joined, so null ids
do no harm. Long texts are worked on whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lcarank.llm.common import chunks, hashed_words, mix, small_batches, tidy, window_hashes, worker_state
from lcarank.llm.scripts import SCRIPTS, letter_scripts
from lcarank.session import materialize

LEAST_WORDS, REPEATED, REPEAT_WINDOW = 10, 20, 5
BAND, LEAST = 4.5, 30
SPREAD = {"fertility": 0.04, "byte_share": 0.02, "entropy": 0.08, "second_fertility": 0.04}
#: Half octaves of tokens that bands are made for.
SIZES = 64
PIECE = 1 << 20

_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[list(b"#*$%&|<>")] = 1
_WORD_CHAR = np.ones(256, np.int32)
_WORD_CHAR[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = 0


def base_counts(texts: list) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text (UTF-8 bytes)."""
    words, counts = hashed_words(texts)
    data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    ends = np.cumsum([len(t or b"") for t in texts])
    per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[np.concatenate([[0], ends])])
    return {"n_words": counts, "word_chars": per_text(_WORD_CHAR[data]), "n_symbols": per_text(_SYMBOL[data]),
            "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64), "n_repeat_words": repeat_words(words, counts)}


def _dup_lines(text: bytes | None) -> int:
    if not text or b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeat_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    k = REPEAT_WINDOW
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = np.maximum(counts - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), n)
    at = np.arange(n.sum()) - np.concatenate([[0], np.cumsum(n)])[doc] + starts[doc]
    if not len(at):
        return np.zeros(len(counts), np.int64)
    with np.errstate(over="ignore"):
        key = mix(window_hashes(words, k)[at] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    return np.diff(np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])[starts])


class Tokenizer:
    """``model``: a sentencepiece model with byte fallback; ``ranks``: a byte-level vocabulary, a token (base64) and its rank a line."""

    def __init__(self, model: bytes, ranks: bytes, pattern: str):
        self.second = tiktoken.Encoding("second", pat_str=pattern, special_tokens={},
                                        mergeable_ranks={base64.b64decode(x): int(n) for x, n in map(bytes.split, ranks.splitlines())})
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def figures(self, text: str) -> tuple[int, float, float, float, float]:
        """(tokens, characters per token, byte-fallback share, token entropy, characters per token of the second vocabulary)."""
        ids = np.array(self.model.encode(text), np.int64) if text else np.empty(0, np.int64)
        if not len(ids):
            return 0, 0.0, 0.0, 0.0, 0.0
        n = np.unique(ids, return_counts=True)[1] / len(ids)
        return (len(ids), len(text) / len(ids), float(self.is_byte[ids].mean()), float(-(n * np.log2(n)).sum()),
                len(text) / max(1, len(self.second.encode_ordinary(text))))


FIGURES = ("text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
           "fertility double, byte_share double, entropy double, second_fertility double")


def measure(df: DataFrame, model_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
            keep: bool = False) -> DataFrame:
    """Per row: id, ``lang`` (may be null), ``script``, a hash of the text, the base counts and the tokenizers' figures; with
    ``keep`` the row itself as ``row`` instead of the id."""
    with open(model_path, "rb") as f, open(second_path, "rb") as g:
        held = df.sparkSession.sparkContext.broadcast((f.read(), g.read(), public_tokenizers.PATTERN))
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row") if keep else F.col(f"`{id_col}`").alias("row")
    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    source = small_batches(df).select(own, text.alias("text"), lang.alias("lang"), F.xxhash64(text).alias("text_hash"))
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), *T.StructType.fromDDL(f"lang string, script string, {FIGURES}").fields])
    names = ["row", "lang", "script", *(x.split()[0] for x in FIGURES.split(", "))]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_state("fertility tokenizer", lambda: Tokenizer(*held.value))
        for batch in batches:
            at, langs, hashes = 0, batch.column(2), batch.column(3)
            for rows, texts in chunks([batch], PIECE):
                base = base_counts(texts)
                whole = [(t or b"").decode() for t in texts]
                figures = [tokenizer.figures(t) for t in whole]
                lang, text_hash = langs.slice(at, len(texts)), hashes.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows, lang, pa.array([main_script(t) for t in whole], pa.string()), text_hash, *(pa.array(x, pa.int64()) for x in base.values()),
                     *(pa.array([f[i] for f in figures], pa.int64() if i == 0 else pa.float64()) for i in range(5))], names=names)

    return source.mapInArrow(run, schema)


def main_script(text: str) -> str:
    found = np.bincount(letter_scripts(text), minlength=len(SCRIPTS) + 1)[1:]
    return f"script {SCRIPTS[int(found.argmax())]}" if found.any() else "script none"


def bands(figures: DataFrame) -> DataFrame:
    """Per ``band`` and ``size``, over distinct texts: of every figure the middle as a line over log2 n_tokens (``_base``,
    ``_slope``; flat for cells of LEAST texts or more), and its ``_spread``. Bands of fewer than LEAST texts have no rows."""
    once = figures.where("n_tokens > 0").groupBy("band", "text_hash").agg(*(F.first(c).alias(c) for c in ("n_tokens", *SPREAD)))
    sized = materialize(once.select("band", _size().alias("size"), F.round(F.log2("n_tokens"), 3).alias("x"), *(F.round(c, 3).alias(c) for c in SPREAD)))
    cells = sized.groupBy("band", "size").agg(F.count("*").alias("texts"))
    binned = materialize(cells.groupBy("band").applyInPandas(_bins, "band string, size int, bin int, own boolean"))
    in_bins = sized.join(binned.where("bin >= 0"), ["band", "size"])
    # of rounded figures an exact median needs a count for each thousandth only
    middle = in_bins.groupBy("band", "bin").agg(F.median("x").alias("x"), *(F.median(c).alias(c) for c in SPREAD))
    line = ", ".join(f"{c}_base double, {c}_slope double" for c in SPREAD)
    lines = materialize(binned.join(middle, ["band", "bin"], "left").groupBy("band").applyInPandas(
        _lines, f"band string, size int, bin int, own boolean, x double, {line}"))
    off = sized.join(lines.where("bin >= 0").drop("x"), ["band", "size"]) \
        .withColumns({c: F.round(F.abs(F.col(c) - _middle(c, "x")), 3) for c in SPREAD})
    spread = off.groupBy("band", "bin").agg(*((1.4826 * F.median(c)).alias(f"{c}_spread") for c in SPREAD))
    return lines.join(spread, ["band", "bin"], "left").groupBy("band").applyInPandas(
        _spreads, f"band string, size int, {line}, {', '.join(f'{c}_spread double' for c in SPREAD)}")


def _middle(figure: str, x: str) -> Column:
    return F.col(f"{figure}_base") + F.col(f"{figure}_slope") * F.col(x)


def _bins(cells: pd.DataFrame) -> pd.DataFrame:
    """Of one band: the bin of every size (its first size; -1: none), and whether it has LEAST texts by itself."""
    band = cells["band"].iloc[0]
    cells = cells.set_index("size")["texts"].reindex(range(SIZES), fill_value=0).reset_index().assign(band=band)
    own, bin_ = (cells["texts"] >= LEAST).to_numpy(), np.full(len(cells), -1)
    start, held = 0, 0
    for i, (size, texts) in enumerate(zip(cells["size"], cells["texts"], strict=True)):
        if own[i]:
            bin_[i], start, held = size, i + 1, 0
        elif (held := held + texts) >= LEAST:
            bin_[start:i + 1], start, held = cells["size"][start], i + 1, 0
    return pd.DataFrame({"band": cells["band"], "size": cells["size"], "bin": bin_, "own": own})


def _knots(cells: pd.DataFrame) -> pd.DataFrame:
    """Of one band: a row for each bin, by length."""
    return cells[cells["bin"] >= 0].drop_duplicates("bin").sort_values("x")


def _lines(cells: pd.DataFrame) -> pd.DataFrame:
    """Of one band: the middles of every size as lines."""
    cells = cells.sort_values("size").reset_index(drop=True)
    knots = _knots(cells)
    if not len(knots):
        return cells.iloc[:0].reindex(columns=[*_LINE_COLUMNS])
    for c in SPREAD:
        xs, ys = knots["x"].tolist(), knots[c].tolist()
        # Ends: entropy comes from 0 at one token, the others are flat below; all are flat above.
        xs, ys = [0.0, *xs, 64.0], [0.0 if c == "entropy" else ys[0], *ys, ys[-1]]
        base, slope = [], []
        for size, own, y in zip(cells["size"], cells["own"], cells[c], strict=True):
            at = max(1, int(np.searchsorted(xs, _center(size))))
            flat = own or xs[at] <= xs[at - 1]
            slope.append(0.0 if flat else (ys[at] - ys[at - 1]) / (xs[at] - xs[at - 1]))
            base.append(y if own else ys[at] - slope[-1] * xs[at])
        cells[f"{c}_base"], cells[f"{c}_slope"] = base, slope
    return cells[[*_LINE_COLUMNS]]


def _spreads(cells: pd.DataFrame) -> pd.DataFrame:
    """Of one band: the spreads of every size."""
    cells = cells.sort_values("size").reset_index(drop=True)
    knots = _knots(cells)
    for c, least in SPREAD.items():
        xs, spreads, out = knots["x"].tolist(), knots[f"{c}_spread"].tolist(), []
        for size, bin_, own, x, spread in zip(cells["size"], cells["bin"], cells["own"], cells["x"], cells[f"{c}_spread"], strict=True):
            at = int(np.searchsorted(xs, _center(size)))
            near = [(x, spread)] if bin_ >= 0 else list(zip(xs, spreads, strict=True))[max(0, at - 1):at + 1]
            # Sampling noise of a mean over tokens; entropy's line lies low enough for short texts.
            wider = lambda k: 1.0 if own or c == "entropy" else max(1.0, 2 ** ((k - _center(size)) / 2))  # noqa: B023, E731
            out.append(max(least, *(s * wider(k) for k, s in near)))
        cells[f"{c}_spread"] = out
    return cells[["band", "size", *(f"{c}_{x}" for c in SPREAD for x in ("base", "slope")), *(f"{c}_spread" for c in SPREAD)]]


_LINE_COLUMNS = ("band", "size", "bin", "own", "x", *(f"{c}_{x}" for c in SPREAD for x in ("base", "slope")))


def _center(size: int) -> float:
    """log2 of the tokens in the middle of a half octave."""
    return size / 2 + 0.25


def _size() -> Column:
    return F.floor(2 * F.log2("n_tokens")).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def banded(figures: DataFrame) -> DataFrame:
    """``figures`` with ``band``: the language if it has LEAST distinct texts with tokens, else the script."""
    texts = figures.where("n_tokens > 0 and lang is not null").groupBy("lang", "text_hash").agg(F.first("script").alias("script"))
    by_script = texts.groupBy("lang", "script").agg(F.count("*").alias("texts"))
    large = by_script.groupBy("lang").agg(F.max_by("script", F.struct("texts", "script")).alias("written"), F.sum("texts").alias("texts")).where(F.col("texts") >= LEAST)
    # written first: Spark then knows how small it is, broadcasts it, and no text is shuffled
    return figures.join(materialize(large.select("lang", "written")), "lang", "left") \
        .withColumn("band", F.when(F.col("written").isNotNull(), F.concat(F.lit("language "), "lang")).otherwise(F.col("script")))


def judged(figures: DataFrame) -> DataFrame:
    """``figures`` with ``base_failed`` and ``kept``. Bands are a few hundred rows (languages times half
    octaves of length) and meet the figures by an equi-join that Spark plans by their size."""
    with_band = banded(figures)
    limits = materialize(bands(with_band))
    written = with_band.where("written is not null").select("band", "written").distinct()
    limit = F.struct(*(F.col(c) for c in limits.columns if c not in ("band", "size"))).alias("limit")
    by_language = limits.join(written, "band").groupBy(F.col("written").alias("band"), "size").agg(F.collect_list(limit).alias("limits"))
    own = limits.groupBy("band", "size").agg(F.collect_list(limit).alias("own"))
    # a script is judged by its languages where it has any, by its own band else
    choices = materialize(own.join(by_language, ["band", "size"], "full").select("band", "size", F.coalesce("limits", "own").alias("limits")))
    joined = with_band.withColumn("size", _size()).join(choices, ["band", "size"], "left")

    def inside(limit: Column) -> Column:
        ok = F.lit(True)
        for c in SPREAD:
            mid = limit[f"{c}_base"] + limit[f"{c}_slope"] * F.log2("n_tokens")
            far = {"byte_share": F.col(c) - mid, "entropy": mid - F.col(c)}.get(c, F.abs(F.col(c) - mid))
            ok = ok & (far <= BAND * limit[f"{c}_spread"])
        return ok

    fits = F.coalesce(F.exists("limits", inside), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & fits) \
        .select(*figures.columns, "base_failed", "kept")


def keep_good(df: DataFrame, model_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``df`` that pass, unchanged."""
    figures = materialize(measure(df, model_path, second_path, id_col, text_col, lang_col, keep=True))
    return judged(figures).where("kept").select("row.*")


def digest(df: DataFrame, model_path: str, second_path: str) -> DataFrame:
    """The registered query's columns."""
    figures = materialize(measure(df, model_path, second_path))
    return judged(figures).select(F.col("row").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                  "base_failed", "kept", "n_tokens", *SPREAD)

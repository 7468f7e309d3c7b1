"""Collocations against brute force over all phrases; filters against counters."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lcarank.llm import collocations as C
from lcarank.llm import queries

SCHEMA = "doc_id long, text string, lang string, word string, ids string, n int, hash string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _brute(rows, least, kept=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for k, (s, a, p, l, r) in enumerate(sorted(scored)[:kept]):
            out.append((lang, k + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def _rows():
    rng = np.random.default_rng(5)
    phrases = ["new york city", "as well as", "on the other hand", "Ångström unit", "x y", "x y z", "very Very very very very", "日本 語"]

    def prose(n):
        out = []
        for _ in range(n):
            out.append(phrases[int(rng.integers(0, len(phrases)))] if rng.random() < 0.2 else f"w{rng.zipf(1.5) % 60}")
            if rng.random() < 0.12:
                out[-1] += str(rng.choice([".", ",", ";", ":", "!", "?", "\n", "\r\n", "\x0b", "\x0c", " \t"]))
        return " ".join(out)

    rows = [(i, prose(int(rng.integers(1, 120))), ["en", "de", "xx"][i % 3]) for i in range(90)] + [(200 + i, prose(40), None) for i in range(10)]
    rows += [(300, prose(6000), "en"), (301, prose(30), "und"), (302, None, "en"), (303, "", "en"), (304, " .,;\n", None), (305, "lonely", "zz"), (306, "...a..b", ""), (None, "x y", "en")]
    rows += [rows[0]] * 3
    return [(*r, "a", "b", 1, "c") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(4)


def _got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("width", [8, 13, 16, 17, 25, 32, 64])
def test_filter_keeps_every_count(width):
    rng = np.random.default_rng(width)
    packing, total, rows = C.Packing(width), Counter(), []
    for n in (1, 50, 3000):
        ids = [rng.integers(0, min(1 << width, 1 << 63) if k % 2 else 9, n).astype(np.uint64) for k in range(4)]
        ids = [np.concatenate([x, x[:1].repeat(700)]) for x in ids]  # one number far above a byte's count
        total.update(zip(*(x.tolist() for x in ids), strict=True))
        rows += list(C.QuotientFilter.of(packing, *packing.pack(ids)).sections(4))
    got = Counter()
    for s in {r[0] for r in rows}:
        x = C.QuotientFilter.merged(packing, s, 4, [r[1:] for r in rows if r[0] == s])
        assert (np.diff(x.first.astype(object)) >= 0).all()
        for *key, n in zip(*(y.tolist() for y in packing.unpack(x.first, x.rest)), x.counts.tolist(), strict=True):
            got[tuple(key)] += n
    assert got == total


def test_filter_of_numbers_with_equal_leading_bits():
    packing = C.Packing(32)
    first, rest = np.array([7, 7, 7, 1, 7], np.uint64), [np.array([2, 1, 2, 5, 1], np.uint64)]
    x = C.QuotientFilter.of(packing, first, rest)
    assert (x.first.tolist(), x.rest[0].tolist(), x.counts.tolist()) == ([1, 7, 7], [5, 1, 2], [1, 2, 2])


@pytest.mark.parametrize("how", [{}, {"held": 50}, {"most_words": 5}, {"kept": 7}])
def test_collocations(docs, how):
    """Whole filters, filters of 50 n-grams, ids that are hashes, and a short list with ties at its end."""
    want = _brute(_rows(), 4, how.get("kept", 2000))
    assert _got(C.collocations(docs, least=4, **how)) == want and len(want) > 20


def test_every_phrase(docs):
    assert _got(C.collocations(docs, least=1, covered=1000)) != [] and _got(C.collocations(docs, least=2)) == _brute(_rows(), 2)


def test_empty_table_and_query(spark, docs, tmp_path):
    assert C.collocations(docs.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = _got(queries.op12_collocations(spark, str(tmp_path)))
    assert got == _brute(_rows(), 30) and got

"""Hard negatives against brute force with Python integers."""

import math

import numpy as np
import pytest

from lcarank.llm import hard_negatives as H
from lcarank.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, id string, uid string, score int, vec string"


def _brute(rows):
    part = []
    for k, (i, vec, label) in enumerate(rows):
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        part.append((k, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in vec]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731,B905
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for k, i, label, v in part:
        if i is None or i % 100:
            continue
        scored = sorted(((dot(v, w), j, m, other) for m, j, other, w in part if m != k), key=order)
        for p, pi, *_ in [x for x in scored if x[3] == label][:5]:
            found = [x for x in scored if x[3] != label and 30 * p <= 100 * x[0] <= 90 * p][:10]
            out += [(i, pi, n + 1, x[1], p, x[0]) for n, x in enumerate(found)]
    return sorted(map(str, out))


def _rows(n=700, dim=12):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, dim))
    rows = [(i, [float(x) for x in np.float32(centres[i % 4] + 0.6 * rng.normal(size=dim))], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000, [0.5] * dim, 1), (1001, [0.5] * dim, 1), (1002, [0.5] * dim, 2), (1003, [0.4] * dim, 2), (1004, [0.4] * dim, 3)]  # ties
    rows += [(1005, None, 1), (1006, [0.5] * dim, None), (1007, [float("nan")] * dim, 1), (1008, [float("inf"), *[0.5] * (dim - 1)], 1),
             (1009, [None, *[0.5] * (dim - 1)], 1), (1011, [], 1), (1012, [0.5] * 3, 2), (1013, [0.5] * (dim + 4), 1), (1100, [], 1),
             (None, [0.5] * dim, 1), (None, [0.4] * dim, 2), (1000, [0.5] * dim, 1), (1200, [-0.5] * dim, 5), (1300, [0.5] * dim, 9)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 3, "c") for r in rows], SCHEMA).repartition(3)


def _got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_scores_are_exact():
    rng = np.random.default_rng(0)
    for most, dim in ((3, 1), (250, 64), (40_000, 300), (2**40, 70), (2**52, 5)):
        a, b = (np.floor(rng.uniform(-most, most, (7, dim))) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert H.scores(a, b).tolist() == want
    assert H.scores(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2
    extreme = np.full((1, 2000), 255.0)  # every partial sum at its largest
    assert H.scores(extreme, -extreme).tolist() == [[-2000 * 255 * 255]]


def test_hard_negatives(spark):
    rows = _rows()
    want = _brute(rows)
    out = H.hard_negatives(_frame(spark, rows))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(out.dtypes)["rank"] == "int"
    assert _got(out) == want and len(want) > 200


def test_many_blocks(spark, monkeypatch):
    """Blocks of a few rows: each meeting merges with others of its group, and groups merge by anchor."""
    rows = _rows(400)
    monkeypatch.setattr(H, "BLOCK_ROWS", 17)
    monkeypatch.setattr(H, "ANCHOR_ROWS", 2)
    monkeypatch.setattr(H, "GROUP_BLOCKS", 5)
    assert _got(H.hard_negatives(_frame(spark, rows))) == _brute(rows)


def test_large_components(spark):
    """Scores of some pairs pass 64 bits, those returned do not."""
    rows = [(0, [3.0, 0.0, 0.0], 1), (1, [3.0, 1.0, 0.0], 1), (2, [2.0, 0.0, 1e17], 2), (3, [1.5, 1e17, 0.0], 2), (4, [0.0, 1e18, 1e18], 3)]
    assert _got(H.hard_negatives(_frame(spark, rows))) == _brute(rows)


def test_empty_table_and_query(spark, tmp_path):
    assert H.hard_negatives(_frame(spark, _rows(10)).limit(0)).count() == 0
    rows = _rows(150)
    _frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert _got(queries.op11_hard_negatives(spark, str(tmp_path))) == _brute(rows)
